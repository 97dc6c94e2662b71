"""Scoring documents: input status, prediction, skills and screening score (K1, K2, K7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators.screening import screen
from docscreen.plans.train import ScreeningModel


def input_status(text: Column, cleaned: Column, min_tokens: int = C.MIN_TOKENS) -> Column:
    """``ok``, or why a text cannot be scored."""
    return (F.when(X.is_blank(text), "insufficient text").when(cleaned == "", "no usable text")
            .when(X.word_count(cleaned) < min_tokens, "too short").otherwise("ok"))


def score_documents(df: DataFrame, model: ScreeningModel, text: str = "text",
                    min_tokens: int = C.MIN_TOKENS) -> DataFrame:
    """Every row with ``status``; prediction columns are null unless the status is ``ok``.

    All rows go through one row-local plan, so nothing is split, joined or shuffled.
    """
    cleaned = df.withColumn("_clean", X.clean_text(F.col(text)))
    status = input_status(F.col(text), F.col("_clean"), min_tokens)
    scored = model.predict_cleaned(cleaned.withColumn("status", status), "_clean").drop("_clean")
    added = ("prediction", "confidence", "top_predictions", "top_labels")
    ok = F.col("status") == "ok"
    return scored.withColumns({c: F.when(ok, F.col(c)) for c in added})


def probability_map(model: ScreeningModel, scores: str = "scores", digits: int = 4) -> Column:
    """``map<label, probability>`` of a score column, null for margins."""
    if not model.classifier.probabilistic:
        return F.lit(None).cast("map<string,double>")
    names = F.array(*[F.lit(x) for x in model.classifier.labels])
    return F.map_from_arrays(names, F.transform(scores, lambda p: F.round(p, digits)))


def analyze(df: DataFrame, model: ScreeningModel, vocabulary: Mapping[str, str],
            requirements: Mapping[str, Sequence[str]] | DataFrame, text: str = "text",
            role_aliases: Mapping[str, str] | None = None,
            weights: Mapping[str, float] = C.WEIGHTS, min_tokens: int = 1) -> DataFrame:
    """Prediction plus skills, missing skills and screening score on the raw text.

    ``role_aliases`` translates model classes to the names used by the requirements.
    """
    scored = score_documents(df, model, text, min_tokens).withColumnRenamed(
        "prediction", "predicted_role")
    role = F.col("predicted_role")
    if role_aliases:
        pairs = [F.lit(x) for kv in role_aliases.items() for x in kv]
        role = F.coalesce(F.element_at(F.create_map(*pairs), role), role)
    out = screen(scored.withColumn("_role", role), text, "_role", "confidence", vocabulary,
                 requirements, weights)
    ok = F.col("status") == "ok"
    added = ("detected_skills", "missing_common_skills", "screening_breakdown")
    return out.drop("_role").withColumns({c: F.when(ok, F.col(c)) for c in added})
