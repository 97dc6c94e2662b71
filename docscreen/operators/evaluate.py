"""Classification metrics from one small (label, prediction) grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X


def confusion_grid(df: DataFrame, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Rows per pair that occurs: the only step that reads the rows."""
    return (df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
            .groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("rows")))


def confusion_matrix(grid: DataFrame) -> DataFrame:
    """Every pair of known classes, zeros included.

    The classes (one row each) become one array, so each class expands to its own row of cells.
    """
    classes = _classes(grid)
    known = classes.agg(F.sort_array(F.collect_list("label"))).scalar()
    cells = classes.withColumn("_all", known).select("label", F.explode("_all").alias("prediction"))
    return (cells.join(grid, ["label", "prediction"], "left")
            .withColumn("rows", F.coalesce("rows", F.lit(0))))


def _classes(grid: DataFrame) -> DataFrame:
    return grid.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()


def class_report(grid: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    def side(name, as_label, as_prediction, hit):
        return F.struct(F.col(name).alias("class"), as_label.alias("t"), as_prediction.alias("p"),
                        hit.alias("hit"))

    rows, none = F.col("rows"), F.lit(0).cast("long")
    correct = F.when(F.col("label") == F.col("prediction"), rows).otherwise(none)
    sides = grid.select(F.inline(F.array(side("label", rows, none, correct),
                                         side("prediction", none, rows, none))))
    per = sides.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"),
                                     F.sum("hit").alias("hits"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return per.select(F.col("class").alias("label"), ratio(hits, predicted).alias("precision"),
                      ratio(hits, support).alias("recall"),
                      ratio(2 * hits, support + predicted).alias("f1"), "support", "hits")


def metrics(grid: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted precision, recall, F1, and the lowest class F1."""
    n = F.sum("support")

    def weighted(name):
        return (F.sum(F.col(name) * F.col("support")) / n).alias(f"weighted_{name}")

    return class_report(grid).agg(
        (F.sum("hits") / n).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[weighted(m) for m in ("precision", "recall", "f1")],
        F.min("f1").alias("minority_f1"))


def top_k(scores, k: int = 3):
    """Names of the ``k`` best entries of ``array<struct<name, score>>``; ties by name."""
    ordered = F.sort_array(F.transform(scores, lambda s: F.struct(
        (-s["score"]).alias("neg"), s["name"].alias("name"))))
    return F.transform(F.slice(ordered, 1, k), lambda s: s["name"])


def topk_accuracy(df: DataFrame, scores, label: str = "label", k: int = 3) -> DataFrame:
    """Share of rows whose label is among the ``k`` best scores (E5)."""
    hit = F.array_contains(top_k(scores, k), F.col(label))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("hits")).withColumn(
        "accuracy", F.col("hits") / F.col("rows"))


def misclassified(df: DataFrame, text: str = "text", label: str = "label",
                  prediction: str = "prediction", row_id: str = "doc_id") -> DataFrame:
    """Wrong rows with a snippet."""
    return (df.filter(F.col(label) != F.col(prediction))
            .select(row_id, label, prediction, X.snippet(F.col(text)).alias("snippet")))


def error_rate(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col(label) != F.col(prediction)).alias("errors"))


def error_words(df: DataFrame, text: str = "text", label: str = "label",
                prediction: str = "prediction", row_id: str = "doc_id",
                words: Sequence[str] = C.ERROR_WATCH_WORDS) -> DataFrame:
    """Wrong rows with a snippet and the watched words of the whole text."""
    found = X.let(F.lower(text), lambda low: F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words])))
    return (df.filter(F.col(label) != F.col(prediction))
            .select(row_id, label, prediction, X.snippet(F.col(text)).alias("snippet"),
                    found.alias("words")))


# -- tables of models (E8, J11, M9, M11) ---------------------------------------

def comparison_table(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Long ``(model, split, metric, value)`` to one row per model."""
    named = rows.select("model", F.concat_ws("_", "split", "metric").alias("name"),
                        F.round("value", digits).alias("value"))
    return named.groupBy("model").pivot("name").agg(F.first("value"))


def select_best(candidates: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """The candidate with the highest criteria, compared in order; ``-name`` prefers low."""
    order = [F.asc(c[1:]) if c.startswith("-") else F.desc(c) for c in criteria]
    return candidates.orderBy(*order).limit(1)
