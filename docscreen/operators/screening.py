"""Skill gaps, screening score and catalogue match."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.functions.skills import find_skills
from docscreen.operators.grouping import broadcast_if_small


# -- requirements (J8, K5) -----------------------------------------------------

def required_skills(role: Column, requirements: Mapping[str, Sequence[str]]) -> Column:
    """Required skills of a role from a dictionary held as one literal map."""
    empty = F.array().cast("array<string>")
    if not requirements:
        return empty
    entries = []
    for name, skills in requirements.items():
        entries += [F.lit(name), F.array(*[F.lit(s) for s in skills]).cast("array<string>")]
    return F.coalesce(F.element_at(F.create_map(*entries), role), empty)


def join_requirements(df: DataFrame, role: str, requirements: DataFrame) -> DataFrame:
    """Same from a table ``(role, skills)`` of any size; broadcast only when measured small."""
    table = broadcast_if_small(requirements.select(F.col("role").alias("_role"),
                                                   F.col("skills").alias("required")))
    return (df.join(table, F.col(role) == F.col("_role"), "left").drop("_role")
            .withColumn("required", F.coalesce("required", F.array().cast("array<string>"))))


def missing_skills(required: Column, detected: Column) -> Column:
    """Required but not detected, in the order of the requirements."""
    return X.let(F.transform(detected, F.lower), lambda found: F.filter(
        required, lambda skill: ~F.array_contains(found, F.lower(skill))))


# -- score (K6) ----------------------------------------------------------------

def score_components(text: Column, required: Column, missing: Column,
                     confidence: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {
        # No confidence and a confidence of zero mean the same: unknown.
        "role_match": F.when(F.coalesce(confidence, F.lit(0.0)) == 0, F.lit(0.5))
        .otherwise(F.least(F.lit(1.0), confidence * C.CONFIDENCE_SCALE)),
        "skills_match": F.when(F.size(required) > 0,
                               F.lit(1.0) - F.size(missing) / F.size(required))
        .otherwise(F.lit(0.5)),
        "experience_match": F.when(X.any_word(low, C.EXPERIENCE_WORDS), F.lit(0.8))
        .otherwise(F.lit(0.4)),
        "education_match": F.when(X.any_word(low, C.EDUCATION_WORDS), F.lit(0.9))
        .otherwise(F.lit(0.3)),
    }


def final_score(components: Mapping[str, Column],
                weights: Mapping[str, float] = C.WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + components[name] * F.lit(weight)
    return total


def screening_breakdown(components: Mapping[str, Column],
                        weights: Mapping[str, float] = C.WEIGHTS) -> Column:
    return F.struct(
        X.percent(final_score(components, weights)).alias("final_score_pct"),
        F.struct(*[F.struct(X.percent(components[n]).alias("score_pct"),
                            F.lit(w).alias("weight")).alias(n)
                   for n, w in weights.items()]).alias("components"))


def screen(df: DataFrame, text: str, role: str, confidence: str,
           vocabulary: Mapping[str, str], requirements: Mapping[str, Sequence[str]] | DataFrame,
           weights: Mapping[str, float] = C.WEIGHTS) -> DataFrame:
    """Add ``detected_skills``, ``missing_common_skills`` and ``screening_breakdown``."""
    if isinstance(requirements, DataFrame):
        df = join_requirements(df, role, requirements)
    else:
        df = df.withColumn("required", required_skills(F.col(role), requirements))
    out = (df.withColumn("detected_skills", find_skills(F.col(text), vocabulary))
           .withColumn("missing_common_skills",
                       missing_skills(F.col("required"), F.col("detected_skills"))))
    parts = score_components(F.col(text), F.col("required"), F.col("missing_common_skills"),
                             F.col(confidence))
    return out.withColumn("screening_breakdown", screening_breakdown(parts, weights)).drop(
        "required")


# -- catalogue (J12, K8) ---------------------------------------------------------

def catalogue_category(role: Column, rules=C.CATALOGUE_RULES,
                       default: str = C.CATALOGUE_DEFAULT) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    out = F.lit(default)
    for name, words in reversed(list(rules)):
        pattern = rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _catalogue_map(catalogue) -> Column:
    entries = []
    for category, rows in catalogue.items():
        entries += [F.lit(category), F.array(*[
            F.struct(F.lit(name).alias("name"),
                     F.array(*[F.lit(f) for f in focus]).alias("focus"))
            for name, focus in rows])]
    return F.create_map(*entries)


def catalogue_match(df: DataFrame, text: str = "text", role: str = "predicted_role",
                    catalogue=None, rules=C.CATALOGUE_RULES,
                    default: str = C.CATALOGUE_DEFAULT) -> DataFrame:
    """One row per document and catalogue entry with matches, reasons and capped score.

    Expects the columns of :func:`screen`.  The catalogue is a literal map, so no join is needed.
    """
    catalogue = C.CATALOGUE if catalogue is None else catalogue
    comps = "screening_breakdown.components"
    entry = F.explode(F.element_at(_catalogue_map(catalogue),
                                   catalogue_category(F.col(role), rules, default)))
    out = (df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
           .withColumn("_skills", F.filter("detected_skills", lambda s: X.strip(s) != ""))
           .withColumn("entry", entry))

    def display(skill: Column) -> Column:
        # The last skill with this spelling supplies the casing.
        return F.element_at(F.filter("_skills", lambda s: F.lower(s) == F.lower(skill)), -1)

    listed = F.filter(F.transform("entry.focus", lambda f: F.when(
        F.exists("_skills", lambda s: F.lower(s) == F.lower(f)), display(f))),
        lambda s: s.isNotNull())
    out = out.withColumn("_listed", listed)
    in_text = F.filter("entry.focus", lambda f: F.contains(F.col("_low"), F.lower(f)) & ~F.exists(
        "_listed", lambda s: F.lower(s) == F.lower(f)))
    filled = F.when(F.size("_listed") < 2, F.slice(F.concat("_listed", in_text), 1, 3)).otherwise(
        F.col("_listed"))
    out = out.withColumn("matches", filled)

    role_low = F.lower(F.coalesce(role, F.lit("")))
    represented = F.exists("matches", lambda s: F.contains(role_low, F.lower(s))
                           | F.contains(F.lower(s), role_low))
    exp, edu = F.col(f"{comps}.experience_match.score_pct"), F.col(
        f"{comps}.education_match.score_pct")
    alignment = F.concat(F.when(F.coalesce(role, F.lit("")) == "", F.lit("Relevant role"))
                         .otherwise(F.col(role)), F.lit(" alignment"))
    signal = (F.when(exp > 0, F.when(exp >= 50, "Relevant experience signal")
                     .otherwise("Experience considered"))
              .when(edu > 0, F.when(edu >= 50, "Education indicator")
                    .otherwise("Education considered")))
    reasons = X.let(F.slice("matches", 1, 3), lambda r: F.when(
        (F.size(r) < 2) & ~represented, F.array_append(r, alignment)).otherwise(r))
    reasons = X.let(reasons, lambda r: F.when(
        (F.size(r) < 3) & signal.isNotNull(), F.array_append(r, signal)).otherwise(r))
    rounded = F.floor(F.col(f"{comps}.role_match.score_pct") * F.lit(0.08) + 0.5)
    score = F.least(F.lit(94), (70 + rounded + F.least(F.size("matches"), F.lit(4)) * 2
                                + F.when(exp >= 50, 3).otherwise(0)
                                + F.when(edu >= 50, 2).otherwise(0)).cast("int"))
    return (out.withColumn("reasons", reasons).withColumn("score", score)
            .withColumn("entry_name", F.col("entry.name"))
            .drop("_low", "_skills", "_listed", "entry"))
