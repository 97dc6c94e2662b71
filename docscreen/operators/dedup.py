"""Repeats, conflicts and keep-first.

Keys are hashed to 16 bytes before anything is shuffled.  Groups are summarised by aggregates
that combine map-side; rows meet the summary again on their unique id, or through
:func:`with_group_stats`, so a text with very many copies never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators.grouping import hash_order, with_group_stats


def first_ids(df: DataFrame, key: Column, row_id: str = "doc_id",
              within: Sequence[str] = ()) -> DataFrame:
    """Lowest id per key (and per value of ``within``)."""
    return (df.select(row_id, X.key_hash(key).alias("_key"), *within)
            .groupBy("_key", *within).agg(F.min(row_id).alias(row_id)).select(row_id))


def mark_repeats(df: DataFrame, key: Column, row_id: str = "doc_id",
                 within: Sequence[str] = ()) -> DataFrame:
    """``is_repeat``: an earlier row has the same key (D1; D8 with ``within``)."""
    firsts = first_ids(df, key, row_id, within).withColumn("_first", F.lit(True))
    return (df.join(firsts, row_id, "left")
            .withColumn("is_repeat", F.col("_first").isNull()).drop("_first"))


def mark_repeated_groups(df: DataFrame, key: Column, row_id: str = "doc_id") -> DataFrame:
    """``in_repeated_group``: the key occurs more than once, first row included."""
    return (with_group_stats(df.withColumn("_key", X.key_hash(key)), ["_key"], row_id,
                             _n=F.count(F.lit(1)))
            .withColumn("in_repeated_group", F.col("_n") > 1).drop("_key", "_n"))


def keep_first(df: DataFrame, key: Column, row_id: str = "doc_id") -> DataFrame:
    """One row per key, the one with the lowest id (D3)."""
    return df.join(first_ids(df, key, row_id), row_id, "left_semi")


def key_groups(df: DataFrame, key: Column, label: str = "label",
               row_id: str = "doc_id") -> DataFrame:
    """Per key: rows, lowest id, distinct labels.  Two combinable steps."""
    pairs = (df.select(row_id, X.key_hash(key).alias("_key"), F.col(label).alias("_label"))
             .groupBy("_key", "_label")
             .agg(F.count(F.lit(1)).alias("_n"), F.min(row_id).alias("_first")))
    return pairs.groupBy("_key").agg(F.sum("_n").alias("rows"), F.min("_first").alias("first_id"),
                                     F.count("_label").alias("labels"))


def label_conflicts(df: DataFrame, key: Column, label: str = "label",
                    row_id: str = "doc_id") -> DataFrame:
    """Keys that carry more than one label."""
    return (key_groups(df, key, label, row_id).filter(F.col("labels") > 1)
            .select("first_id", "rows", "labels"))


def mark_conflicts(df: DataFrame, key: Column, label: str = "label",
                   row_id: str = "doc_id") -> DataFrame:
    """``in_conflict``: another row has the same key and a different label."""
    keyed = df.withColumn("_key", X.key_hash(key))
    return (with_group_stats(keyed, ["_key"], row_id, _low=F.min(label), _high=F.max(label))
            .withColumn("in_conflict", F.coalesce(F.col("_low") != F.col("_high"), F.lit(False)))
            .drop("_key", "_low", "_high"))


def drop_conflicts(df: DataFrame, key: Column, label: str = "label",
                   row_id: str = "doc_id") -> DataFrame:
    """All rows of conflicting groups removed."""
    return mark_conflicts(df, key, label, row_id).filter(~F.col("in_conflict")).drop("in_conflict")


def survivors(df: DataFrame, key: Column, label: str = "label",
              row_id: str = "doc_id") -> DataFrame:
    """``(row_id, label)`` of the first row of every group without a conflict (J3 + D3).

    A single aggregation: a group without a conflict has one label, so no row is looked up.
    """
    return (df.select(row_id, X.key_hash(key).alias("_key"), F.col(label).alias("_label"))
            .groupBy("_key")
            .agg(F.min(row_id).alias(row_id), F.min("_label").alias("_low"),
                 F.max("_label").alias("_high"))
            .filter(F.col("_low") == F.col("_high")).select(row_id, F.col("_low").alias(label)))


def resolve_groups(df: DataFrame, key: Column, label: str = "label",
                   row_id: str = "doc_id") -> DataFrame:
    """Conflicting groups removed and the first row of every other group kept."""
    return df.join(survivors(df, key, label, row_id).select(row_id), row_id, "left_semi")


def duplicate_audit(df: DataFrame, text: str = "text", label: str = "label",
                    row_id: str = "doc_id", full_unicode: bool = True) -> DataFrame:
    """The six duplicate and conflict numbers of a corpus.

    Both keys are computed in one pass; the exact key is finer than the normalised one, so the
    first aggregation serves both.
    """
    base = (df.filter(~X.is_blank(F.col(text)))
            .select(X.key_hash(F.col(text)).alias("_exact"),
                    X.key_hash(X.dedup_key(F.col(text), full_unicode)).alias("_norm"),
                    F.col(label).alias("_label")))
    return duplicate_numbers(base)


def duplicate_numbers(keyed: DataFrame) -> DataFrame:
    """The same from rows of ``_exact``, ``_norm`` and ``_label``."""
    base = (keyed.groupBy("_norm", "_exact")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_label").alias("low"),
                 F.max("_label").alias("high")))
    groups = base.groupBy("_norm").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.col("n") - 1).alias("exact_rows"),
        F.count_if(F.col("n") > 1).alias("exact_groups"))
    conflict = F.col("low") != F.col("high")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return groups.agg(
        total(F.col("exact_rows")).alias("exact_repeat_rows"),
        total(F.col("exact_groups")).alias("exact_repeat_groups"),
        total(F.col("n") - 1).alias("normalised_repeat_rows"),
        F.count_if(F.col("n") > 1).alias("normalised_repeat_groups"),
        F.count_if(conflict).alias("conflicting_groups"),
        total(F.when(conflict, F.col("n"))).alias("rows_in_conflicting_groups"))


def seeded_sample(df: DataFrame, n: int = C.NEAR_DUP_SAMPLE, row_id: str = "doc_id",
                  seed: int = C.SEED) -> DataFrame:
    """``n`` rows in a reproducible random order: a top-k, no shuffle of the table."""
    return (df.withColumn("_hash", hash_order(row_id, seed)).orderBy("_hash", row_id).limit(n)
            .drop("_hash"))
