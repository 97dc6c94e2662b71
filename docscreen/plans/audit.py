"""Corpus audit from raw table to splits and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators import dedup, leakage, profile
from docscreen.operators.grouping import with_group_stats
from docscreen.operators.schema import valid_rows
from docscreen.operators.split import stratified_split
from docscreen.session import cut_lineage


def classify_rows(df: DataFrame, text: str = "text", label: str = "label",
                  row_id: str = "doc_id", full_unicode: bool = True) -> DataFrame:
    """``(row_id, reason)``: why a row leaves the corpus, ``kept`` if it stays.

    The first rule that applies decides, so a row with two faults is counted once.
    """
    blank = X.is_blank(F.col(text)) | X.is_blank(F.col(label))
    key = X.dedup_key(F.col(text), full_unicode)
    # Written once: the groups, the rows that meet them and the blank rows would each normalise all texts.
    narrow = cut_lineage(df.select(row_id, X.strip(F.col(label)).alias("_label"), blank.alias("_blank"),
                                   X.key_hash(key).alias("_key")))
    # A blank row must not shape the groups of the others.
    marked = narrow.filter(~F.col("_blank"))
    stats = with_group_stats(marked, ["_key"], row_id, _first=F.min(row_id), _low=F.min("_label"),
                             _high=F.max("_label"))
    reason = (F.when(F.col("_low") != F.col("_high"), "conflicting labels")
              .when(F.col(row_id) != F.col("_first"), "repeat").otherwise("kept"))
    return (stats.select(row_id, reason.alias("reason")).unionByName(
        narrow.filter("_blank").select(row_id, F.lit("missing or empty").alias("reason"))))


def filter_ledger(df: DataFrame, text: str = "text", label: str = "label",
                  row_id: str = "doc_id", full_unicode: bool = True) -> DataFrame:
    """Rows per reason (A16), from the group sizes alone."""
    blank = X.is_blank(F.col(text)) | X.is_blank(F.col(label))
    key = X.key_hash(X.dedup_key(F.col(text), full_unicode))
    return _ledger(df.select(blank.alias("_blank"), F.when(~blank, key).alias("_key"),
                             X.strip(F.col(label)).alias("_label")))


def _ledger(keyed: DataFrame) -> DataFrame:
    """From rows of ``_blank``, ``_key`` (null for blank rows) and ``_label``."""
    groups = (keyed.groupBy("_blank", "_key")
              .agg(F.count(F.lit(1)).alias("n"), F.min("_label").alias("low"),
                   F.max("_label").alias("high")))
    n, conflict = F.col("n"), F.col("low") != F.col("high")
    shares = F.when(F.col("_blank"), F.array(_part("missing or empty", n))).when(
        conflict, F.array(_part("conflicting labels", n))).otherwise(
        F.array(_part("kept", F.lit(1)), _part("repeat", n - 1)))
    return (groups.select(F.inline(shares)).groupBy("reason").agg(F.sum("rows").alias("rows"))
            .filter(F.col("rows") > 0))


def _part(reason: str, rows) -> Column:
    return F.struct(F.lit(reason).alias("reason"), rows.cast("long").alias("rows"))


def clean_corpus(df: DataFrame, text: str = "text", label: str = "label", row_id: str = "doc_id",
                 full_unicode: bool = True) -> DataFrame:
    """Valid rows, conflicting groups removed, first row of each group kept."""
    return dedup.resolve_groups(valid_rows(df, text, label),
                                X.dedup_key(F.col(text), full_unicode), label, row_id)


def audited_splits(df: DataFrame, text: str = "text", label: str = "label",
                   row_id: str = "doc_id", holdouts=C.HOLDOUTS_70_15_15,
                   full_unicode: bool = True) -> DataFrame:
    """Filter, resolve conflicts, keep first, split: the corpus ready for training.

    The texts are normalised in one pass.  Everything up to the split runs on the written table
    of surviving ids and labels; the texts are met once, by id.
    """
    valid = valid_rows(df, text, label)
    kept = cut_lineage(dedup.survivors(valid, X.dedup_key(F.col(text), full_unicode), label,
                                       row_id))
    parts = stratified_split(kept, label, row_id, holdouts).select(row_id, "split")
    return valid.join(parts, row_id)


def audit_report(df: DataFrame, splits: DataFrame, text: str = "text", label: str = "label",
                 row_id: str = "doc_id", full_unicode: bool = True) -> DataFrame:
    """The whole audit as one nested row.

    Two passes over texts, one of the corpus and one of its splits: each is reduced once to ids,
    labels, key hashes and flags, and all numbers come from these narrow tables.
    """
    def packed(part: DataFrame) -> DataFrame:
        return part.select(F.struct(*part.columns))

    def as_map(part: DataFrame, key, value: str) -> DataFrame:
        return part.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))))

    def counts(part: DataFrame, key: str) -> DataFrame:
        return as_map(part.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n")

    own = X.strip(F.col(label))
    narrow = cut_lineage(
        df.withColumn("_norm", X.dedup_key(F.col(text), full_unicode))
        .select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(text).isNull().alias("no_text"),
                X.is_blank(F.col(text)).alias("blank"), X.key_hash(F.col(text)).alias("_exact"),
                X.key_hash(F.col("_norm")).alias("_norm"),
                leakage.label_marker(F.col(text), own).alias("marker"),
                F.coalesce(F.endswith(F.concat(F.lit(" "), F.col("_norm")), F.concat(
                    F.lit(" "), X.dedup_key(own, full_unicode))), F.lit(False)).alias("suffix")))
    no_label = X.is_blank(F.col("label"))
    missing = narrow.agg(
        F.count_if("no_text").alias("missing_text"), F.count_if(~F.col("no_text") & F.col("blank")).alias("empty_text"),
        F.count_if(F.col("label").isNull()).alias("missing_label"),
        F.count_if(F.col("label").isNotNull() & no_label).alias("empty_label"))
    out = F.col("blank") | no_label
    kept = cut_lineage(splits.select(
        F.col(label).alias("label"), "split", (F.length(text) < C.SHORT_CHARS).alias("short"),
        X.key_hash(X.dedup_key(F.col(text), full_unicode)).alias("key")))
    return profile.one_row(
        df.sparkSession,
        total_rows=narrow.agg(F.count(F.lit(1))),
        class_distribution=counts(narrow.filter("label is not null"), "label"),
        missing=packed(missing),
        duplicates=packed(dedup.duplicate_numbers(narrow.filter(~F.col("blank")).select(
            "_exact", "_norm", F.col("label").alias("_label")))),
        label_in_text=packed(leakage.suffix_numbers(narrow.filter(~out), "id")),
        filtering=as_map(_ledger(narrow.select(out.alias("_blank"), F.when(~out, F.col("_norm")).alias("_key"),
                                               X.strip(F.col("label")).alias("_label"))), "reason", "rows"),
        kept=packed(kept.agg(F.count(F.lit(1)).alias("rows"), F.count_if("short").alias("short"))),
        class_distribution_after=counts(kept, "label"),
        split_counts=counts(kept, "split"),
        overlap=_shared_keys(kept),
    ).select(
        "total_rows", F.size("class_distribution").cast("long").alias("classes"),
        "class_distribution", "missing", "duplicates", "label_in_text",
        F.col("kept.short").alias("short_rows"), "filtering",
        F.col("kept.rows").alias("rows_after_filtering"), "class_distribution_after",
        "split_counts", "overlap",
        F.when(F.col("overlap") > 0, "FAILED").otherwise("CLEAN").alias("status"))


def _shared_keys(kept: DataFrame) -> DataFrame:
    """Number of normalised texts present in more than one split."""
    return (kept.groupBy("key").agg(F.min("split").alias("a"), F.max("split").alias("b"))
            .agg(F.count_if(F.col("a") != F.col("b"))))
