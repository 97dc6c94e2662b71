"""Leak-free stratified splits and folds.

Class sizes are met exactly (largest remainder), membership follows the hash of the id, so a
split does not depend on partitioning or run.  Assigning a split needs only each class's cut-off
hash: texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators.grouping import broadcast_if_small, exact_rank, hash_order, rank_cutoffs
from docscreen.operators.profile import class_counts
from docscreen.session import cut_lineage

Holdouts = Sequence[tuple[str, float]]


def split_quotas(counts: DataFrame, label: str, holdouts: Holdouts) -> DataFrame:
    """Rows per class for every holdout, one after the other, and for ``train``.

    Each stage holds out ``ceil(fraction * rest)`` rows.  The rows that stay are shared among the
    classes in proportion, fractions going to the largest remainders (ties by label).  One row
    per class takes part here.
    """
    all_classes = Window.partitionBy(F.lit(0))
    out = counts.withColumn("_left", F.col("rows"))
    for name, fraction in holdouts:
        total = F.sum("_left").over(all_classes)
        keep = total - F.ceil(F.round(F.lit(fraction) * total, 9))
        out = (out.withColumn("_share", F.col("_left") * keep / total)
               .withColumn("_keep", keep).withColumn("_floor", F.floor("_share")))
        order = all_classes.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), label)
        spare = F.col("_keep") - F.sum("_floor").over(all_classes)
        stays = F.col("_floor") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)
        out = (out.withColumn("_stays", stays.cast("long"))
               .withColumn(f"n_{name}", F.col("_left") - F.col("_stays"))
               .withColumn("_left", F.col("_stays")).drop("_stays", "_share", "_keep", "_floor"))
    return out.withColumnRenamed("_left", "n_train")


def stratified_split(df: DataFrame, label: str = "label", row_id: str = "doc_id",
                     holdouts: Holdouts = C.HOLDOUTS_70_15_15, seed: int = C.SEED) -> DataFrame:
    """``df`` plus ``split``: train first in hash order, then the holdouts from last to first."""
    names = ["train"] + [name for name, _ in reversed(holdouts)]
    quotas = split_quotas(class_counts(df, label), label, holdouts)
    # Cumulative ranks at which one split ends; the last split needs no limit.
    ends, running = [], F.lit(0)
    for name in names[:-1]:
        running = running + F.col(f"n_{name}")
        ends.append(F.struct(F.lit(name).alias("name"), running.alias("wanted")))
    wanted = quotas.select(label, F.inline(F.array(*ends)))
    cuts = (rank_cutoffs(df, label, row_id, wanted, seed).groupBy(label)
            .agg(*[F.max(F.when(F.col("name") == n, F.struct("cut_hash", "cut_id"))).alias(f"_{n}")
                   for n in names[:-1]]))
    at = F.struct(hash_order(row_id, seed).alias("cut_hash"), F.col(row_id).alias("cut_id"))
    # A split without rows in this class has no cut-off of its own: then nothing is below it.
    choice = F.lit(None).cast("string")
    for name in names[:-1]:
        choice = F.coalesce(choice, F.when(at <= F.col(f"_{name}"), F.lit(name)))
    choice = F.coalesce(choice, F.when(F.col(label).isNotNull(), F.lit(names[-1])))
    return (df.join(broadcast_if_small(cut_lineage(cuts)), label, "left")
            .withColumn("split", choice).select(*df.columns, "split"))


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", row_id: str = "doc_id",
                     seed: int = C.SEED) -> DataFrame:
    """``(label, row_id, fold)`` with fold sizes per class within one row.

    Rows without a label keep a null fold, as they keep a null split in ``stratified_split``.
    """
    known = F.col(label).isNotNull()
    ranked = exact_rank(df.filter(known), label, row_id, seed)
    folds = ranked.select(label, row_id, ((F.col("rank") - 1) % k).cast("int").alias("fold"))
    return folds.unionByName(df.filter(~known).select(label, row_id, F.lit(None).cast("int").alias("fold")))


def members(df: DataFrame, ids: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Rows whose id is in an id list."""
    return df.join(ids.select(row_id), row_id, "left_semi")


def split_overlap(df: DataFrame, key, split: str = "split") -> DataFrame:
    """Keys shared by each pair of splits, pairs that share none included.

    One aggregation over the keys; what follows are the few sets of splits that occur.
    """
    sets = (df.filter(F.col(split).isNotNull()).select(X.key_hash(key).alias("_key"), split)
            .groupBy("_key").agg(F.sort_array(F.collect_set(split)).alias("s")).groupBy("s")
            .agg(F.count(F.lit(1)).alias("n")))
    all_sets = sets.agg(F.collect_list(F.struct("s", "n")).alias("sets")).withColumn(
        "names", F.array_sort(F.array_distinct(F.flatten(F.transform("sets", lambda x: x["s"])))))
    pairs = all_sets.select("sets", "names", F.explode("names").alias("split_a")).select(
        "sets", "split_a", F.explode(F.filter("names", lambda x: x > F.col("split_a"))).alias("split_b"))

    def both(x):
        return F.array_contains(x["s"], F.col("split_a")) & F.array_contains(x["s"], F.col("split_b"))

    return pairs.select("split_a", "split_b", F.aggregate(
        F.filter("sets", both), F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("shared"))


def split_partition(full: DataFrame, parts: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """How far the splits are from covering the corpus exactly once.

    One count per id over both sides: no missing, no foreign, no repeated id means a partition.
    """
    both = (full.select(row_id, F.lit(1).alias("f"), F.lit(0).alias("p"))
            .unionByName(parts.select(row_id, F.lit(0).alias("f"), F.lit(1).alias("p")))
            .groupBy(row_id).agg(F.sum("f").alias("f"), F.sum("p").alias("p")))
    return both.agg(F.count_if(F.col("p") == 0).alias("missing"),
                    F.count_if(F.col("f") == 0).alias("foreign"),
                    F.count_if(F.col("p") > 1).alias("repeated"))


class LeakageError(ValueError):
    """Training was refused."""


def require_clean_splits(full: DataFrame, parts: DataFrame, text: str = "text",
                         row_id: str = "doc_id", status: str = "CLEAN") -> DataFrame:
    """``parts``, or LeakageError when the audit failed or the splits overlap."""
    if status != "CLEAN":
        raise LeakageError(f"corpus audit status is {status}")
    faults = split_partition(full, parts, row_id).first()
    if faults.missing or faults.foreign or faults.repeated:
        raise LeakageError(f"splits do not partition the corpus: {faults.asDict()}")
    shared = split_overlap(parts, X.dedup_key(F.col(text))).filter("shared > 0").collect()
    if shared:  # at most one row per pair of splits
        raise LeakageError(f"texts shared between splits: {[r.asDict() for r in shared]}")
    return parts
