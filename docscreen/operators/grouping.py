"""Building blocks that stay balanced when one key holds a large share of all rows.

* :func:`with_group_stats` - attach per-key aggregates to every row.  A window over the key
  would send all rows of a hot key to one task; here the aggregates are combined map-side and
  joined back, and the rows of a hot key are spread by their id.
* :func:`rank_cutoffs` / :func:`exact_rank` - exact ranks inside a hot group.  Rows are cut into
  buckets of their hash, bucket counts give each bucket's offset, and only rows of one bucket
  are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.session import cut_lineage

# A key with at least this many rows is hot.  There are at most N / HOT_ROWS hot keys, which
# bounds the broadcast: 10^12 rows give at most one million keys.
HOT_ROWS = 1_000_000
# A side with at most this many rows is broadcast; measured by ``is_small`` before it happens.
BROADCAST_ROWS = 100_000
# Ranks inside a hash bucket are sorted by one task: 16^3 buckets per group.
HASH_DIGITS = 3


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Measure (with an early stop) whether ``df`` has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, rows) else df


def with_group_stats(df: DataFrame, keys: Sequence[str], row_id: str,
                     hot_rows: int = HOT_ROWS, few_keys: bool = False,
                     **aggregates: Column) -> DataFrame:
    """``df`` plus one column per aggregate of the row's key group; null keys form a group.

    ``few_keys`` (labels, not texts): measure the number of groups first and, if they are few,
    broadcast the aggregates so that the rows are not shuffled at all.
    """
    keys = list(keys)
    stats = (df.select(*keys, *_inputs(df, aggregates, keys)).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("_rows"), *[a.alias(n) for n, a in aggregates.items()]))
    names = list(aggregates)
    if few_keys:
        stats = cut_lineage(stats)  # measured and then used
    if few_keys and is_small(stats):
        table = F.broadcast(stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return df.join(table, match, "left").select(*df.columns, *names)
    hot = F.broadcast(stats.filter(F.col("_rows") >= hot_rows)
                      .select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"),
                              *[F.col(n).alias(f"_h_{n}") for n in names]))
    rest = stats.filter(F.col("_rows") < hot_rows).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.lit("").alias("_r_spread"),
        *[F.col(n).alias(f"_r_{n}") for n in names])

    def same(left: str, right: str) -> Column:
        return F.col(left).eqNullSafe(F.col(right))

    hot_match = F.lit(True)
    rest_match = F.col("_spread") == F.col("_r_spread")
    for k in keys:
        hot_match = hot_match & same(k, f"_h_{k}")
        rest_match = rest_match & same(k, f"_r_{k}")
    # Rows of hot keys already have their values; a spread column that matches nothing keeps
    # them from meeting in one partition of the second join.
    spread = F.when(F.col("_hot"), F.md5(F.col(row_id).cast("string"))).otherwise(F.lit(""))
    joined = (df.join(hot, hot_match, "left").withColumn("_spread", spread)
              .join(rest, rest_match, "left"))
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.when(F.col("_hot"), F.col(f"_h_{n}")).otherwise(F.col(f"_r_{n}")).alias(n)
          for n in names])


def _inputs(df: DataFrame, aggregates, keys):
    # Catalyst prunes the unused columns; selecting all keeps the aggregates free to use any.
    return [c for c in df.columns if c not in keys]


def unnest(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per array element.

    A plain ``explode`` makes the optimiser add ``size(array) > 0`` below it, which computes a
    costly array twice; the outer form does not, and its null rows are dropped afterwards.
    """
    return (df.select(*keep, F.explode_outer(array).alias(name))
            .filter(F.col(name).isNotNull()))


def computed_once(df: DataFrame, column: str) -> DataFrame:
    """``df`` whose column a filter above does not compute again.

    The optimiser moves a filter below the projection that its column comes from and so computes a costly
    column twice; it moves nothing below a generator that makes the column.
    """
    return df.select(*[F.explode_outer(F.array(c)).alias(c) if c == column else F.col(c) for c in df.columns])


def hash_order(row_id: str, seed: int = C.SEED) -> Column:
    """Reproducible pseudo-random order of rows: md5 of the id and the seed."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"|{seed}")))


def _bucket_offsets(rows: DataFrame, group: str) -> DataFrame:
    """Per (group, bucket): number of rows, and number of rows in earlier buckets."""
    before = (Window.partitionBy(group).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
            .withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))))


def _hashed(df: DataFrame, group: str, row_id: str, seed: int) -> DataFrame:
    return (df.select(group, row_id, hash_order(row_id, seed).alias("_hash"))
            .withColumn("_bucket", F.left("_hash", F.lit(HASH_DIGITS))))


def _rank_in_bucket(rows: DataFrame, offsets: DataFrame, group: str, row_id: str) -> DataFrame:
    within = Window.partitionBy(group, "_bucket").orderBy("_hash", row_id)
    return (rows.join(offsets, [group, "_bucket"])
            .withColumn("rank", F.col("_before") + F.row_number().over(within)))


def exact_rank(df: DataFrame, group: str, row_id: str, seed: int = C.SEED) -> DataFrame:
    """``(group, row_id, rank)``: 1-based rank in hash order within each group."""
    rows = _hashed(df, group, row_id, seed)
    return _rank_in_bucket(rows, _bucket_offsets(rows, group), group, row_id).select(
        group, row_id, "rank")


def rank_cutoffs(df: DataFrame, group: str, row_id: str, wanted: DataFrame,
                 seed: int = C.SEED) -> DataFrame:
    """Hash and id of the row with a given rank, for each ``(group, name, rank)`` of ``wanted``.

    Only the buckets that hold a wanted rank are sorted, so nothing but bucket counts and
    1/16^3 of the rows is shuffled.  Ranks below 1 give no row.
    """
    rows = _hashed(df, group, row_id, seed)
    offsets = _bucket_offsets(rows, group)
    targets = cut_lineage(
        offsets.join(wanted, group)
        .filter((F.col("wanted") > F.col("_before"))
                & (F.col("wanted") <= F.col("_before") + F.col("_in_bucket"))))
    # One row per group and wanted rank: measured, then rows of other buckets are not shuffled.
    buckets = broadcast_if_small(targets.select(group, "_bucket", "_before").distinct())
    ranked = _rank_in_bucket(rows, buckets, group, row_id)
    return (ranked.join(targets.select(group, "name", F.col("wanted").alias("rank")),
                        [group, "rank"])
            .select(group, "name", F.col("_hash").alias("cut_hash"),
                    F.col(row_id).alias("cut_id")))


#: Rows of a slice that one task sorts.
SLICE_ROWS = 1_000_000


def ordered_ids(df: DataFrame, order_by: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` plus ``position``: the 0-based place in the order of a key, nulls first.

    Rows with equal keys are ordered by a hash of the whole row, so they are spread over tasks like all others
    and the result does not depend on how rows were dealt (rows that are equal throughout are
    interchangeable).  Ranges come from Spark's sample of (key, hash), about ``slice_rows`` rows to a task;
    the sorted slices are written once and their counts give the offsets.
    """
    slices = max(1, -(-df.count() // slice_rows))
    dealt = (df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
             .repartitionByRange(slices, order_by, "_tie").sortWithinPartitions(order_by, "_tie")
             .withColumn("_place", F.monotonically_increasing_id()))
    inside = (1 << 33) - 1
    sliced = cut_lineage(dealt.drop("_tie")).withColumn("_slice", F.shiftright("_place", 33))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
               .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    # One row a slice: a million slices hold 10^12 rows.
    return (sliced.join(F.broadcast(offsets), "_slice")
            .withColumn("position", F.col("_before") + F.col("_place").bitwiseAND(F.lit(inside)))
            .drop("_slice", "_before", "_place"))
