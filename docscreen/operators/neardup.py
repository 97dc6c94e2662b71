"""Near duplicates by cosine of TF-IDF vectors over the whole vocabulary.

Exact: every pair of different vectors at or above the threshold is found. The job is quadratic in the
number of different vectors, in time only: neither rows nor pairs are copied to be compared.

* Rows with equal bags of terms are one representative with a count before all this.
* Representatives are packed into blocks of rows, one table row each. A product of this table with itself
  (without a shuffle: tasks read it from the shared folder) brings every block to every other one.
* A pair of blocks is one matrix product of sketches: ``DEPTH`` heavy terms have a place of their own, the
  others share ``CROWD`` places by hash, with the norm of what falls there. The product of two sketches is
  never below the cosine (Cauchy-Schwarz in each place); pairs that reach the threshold by it are
  computed in double precision from the terms.

Terms are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators.features import TfidfParams
from docscreen.operators.grouping import HOT_ROWS, broadcast_if_small, is_small, unnest, with_group_stats
from docscreen.session import cut_lineage, release, written

#: Places of a sketch that the terms share which have none of their own.
CROWD = 256
#: Terms with a place of their own.
DEPTH = 256
#: Rows of a block, and entries (16 bytes each) after which it ends.
BLOCK, BLOCK_ENTRIES = 2_048, 500_000
#: Rows that are opened or multiplied at a time.
TILE = 512
#: Terms of more than one row whose frequencies every task may hold, 12 bytes each.
SHARED_TERMS = 8_000_000
#: Representatives that are broadcast to find their bags, 24 bytes each.
SHARED_REPS = 1_000_000
#: Entries of candidate pairs that are multiplied at a time.
PRODUCTS = 500_000
#: All terms; ``CAPPED`` keeps the most frequent ones only.
WHOLE = TfidfParams(0, 1, 1, sublinear=False, strip_accents=False)
CAPPED = TfidfParams(C.NEAR_DUP_FEATURES, 1, 1, sublinear=False, strip_accents=False)


def near_duplicates(df: DataFrame, text: str, row_id: str = "doc_id", params: TfidfParams = WHOLE,
                    threshold: float = C.NEAR_DUP_COSINE) -> tuple[DataFrame, DataFrame]:
    """All pairs of different vectors with cosine >= ``threshold``.

    Returns ``(copies, pairs)``.  ``copies`` maps every row to the lowest id with the same vector
    (cosine 1), so groups of equal rows are never expanded into pairs.  ``pairs`` holds the distinct
    vectors that are near each other, with the number of rows each stands for.  A row without a term
    equals no other row.  ``params.max_features`` of 0 stands for the whole vocabulary.
    """
    bags = cut_lineage(_bags(df, text, row_id, params))
    own = written()[-1:]
    keys = cut_lineage(bags.select("id", "key"))
    groups = cut_lineage(keys.groupBy("key").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies")))
    rows, frequencies = bags.count(), _frequencies(bags)
    with _settings(df.sparkSession, LARGE_ROWS):
        blocks = cut_lineage(_weighed(_representatives(bags, groups), frequencies, rows))
    release(df.sparkSession, own)
    pairs = _near_pairs(blocks, _heavy(frequencies, rows), rows, threshold)
    return _copies(keys, row_id), pairs


def _representatives(bags: DataFrame, groups: DataFrame) -> DataFrame:
    """id, copies, h, tf: the bag of the lowest id of each group; bags move only where the groups are many."""
    named = broadcast_if_small(groups.select(F.col("rep_id").alias("id"), "copies", F.col("key").alias("_key")), SHARED_REPS)
    reps = bags.filter(F.size("h") > 0).join(named, "id").filter(F.col("key") == F.col("_key"))
    found = reps.agg(F.count("id"), F.countDistinct("id")).first()
    if found[0] > found[1]:  # an id that stands in several rows
        reps = reps.dropDuplicates(["id"])
    return reps.select("id", "copies", "h", "tf")


def equal_vectors(df: DataFrame, text: str, row_id: str = "doc_id", params: TfidfParams = WHOLE) -> DataFrame:
    """``copies`` of ``near_duplicates`` alone: ids and 16-byte keys, no terms, are written and shuffled."""
    return _copies(cut_lineage(_bags(df, text, row_id, params).select("id", "key")), row_id)


def _copies(keys: DataFrame, row_id: str) -> DataFrame:
    return with_group_stats(keys, ["key"], "id", rep_id=F.min("id"), copies=F.count(F.lit(1))).select(
        F.col("id").alias(row_id), "rep_id", "copies")


def _bags(df: DataFrame, text: str, row_id: str, params: TfidfParams) -> DataFrame:
    """id, h (hashes of the distinct terms), tf and key (equal for equal bags; a row without terms has its own)."""
    counted = df.select(F.col(row_id).alias("id"), X.term_counts(params.terms(F.coalesce(text, F.lit("")))).alias("c"))
    bags = counted.select("id", F.transform("c", lambda x: F.xxhash64(x["term"])).alias("h"),
                          F.transform("c", lambda x: x["tf"].cast("int")).alias("tf"))
    if params.max_features or params.min_df > 1 or params.max_df < 1.0:
        bags = _only(bags, _usable(counted, params))
    own = F.when(F.size("h") == 0, F.concat(F.lit("row "), F.col("id").cast("string"))).otherwise(
        F.concat_ws("|", F.array_join(F.transform("h", lambda x: x.cast("string")), ","),
                    F.array_join(F.transform("tf", lambda x: x.cast("string")), ",")))
    return bags.withColumn("key", F.unhex(F.md5(own)))


def _usable(counted: DataFrame, params: TfidfParams) -> np.ndarray:
    """Hashes of the terms within the bounds, the most frequent ones: at most ``max_features`` numbers."""
    if not params.max_features:
        raise ValueError("bounds on document frequency need max_features")
    rows = counted.count()
    stats = (unnest(counted, F.col("c"), "t").groupBy(F.col("t.term").alias("term"))
             .agg(F.count(F.lit(1)).alias("df"), F.sum("t.tf").alias("cf"))
             .filter((F.col("df") >= params.min_df) & (F.col("df") <= params.max_df * rows)))
    top = stats.orderBy(F.desc("cf"), "term").limit(params.max_features).select(F.xxhash64("term").alias("h"))
    return np.array([r.h for r in top.collect()], dtype=np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()


def _listed(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def _only(bags: DataFrame, wanted: np.ndarray) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (lengths, h), (_, tf) = _lists(batch.column(1)), _lists(batch.column(2))
            known = np.isin(h, wanted)
            sizes = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[known], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(sizes, h[known]), _listed(sizes, tf[known])],
                                             names=["id", "h", "tf"])

    return bags.mapInArrow(keep, bags.schema)


def _frequencies(bags: DataFrame) -> DataFrame:
    """Rows of every term (h, df) that is in more than one."""
    return cut_lineage(unnest(bags, F.col("h"), "h").groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df"))
                       .filter("df > 1"))


def _idf(df, rows: int):
    return np.log((rows + 1) / (df + 1)) + 1


def _heavy(frequencies: DataFrame, rows: int) -> np.ndarray:
    """The ``DEPTH`` terms of most weight, sorted; any choice gives the same pairs."""
    weight = F.col("df") * F.pow(F.log((F.lit(rows) + 1) / (F.col("df") + 1)) + 1, F.lit(2))
    return np.sort(np.array([r.h for r in frequencies.orderBy(weight.desc(), "h").limit(DEPTH).collect()], dtype=np.int64))


_BLOCKS = ("block long, ids array<{0}>, copies array<long>, norms array<double>, lengths array<int>, "
           "h binary, tf binary, df binary")


def _weighed(reps: DataFrame, frequencies: DataFrame, rows: int) -> DataFrame:
    """Blocks of rows: their entries with frequencies, and norms; a term of one row alone counts in its norm only."""
    schema = _BLOCKS.format(reps.schema["id"].dataType.simpleString())
    if is_small(frequencies, SHARED_TERMS):
        table = frequencies.orderBy("h").toArrow()
        shared = reps.sparkSession.sparkContext.broadcast((table.column("h").to_numpy(), table.column("df").to_numpy()))

        def look_up(h: np.ndarray) -> np.ndarray:
            terms, counts = shared.value
            if not len(terms):
                return np.ones(len(h), dtype=np.int32)
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            return np.where(terms[at] == h, counts[at], 1).astype(np.int32)

        return reps.mapInArrow(_packer(look_up, rows, BLOCK, BLOCK_ENTRIES), schema)
    # Beyond that each entry meets its frequency in a join; the rows of frequent terms are spread.
    entries = cut_lineage(reps.select("id", F.explode(F.arrays_zip("h", "tf")).alias("e")).select("id", "e.*"))
    hot = frequencies.filter(F.col("df") >= HOT_ROWS).select("h", F.col("df").alias("_hot"))
    met = (entries.join(F.broadcast(hot), "h", "left")
           .join(frequencies.filter(F.col("df") < HOT_ROWS), "h", "left")
           .groupBy("id").agg(F.collect_list(F.struct("h", "tf", F.coalesce("_hot", "df", F.lit(1)).alias("df"))).alias("e"))
           .select("id", F.col("e.h").alias("h"), F.col("e.tf").alias("tf"), F.col("e.df").alias("df")))
    full = met.join(reps.select("id", "copies"), "id").select("id", "copies", "h", "tf", "df")
    return full.mapInArrow(_packer(None, rows, BLOCK, BLOCK_ENTRIES), schema)


def _packer(look_up, rows: int, most: int, most_entries: int):
    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Rows of a batch in parts that fit into a block each."""
        (lengths, h), (_, tf) = _lists(batch.column(2)), _lists(batch.column(3))
        df = look_up(h) if look_up else _lists(batch.column(4))[1]
        row = np.repeat(np.arange(len(lengths)), lengths)
        w = tf * _idf(df, rows)
        norms = np.sqrt(np.bincount(row, w * w, minlength=len(lengths)))
        kept = df > 1
        sizes = np.bincount(row[kept], minlength=len(lengths))
        h, tf, df, ends = h[kept], tf[kept].astype(np.int32), df[kept].astype(np.int32), np.concatenate(([0], np.cumsum(sizes)))
        lo = 0
        while lo < len(sizes):
            hi = max(min(int(np.searchsorted(ends, ends[lo] + most_entries, "right")) - 1, lo + most), lo + 1)
            part = slice(ends[lo], ends[hi])
            yield batch.column(0)[lo:hi], batch.column(1)[lo:hi], norms[lo:hi], sizes[lo:hi], h[part], tf[part], df[part]
            lo = hi

    def block(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, copies, norms, sizes, h, tf, df = zip(*parts, strict=True)

        def one(values) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(pa.concat_arrays(ids)), one(pa.concat_arrays(copies)), one(pa.array(np.concatenate(norms))),
             one(pa.array(np.concatenate(sizes).astype(np.int32))),
             *(pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (h, tf, df))],
            names=["block", "ids", "copies", "norms", "lengths", "h", "tf", "df"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held, entries = TaskContext.get().partitionId() << 32, [], 0, 0
        for piece in (p for batch in batches for lo in range(0, batch.num_rows, TILE) for p in pieces(batch.slice(lo, TILE))):
            if parts and (held + len(piece[0]) > most or entries + len(piece[4]) > most_entries):
                yield block(number, parts)
                number, parts, held, entries = number + 1, [], 0, 0
            parts.append(piece)
            held, entries = held + len(piece[0]), entries + len(piece[4])
        if parts:
            yield block(number, parts)

    return pack


class _Rows:
    """A block as arrays: weights of unit rows, and their sketches."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str, heavy: np.ndarray, crowd: int, rows: int):
        def flat(name: str, kind) -> np.ndarray:
            return np.frombuffer(batch.column(f"{name}_{side}")[at].as_buffer(), kind)

        self.ids, self.copies = (batch.column(f"{c}_{side}")[at].values for c in ("ids", "copies"))
        norms, self.lengths = (batch.column(f"{c}_{side}")[at].values.to_numpy() for c in ("norms", "lengths"))
        self.ends = np.concatenate(([0], np.cumsum(self.lengths)))
        self.h, n = flat("h", np.int64), len(self.lengths)
        row = np.repeat(np.arange(n), self.lengths)
        self.w = flat("tf", np.int32) * _idf(flat("df", np.int32), rows) / norms[row]
        place = len(heavy) + ((self.h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % crowd
        if len(heavy):
            near = np.minimum(np.searchsorted(heavy, self.h), len(heavy) - 1)
            place = np.where(heavy[near] == self.h, near, place)
        width = len(heavy) + crowd
        self.sketch = np.empty((n, width), dtype=np.float32)
        for lo in range(0, n, TILE):
            hi = min(lo + TILE, n)
            own = slice(self.ends[lo], self.ends[hi])
            self.sketch[lo:hi] = np.sqrt(np.bincount((row[own] - lo) * width + place[own], self.w[own] * self.w[own],
                                                     minlength=(hi - lo) * width)).reshape(hi - lo, width)
        self._terms = None

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's terms, sorted, and the place of each entry's term among them."""
        if self._terms is None:
            self._terms = np.unique(self.h, return_inverse=True)
        return self._terms

    def entries(self, rows: np.ndarray) -> np.ndarray:
        """Places of the entries of some rows, one row after the other."""
        sizes = self.lengths[rows]
        return np.repeat(self.ends[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _cosines(a: _Rows, b: _Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of row i of ``a`` and row j of ``b``; ``i`` ascends."""
    known, place = a.terms()
    wanted = np.unique(j)
    at = b.entries(wanted)
    found = np.minimum(np.searchsorted(known, b.h[at]), len(known) - 1)
    there = known[found] == b.h[at]
    code = np.full(len(b.h), len(known))  # an empty place for the other terms
    code[at[there]] = found[there]
    out, row = np.zeros(len(i)), np.zeros(len(known) + 1)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(i)], strict=True):
        own = slice(a.ends[i[lo]], a.ends[i[lo] + 1])
        row[place[own]] = a.w[own]
        step = max(1, PRODUCTS // max(int(b.lengths.max()), 1))
        for first in range(lo, hi, step):
            part = j[first:min(first + step, hi)]
            at = b.entries(part)
            out[first:first + len(part)] = np.bincount(np.repeat(np.arange(len(part)), b.lengths[part]),
                                                       b.w[at] * row[code[at]], minlength=len(part))
        row[place[own]] = 0.0
    return out


def _near_pairs(blocks: DataFrame, heavy: np.ndarray, rows: int, threshold: float) -> DataFrame:
    spark, kind, crowd = blocks.sparkSession, blocks.schema["ids"].dataType.elementType.simpleString(), CROWD
    # Single precision in the sketch must not lose a pair at the limit.
    limit = threshold - 1e-4

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, a = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                one, two = (batch.column(f"block_{x}")[at].as_py() for x in "ab")
                if one != number:
                    number, a = one, _Rows(batch, at, "a", heavy, crowd, rows)
                b = a if one == two else _Rows(batch, at, "b", heavy, crowd, rows)
                for lo in range(0, len(b.lengths), TILE):
                    i, j = np.nonzero(a.sketch @ b.sketch[lo:lo + TILE].T >= limit)
                    j += lo
                    if a is b:
                        i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    cosine = _cosines(a, b, i, j)
                    near = cosine >= limit
                    i, j = pa.array(i[near]), pa.array(j[near])
                    yield pa.RecordBatch.from_arrays([a.ids.take(i), b.ids.take(j), a.copies.take(i), b.copies.take(j),
                                                      pa.array(cosine[near])], names=["x", "y", "copies_x", "copies_y", "cosine"])

    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in blocks.columns]) for x in "ab")
    # Blocks are read again for each other one instead of being sent; a batch holds one pair.
    met = a.hint("shuffle_replicate_nl").join(b, F.col("block_a") <= F.col("block_b"))
    found = met.mapInArrow(compare, f"x {kind}, y {kind}, copies_x long, copies_y long, cosine double")
    swap = F.col("x") > F.col("y")
    ordered = found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"),
                           F.when(swap, F.col("copies_y")).otherwise(F.col("copies_x")).alias("copies_a"),
                           F.when(swap, F.col("copies_x")).otherwise(F.col("copies_y")).alias("copies_b"),
                           F.round("cosine", 6).alias("cosine"))
    with _settings(spark, LARGE_ROWS | {BATCH: "1"}):
        return cut_lineage(ordered.filter(F.col("cosine") >= threshold))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A row of the table of blocks has megabytes. Spark's readers and writers count rows, and would hold all those of a file
#: at once, in several copies: here they hold a few blocks, whatever the size of a file or of a split.
LARGE_ROWS = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.parquet.columnarReaderBatchSize": "1",
              "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1",
              "parquet.page.size.row.check.min": "1"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def near_duplicate_summary(copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of row pairs at or above the threshold, counted without listing equal rows."""
    equal = copies.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")))
    near = pairs.agg(F.coalesce(F.sum(F.col("copies_a") * F.col("copies_b")), F.lit(0)))
    return (copies.sparkSession.range(1)
            .select(equal.scalar().alias("equal_pairs"), near.scalar().alias("near_pairs")))
