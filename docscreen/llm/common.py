"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docscreen.session import cut_lineage

__all__ = ["cut_lineage", "held_out", "id_and_bytes", "local_forest", "map_batches", "pairs_in_runs",
           "read", "runs", "salted_cells", "whole_runs"]


#: Rows of an Arrow batch that a task turns into Python objects at once.
ROWS_AT_ONCE = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the UTF-8 bytes of text; other columns, whatever their names, are left behind."""
    return docs.select("doc_id", *more, F.col("text").cast("binary").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from (a null id is learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], list | None],
                schema: T.StructType | str) -> DataFrame:
    """``work`` gives the columns of the result for the rows it is handed (None: no rows).

    It gets Arrow batches in slices of ``ROWS_AT_ONCE`` rows: only one slice at a time exists as
    Python objects, which keeps a worker small.
    """
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                made = work(batch.slice(lo, ROWS_AT_ONCE))
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                         for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, target)


def salted_cells(rows: DataFrame, keys: list[str], salt_by: str, limit: int) -> DataFrame:
    """Rows of keys that occur more than once, dealt into cells of about ``limit`` rows.

    A key with n rows gets p = ceil(n / limit) parts; a row of part i goes to the cells (i, j) of
    every other part, so that any two rows of a key meet in exactly one cell, or, if they are of
    the same part, in all of its cells but compare only in the one that is theirs alone. No cell
    holds more than two parts, whatever the size of the key. Adds ``cell`` (long), ``part`` (int)
    and ``alone`` (boolean).
    """
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    parts = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    dealt = (rows.join(sizes, keys)
             .withColumn("_p", parts)
             .withColumn("part", F.pmod(F.xxhash64(salt_by), F.col("_p")).cast("int"))
             .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))))
    return (dealt.withColumn("cell", F.least("part", "_q").cast("long") * F.col("_p")
                             + F.greatest("part", "_q"))
            .withColumn("alone", F.col("part") == F.col("_q")).drop("_n", "_p", "_q"))


def runs(*arrays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of rows that are equal in all ``arrays``."""
    n = len(arrays[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the stream, cut only between runs of equal keys."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        if not table.num_rows:
            continue
        cols = [table.column(k).to_numpy() for k in keys]
        first, _ = runs(*cols)
        cut = int(first[-1])
        kept = table.slice(cut)
        if cut:
            yield {n: table.column(n).slice(0, cut).to_numpy() for n in table.column_names}
    if kept is not None and kept.num_rows:
        yield {n: kept.column(n).to_numpy() for n in kept.column_names}


def pairs_in_runs(first: np.ndarray, length: np.ndarray, at_once: int
                  ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of the same run, in portions of about ``at_once``."""
    n = int(length.sum())
    base = first[0] if len(first) else 0
    left = np.repeat(first + length, length) - np.arange(base, base + n)
    todo: list[tuple[np.ndarray, np.ndarray]] = []
    size, step, rows = 0, 1, np.arange(base, base + n)
    while True:
        rows = rows[left[rows - base] > step]
        if not len(rows):
            break
        todo.append((rows, rows + step))
        size, step = size + len(rows), step + 1
        if size >= at_once:
            yield np.concatenate([a for a, _ in todo]), np.concatenate([b for _, b in todo])
            todo, size = [], 0
    if todo:
        yield np.concatenate([a for a, _ in todo]), np.concatenate([b for _, b in todo])


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node linked to it) that connect what the pairs (a, b) connect."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[:len(a)], index[len(a):]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[u], low[v])
        after = low.copy()
        np.minimum.at(after, low[u], least)
        np.minimum.at(after, low[v], least)
        after = np.minimum(after, after[after])
        after = after[after]
        if np.array_equal(after, low):
            break
        low = after
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]
