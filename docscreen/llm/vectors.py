"""Embedding near duplicates by randomly rotated binary codes with correction factors.

Method. A unit vector is turned by a random rotation and kept as the signs of its coordinates, a
code whose unit vector is o; the stored correction factor a = <vector, o> makes <q, o> / a an
unbiased estimate of the inner product of a query q with the vector. Its confidence bound is
``SIGMAS * sqrt((1 - a^2) / (a^2 (D - 1)))``; besides, the angles of a triangle give a bound that
holds for certain. A pair is dropped only where the estimate and its bound stay below the
threshold; all other pairs are recomputed exactly, in double precision, and that alone decides.

Candidates share bits. Several rotations give ``TABLES`` keys of ``KEY_BITS`` code bits each, and
vectors meet where a key and the label are equal; at cosine 0.93 a pair misses all 40 keys of 14
bits with probability below 0.001, at 0.97 below 10^-5. Equal vectors are one node with a count
before anything is compared. Keys that many vectors share are dealt into cells of bounded size; a
pair is counted in the first table whose keys agree, so pairs are neither kept nor made distinct:
a cell sends each vector's number of links and a spanning forest.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or whose
label is null, link with nothing and are their own component; vectors of different dimension do
not link; other columns are ignored; a repeated vec_id counts as one more vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscreen.llm.common import (cut_lineage, local_forest, map_batches, pairs_in_runs, read, runs,
                                  salted_cells, whole_runs)
from docscreen.llm.components import connected_components

THRESHOLD = 0.93
TABLES = 40
KEY_BITS = 14
SIGMAS = 4.0
SEED = 11
#: Vectors of one key compared in one cell.
CELL_ROWS = 1024
_PAIRS_AT_ONCE = 1 << 17


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, the same in every task."""
    random = np.random.default_rng([SEED, dim])
    return np.stack([np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(count)])


def rotations_needed(dim: int, tables: int = TABLES, key_bits: int = KEY_BITS) -> int:
    return -(-tables * key_bits // dim)


def codes(unit: np.ndarray, count: int) -> np.ndarray:
    """Signs (as booleans) of all rotations of unit vectors, one after the other."""
    turned = np.einsum("rij,nj->nri", rotations(unit.shape[1], count), unit)
    return (turned >= 0).reshape(len(unit), -1)


def keys_of(bits: np.ndarray, tables: int = TABLES, key_bits: int = KEY_BITS) -> np.ndarray:
    """(vectors, tables) integers made of consecutive code bits."""
    own = bits[:, :tables * key_bits].reshape(len(bits), tables, key_bits)
    return own @ (1 << np.arange(key_bits, dtype=np.int64))


def upper_bound(estimate_dot: np.ndarray, factor: np.ndarray, dim: int, sigmas: float = SIGMAS) -> np.ndarray:
    """The most that <q, vector> may be, given <q, code> and the factor <vector, code>."""
    a = np.clip(factor, 1e-6, 1.0)
    likely = estimate_dot / a + sigmas * np.sqrt((1 - a * a) / (a * a * max(dim - 1, 1)))
    certain = np.cos(np.maximum(0.0, np.arccos(np.clip(estimate_dot, -1, 1)) - np.arccos(a)) - 1e-7)
    return np.minimum(likely, certain)


def _matrix(column: pa.Array | np.ndarray) -> np.ndarray:
    return np.array(column.tolist() if isinstance(column, np.ndarray) else column.to_pylist(), dtype=np.float64)


def nodes(vectors: DataFrame) -> DataFrame:
    """One row for each distinct usable vector of a label: node (its least vec_id), copies."""
    x = F.col("embedding")
    usable = (F.col("label").isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
              & F.exists(x, lambda v: v != 0))
    return (vectors.filter(usable).groupBy("label", "embedding")
            .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))


def _keyed(distinct: DataFrame, tables: int, key_bits: int) -> DataFrame:
    """node, label, dim, choice (table) and key."""
    def work(batch: pa.RecordBatch) -> list | None:
        dims = np.array([len(v) for v in batch.column(2)])
        out = []
        for dim in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == dim))
            m = _matrix(batch.column(2).take(at))
            m = m / np.linalg.norm(m / np.abs(m).max(axis=1, keepdims=True), axis=1, keepdims=True) \
                / np.abs(m).max(axis=1, keepdims=True)
            keys = keys_of(codes(m, rotations_needed(int(dim), tables, key_bits)), tables, key_bits)
            out.append([batch.column(0).take(at), batch.column(1).take(at),
                        pa.array(np.full(len(m), dim, dtype=np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)),
                                                 pa.array(keys.ravel().astype(np.int32)))])
        return [pa.concat_arrays(c) for c in zip(*out, strict=True)]

    label = distinct.schema["label"].dataType.simpleString()
    many = map_batches(distinct.select("node", "label", "embedding"), work,
                       f"node long, label {label}, dim int, keys array<int>")
    return many.select("node", "label", "dim", F.posexplode("keys").alias("choice", "key"))


def links(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, key_bits: int = KEY_BITS,
          cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, (node, found): vectors linked to a node that are not its copies, (a, b): a forest)."""
    distinct = cut_lineage(nodes(vectors))
    keyed = _keyed(distinct, tables, key_bits)
    cells = salted_cells(keyed, ["label", "dim", "choice", "key"], "node", cell_rows)
    # Only vectors that share a key with another one travel with their components.
    full = (cells.join(distinct.select("node", "copies", "embedding"), "node")
            .repartition("label", "dim", "choice", "key", "cell")
            .sortWithinPartitions("label", "dim", "choice", "key", "cell")
            .select("label", "dim", "choice", "key", "cell", "part", "alone", "node", "copies", "embedding"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("found", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches, ("label", "dim", "choice", "key", "cell")):
            for dim in np.unique(part["dim"]):
                own = {k: v[part["dim"] == dim] for k, v in part.items()}
                node, found, a, b = _cell_links(own, int(dim), threshold, tables, key_bits)
                if len(node):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(found)], schema=schema)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)

    seen = cut_lineage(full.mapInArrow(compare, "a long, b long, found long"))
    return (distinct, seen.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("found").alias("found")),
            seen.filter("b is not null").select("a", "b"))


def _cell_links(own: dict[str, np.ndarray], dim: int, threshold: float, tables: int, key_bits: int):
    """Links of the runs of some cells: nodes, vectors linked to each, edges of a forest."""
    m = np.array(own["embedding"].tolist(), dtype=np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    count = rotations_needed(dim, tables, key_bits)
    bits = codes(unit, count)
    keys = keys_of(bits, tables, key_bits)
    turned = (unit @ rotations(dim, count)[0].T).astype(np.float32)
    signs = np.where(bits[:, :dim], 1, -1).astype(np.float32) / np.float32(np.sqrt(dim))
    factor = (turned * signs).sum(axis=1)
    node, copies, choice, part = own["node"], own["copies"], own["choice"], own["part"]
    first, length = runs(own["label"], choice, own["key"], own["cell"])
    got = np.zeros(len(node), dtype=np.int64)
    edges = []
    for i, j in pairs_in_runs(first, length, _PAIRS_AT_ONCE):
        meet = (part[i] != part[j]) | own["alone"][i]
        i, j = i[meet], j[meet]
        # Estimates in both directions; either may rule the pair out.
        near = upper_bound(np.einsum("ij,ij->i", turned[i], signs[j]), factor[j], dim) >= threshold
        i, j = i[near], j[near]
        near = upper_bound(np.einsum("ij,ij->i", turned[j], signs[i]), factor[i], dim) >= threshold
        i, j = i[near], j[near]
        # The first table whose keys agree counts the pair.
        near = (keys[i] == keys[j]).argmax(axis=1) == choice[i]
        i, j = i[near], j[near]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        i, j = i[near], j[near]
        if len(i):
            np.add.at(got, i, copies[j])
            np.add.at(got, j, copies[i])
            edges.append(local_forest(node[i], node[j]))
    hit = np.flatnonzero(got)
    if not len(hit):
        return node[:0], got[:0], node[:0], node[:0]
    a, b = local_forest(np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges]))
    return node[hit], got[hit], a, b


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    distinct, found, forest = links(vectors, threshold)
    joined = (distinct.join(found, "node", "left")
              .join(connected_components(forest).withColumnRenamed("node", "low_node"),
                    F.col("node") == F.col("low_node"), "left")
              .select("label", "embedding",
                      (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "node").alias("component_id")))
    classes = cut_lineage(joined)
    own = vectors.select("vec_id", "label", "embedding")
    # NaN and zero vectors are not among the classes; nulls never join.
    return (own.join(classes, ["label", "embedding"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.vec_id as a, b.vec_id as b from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
   and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach as (
  select vec_id as id, vec_id as root from embeddings
  union
  select p.b, r.root from reach r join pairs p on p.a = r.id)
select e.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e
left join (select a, count(*) as n_links from pairs group by a) n on n.a = e.vec_id
join (select id, min(root) as component_id from reach group by id) c on c.id = e.vec_id
"""
