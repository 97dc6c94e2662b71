"""Clusters around integer centroids, found through a vantage-point tree.

Method. Vectors become integers, so every distance, sum and centroid is exact. Each round builds a
vantage-point tree over the current centroids and broadcasts it (K x D integers: bounded by the
parameters). A vector searches it best first: of the subtrees still open it enters the one with the
smallest lower bound, computes the integer distance to its vantage point or to the centroids of its
leaf, and stops when every open bound lies above its best distance. A subtree whose bound equals
the best distance is still entered, and equal distances go to the smaller number, so the result is
that of comparing all centroids. Bounds come from square roots and are lowered by more than their
rounding error. The vectors of a batch take the steps of their searches together.

Tasks send sums of their vectors by cluster, K rows each; a round adds them exactly and divides.

Defined cases: vectors that are null, of another length than ``dim`` or hold null or non-finite
components are left out; fewer vectors than ``k`` make fewer clusters, an empty table an empty
result; repeated vec_ids are vectors of their own, and those that tie as first centroids are taken
in the order of their components (a null vec_id comes last); a cluster without vectors keeps its
centroid; other columns are ignored. Integers must stay below 2^27, or distances might pass 64
bits; larger ones raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscreen.llm.common import cut_lineage, read

K, ROUNDS, SCALE, DIM = 40, 5, 256, 64
#: Centroids of a leaf, all of them compared.
LEAF = 4
#: Vectors that search together; bounds the arrays of a task.
AT_ONCE = 4096
LIMIT = 1 << 27
_FAR = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Inner nodes have a vantage point and two children; leaves a list of centroids."""

    centroids: np.ndarray
    #: Vantage point of a node, or -1 for a leaf.
    vantage: np.ndarray
    #: (nodes, 2): children, or -1.
    child: np.ndarray
    #: (nodes, 2): smallest and largest distance of the child's centroids to the vantage point.
    near: np.ndarray
    far: np.ndarray
    #: (nodes, LEAF): centroids of a leaf, padded by -1.
    leaf: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def build(centroids: np.ndarray) -> Tree:
    """Each vantage point is the centroid farthest from the middle of its set."""
    nodes: list[tuple[int, list[int], list[float], list[float], list[int]]] = []

    def grow(own: list[int]) -> int:
        at = len(nodes)
        nodes.append((-1, [-1, -1], [0.0, 0.0], [0.0, 0.0], own if len(own) <= LEAF else []))
        if len(own) <= LEAF:
            return at
        points = centroids[own].astype(np.float64)
        point = own[int(np.argmax(squared(points, points.mean(axis=0))))]
        others = np.array([i for i in own if i != point])
        root = np.sqrt(squared(centroids[others], centroids[point]).astype(np.float64))
        order = np.argsort(root, kind="stable")
        halves = order[:len(order) // 2], order[len(order) // 2:]
        nodes[at] = (point, [grow(others[h].tolist()) for h in halves], [float(root[h].min()) for h in halves],
                     [float(root[h].max()) for h in halves], [])
        return at

    if len(centroids):
        grow(list(range(len(centroids))))
    leaf = np.full((len(nodes), LEAF), -1, dtype=np.int64)
    for i, n in enumerate(nodes):
        leaf[i, :len(n[4])] = n[4]
    return Tree(centroids, np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]),
                np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes]), leaf)


def search(tree: Tree, vectors: np.ndarray, visited: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, for each vector.

    ``visited`` (for tests) collects how many distances were computed.
    """
    n = len(vectors)
    best, number = np.full(n, _FAR), np.full(n, len(tree.centroids), dtype=np.int64)
    if not n or not len(tree.centroids):
        return number, best
    # The lower bound of each open subtree; closed ones are infinite.
    bound = np.full((n, len(tree.vantage)), np.inf)
    bound[:, 0] = 0.0
    active = np.arange(n)

    def compare(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        found = squared(vectors[rows], tree.centroids[point])
        better = (found < best[rows]) | ((found == best[rows]) & (point < number[rows]))
        best[rows[better]], number[rows[better]] = found[better], point[better]
        if visited is not None:
            visited.append(len(rows))
        return found

    while len(active):
        node = bound[active].argmin(axis=1)
        low = bound[active, node]
        go = low <= np.where(best[active] == _FAR, np.inf, np.sqrt(best[active].astype(np.float64)))
        go &= np.isfinite(low)
        active, node, low = active[go], node[go], low[go]
        bound[active, node] = np.inf
        point = tree.vantage[node]
        inner = point >= 0
        rows, at = active[inner], node[inner]
        root = np.sqrt(compare(rows, point[inner]).astype(np.float64))
        for side in (0, 1):
            gap = np.maximum(tree.near[at, side] - root, root - tree.far[at, side])
            gap -= 1e-9 * (1.0 + root + tree.far[at, side])  # above the rounding error of the roots
            bound[rows, tree.child[at, side]] = np.maximum(gap, low[inner])
        for i in range(LEAF):
            inside = tree.leaf[node, i]
            held = inside >= 0
            compare(active[held], inside[held])
    return number, best


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<int>) of the usable vectors."""
    x = F.col("embedding")
    usable = ((F.size(x) == dim)
              & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall("v", lambda v: F.abs(v) < LIMIT)
    return (vectors.filter(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v"))
            .select("vec_id", F.when(fits, F.col("v").cast("array<int>")).otherwise(
                F.raise_error(F.lit(f"a component reaches {LIMIT} after scaling")).cast("array<int>")).alias("v")))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _assigned(batch: pa.RecordBatch, tree: Tree, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray,
                                                                             np.ndarray]]:
    for lo in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(lo, AT_ONCE)
        m = _matrix(part.column(1), dim)
        yield (part, m, *search(tree, m))


def _sums(points: DataFrame, centroids: np.ndarray) -> list:
    """One row a cluster: its number, (count, sums of the components)."""
    dim = centroids.shape[1]
    shared = points.sparkSession.sparkContext.broadcast(build(centroids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dim + 1), dtype=np.int64)
        for batch in batches:
            for _, m, number, _ in _assigned(batch, shared.value, dim):
                order = np.argsort(number, kind="stable")
                found, first = np.unique(number[order], return_index=True)
                total[found, 1:] += np.add.reduceat(m[order], first, axis=0)
                total[:, 0] += np.bincount(number, minlength=len(total))
        some = np.flatnonzero(total[:, 0])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(some) * (dim + 1) + 1, dim + 1, dtype=np.int32)),
                pa.array(total[some].ravel()))], names=["cluster", "parts"])

    parts = points.mapInArrow(work, "cluster long, parts array<long>")
    whole = [F.sum(F.get("parts", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim + 1)]
    out = parts.groupBy("cluster").agg(*whole).collect()  # one row a cluster
    shared.unpersist()
    return out


def centroids_of(vectors: DataFrame, points: DataFrame, k: int = K, rounds: int = ROUNDS) -> np.ndarray:
    """(clusters, dim) integers after ``rounds`` rounds over ``points`` (vec_id, v)."""
    seed = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = points.select(seed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], dtype=np.int64)
    for _ in range(rounds if len(first) else 0):
        moved = centroids.copy()
        for row in _sums(points, centroids):
            count = int(row["s0"])
            moved[row["cluster"]] = [int(row[f"s{i}"]) // count for i in range(1, centroids.shape[1] + 1)]
        centroids = moved
    return centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE
            ) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, and the centroids."""
    points = cut_lineage(integers(vectors, dim, scale))
    centroids = centroids_of(vectors, points, k, rounds)
    shared = points.sparkSession.sparkContext.broadcast(build(centroids) if len(centroids) else None)
    kind = points.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, number, distance in _assigned(batch, shared.value, dim):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)),
                                                  pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return cut_lineage(points.mapInArrow(work, f"vec_id {kind}, cluster int, distance long")), centroids


def query(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(read(spark, sf_dir, "embeddings"))
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
               for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # One row a cluster: at most K.
    sums = cut_lineage(found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")))
    sums = named.join(sums, "cluster").withColumn("inertia", sums.agg(F.sum("cluster_inertia")).scalar())
    return found.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Rounds written out one after the other."""
    steps = [f"""
v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as cluster, v as c from v
  order by sha256('2:' || vec_id), v limit {K})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} as (select vec_id, v, least_one.cluster, least_one.d from (select vec_id, v, min(struct_pack(
    d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint,
    cluster := cluster)) as least_one from v, c{i} group by vec_id, v))""")
        if i < ROUNDS:
            steps.append(f"""
s{i} as (select cluster, i, floor_of.q as q from (select cluster, i, struct_pack(q := (sum(x) // count(*)
    - (case when sum(x) < 0 and sum(x) % count(*) <> 0 then 1 else 0 end))::bigint) as floor_of
  from (select cluster, unnest(range(1, {DIM + 1})) as i, unnest(v) as x from a{i}) group by cluster, i)),
c{i + 1} as (select p.cluster, coalesce(m.c, p.c) as c from c{i} p left join
  (select cluster, list(q order by i) as c from s{i} group by cluster) m using (cluster))""")
    return "with " + ",".join(steps) + f"""
select vec_id, a.cluster::integer as cluster, d as distance, (sum(d) over (partition by a.cluster))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on a.cluster = c.cluster"""


ORACLE = _oracle()
