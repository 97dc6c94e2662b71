"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Method. Every shard owns ``vnodes`` points of a hash ring; a document starts at the shard whose
point follows its own hash. Shards hold at most their capacity. Documents are seated in ring
order, and one whose shard is full goes on clockwise to the next shard with room. With
``slack=0`` the capacities add up to the number of rows, so every shard ends exactly at its
capacity: counts differ by one at most (law ``rows``). With more slack fewer documents move when
a shard is added.

Ring order is cut in ``arcs`` equal arcs. A document's rank inside its arc comes from a window per
arc; the seating itself needs only the number of documents of each arc before and after each
virtual node, which is at most ``arcs`` + ``shards`` * ``vnodes`` rows on the driver whatever the
size of the corpus. It gives each stretch of an arc a run of ranks per shard, and with it gapless
slots; documents find their run by their rank. Texts are read once for their size and checksum and
are never shuffled.

Defined cases: rows without an id lie on the ring by size and checksum; a null text has size 1 and the checksum of nothing; equal ids and texts are ordered
by size and checksum, so repeated rows get slots of their own; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docscreen.llm.common import cut_lineage, map_batches, read

SHARDS = 8
VNODES = 64
ARCS = 4096
_RING = 1 << 32


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order."""
    def place(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{node}".encode()).digest()[:4], "big")

    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


@dataclass
class Seats:
    """Runs of ranks: those of stretch i start at ``first[i]`` and go to ``shard[i]`` from ``slot[i]``."""

    first: list[int] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)
    slot: list[int] = field(default_factory=list)


def seat(counts: dict[int, int], shards: int, capacity: list[int], vnodes: int = VNODES) -> dict[int, Seats]:
    """Runs of every stretch; ``counts`` has the documents of each stretch, numbered in ring order.

    Stretches are numbered as ``stretch_bounds`` cuts the ring.
    """
    nodes = ring(shards, vnodes)
    places = [p for p, _ in nodes]
    bounds = stretch_bounds(shards, vnodes)
    load = [0] * shards
    out: dict[int, Seats] = {}
    for stretch in sorted(counts):
        node = bisect.bisect_left(places, bounds[stretch]) % len(nodes)
        todo, rank, own = counts[stretch], 0, Seats()
        while todo:
            for step in range(len(nodes)):  # clockwise to the next shard with room
                shard = nodes[(node + step) % len(nodes)][1]
                if load[shard] < capacity[shard]:
                    break
            else:
                raise ValueError("the capacities are smaller than the number of documents")
            n = min(todo, capacity[shard] - load[shard])
            own.first.append(rank)
            own.shard.append(shard)
            own.slot.append(load[shard])
            load[shard], rank, todo = load[shard] + n, rank + n, todo - n
        out[stretch] = own
    return out


def stretch_bounds(shards: int, vnodes: int = VNODES, arcs: int = ARCS) -> list[int]:
    """First places of the stretches: starts of arcs, and the place after each virtual node."""
    return sorted({i * _RING // arcs for i in range(arcs)}
                  | {p + 1 for p, _ in ring(shards, vnodes) if p + 1 < _RING})


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Documents that each shard may hold; without slack they add up to ``rows``."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    bounds = np.array(stretch_bounds(shards, vnodes), dtype=np.int64)
    # The place of a document: the upper 32 bits of a hash of its id, or of what it holds without one.
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    placed = measured(docs).withColumn("place", F.shiftrightunsigned(hashed, 32))

    def stretches(batch: pa.RecordBatch) -> list:
        place = batch.column(batch.schema.get_field_index("place")).to_numpy()
        return [*batch.columns, pa.array(np.searchsorted(bounds, place, side="right").astype(np.int64) - 1)]

    cut = cut_lineage(map_batches(placed, stretches, T.StructType([
        *placed.schema.fields, T.StructField("stretch", T.LongType())])))
    counts = {r.stretch: r.n for r in cut.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).collect()}
    seats = seat(counts, shards, capacities(sum(counts.values()), shards, slack), vnodes)
    shared = spark.sparkContext.broadcast(
        {k: tuple(np.array(x, dtype=np.int64) for x in (s.first, s.shard, s.slot)) for k, s in seats.items()})
    order = Window.partitionBy("stretch").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1)

    def sit(batch: pa.RecordBatch) -> list:
        stretch, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("stretch", "rank"))
        shard, slot = np.empty(len(rank), dtype=np.int32), np.empty(len(rank), dtype=np.int64)
        for k in np.unique(stretch):
            at = np.flatnonzero(stretch == k)
            first, own, base = shared.value[int(k)]
            run = np.searchsorted(first, rank[at], side="right") - 1
            shard[at] = own[run]
            slot[at] = base[run] + rank[at] - first[run]
        return [*[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "size", "text_crc32")],
                pa.array(shard), pa.array(slot)]

    return map_batches(ranked, sit, T.StructType([
        *[placed.schema[c] for c in ("doc_id", "size", "text_crc32")],
        T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents under ``path/shard=<n>``; a shard of a large corpus is many files."""
    seats = assign(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), shards).select("doc_id", "shard")
    docs.join(seats, "doc_id").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
