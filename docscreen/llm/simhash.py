"""SimHash near duplicates: 64-bit fingerprints joined on blocks that close pairs must share.

Method. A fingerprint bit is 1 where more than half of the shingle hashes have it. The 64 bits are
cut in ``BLOCKS`` blocks; two fingerprints that differ in at most 3 bits agree in at least
``BLOCKS - 3`` of them, so joining on every choice of ``BLOCKS - 3`` blocks (20 keys of about 32
bits) loses no pair. Equal fingerprints are one node before anything is joined, so copies never
make pairs; a key shared by many different fingerprints is dealt into cells of bounded size, and
of each cell only a spanning forest leaves the task.

Defined cases: a null text has no words; no words give fingerprint zero, which links like any
other; fewer words than a shingle form one shingle; other columns are ignored; repeated rows give
repeated results; a null doc_id keeps its row with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscreen.llm.common import (cut_lineage, id_and_bytes, local_forest, map_batches,
                                  pairs_in_runs, read, runs, salted_cells, whole_runs)
from docscreen.llm.components import connected_components

SEED = 42
BLOCKS = 6
MAX_BITS = 3
#: Fingerprints of one key compared in one cell.
CELL_ROWS = 2048
_PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six white-space bytes
    if not words:
        return 0
    n = min(shingle, len(words))
    joined = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    hashes = np.array(list(map(partial(xxhash.xxh64_intdigest, seed=SEED), joined)), dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[lo:lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # Sums of at most 2^14 ones, by a product that stays in machine code.
        bits += (np.ones((1, len(part)), dtype=np.float32) @ part.astype(np.float32))[0].astype(np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a signed long."""
    def work(batch: pa.RecordBatch) -> list:
        ids = batch.column(0)
        bits = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return [ids, pa.array(bits.view(np.int64))]

    return map_batches(id_and_bytes(docs), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


def _keys(blocks: int, max_bits: int) -> list[int]:
    """Masks of every choice of blocks that a close pair agrees on."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def close_pairs_forest(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                       cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) of longs that connect all ``nodes.bits`` within ``max_bits`` of each other."""
    masks = F.array(*[F.lit(m).cast("long") for m in _keys(blocks, max_bits)])
    keyed = (nodes.select("bits", F.posexplode(masks).alias("choice", "mask"))
             .select("bits", "choice", F.col("bits").bitwiseAND(F.col("mask")).alias("key")))
    cells = salted_cells(keyed, ["choice", "key"], "bits", cell_rows)
    # Cells go by a hash of the whole key: no partition depends on one key alone.
    placed = (cells.repartition("choice", "key", "cell")
              .sortWithinPartitions("choice", "key", "cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for part in whole_runs(batches, ("choice", "key", "cell")):
            bits = part["bits"]
            first, length = runs(part["choice"], part["key"], part["cell"])
            found = []
            for i, j in pairs_in_runs(first, length, _PAIRS_AT_ONCE):
                # Rows of the same part meet only in the cell of that part.
                meet = (part["part"][i] != part["part"][j]) | part["alone"][i]
                i, j = i[meet], j[meet]
                near = np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)) <= max_bits
                if near.any():
                    found.append(local_forest(bits[i[near]], bits[j[near]]))
            if found:
                a, b = local_forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return placed.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, bits, component_id: the smallest doc_id reachable over links of ``max_bits`` bits."""
    prints = cut_lineage(fingerprints(docs, shingle))
    nodes = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = connected_components(close_pairs_forest(nodes, max_bits))
    rooted = (nodes.join(linked, nodes.bits == linked.node, "left")
              .select("bits", "least", F.coalesce("component", "bits").alias("root")))
    rooted = cut_lineage(rooted)
    # A component's smallest document is not that of its smallest fingerprint.
    roots = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut_lineage(rooted.join(roots, "root").select("bits", "component_id"))
    return prints.join(classes, "bits")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that are the smallest of their class, all columns as they were.

    Rows that repeat a kept doc_id stay, and so do rows without one, which no class can name.
    """
    kept = cut_lineage(near_duplicates(docs, shingle, max_bits).filter("doc_id = component_id")
                       .select("doc_id").distinct())
    # The kept ids grow with the corpus: a merge join at every size, never a broadcast of them.
    return (docs.filter("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
            .unionByName(docs.filter("doc_id is null")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")

