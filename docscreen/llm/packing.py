"""Best-fit packing of tokenised documents under several capacities at once.

Method. Every piece has a vector of demands: tokens, documents (one) and attention cost (tokens
squared). A sequence is a bin with a capacity for each. Pieces go in by falling length; a piece
goes to the open bin, among those with room in every dimension, with the smallest weighted norm of
what would be left over (``rule="norm"``) or the largest weighted dot product of its demands with
the bin's residuals (``rule="dot"``); with no such bin a new one is opened.

Pieces of one length have equal demands and bins of one state have equal residuals, so the plan is
made for lengths and states, not for pieces: at most ``capacity`` lengths come to the driver with
their counts, whatever the size of the corpus, and the plan is a list of steps "pieces a..b of
length L go to bins c..d, q to a bin, from token o". Each piece then finds its step by its rank
among the pieces of its length. Ranks come from hash buckets, so a length that a third of the
corpus shares is ranked by many tasks.

Defined cases: a null or empty text is the closing id 0 alone; a text longer than a sequence is
cut, its first piece being the short one; other columns are ignored; repeated rows are packed once
each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docscreen.llm.common import cut_lineage, map_batches, read

#: What the tokenizer's byte-level pre-tokenizer splits a text by (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_END = b"\0\0\0\0"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for
    themselves, the others for 256, 257, .. in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer file gives the vocabulary and its special tokens. Its merges are ranked by id,
    so the byte-pair engine of tiktoken gives the same ids four times as fast; the tests hold the
    two against each other.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, byte_of = Tokenizer.from_file(path), _byte_of()
        tokenizer = self.tokenizer
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items()
                 if token not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regular expressions give up on millions of spaces in a row
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4").tobytes() + _END


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every piece of every document."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        *[T.StructField("ids", T.BinaryType())] * with_ids])

    def work(batch: pa.RecordBatch) -> list:
        encode, rows = token_ids(path).ids, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "")
            total = len(ids) // 4
            at, piece = 0, 0
            while at < total:
                length = (total - at) % capacity or capacity
                part = ids[4 * at:4 * (at + length)]
                rows.append((doc_id, piece, at, length, zlib.crc32(part), part)[:5 + with_ids])
                at, piece = at + length, piece + 1
        return list(zip(*rows, strict=True))

    return map_batches(docs.select("doc_id", "text"), work, schema)


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold. By default documents and attention never bind before tokens do."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: Weights of the three residuals, each taken as a share of its capacity.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


def plan(counts: dict[int, int], room: Capacities = Capacities(), rule: str = "norm") -> list[tuple[int, ...]]:
    """Steps (length, first rank, pieces, first bin, pieces a bin, first offset) for piece counts."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule is 'norm' or 'dot', not {rule!r}")
    scale = room.vector.astype(float)
    weights = np.array(room.weights)
    # One state per row: residual tokens, documents, attention; first bin, bins, tokens used.
    left = np.zeros((0, 3), dtype=np.int64)
    bins = np.zeros((0, 2), dtype=np.int64)
    steps: list[tuple[int, ...]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if (demand > room.vector).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity of an empty sequence")
        rank, todo = 0, counts[length]
        parted: list[tuple[np.ndarray, tuple[int, int]]] = []
        fits = (left >= demand).all(axis=1)
        if rule == "norm":
            score = -(weights * ((left - demand) / scale) ** 2).sum(axis=1)
        else:
            score = (weights * (left / scale) * (demand / scale)).sum(axis=1)
        for state in np.argsort(-score, kind="stable"):
            if not todo:
                break
            if not fits[state]:
                continue
            deep = int((left[state] // demand).min())
            todo, rank = _fill(steps, parted, left, bins, state, demand, deep, todo, rank, room.tokens)
        if todo:
            deep = int((room.vector // demand).min())
            left = np.vstack([left, room.vector])
            bins = np.vstack([bins, (opened, -(-todo // deep))])
            opened += -(-todo // deep)
            state = len(left) - 1
            todo, rank = _fill(steps, parted, left, bins, state, demand, deep, todo, rank, room.tokens)
        for residual, span in parted:
            left, bins = np.vstack([left, residual]), np.vstack([bins, span])
        keep = (bins[:, 1] > 0) & (left > 0).all(axis=1)
        left, bins = left[keep], bins[keep]
    return steps


def _fill(steps: list, parted: list, left: np.ndarray, bins: np.ndarray, state: int, demand: np.ndarray,
          deep: int, todo: int, rank: int, tokens: int) -> tuple[int, int]:
    """Put up to ``deep`` pieces in each bin of a state; bins that get fewer go to ``parted``."""
    first, n = (int(x) for x in bins[state])
    offset = tokens - int(left[state][0])
    full, rest = min(todo // deep, n), 0
    if full < n:
        rest = todo - full * deep
    placed = full * deep + rest
    steps.append((int(demand[0]), rank, placed, first, deep, offset))
    before = left[state].copy()
    left[state] = before - deep * demand
    bins[state] = (first, full)
    if rest:
        parted.append((before - rest * demand, (first + full, 1)))
    untouched = n - full - bool(rest)
    if untouched:
        parted.append((before, (first + full + bool(rest), untouched)))
    return todo - placed, rank + placed


def ranked(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """Rows with ``rank``, 0.. without gaps among those of one length.

    Ranks are counted within (length, bucket of the id) and moved by the sizes of the buckets
    before, so no task sees all rows of a length.
    """
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = placed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (placed.withColumn("rank", F.row_number().over(inside) - 1)
            .join(starts, ["length", "bucket"])
            .withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base"))


def pack(docs: DataFrame, room: Capacities = Capacities(), rule: str = "norm",
         path: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset, their place in it (gapless from 0)."""
    spark = docs.sparkSession
    rows = cut_lineage(pieces(docs, room.tokens, path or tokenizer_path()))
    # One row per length: at most room.tokens of them.
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, room, rule)
    # By length, its steps in the order of ranks; a piece's step is the last that starts at or
    # before its rank. Their number depends on the lengths, not on the number of documents.
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for step in steps:
        by_length.setdefault(step[0], []).append(step[1:])
    shared = spark.sparkContext.broadcast(
        {n: (np.array([s[0] for s in own]), np.array(own, dtype=np.int64)) for n, own in by_length.items()})
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    names = rows.columns

    def work(batch: pa.RecordBatch) -> list:
        table = shared.value
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
        bin_of, offset = np.empty_like(rank), np.empty_like(rank)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            starts, own = table[int(n)]
            step = own[np.searchsorted(starts, rank[at], side="right") - 1]
            inside = rank[at] - step[:, 0]
            bin_of[at] = step[:, 2] + inside // step[:, 3]
            offset[at] = step[:, 4] + inside % step[:, 3] * n
        return [*[batch.column(batch.schema.get_field_index(c)) for c in names],
                pa.array(bin_of), pa.array(offset)]

    return map_batches(ranked(rows), work, schema)


def sequences(docs: DataFrame, packed: DataFrame, room: Capacities = Capacities(),
              path: str | None = None) -> DataFrame:
    """sequence_id and ``ids``, the token ids of each packed sequence in order.

    Rows are told apart by id, place and checksum; those that agree in all of these have the same
    ids and take the places of ``packed`` one after the other. A null doc_id is an id of its own.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    have = pieces(docs, room.tokens, path or tokenizer_path(), with_ids=True).withColumn(
        "nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    place = packed.select(*[F.col(k).alias(f"_{k}") for k in keys], "sequence_id", "offset", F.row_number().over(
        Window.partitionBy(*keys).orderBy("sequence_id", "offset")).alias("_nth"))
    same = F.lit(True)
    for k in [*keys, "nth"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = have.join(place, same).select("sequence_id", "offset", "ids")

    def work(batch: pa.RecordBatch) -> list:
        parts = batch.column(1).to_pylist()
        return [batch.column(0), [np.concatenate([np.frombuffer(p["ids"], dtype="<u4") for p in ps]).tolist()
                                  for ps in parts]]

    whole = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return map_batches(whole, work, "sequence_id long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
