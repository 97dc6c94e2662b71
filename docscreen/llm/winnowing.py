"""Benchmark decontamination by winnowed k-gram fingerprints.

Method. A span of ``SPAN`` words holds ``SPAN - GRAM + 1`` k-grams; the smallest of their hashes is
its fingerprint, so two texts that share the span share the fingerprint: no shared span of that
length can be missed. Training and benchmark spans are joined on fingerprint and words, and hits
that overlap are extended to the covered words. Items of fewer than ``SPAN`` words are one span of
their own length, whose fingerprint is the hash of all of it.

Documents only send the spans whose fingerprint may belong to the benchmark, told by a bitmap of
fixed size. However large the benchmark, the bitmap stays at ``2^FILTER_BITS`` bits; a full bitmap
lets everything through to the join, which alone decides.

Defined cases: null or wordless documents have no hits, wordless items no spans; an item_id that
repeats counts once; a null item_id is left out; other columns are ignored; documents that repeat
a doc_id share their hits (a null doc_id is one id).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.llm.common import cut_lineage, map_batches, read
from docscreen.llm.words import ALNUM_LOWER, chunks, run_hashes, sliding_min, split_words

SPAN = 10
GRAM = 5
FILTER_BITS = 23

_SPANS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()),
                                   T.StructField("print", T.LongType()), T.StructField("words", T.StringType())]))


def _slot(prints: np.ndarray) -> np.ndarray:
    return prints >> np.uint64(64 - FILTER_BITS)


def _spans(values: list[bytes | None], lengths: tuple[int, ...], whole_only: bool, keep: np.ndarray | None):
    """counts of words and (text, at, n, print, words) of the spans.

    ``lengths``: spans to look for besides those of SPAN words. ``whole_only``: texts of fewer
    words are one span themselves.
    """
    words = split_words(values, ALNUM_LOWER)
    counts, hashes = words.counts, words.hashes()
    left, text = words.left_in_text(), words.text_of_word()
    found = []
    for n in (SPAN, *lengths):
        prints = sliding_min(run_hashes(hashes, GRAM), SPAN - GRAM + 1) if n == SPAN else run_hashes(hashes, n)
        ok = left[:len(prints)] >= n
        if n != SPAN and whole_only:
            ok &= counts[text[:len(prints)]] == n
        if keep is not None:
            slot = _slot(prints)
            ok &= (keep[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        for at in np.flatnonzero(ok).tolist():
            found.append((int(text[at]), at - int(words.first[text[at]]), n, int(prints[at].view(np.int64)),
                          b" ".join(words.words(at, at + n)).decode("utf-8", "replace")))
    found.sort(key=lambda s: s[:3])
    return counts, found


def spans(table: DataFrame, row_id: str, lengths: tuple[int, ...] = (), whole_only: bool = False,
          keep: np.ndarray | None = None) -> DataFrame:
    """row_id, n_words and the spans of each text, only those that ``keep`` may hold."""
    shared = table.sparkSession.sparkContext.broadcast(keep) if keep is not None else None
    schema = T.StructType([T.StructField(row_id, table.schema[row_id].dataType),
                           T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS)])

    def work(batch: pa.RecordBatch) -> list:
        texts = batch.column(1).to_pylist()
        counts: list[int] = []
        own: list[list[dict]] = []
        for lo, hi in chunks(texts):
            n, found = _spans(texts[lo:hi], lengths, whole_only, shared.value if shared else None)
            lists: list[list[dict]] = [[] for _ in range(hi - lo)]
            for i, at, size, mark, said in found:
                lists[i].append({"at": at, "n": size, "print": mark, "words": said})
            counts += n.tolist()
            own += lists
        return [batch.column(0), counts, own]

    return map_batches(table.select(row_id, F.col("text").cast("binary").alias("text")), work, schema)


def benchmark_spans(benchmark: DataFrame) -> DataFrame:
    """item_id, n, print, words: the distinct spans of the benchmark."""
    named = spans(benchmark.filter("item_id is not null"), "item_id", tuple(range(1, SPAN)), whole_only=True)
    return (named.select("item_id", F.explode("spans").alias("s"))
            .select("item_id", "s.n", "s.print", "s.words").distinct())


def _bitmap(item_spans: DataFrame) -> np.ndarray:
    """Bits of all fingerprints: at most 2^FILTER_BITS / 64 rows come to the driver."""
    slot = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    bits = (item_spans.select(slot.alias("slot")).distinct()
            .select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit")))
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row.word] = row.bits & ((1 << 64) - 1)
    return out


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words of every document), (doc_id, at, n, item_id of every hit)."""
    items = cut_lineage(benchmark_spans(benchmark))
    short = tuple(sorted(r.n for r in items.filter(F.col("n") < SPAN).select("n").distinct().collect()))
    found = cut_lineage(spans(docs, "doc_id", short, keep=_bitmap(items)))
    # Copies of a hot passage meet one short list of items; both sides are plain exchanges, so a
    # hot fingerprint is split by the skew join.
    met = (found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
           .join(items, ["n", "print", "words"]).select("doc_id", "at", "n", "item_id"))
    return found.select("doc_id", "n_words"), cut_lineage(met)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), covered (array of [first, last))."""
    sizes, met = hits(docs, benchmark)
    own = met.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("at", "n"))).alias("places"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    # Overlapping hits become one range.
    covered = F.expr("""
        aggregate(places, named_struct('done', cast(array() as array<struct<first: int, last: int>>),
                                       'open', named_struct('first', -1, 'last', -1)),
          (acc, x) -> if(acc.open.first >= 0 and x.at <= acc.open.last,
             named_struct('done', acc.done, 'open', named_struct('first', acc.open.first,
                                                                 'last', greatest(acc.open.last, x.at + x.n))),
             named_struct('done', if(acc.open.first < 0, acc.done, concat(acc.done, array(acc.open))),
                          'open', named_struct('first', x.at, 'last', x.at + x.n))),
          acc -> concat(acc.done, array(acc.open)))""")
    own = own.select(F.col("doc_id").alias("hit_id"), "item_ids", covered.alias("covered"))
    empty = F.array().cast("array<string>")
    return (sizes.join(own, sizes.doc_id.eqNullSafe(own.hit_id), "left")
            .select("doc_id", "n_words",
                    F.coalesce(F.expr("aggregate(covered, 0L, (s, c) -> s + c.last - c.first)"), F.lit(0)).alias("n_hit"),
                    F.coalesce("item_ids", empty).alias("item_ids"),
                    F.coalesce("covered", F.expr("cast(array() as array<struct<first: int, last: int>>)")).alias("covered")))


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a hit, all columns as they were."""
    _, met = hits(docs, benchmark)
    bad = met.select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.hit_id), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits_by_force(docs: dict[int, bytes | None], items: dict[int, bytes | None]) -> dict[int, tuple[int, int, list[int]]]:
    """(n_words, n_hit, item_ids) from plain comparisons; for checks on small tables."""
    cut = lambda t: _WORD.findall((t or b"").lower())
    windows: dict[tuple[bytes, ...], set[int]] = {}
    for item, text in items.items():
        words = cut(text)
        n = min(SPAN, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs.items():
        words = cut(text)
        hit, met = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i:i + n])):
                    met |= own
                    hit |= set(range(i, i + n))
        out[doc] = (len(words), len(hit), sorted(met))
    return out
