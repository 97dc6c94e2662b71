"""Exact removal of repeated word sequences through a compacted De Bruijn graph.

Method. A window of ``k`` consecutive words is an edge of the graph (between its first and its
last k - 1 words). Consecutive windows with the same minimizer, the smallest hash of the 10-word
runs inside the window, travel as one row: a stretch of a path that nothing branches off from. A
window is known by its minimizer and its own hash, two 64-bit sums of powers over 64-bit word hashes
(XXH64 for words of more than 32 bytes); the texts themselves are not compared again.

1. Minimizers that occur once cannot lie in a repeated window; a join leaves only the others.
2. Equal stretches are one path class with its smallest source (doc_id, start). Copies are gone
   from here on, however many there are.
3. Where a minimizer has several classes, paths branch: their windows are taken apart, the smallest
   source of each window is found over all classes, and neighbouring windows whose sources advance
   together are compacted into paths again by a join with the classes.
4. Every occurrence joins the paths of its class. One that does not lie at the path's own source
   coordinates repeats an earlier one, and the words it covers go.

Defined cases: a null text has no words; texts of fewer than ``k`` words lose nothing; other
columns are ignored; ids of any type that has an order. Rows that share a doc_id are one document
that starts anew in each row: a window is not repeated by one at the same place of another row, and
of equal windows the one with the smallest start stays, in every row that has it there. A null doc_id
counts as smallest.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.llm.common import cut_lineage, id_and_bytes, map_batches, read
from docscreen.llm.words import SPACED, chunks, run_hashes, sliding_min, split_words

WINDOW = 20
#: Words of the runs whose smallest hash is a window's minimizer.
RUN = 10
#: Windows in a row at most; longer stretches (text that repeats itself) go on in the next row.
STRETCH = 16


def _stretches(values: list[bytes | None], k: int, run: int):
    """Arrays of the stretches of some texts: text, start, minimizer, repeats, windows (CSR)."""
    words = split_words(values, SPACED)
    hashes = words.hashes()
    if len(hashes) < k:
        return None
    low = sliding_min(run_hashes(hashes, run), k - run + 1)
    at = np.flatnonzero(words.left_in_text()[:len(low)] >= k)
    if not len(at):
        return None
    windows, low, text = run_hashes(hashes, k)[at], low[at], words.text_of_word()[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inside % STRETCH == 0)
    number = np.cumsum(inside % STRETCH == 0) - 1
    repeats = np.zeros(len(first), dtype=bool)
    for step in range(1, STRETCH):
        same = np.flatnonzero((windows[step:] == windows[:-step]) & (number[step:] == number[:-step]))
        repeats[number[same]] = True
    return (text[first], at[first] - words.first[text[first]], low[first].view(np.int64), repeats,
            np.append(first, len(at)), windows.view(np.int64))


def _mark(text: bytes | None) -> int:
    """Tells rows of one doc_id apart; rows with equal texts lose the same words."""
    return (zlib.crc32(text or b"") ^ 0x80000000) - 0x80000000


def stretches(docs: DataFrame, k: int = WINDOW, run: int = RUN, with_windows: bool = True) -> DataFrame:
    """minimizer and, ``with_windows``, doc_id, mark, start and the windows of each stretch; else how
    often the minimizer counts (twice if a window repeats inside the stretch)."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("minimizer", T.LongType()), *(
        [T.StructField("doc_id", id_type), T.StructField("mark", T.IntegerType()), T.StructField("start", T.LongType()),
         T.StructField("windows", T.ArrayType(T.LongType()))] if with_windows
        else [T.StructField("times", T.IntegerType())])])

    def work(batch: pa.RecordBatch) -> list | None:
        texts, out = batch.column(1).to_pylist(), []
        for lo, hi in chunks(texts):
            made = _stretches(texts[lo:hi], k, run)
            if made is None:
                continue
            text, start, low, repeats, bounds, windows = made
            if with_windows:
                marks = np.array([_mark(t) for t in texts[lo:hi]], dtype=np.int32)
                out.append([pa.array(low), batch.column(0).take(pa.array(text + lo)), pa.array(marks[text]), pa.array(start),
                            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(windows))])
            else:
                out.append([pa.array(low), pa.array(1 + repeats.astype(np.int32))])
        return [pa.concat_arrays(c) for c in zip(*out, strict=True)] if out else None

    return map_batches(id_and_bytes(docs), work, schema)


def _source(doc: str, start: str) -> F.Column:
    return F.struct(F.col(doc).alias("doc"), F.col(start).alias("at"))


def repeated_spans(docs: DataFrame, k: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, mark, first, last: word ranges (last exclusive) that windows seen before cover."""
    again = cut_lineage(stretches(docs, k, run, with_windows=False).groupBy("minimizer")
                        .agg(F.sum("times").alias("n")).filter("n > 1").select("minimizer"))
    seen = cut_lineage(stretches(docs, k, run).join(again, "minimizer")
                       .withColumn("path", F.xxhash64("windows")))
    classes = cut_lineage(seen.groupBy("minimizer", "path").agg(
        F.min(_source("doc_id", "start")).alias("source"), F.first("windows").alias("windows")))
    forks = cut_lineage(classes.groupBy("minimizer").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("windows") - F.size(F.array_distinct("windows"))).alias("inner"))
        .filter("n > 1 or inner > 0").select("minimizer"))
    straight = (classes.join(forks, "minimizer", "left_anti")
                .select("minimizer", "path", F.array(F.struct(
                    F.lit(0).alias("i"), F.size("windows").alias("n"), F.col("source.doc").alias("doc"),
                    F.col("source.at").alias("at"))).alias("pieces")))
    apart = cut_lineage(classes.join(forks, "minimizer")
                        .select("minimizer", "path", "source", F.posexplode("windows").alias("i", "window"))
                        .withColumn("at", F.col("source.at") + F.col("i")))
    edges = cut_lineage(apart.groupBy("minimizer", "window")
                        .agg(F.min(F.struct(F.col("source.doc").alias("doc"), F.col("at").alias("at"))).alias("edge")))
    rows = (apart.select("minimizer", "path", "i", "window").join(edges, ["minimizer", "window"])
            .groupBy("minimizer", "path")
            .agg(F.sort_array(F.collect_list(F.struct("i", "edge.doc", "edge.at"))).alias("own")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    branching = rows.select("minimizer", "path", _compacted("own", id_type).alias("pieces"))
    paths = cut_lineage(straight.unionByName(branching))
    found = (seen.select("minimizer", "path", "doc_id", "mark", "start").join(paths, ["minimizer", "path"])
             .select("doc_id", "mark", "start", F.explode("pieces").alias("p"))
             .select("doc_id", "mark", (F.col("start") + F.col("p.i")).alias("first"), "p.n", "p.doc", "p.at"))
    return (found.filter(~(F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("first"))))
            .select("doc_id", "mark", "first", (F.col("first") + F.col("n") + F.lit(k - 1)).alias("last")))


def _compacted(column: str, id_type: str) -> F.Column:
    """Neighbouring windows whose sources advance together, as one piece (at most STRETCH long)."""
    return F.expr(f"""
        aggregate({column}, cast(array() as array<struct<i: int, n: int, doc: {id_type}, at: bigint>>), (acc, x) ->
          if(try_element_at(acc, -1).doc <=> x.doc
               and try_element_at(acc, -1).at + try_element_at(acc, -1).n = x.at,
             concat(slice(acc, 1, size(acc) - 1), array(named_struct('i', try_element_at(acc, -1).i,
               'n', try_element_at(acc, -1).n + 1, 'doc', x.doc, 'at', x.at - try_element_at(acc, -1).n))),
             concat(acc, array(named_struct('i', x.i, 'n', 1, 'doc', x.doc, 'at', x.at)))))""")


def _without(text: bytes | None, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    words = (text or b"").split()  # of bytes: the six white-space bytes
    if not spans:
        return len(words), words
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, [s["first"] for s in spans], 1)
    np.add.at(cover, [s["last"] for s in spans], -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(words), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _with_spans(docs: DataFrame, k: int, run: int) -> DataFrame:
    spans = cut_lineage(repeated_spans(docs, k, run).distinct())
    spans = (spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
             .withColumnsRenamed({"doc_id": "span_id", "mark": "span_mark"}))
    own = id_and_bytes(docs)
    signed = F.crc32(F.coalesce("text", F.lit(b"")))
    signed = F.when(signed >= 1 << 31, signed - (1 << 32)).otherwise(signed).cast("int")
    return (own.withColumn("mark", signed)
            .join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("mark") == F.col("span_mark")), "left")
            .select("doc_id", "text", "spans"))


def remove_repeats(docs: DataFrame, k: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed and ``text``, the kept words joined by one space."""
    def work(batch: pa.RecordBatch) -> list:
        made = [_without(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return [batch.column(0), [n for n, _ in made], [n - len(w) for n, w in made],
                [b" ".join(w).decode("utf-8", "replace") for _, w in made]]

    return map_batches(_with_spans(docs, k, run), work, _schema(docs, "text string"))


def _schema(docs: DataFrame, last: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, {last}"


def query(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def removed_by_force(texts: dict[int, bytes | None], k: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same result one window at a time; for checks on small tables."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for doc in sorted(texts):
        words = (texts[doc] or b"").split()
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            window = tuple(words[i:i + k])
            if window in seen:
                gone[i:i + k] = [True] * k
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
