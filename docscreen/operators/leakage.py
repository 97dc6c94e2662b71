"""Label leakage audit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators import dedup, profile
from docscreen.operators.grouping import broadcast_if_small, is_small, unnest, with_group_stats
from docscreen.session import cut_lineage

# Dictionaries up to this size are tested as literals in one pass over the texts.
LITERAL_PHRASES = 300
# Bytes of phrases that every task holds at once.
PORTION_BYTES = 16 << 20


# -- phrases inside texts (J6, L1, L2) ----------------------------------------

def phrase_matches(df: DataFrame, text: str, phrases: DataFrame, row_id: str = "doc_id",
                   keep: Sequence[str] = (), literal_limit: int = LITERAL_PHRASES) -> DataFrame:
    """``(phrase, row_id, *keep)`` for every phrase contained in a text, ignoring case.

    Two exact ways, chosen by measuring the dictionary:

    * small: all phrases are literals of one array expression, JVM-side;
    * large: phrases of up to ``PORTION_BYTES`` make one automaton that every task holds and that
      finds all of them in one pass over a text, however frequent their words are. A larger
      dictionary is dealt into portions, one pass each. Nothing is joined or shuffled.
    """
    distinct = phrases.select("phrase").filter(~X.is_blank(F.col("phrase"))).distinct()
    listed = [r.phrase for r in distinct.limit(literal_limit + 1).collect()]
    if len(listed) <= literal_limit:
        return _literal_matches(df, text, sorted(listed), row_id, keep)
    table = cut_lineage(distinct.withColumn("_low", F.lower("phrase")))
    size = table.agg(F.sum(F.octet_length("phrase") + F.octet_length("_low"))).first()[0]
    portions = -(-size // PORTION_BYTES)
    dealt = F.pmod(F.xxhash64("phrase"), F.lit(portions))
    return reduce(DataFrame.unionByName, [
        _automaton_matches(df, text, table.filter(dealt == i), row_id, keep) for i in range(portions)])


def _automaton_matches(df, text, phrases, row_id, keep):
    said: dict[str, list[str]] = {}
    for r in phrases.collect():  # about PORTION_BYTES
        said.setdefault(r["_low"], []).append(r.phrase)
    shared = df.sparkSession.sparkContext.broadcast(said)
    made: list[ahocorasick.Automaton] = []

    def search(texts: pd.Series) -> pd.Series:
        if not made:  # once a task
            automaton = ahocorasick.Automaton()
            for low, own in shared.value.items():
                automaton.add_word(low, (low, own))
            automaton.make_automaton()
            made.append(automaton)
        return texts.map(lambda t: [p for own in {low: own for _, (low, own) in made[0].iter(t)}.values() for p in own]
                         if t else [])

    hits = F.pandas_udf(search, "array<string>")(F.lower(text)) if said else F.array().cast("array<string>")
    return unnest(df, hits, "phrase", row_id, *keep)


def _literal_matches(df, text, phrases, row_id, keep):
    def search(lowered: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.contains(lowered, F.lit(p.lower())), F.lit(p)) for p in phrases]))

    hits = X.let(F.lower(text), search)
    return unnest(df, hits, "phrase", row_id, *keep)


def phrase_hits(df: DataFrame, text: str, phrases: DataFrame, row_id: str = "doc_id",
                leak_rows: int = C.LEAK_ROWS, literal_limit: int = LITERAL_PHRASES) -> DataFrame:
    """Rows and percent per phrase, phrases without a hit included (L1)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = phrase_matches(df, text, phrases, row_id, (), literal_limit).groupBy(
        "phrase").agg(F.count(F.lit(1)).alias("_rows"))
    return (phrases.select("phrase").distinct().join(counts, "phrase", "left")
            .withColumn("rows", F.coalesce("_rows", F.lit(0))).drop("_rows")
            .withColumn("percent", F.round(F.col("rows") / total * 100, 1))
            .withColumn("leak", F.col("rows") > leak_rows))


def phrase_totals(df: DataFrame, text: str, phrases: DataFrame,
                  row_id: str = "doc_id") -> DataFrame:
    """Pairs of phrase and row, and rows with at least one phrase (L1)."""
    per_row = phrase_matches(df, text, phrases, row_id).groupBy(row_id).agg(
        F.count(F.lit(1)).alias("n"))
    return per_row.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
                       F.count(F.lit(1)).alias("rows_with_phrase"))


def cleaned_phrases(phrases: DataFrame) -> DataFrame:
    """Phrases passed through the cleaning chain; empty ones are dropped."""
    return (phrases.withColumn("phrase", X.clean_text(F.col("phrase")))
            .filter(F.col("phrase") != ""))


def phrase_survivors(df: DataFrame, cleaned: str, phrases: DataFrame,
                     row_id: str = "doc_id") -> DataFrame:
    """Phrases that are still found after cleaning (L2)."""
    return (phrase_matches(df, cleaned, cleaned_phrases(phrases), row_id).groupBy("phrase")
            .agg(F.count(F.lit(1)).alias("rows")))


def phrase_uniformity(df: DataFrame, cleaned: str, phrases: DataFrame, label: str = "label",
                      row_id: str = "doc_id", limit: float = C.UNIFORM_STD) -> DataFrame:
    """Are a phrase's hits spread evenly over classes (L3)?  One class only is not even."""
    per_class = (phrase_matches(df, cleaned, cleaned_phrases(phrases), row_id, [label])
                 .groupBy("phrase", label).agg(F.count(F.lit(1)).alias("n")))
    return (per_class.groupBy("phrase")
            .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"),
                 F.stddev_samp("n").alias("std"))
            .withColumn("uniform", F.coalesce(F.col("std") < limit, F.lit(False))))


# -- the row's own label inside its text (L4-L9) -------------------------------

def label_marker(text: Column, label: Column) -> Column:
    """Explicit ``category: <label>`` line at the end of the text (L4)."""
    body = X.rstrip(text)
    ends = F.endswith(F.lower(body), F.lower(label))
    head = F.left(body, F.length(body) - F.length(label))
    return F.coalesce(ends & head.rlike(C.MARKER_HEAD), F.lit(False))


def label_suffix(text: Column, label: Column, full_unicode: bool = True) -> Column:
    """Normalised text ends with the normalised label as whole words."""
    key, own = X.dedup_key(text, full_unicode), X.dedup_key(label, full_unicode)
    return F.coalesce(F.endswith(F.concat(F.lit(" "), key), F.concat(F.lit(" "), own)),
                      F.lit(False))


def label_suffix_report(df: DataFrame, text: str = "text", label: str = "label",
                        row_id: str = "doc_id", examples: int = 10) -> DataFrame:
    """Counts of L4 and L5 and the first flagged ids."""
    return suffix_numbers(df.select(row_id, label_marker(F.col(text), F.col(label)).alias("marker"),
                                    label_suffix(F.col(text), F.col(label)).alias("suffix")), row_id, examples)


def suffix_numbers(flagged: DataFrame, row_id: str = "doc_id", examples: int = 10) -> DataFrame:
    """The same from rows with the flags ``marker`` and ``suffix``."""
    shown = (flagged.filter("suffix").orderBy(row_id).limit(examples)
             .agg(F.sort_array(F.collect_list(row_id)).alias("ids"))).scalar()
    return flagged.agg(F.count_if("marker").alias("marker_rows"),
                       F.count_if("suffix").alias("suffix_rows")).withColumn("examples", shown)


def label_verbatim(text: Column, label: Column) -> Column:
    return X.contains_ci(text, label)


def label_words(text: Column, label: Column, empty_is: bool, longer_than: int = 3) -> Column:
    """All words of the label longer than three characters occur in the text."""
    def check(lowered: Column) -> Column:
        return X.let(F.filter(X.words(F.lower(label)), lambda w: F.length(w) > longer_than),
                     lambda ws: F.when(F.size(ws) == 0, F.lit(empty_is)).otherwise(
                         F.forall(ws, lambda w: F.contains(lowered, w))))

    return X.let(F.lower(text), check)


def label_position(df: DataFrame, text: str = "text", label: str = "label",
                   row_id: str = "doc_id", around: int = 50) -> DataFrame:
    """Where the label first stands: offset, percent through the text, context."""
    at = F.instr(F.lower(text), F.lower(label)) - 1
    start = F.greatest(F.col("at") - around, F.lit(0))
    end = F.least(F.length(text), F.col("at") + F.length(label) + around)
    return (df.withColumn("at", at).filter(F.col("at") >= 0)
            .select(row_id, "at",
                    F.bround(F.col("at") / F.length(text) * 100, 0).cast("int").alias("percent"),
                    F.replace(F.substring(text, start + 1, end - start), F.lit("\n"), F.lit(" "))
                    .alias("context")))


def label_in_tail(text: Column, label: Column, share: float = 0.9) -> Column:
    """The label occurs in the last tenth of the text."""
    tail = F.substring(F.lower(text), F.floor(F.length(text) * share).cast("int") + 1,
                       F.length(text))
    return F.coalesce(F.contains(tail, F.lower(label)), F.lit(False))


def share_of_rows(df: DataFrame, **flags: Column) -> DataFrame:
    """Rows and percent for each boolean column, in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count_if(c).alias(n) for n, c in flags.items()])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("rows"),
                 F.round(F.col(n) / F.col("_n") * 100, 1).alias("percent")) for n in flags])))


# -- templates (L10, L11) ------------------------------------------------------

def has_template_marker(text: Column, markers: Sequence[str] = C.TEMPLATE_MARKERS) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(markers)), F.lit(False))


def boilerplate(df: DataFrame, text: str = "text", label: str = "label", row_id: str = "doc_id",
                share: float = C.BOILERPLATE_SHARE, window: int = C.BOILERPLATE_WINDOW,
                windows: int = C.BOILERPLATE_WINDOWS,
                min_rows: int = C.TINY_CLASS_ROWS) -> DataFrame:
    """Windows of a class's first text that most texts of the class contain."""
    known = df.filter(F.col(label).isNotNull())
    # Only the first text of a class is carried, by id: the texts are not aggregated.
    joined = with_group_stats(known, [label], row_id, few_keys=True,
                              _first_id=F.min(row_id), _class_rows=F.count(F.lit(1)))
    usable = joined.filter(F.col("_class_rows") >= min_rows)
    anchor = F.left(text, F.lit(C.BOILERPLATE_PREFIX))
    cuts = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.struct(
            i.alias("no"), F.substring(anchor, i * window + 1, F.lit(window)).alias("text"))),
        lambda c: F.length(c["text"]) == window)
    anchors = (usable.filter(F.col(row_id) == F.col("_first_id"))
               .select(F.col(label).alias("_label"), cuts.alias("_cuts")))
    members = usable.join(broadcast_if_small(anchors), F.col(label) == F.col("_label"))
    found = X.let(F.lower(text), lambda low: F.transform("_cuts", lambda c: F.struct(
        c["no"].alias("no"), c["text"].alias("text"),
        F.contains(low, F.lower(c["text"])).alias("hit"))))
    return (unnest(members.withColumn("label", F.col(label)), found, "w", "label")
            .groupBy("label", F.col("w.no").alias("window"),
                     F.left("w.text", F.lit(50)).alias("block"))
            .agg(F.count_if("w.hit").alias("rows"),
                 F.round(F.avg(F.col("w.hit").cast("int")), 6).alias("share"))
            .withColumn("suspicious", F.col("share") > share))


#: Characters of the pieces whose smallest hash marks a window.
MARK_PIECE = 20
#: Marks of all classes that every task may hold.
SHARED_MARKS = 1_000_000
#: Characters whose windows are cut at once.
_CHARS_AT_ONCE = 1 << 18


def boilerplate_windows(df: DataFrame, text: str = "text", label: str = "label",
                        row_id: str = "doc_id", share: float = C.BOILERPLATE_SHARE,
                        window: int = C.BOILERPLATE_WINDOW,
                        min_rows: int = C.TINY_CLASS_ROWS) -> DataFrame:
    """Windows that more than ``share`` of a class's texts have, wherever they stand in them.

    The mark of a window is the smallest hash of the pieces of ``MARK_PIECE`` characters in it, so it
    depends on the window alone, and neighbouring windows mostly have the same one: a text has about
    one distinct mark for 21 characters. Marks are counted by class first. A window that enough texts
    have has a mark that enough texts have, so then only the windows of such marks are cut out, once
    a text, and counted by what they say. Texts are lower-cased; nulls have no window.
    """
    known = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_label"), F.lower(text).alias("_low"))
    sizes = cut_lineage(known.groupBy("_label").agg(F.count(F.lit(1)).alias("_class_rows"))
                        .filter(F.col("_class_rows") >= min_rows))
    counted = known.mapInArrow(_marks(window), f"_label {known.schema['_label'].dataType.simpleString()}, _mark long")
    often = cut_lineage(counted.groupBy("_label", "_mark").agg(F.count(F.lit(1)).alias("_n"))
                        .join(broadcast_if_small(sizes), "_label").filter(F.col("_n") > F.col("_class_rows") * share)
                        .select("_label", "_mark"))
    shared = None
    if is_small(often, SHARED_MARKS):
        own: dict = {}
        for r in often.collect():
            own.setdefault(r["_label"], []).append(r["_mark"])
        shared = df.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in own.items()})
    cut = known.mapInArrow(_windows(window, shared), (
        f"_label {known.schema['_label'].dataType.simpleString()}, _mark long, block string"))
    if shared is None:
        cut = cut.join(often, ["_label", "_mark"], "left_semi")
    return (cut.groupBy("_label", "block").agg(F.count(F.lit(1)).alias("rows"))
            .join(broadcast_if_small(sizes), "_label").filter(F.col("rows") > F.col("_class_rows") * share)
            .select(F.col("_label").alias(label), "block", "rows",
                    F.round(F.col("rows") / F.col("_class_rows"), 6).alias("share")))


def _window_marks(text: str, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, marks of the windows from there on), portion by portion."""
    for lo in range(0, len(text) - window + 1, _CHARS_AT_ONCE):
        part = text[lo:lo + _CHARS_AT_ONCE + window - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        size = min(MARK_PIECE, window)
        h = np.zeros(len(codes) - size + 1, dtype=np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + len(h)] + np.uint64(1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width, span = window - size + 1, 1
        while 2 * span <= width:
            h, span = np.minimum(h[:-span], h[span:]), 2 * span
        if width > span:
            h = np.minimum(h[:span - width], h[width - span:])
        yield lo, h.view(np.int64)


def _marks(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, marks = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for i, low in enumerate(batch.column(1).to_pylist()):
                found = [np.unique(m) for _, m in _window_marks(low or "", window)]
                marks.append(np.unique(np.concatenate([marks[0], *found])))
                at.append(np.full(len(marks[-1]), i))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))),
                                              pa.array(np.concatenate(marks))], names=["_label", "_mark"])

    return work


def _windows(window: int, shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks, blocks = [], [], []
            for row, (label, low) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                wanted = shared.value.get(label) if shared else None
                if shared and wanted is None:
                    continue
                found: dict[str, int] = {}
                for lo, own in _window_marks(low or "", window):
                    at = np.flatnonzero(np.isin(own, wanted)) if shared else np.arange(len(own))
                    found.update((low[lo + i:lo + i + window], m) for i, m in zip(at.tolist(), own[at].tolist()))
                rows += [row] * len(found)
                marks += found.values()
                blocks += found
                if len(rows) >= _CHARS_AT_ONCE:
                    yield _cut(batch, rows, marks, blocks)
                    rows, marks, blocks = [], [], []
            yield _cut(batch, rows, marks, blocks)

    return work


def _cut(batch: pa.RecordBatch, rows: list, marks: list, blocks: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(marks, pa.int64()),
                                       pa.array(blocks, pa.string())], names=["_label", "_mark", "block"])


# -- verdicts (L12, L13) --------------------------------------------------------

def leak_verdict(df: DataFrame, text: str = "text", label: str = "label",
                 row_id: str = "doc_id") -> DataFrame:
    """Points for verbatim labels, template markers, repeats and conflicts, and the verdict."""
    spark = df.sparkSession
    rows = df.agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label_verbatim(F.col(text), F.col(label))).alias("verbatim"),
        F.count_if(has_template_marker(F.col(text))).alias("markers")).alias("r"))
    groups = dedup.key_groups(df, F.col(text), label, row_id).agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("repeats"),
        F.count_if(F.col("labels") > 1).alias("conflicts")).alias("g"))
    n = F.col("r.n")
    points = (F.when(F.col("r.verbatim") > n * 0.3, 3).when(F.col("r.verbatim") > n * 0.05, 1)
              .otherwise(0)
              + F.when(F.col("r.markers") > 0, 2).otherwise(0)
              + F.when(F.col("g.repeats") > n * 0.1, 1).otherwise(0)
              + F.when(F.col("g.conflicts") > 0, 2).otherwise(0))
    return (profile.one_row(spark, r=rows, g=groups)
            .select("r.verbatim", "r.markers", "g.repeats", "g.conflicts", points.alias("points"))
            .withColumn("verdict", F.when(F.col("points") == 0, "pass")
                        .when(F.col("points") <= 2, "minor").otherwise("fail")))


def leak_hypotheses(shared_texts: DataFrame, survivors: DataFrame, totals: DataFrame,
                    corpus: DataFrame) -> DataFrame:
    """Severity of each leakage hypothesis.

    The inputs are results of ``split_overlap``, ``phrase_survivors`` and ``phrase_totals``.
    """
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum(name), F.lit(0)))

    parts = profile.one_row(
        corpus.sparkSession, overlap=total(shared_texts, "shared"),
        survive=total(survivors, "rows"), phrase=total(totals, "rows_with_phrase"),
        n=corpus.agg(F.count(F.lit(1))))
    survive, phrase = F.col("survive"), F.col("phrase")
    rows = F.array(
        F.struct(F.lit("texts shared between splits").alias("hypothesis"),
                 F.when(F.col("overlap") > 0, "HIGH").otherwise("LOW").alias("severity"),
                 F.col("overlap").alias("evidence")),
        F.struct(F.lit("label phrase survives cleaning").alias("hypothesis"),
                 F.when(survive > 1000, "HIGH").when(survive > 100, "MEDIUM")
                 .otherwise("LOW-MEDIUM").alias("severity"), survive.alias("evidence")),
        F.struct(F.lit("label phrase in text").alias("hypothesis"),
                 F.when(phrase > F.col("n") * 0.5, "HIGH").otherwise("MEDIUM").alias("severity"),
                 phrase.alias("evidence")))
    return parts.select(F.inline(rows))
