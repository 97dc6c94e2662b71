"""Skill dictionaries and the columns that find their entries in a text.

Small dictionaries are parameters: each entry becomes one literal condition that is compiled once per
task.  A plain containment test goes first: it is far cheaper than the regular expression and
rejects almost every entry.  Dictionaries of any size are tables (``with_skills``): each entry is
filed under the words it holds, and the words of a text fetch the entries to compare.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docscreen import constants as C
from docscreen.functions.text import let

_BEFORE_WORD = rf"(?<![{C.WORD}])"
_AFTER_WORD = rf"(?![{C.WORD}])"
_WORD_CHAR = re.compile(r"\w")
_ESCAPED = re.compile(r"([\\.\[\]{}()*+?^$|#&~\-\s])")


def escape(literal: str) -> str:
    return _ESCAPED.sub(r"\\\1", literal)


def skill_pattern(skill: str) -> str:
    """Word boundary next to a word character, otherwise white space or a text end."""
    before = _BEFORE_WORD if _WORD_CHAR.match(skill[0]) else rf"(?:^|[{C.SPACE}])"
    open_ended = _WORD_CHAR.match(skill[-1]) or skill in C.OPEN_ENDED_SKILLS
    after = _AFTER_WORD if open_ended else rf"(?:$|[{C.SPACE}])"
    return before + escape(skill) + after


def skill_vocabulary(requirements: Mapping[str, Iterable[str]] | None = None,
                     extra: Iterable[str] = C.EXTRA_SKILLS) -> dict[str, str]:
    """Lower-case skill -> display name.  The last role listing a skill decides its casing."""
    display: dict[str, str] = {}
    for skills in (requirements or {}).values():
        for skill in skills:
            display[skill.lower()] = skill
    for skill in extra:
        display.setdefault(skill.lower(), skill.title())
    for skill, name in C.SKILL_DISPLAY.items():
        if skill in display:
            display[skill] = name
    return display


def find_skills(text: Column, vocabulary: Mapping[str, str]) -> Column:
    """Sorted array of the display names found in ``text``."""

    def search(lowered: Column) -> Column:
        hits = [F.when(F.contains(lowered, F.lit(skill)) & lowered.rlike(skill_pattern(skill)),
                       F.lit(name))
                for skill, name in vocabulary.items()]
        return F.sort_array(F.array_compact(F.array(*hits)))

    return let(F.lower(F.coalesce(text, F.lit(""))), search)


# -- dictionaries as tables (J7) -------------------------------------------------

#: Bytes of a dictionary that every task may hold.
SHARED_BYTES = 64 << 20
#: Texts whose entries a task holds at once: an Arrow batch has thousands of texts, each with hundreds of entries.
ROWS_AT_ONCE = 256
_RUN = regex.compile(rf"[{C.WORD}]+")
_SPACES = frozenset(C.SPACE_CHARS)


def _is_word(c: str) -> bool:
    return c == "_" or c.isalpha() or c.isnumeric()


def anchor(skill: str) -> tuple[str, int]:
    """What an entry is filed under, and where it starts in the entry.

    Boundaries make every word of an entry a whole word of the text.  Two neighbouring words with
    what stands between them are rarer than one; the longest such pair is taken.  An entry
    without a word is filed under the empty text.
    """
    runs = [m.span() for m in _RUN.finditer(skill)]
    pairs = [(a, d) for (a, _), (_, d) in zip(runs, runs[1:])] or runs
    if not pairs:
        return "", 0
    start, end = max(pairs, key=lambda p: (p[1] - p[0], -p[0]))
    return skill[start:end], start


def _keys(text: str, widest: int) -> Iterator[tuple[str, int]]:
    """Words, and pairs of neighbouring words at most ``widest`` characters apart, with their places."""
    before = None
    for m in _RUN.finditer(text):
        start, end = m.span()
        yield text[start:end], start
        if before is not None and start - before[1] <= widest:
            yield text[before[0]:end], before[0]
        before = (start, end)


def _bounded(text: str, skill: str, start: int) -> bool:
    """Whether ``skill`` stands at ``start`` with the boundaries of ``skill_pattern``."""
    if start < 0 or not text.startswith(skill, start):
        return False
    left, end = text[start - 1:start], start + len(skill)
    right = text[end:end + 1]
    if left and (_is_word(left) if _is_word(skill[0]) else left not in _SPACES):
        return False
    open_ended = _is_word(skill[-1]) or skill in C.OPEN_ENDED_SKILLS
    return not right or not (_is_word(right) if open_ended else right not in _SPACES)


@dataclass
class SkillIndex:
    """Entries by what they are filed under: (skill, name, offset of the key)."""

    entries: dict[str, list[tuple[str, str, int]]]
    widest: int

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str]]) -> "SkillIndex":
        entries: dict[str, list[tuple[str, str, int]]] = {}
        for skill, name in rows:
            if skill:
                key, offset = anchor(skill)
                entries.setdefault(key, []).append((skill, name, offset))
        gaps = [len(g) for k in entries for g in _RUN.split(k)[1:-1]]
        return cls(entries, max(gaps, default=0))

    def names(self, lowered: str) -> list[str]:
        found = {}
        for key, at in _keys(lowered, self.widest):
            for skill, name, offset in self.entries.get(key, ()):
                if skill not in found and _bounded(lowered, skill, at - offset):
                    found[skill] = name
        for skill, name, _ in self.entries.get("", ()):
            at = lowered.find(skill)
            while at >= 0 and skill not in found:
                if _bounded(lowered, skill, at):
                    found[skill] = name
                at = lowered.find(skill, at + 1)
        return sorted(found.values())


def with_skills(df: DataFrame, text: str, vocabulary: DataFrame, row_id: str = "doc_id", output: str = "skills",
                shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``df`` plus the sorted names of the entries found, as ``find_skills`` would give them.

    ``vocabulary`` (skill in lower case, name) may have any number of rows, one a skill; null or empty skills
    match nothing.  Up to ``shared_bytes`` of it travel to every task and no row moves.  Beyond, the
    keys of the texts, narrow rows, join the keys of the entries, and each text is compared with
    the entries that its keys have fetched.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    table = vocabulary.filter("skill is not null and skill <> ''").select("skill", "name")
    size = table.agg(F.sum(F.octet_length("skill") + F.octet_length("name"))).first()[0] or 0
    spark = df.sparkSession
    if size <= shared_bytes:
        shared = spark.sparkContext.broadcast(SkillIndex.of((r.skill, r.name) for r in table.collect()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(lo, ROWS_AT_ONCE)
                    found = [shared.value.names(t) for t in part.column(part.num_columns - 1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.list_(pa.string()))],
                                                     names=[*part.schema.names[:-1], output])

        kept = df.drop(output)
        return kept.withColumn("_lowered", lowered).mapInArrow(search, StructType([*kept.schema.fields, StructField(
            output, ArrayType(StringType()))]))

    def filed(skills: pd.Series) -> pd.Series:
        return skills.map(lambda x: anchor(x)[0])

    def asked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ["", *{k for k, _ in _keys(t, widest)}])

    def compared(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([SkillIndex.of((k["skill"], k["name"]) for k in own).names(t) if own is not None and len(own) else []
                          for t, own in zip(texts, known)])

    def gap(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: max((len(g) for g in _RUN.split(k)[1:-1]), default=0))

    entries = table.withColumn("_key", F.pandas_udf(filed, "string")("skill"))
    widest = entries.agg(F.max(F.pandas_udf(gap, "int")("_key"))).first()[0] or 0
    keys = df.select(row_id, F.explode(F.pandas_udf(asked, "array<string>")(lowered)).alias("_key"))
    met = (keys.join(entries, "_key").groupBy(row_id).agg(F.collect_set(F.struct("skill", "name")).alias("_known"))
           .withColumnRenamed(row_id, "_row"))
    return (df.join(met, F.col(row_id).eqNullSafe(F.col("_row")), "left")
            .withColumn(output, F.pandas_udf(compared, "array<string>")(lowered, F.col("_known")))
            .drop("_known", "_row"))


def find_skill_matches(text: Column, aliases: Mapping[str, Iterable[str]] = C.SKILL_ALIASES,
                       ) -> Column:
    """``map<skill, array<matched substring>>``, substrings distinct ignoring case."""

    def first_seen(found: Column) -> Column:
        lowered = F.transform(found, F.lower)
        return let(lowered, lambda low: F.filter(
            found, lambda item, i: F.array_position(low, F.lower(item)) == i + 1))

    entries = []
    for skill, patterns in aliases.items():
        pattern = f"(?i){_BEFORE_WORD}(?:{'|'.join(patterns)}){_AFTER_WORD}"
        hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        entries.append(F.struct(F.lit(skill).alias("key"), first_seen(hits).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))
