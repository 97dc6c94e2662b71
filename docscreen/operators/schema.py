"""Projection, filtering and schema operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen import constants as C
from docscreen.functions import text as X
from docscreen.operators.grouping import broadcast_if_small, computed_once, ordered_ids, with_group_stats


# -- columns -----------------------------------------------------------------

def _plain(name: str) -> str:
    return name.casefold().replace("_", "").replace(" ", "")


def find_column(columns: Sequence[str], aliases: Sequence[str], purpose: str) -> str:
    """First alias that names a column, ignoring case, underscores and spaces."""
    known = {_plain(c): c for c in columns}
    for alias in aliases:
        if _plain(alias) in known:
            return known[_plain(alias)]
    raise KeyError(f"no {purpose} column among {list(columns)}")


def require_columns(df: DataFrame, required: Sequence[str], exact: bool = False) -> DataFrame:
    """``df`` itself, or KeyError naming what is missing or too many."""
    missing = [c for c in required if c not in df.columns]
    extra = [c for c in df.columns if c not in required] if exact else []
    if missing or extra:
        raise KeyError(f"missing columns {missing}, unexpected columns {extra}")
    return df


def column_profile(df: DataFrame) -> DataFrame:
    """Mean length and distinct values of every string column in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        raise ValueError("no string columns")
    measures = []
    for i, name in enumerate(names):
        measures += [F.avg(F.length(name)).alias(f"_len{i}"),
                     F.count_distinct(X.key_hash(F.col(name))).alias(f"_card{i}")]
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_len{i}").alias("mean_length"),
                              F.col(f"_card{i}").alias("distinct_values"))
                     for i, n in enumerate(names)])
    return df.agg(*measures).select(F.inline(rows))


def detect_columns(df: DataFrame, text: str | None = None, label: str | None = None):
    """Text column = longest on average, label = fewest distinct values; ValueError on doubt."""
    if text and label:
        return text, label
    profile = column_profile(df).collect()  # one row per column
    if len(profile) < 2:
        raise ValueError("two string columns are needed")
    if not text:
        first, second = sorted(profile, key=lambda r: -(r.mean_length or 0.0))[:2]
        if second.mean_length and (first.mean_length - second.mean_length) < 0.2 * first.mean_length:
            raise ValueError(f"text column is ambiguous: {first.column}, {second.column}")
        text = first.column
    if not label:
        rest = [r for r in profile if r.column != text]
        least = min(r.distinct_values for r in rest)
        tied = [r.column for r in rest if r.distinct_values == least]
        if len(tied) > 1:
            raise ValueError(f"label column is ambiguous: {tied}")
        label = tied[0]
    return text, label


def canonical(df: DataFrame, text: str | None = None, label: str | None = None,
              row_id: str | None = None, text_aliases=C.TEXT_ALIASES,
              label_aliases=C.LABEL_ALIASES) -> DataFrame:
    """Project to ``(doc_id, text, label)``; the source names stay in the column metadata."""
    text = text or find_column(df.columns, text_aliases, "text")
    label = label or find_column(df.columns, label_aliases, "label")
    columns = [F.col(text).cast("string").alias("text", metadata={"source_column": text}),
               X.strip(F.col(label).cast("string")).alias("label",
                                                          metadata={"source_column": label})]
    if row_id:
        columns.insert(0, F.col(row_id).alias("doc_id"))
    return df.select(*columns)


def with_document_ids(df: DataFrame, order_by: str, prefix: str = "doc-",
                      width: int = 6) -> DataFrame:
    """Zero-padded id from the position in source order."""
    return (ordered_ids(df, order_by)
            .withColumn("document_id", F.format_string(f"{prefix}%0{width}d", F.col("position")))
            .drop("position"))


# -- filters -----------------------------------------------------------------

def valid_rows(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows with text and label that are not blank; label stripped."""
    return (df.filter(~X.is_blank(F.col(text)) & ~X.is_blank(F.col(label)))
            .withColumn(label, X.strip(F.col(label))))


def missing_counts(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Missing and empty, for text and label."""
    def empty(c):
        return F.col(c).isNotNull() & X.is_blank(F.col(c))

    return df.agg(F.count_if(F.col(text).isNull()).alias("missing_text"),
                  F.count_if(empty(text)).alias("empty_text"),
                  F.count_if(F.col(label).isNull()).alias("missing_label"),
                  F.count_if(empty(label)).alias("empty_label"))


def min_chars(df: DataFrame, column: str, chars: int = C.MIN_CLEAN_CHARS) -> DataFrame:
    return computed_once(df, column).filter(F.length(column) >= chars)


def min_tokens(df: DataFrame, column: str, count: int = C.MIN_TOKENS) -> DataFrame:
    return computed_once(df, column).filter(X.word_count(F.col(column)) >= count)


def viable_classes(df: DataFrame, label: str = "label", row_id: str = "doc_id",
                   rows: int = C.MIN_CLASS_ROWS, strict: bool = False) -> DataFrame:
    """Rows of the classes with at least ``rows`` members (P10)."""
    if strict:
        small = small_classes(df, label, rows).limit(1).collect()
        if small:
            raise ValueError(f"class {small[0][label]!r} has fewer than {rows} rows")
    return (with_group_stats(df, [label], row_id, few_keys=True,
                             _class_rows=F.count(F.lit(1)))
            .filter(F.col("_class_rows") >= rows).drop("_class_rows"))


def small_classes(df: DataFrame, label: str = "label", rows: int = C.MIN_CLASS_ROWS) -> DataFrame:
    return (df.filter(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < rows))


def flag_short(df: DataFrame, text: str = "text", chars: int = C.SHORT_CHARS) -> DataFrame:
    return df.withColumn("is_short", F.length(text) < chars)


# -- labels by dictionary (J1) ------------------------------------------------

def label_from_first_line(text: Column, mapping: Mapping[str, str]) -> Column:
    """Label of the first line; blank gives null, no entry gives ``Unknown: <40 chars>``.

    The mapping is one literal map; dictionaries that grow with the data are tables and go through
    :func:`label_by_dictionary`.
    """
    entries = {k.strip().lower(): v for k, v in mapping.items()}
    if not entries:
        return _or_unknown(text, F.lit(None).cast("string"))
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    return _or_unknown(text, F.try_element_at(table, X.first_line(text)))


def _or_unknown(text: Column, found: Column) -> Column:
    line = X.strip(F.split_part(text, F.lit("\n"), F.lit(1)))
    return F.when(~X.is_blank(text), F.coalesce(
        found, F.concat(F.lit("Unknown: "), F.left(line, F.lit(40)))))


def label_by_dictionary(df: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Same for a dictionary table ``(phrase, label)`` of any size, broadcast if measured small."""
    entries = (dictionary.select(F.lower(X.strip(F.col("phrase"))).alias("_key"),
                                 F.col("label").alias("_label"))
               .groupBy("_key").agg(F.max("_label").alias("_label")))
    return (df.withColumn("_key", X.first_line(F.col(text)))
            .join(broadcast_if_small(entries), "_key", "left")
            .withColumn("mapped_label", _or_unknown(F.col(text), F.col("_label")))
            .drop("_key", "_label"))


# -- before / after (J9) ------------------------------------------------------

def before_after(df: DataFrame, row_id: str, text: str, steps=X.CLEANING_STEPS) -> DataFrame:
    cleaned = reduce(lambda column, step: step(column), steps, F.col(text))
    return df.select(row_id, F.col(text).alias("before"), cleaned.alias("after"))
