"""Corpus readers."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscreen.operators.schema import canonical, require_columns

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType,
             encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and quoted line breaks.

    Such a file cannot be split, so its text is read by one task per file: keep large corpora in
    Parquet, or in many CSV files.
    """
    return spark.read.schema(schema).options(encoding=encoding, **CSV_OPTIONS).csv(path)


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding)`` of every non-empty file: UTF-8 if it is valid, else Latin-1.

    Lines keep their bytes, so files of any size are read in splits.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"),
                                         F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy("path").agg(F.when(F.bool_and("valid"), "UTF-8").otherwise("ISO-8859-1")
                                     .alias("encoding"))


def read_csv_any_encoding(spark: SparkSession, path: str,
                          schema: str | T.StructType) -> DataFrame:
    """CSV files of a folder, each in its own encoding."""
    groups: dict[str, list[str]] = {}
    for row in encodings(spark, path).collect():  # one row per file
        groups.setdefault(row.encoding, []).append(unquote(row.path))
    parts = [read_csv(spark, files, schema, encoding) for encoding, files in sorted(groups.items())]
    return reduce(DataFrame.unionByName, parts) if parts else read_csv(spark, path, schema)


def lossy_text(content: Column) -> Column:
    """Bytes to text, each invalid sequence replaced (S3)."""
    return F.make_valid_utf8(content.cast("string"))


def read_corpus(spark: SparkSession, path: str, file_format: str = "parquet",
                text: str | None = None, label: str | None = None, row_id: str | None = None,
                schema: str | T.StructType | None = None) -> DataFrame:
    """Labelled table in canonical form ``(doc_id, text, label)``."""
    if file_format == "csv":
        if schema is None:
            names = spark.read.options(**CSV_OPTIONS).csv(path).columns
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        source = read_csv(spark, path, schema)
    else:
        reader = spark.read.schema(schema) if schema else spark.read
        source = reader.format(file_format).load(path)
    return canonical(source, text, label, row_id)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per ``.txt`` file with its name."""
    return (spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")))


def read_split_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Id list with labels as written by :func:`docscreen.sources.sinks.write_split_ids`."""
    return require_columns(read_csv(spark, path, f"doc_id {id_type}, label string"),
                           ["doc_id", "label"])
