"""File inventory and intake gate."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions import text as X


def inventory(spark: SparkSession, root: str,
              extensions: Sequence[str] = (".csv", ".parquet", ".jsonl"),
              exclude: Sequence[str] = ()) -> DataFrame:
    """Path and size of the files below ``root``; the contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length"))
    keep = F.lit(False)
    for extension in extensions:
        keep = keep | F.endswith(F.lower("path"), F.lit(extension))
    for keyword in exclude:
        keep = keep & ~F.contains("path", F.lit(keyword))
    return files.filter(keep).select("path", (F.col("length") / 1048576).alias("megabytes"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def intake_status(path: Column, length: Column, text: Column | None = None,
                  extensions: Sequence[str] = C.FILE_EXTENSIONS,
                  max_bytes: int = C.MAX_FILE_BYTES) -> Column:
    """200, or the reason for refusal: 415 extension, 413 size, 422 empty or unreadable."""
    status = (F.when(~extension(path).isin(list(extensions)), 415)
              .when(length > max_bytes, 413).when(length == 0, 422))
    if text is not None:
        status = status.when(X.is_blank(text), 422)
    return status.otherwise(200)


def intake(spark: SparkSession, path: str, extensions: Sequence[str] = (".txt",),
           max_bytes: int = C.MAX_FILE_BYTES) -> DataFrame:
    """Every file with its status; accepted files carry their text, refused ones keep the reason.

    Files are refused by name and length before their content is decoded.
    """
    files = spark.read.format("binaryFile").load(path)
    # The scan leaves out files without content; the file index of the driver still names them.
    names = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string")
    key = F.regexp_replace("path", "^([A-Za-z0-9+.-]+):/+", "$1:/")  # file:/x and file:///x
    empty = (names.withColumn("_key", key)
             .join(files.select(key.alias("_key")), "_key", "left_anti")
             .select("path", F.lit(0).cast("long").alias("length"),
                     intake_status(F.col("path"), F.lit(0), None, extensions).alias("status"),
                     F.lit(None).cast("string").alias("text")))
    early = intake_status(F.col("path"), F.col("length"), None, extensions, max_bytes)
    text = F.when(F.col("early") == 200,
                  F.make_valid_utf8(F.col("content").cast("string")))
    return (files.withColumn("early", early).withColumn("text", text)
            .select("path", "length",
                    F.when((F.col("early") == 200) & X.is_blank(F.col("text")), 422)
                    .otherwise(F.col("early")).alias("status"), "text").unionByName(empty))
