"""Writers (S9, S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True)
     .csv(path))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Corpus partitioned by split, one directory per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_split_ids(df: DataFrame, path: str, split: str, label: str = "label",
                    row_id: str = "doc_id") -> None:
    write_csv(df.filter(F.col("split") == split)
              .select(F.col(row_id).alias("doc_id"), F.col(label).alias("label")), path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
