"""JSON dictionaries as rows (S5): label map, requirements, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``{"phrase": "label"}`` as ``(phrase, label)``."""
    return _whole(spark, path, "map<string,string>").select(
        F.explode("m").alias("phrase", "label"))


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """``{"role": {"skills": [..]}}`` as ``(role, skills)``."""
    return (_whole(spark, path, "map<string,struct<skills:array<string>>>")
            .select(F.explode("m").alias("role", "v")).select("role", F.col("v.skills").alias(
                "skills")))


def requirement_rows(requirements: DataFrame) -> DataFrame:
    """One row per role and skill with its place in the list."""
    return requirements.select("role", F.posexplode("skills").alias("position", "skill"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, "map<string,double>").select(F.explode("m").alias("name", "weight"))


def as_dict(table: DataFrame, limit: int = 10_000) -> dict:
    """A two-column dictionary table as a Python dict; refuses tables that are not small."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"dictionary has more than {limit} entries; pass the DataFrame itself")
    return {r[0]: r[1] for r in rows}
