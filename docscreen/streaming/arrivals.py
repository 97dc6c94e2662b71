"""Documents that arrive as files: scored as they land, repeats dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docscreen.functions import text as X


def read_arrivals(spark: SparkSession, path: str, schema, file_format: str = "parquet",
                  glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """File stream; the trigger size bounds the work of one micro-batch."""
    reader = (spark.readStream.format(file_format).schema(schema)
              .option("maxFilesPerTrigger", files_per_trigger))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_table_arrivals(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A table that is one file or a folder of files.

    The path is given as a pattern: Spark takes a plain one for a folder of partitions, which a file is not.
    """
    return read_arrivals(spark, f"{path[:-1]}[{path[-1]}]", schema, **options)


def read_text_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file with its name."""
    return (spark.readStream.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")))


def drop_repeats(stream: DataFrame, key: Column, event_time: str,
                 within: str = "1 hour") -> DataFrame:
    """First arrival per normalised key; the state forgets keys older than the watermark."""
    return (stream.withColumn("_key", X.key_hash(key)).withWatermark(event_time, within)
            .dropDuplicatesWithinWatermark(["_key"]).drop("_key"))


def first_in_window(stream: DataFrame, keys: Sequence[str], event_time: str, window: str = "6 hours",
                    delay: str = "1 day") -> DataFrame:
    """``keys`` and ``window``, once for each event-time window.

    The state of a window is dropped once an event of its end plus ``delay`` has been seen; rows that come
    after that are late and go no further here (``run_late`` keeps them).
    """
    return (stream.withWatermark(event_time, delay)
            .select(*keys, F.window(event_time, window).alias("window")).dropDuplicates([*keys, "window"]))


def run_late(stream: DataFrame, event_time: str, target: str, checkpoint: str, window: str = "6 hours",
             delay: str = "1 day") -> StreamingQuery:
    """The rows that ``first_in_window`` finds too late, written to ``target``.

    A batch is held against the latest event of all batches before it, as the watermark is. That time
    is noted by batch beside the rows, so a batch that runs again writes the same again.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        marks = f"{target}-marks"
        seen = [r.at for r in spark.read.schema("at timestamp, batch long").parquet(marks).filter(
            F.col("batch") < number).agg(F.max("at").alias("at")).collect()] if number else [None]
        mark = F.date_trunc("millisecond", F.lit(seen[0]).cast("timestamp") - F.expr(f"interval {delay}"))
        late = F.coalesce(F.window(event_time, window)["end"] <= mark, F.lit(False))
        batch.withColumn("_late", late).filter("_late").drop("_late").write.mode("overwrite").parquet(
            f"{target}/batch={number}")
        batch.agg(F.max(event_time).alias("at")).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str,
                  checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Process what has arrived and stop; restarting continues where it ended.

    Output is exactly-once through the checkpoint and the file sink's log.
    """
    query = (transform(stream).writeStream.format(file_format).outputMode("append")
             .option("path", target).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
