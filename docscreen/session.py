"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of a finished execution where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Inputs of more splits than this are never shuffled to use more cores.
SPREAD_SPLITS = 4

_written: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitted session is used as it is."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("docscreen")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    ``docscreen.work.dir`` (settable at any time) wins over ``spark.checkpoint.dir``. Only a
    single-machine session may go without either and gets a temporary folder; a cluster is asked
    to name one.
    """
    named = (spark.conf.get("docscreen.work.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
             or spark.sparkContext.getCheckpointDir())
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir or docscreen.work.dir to a folder that the "
                           "driver and all executors share")
    named = tempfile.mkdtemp(prefix="docscreen-")
    spark.conf.set("docscreen.work.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Computed once, columnar, and still there when an executor is lost. The shuffle files of the
    write are dropped as soon as it is done; ``release`` drops the tables themselves.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Folders of the tables of ``cut_lineage``, the last one last."""
    return list(_written)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete every table that ``cut_lineage`` wrote for this process, or those named; returns how many.

    Call it once the results that were built on them are written.
    """
    jvm, doomed = spark.sparkContext._jvm, list(_written) if paths is None else paths
    for name in doomed:
        _written.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(doomed)


def spread(df: DataFrame, row_id: str) -> DataFrame:
    """Give every core a share of an input of very few splits.

    Meant for small files in front of costly text expressions. Above ``SPREAD_SPLITS`` splits
    (half a gigabyte at Spark's default) nothing is moved, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores, row_id) if splits < min(cores, SPREAD_SPLITS + 1) else df
