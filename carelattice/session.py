"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What a cluster submit should carry; every entry is ordinary Spark configuration.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Write option of jobs with very many small files: each task moves its own files into place, not the driver one after the other.
# A task that runs again writes the same names, and readers come after the job.
PARALLEL_COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def local_session(cores: int | str = 8, app: str = "carelattice", **conf: str) -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {**RECOMMENDED, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                "spark.driver.memory": "12g",
                "spark.ui.showConsoleProgress": "false", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.  Only where that is
    unset and the master is local (tests) a folder of our own is used."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def folder(spark: SparkSession, path: str):
    """(file system, path) as Spark itself sees them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, place = folder(spark, path)
    return files.exists(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Drops one partition of a stored table."""
    files, place = folder(spark, path)
    files.delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    The result survives lost executors, carries no upstream plan, still prunes columns, and has a
    known size, so later joins broadcast it only when it really is small.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_large(df: DataFrame) -> DataFrame:
    """``cut_lineage`` of a table that grows with the input.  Its file is many times smaller than its rows in memory (600,000 facts:
    9 MB against 400 MB), so Spark's size check would still send it to the driver for a broadcast; its joins shuffle instead."""
    return cut_lineage(df).hint("merge")
