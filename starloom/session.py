"""Session settings and durable intermediate results."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here relies on.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, so that spark-submit decides.
    """
    builder = (
        SparkSession.builder.appName("starloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "12g")  # the one process is all executors
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder, so that lost executors cost nothing.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, may fall back on a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors see; in a local session below its own checkpoint folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if spark.sparkContext.getCheckpointDir() is None:
            durable(spark.range(1))  # makes the local session choose its folder
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Stored:
    """``rows`` is ``df`` as compressed Parquet files in the shared folder, a fraction of the size of a checkpoint, which ``delete`` removes.

    For large results that are replaced in the course of a fit; a plan that reads one must have ended before it is deleted.
    """

    def __init__(self, df: DataFrame, name: str = "stored"):
        self.spark, self.folder = df.sparkSession, shared_folder(df.sparkSession, name)
        df.write.parquet(self.folder)
        self.rows = self.spark.read.schema(df.schema).parquet(self.folder)

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def replaced_by(self, df: DataFrame, name: str = "stored") -> "Stored":
        """``df``, which may be made from these rows, stored in their place; shuffle files of ended plans go as well."""
        new = Stored(df, name)
        self.delete()
        drop_ended_shuffles(self.spark)
        return new


def drop_ended_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to: it waits for the driver to collect garbage, which a driver with little to do puts off."""
    for _ in range(2):  # what Python has let go is free for the second collection
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def one_blas_thread(spark: SparkSession) -> None:
    """Let the Python workers of plans made from now on multiply matrices with one thread each.

    Their library takes a thread for every core of the machine otherwise, and as many tasks side by side then hinder each other to a tenth of the speed.
    """
    spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"


def one_row(df: DataFrame) -> dict:
    """The single row of a global aggregate, as plain values for literals in later plans."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one row")
    return rows[0].asDict()
