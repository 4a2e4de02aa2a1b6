"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "casemesh", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="casemesh-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    For results of several joins that a job goes on to use more than once: they are computed a single time, and
    a lost executor costs a re-read. The cluster's housekeeping of the shared folder removes the table.
    """
    path = f"{shared_dir(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly per-row work over a table, in tasks that are even.

    How many tasks a scan has says little: a row group is read by one of them, so those of a large file with few row
    groups may leave all rows to one. Shuffling the rows as read costs little beside such work; the tasks grow in number
    with the files. For tables as read, before any shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming else df.repartition(max(cores, 4 * df.rdd.getNumPartitions()))
