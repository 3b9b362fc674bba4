"""Session settings used by the bench, the tests and the examples."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def build_session(app_name: str = "askloom", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution on and time zone UTC; ``conf`` wins over the defaults.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submitter's settings apply and
    adaptive execution coalesces or splits the shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",
    }
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Settings the operators rely on in a session somebody else built.

    Spark 4.1 may take a union of equally partitioned inputs for partitioned itself; together with a reused
    exchange a later join then doubles rows. The union's claim is switched off; timestamps are read as UTC.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, as the cluster names it.

    Only a local session without the setting falls back to a folder below the working directory.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.abspath("spark-checkpoints")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: later jobs read only the columns they
    need and never recompute it, also after losing executors. The write's shuffle files go when it ends, since nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/askloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` returned and that nothing reads any more."""
    spark = table.sparkSession
    own = f"/askloom/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if own in folder:
            delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any storage that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern with ``*``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in found or [] if s.isDirectory()]
