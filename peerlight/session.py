"""Session settings and shared helpers for staged tables."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Compression of staged tables: mostly texts, of which the default leaves a third more bytes.
CODEC = "zstd"


def build_session(app: str = "peerlight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a session in one process (tests) gets a folder of its own.
    Any other session is refused: on a cluster each machine would write to its own disk.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="peerlight-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, name: str, run_id: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts lineage so that expensive parsing or model calls are not repeated when an
    executor is lost, and survives executor loss since it lives on shared storage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), run_id, name)
    writer = df.write.mode("overwrite").option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(
    df: DataFrame, name: str, run_id: str, key: str, buckets: int | None = None, dealt: bool = False
) -> DataFrame:
    """As ``stage``, but stored in buckets of ``key`` (as many as shuffle partitions, if not said).

    Joins and groups by the key then read the table where it lies: only the other side is
    exchanged. Spark knows buckets of catalog tables only, so the table is registered in the
    session's catalog with its files in the shared folder. ``dealt`` says that the rows come from
    a table in such buckets: they are written from where they are, without an exchange.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = os.path.join(shared_folder(spark), run_id, name)
    table = re.sub(r"\W", "_", f"{name}_{run_id}")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    # One file a bucket, not one for each task and bucket.
    rows = df if dealt else df.repartition(count, key)
    rows.write.mode("overwrite").option("compression", CODEC).bucketBy(count, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def appended(spark: SparkSession, name: str, run_id: str, schema: str) -> DataFrame:
    """Rows that earlier runs with this id have appended to a staged table (none: no rows)."""
    path = os.path.join(shared_folder(spark), run_id, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_stage(df: DataFrame, name: str, run_id: str, schema: str) -> DataFrame:
    """Append ``df`` to a staged table and return the whole table."""
    path = os.path.join(shared_folder(df.sparkSession), run_id, name)
    df.write.mode("append").option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Rows that Spark hands to Python at a time. Texts are long; the default of ten thousand
#: would hold tens of megabytes of them several times over in every worker.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` if it is larger or unlimited."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
