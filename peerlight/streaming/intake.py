"""New paper files as a stream: heuristic review into the audit log."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight.operators.parsing import parse_papers
from peerlight.plans.review import Options, heuristic_review
from peerlight.sources import auditlog
from peerlight.sources.configs import Configs
from peerlight.sources.files import list_files, local_root, name_uri, read_files
from peerlight.sources.papers import TEXT_SUFFIXES, file_parts, from_text, is_text, reject_rows

#: The file source skips files this much older than the newest one it has seen (default: 7d).
MAX_FILE_AGE = "36500d"
LISTED = "file binary, length bigint, listing string"


def listed_files(spark: SparkSession, root: str, checkpoint: str) -> DataFrame:
    """Names of the files arriving anywhere under ``root`` as a stream of (file, length).

    Spark's file source keeps the name of every file it has ever seen on the driver. Here tasks
    list the folders and append the names that are not there yet to a table beside the
    checkpoint, and the source sees the few files of that table. A listing that was cut off is
    made up for by the next one, which takes what the table holds as seen.
    """
    table = f"{checkpoint}/listed"
    found = list_files(spark, root)
    if _exists(spark, table):
        # The listing's folders are named by the schema alone, so an empty table can be read too.
        seen = spark.read.schema(LISTED).parquet(table).select("file")
        found = found.join(seen, "file", "left_anti")
    # Folders by listing: one that finds nothing new leaves no file, and the stream no batch.
    named = found.withColumn("listing", F.lit(uuid.uuid4().hex))
    named.write.mode("append").partitionBy("listing").parquet(table)
    return (
        spark.readStream.schema(LISTED).option("maxFileAge", MAX_FILE_AGE).parquet(table).select("file", "length")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _root(spark: SparkSession, path: str, checkpoint: str | None) -> str | None:
    """The folder for tasks to list. A checkpoint of Spark's file source goes on with that."""
    if checkpoint is None or (_exists(spark, f"{checkpoint}/sources") and not _exists(spark, f"{checkpoint}/listed")):
        return None
    return local_root(spark, path)


def file_stream(spark: SparkSession, path: str, checkpoint: str | None = None, texts: bool = True) -> DataFrame:
    """Files arriving anywhere under ``path``, listed as the batch reader lists them.

    ``arrived`` is the time of the batch that reads a file. A file's own time says nothing
    about its arrival (archives keep theirs), so no file is too old to be read. With ``texts``
    the papers come with their text and other files may be left out.
    """
    root = _root(spark, path, checkpoint)
    if root is None:
        files = (
            spark.readStream.option("recursiveFileLookup", "true")
            .option("maxFileAge", MAX_FILE_AGE)
            .text(path, wholetext=True)
            .select(F.col("value").alias("md"), F.col("_metadata.file_path").alias("path"))
        )
    else:
        files = listed_files(spark, root, checkpoint)
        files = read_files(files, TEXT_SUFFIXES) if texts else files.select(name_uri(F.col("file")).alias("path"))
    return file_parts(files.withColumn("arrived", F.current_timestamp()))


def paper_stream(
    spark: SparkSession, path: str, watermark: str = "1 day", checkpoint: str | None = None
) -> DataFrame:
    """Papers arriving under ``path``; copies of one text within the watermark come once.

    Batch times only rise, so no paper is ever behind the watermark.
    """
    papers = from_text(file_stream(spark, path, checkpoint).filter(is_text())).select(
        "paper_id", "md", "source_name", "arrived"
    )
    return papers.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["paper_id"])


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that a checkpoint belongs to; a new checkpoint has a new id."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def review_stream(
    spark: SparkSession,
    path: str,
    configs: Configs,
    log_path: str,
    checkpoint: str,
    options: Options | None = None,
):
    """Start the review stream. A batch writes to a run folder of its own and replaces it when
    it is retried, so a lost batch leaves no duplicates in the log. The folder carries the id
    that lives with the checkpoint, so other streams and batch runs can share the log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Not asked whether it is empty first: that reads all its files once more. A batch that
        # only moves the watermark writes nothing.
        run_id = f"{stream_id(spark, checkpoint)}-{batch_id}"
        parsed = parse_papers(batch.drop("arrived"))
        auditlog.replace_run(
            auditlog.log_rows(heuristic_review(parsed, configs, options), run_id), log_path
        )

    return (
        paper_stream(spark, path, checkpoint=checkpoint)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def reject_stream(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Start a stream that writes every file no reader takes, with the reason."""
    return (
        reject_rows(file_stream(spark, path, checkpoint, texts=False))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
