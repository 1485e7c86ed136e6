"""The append-only evaluation log: flat score columns beside the full record as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight import schemas
from peerlight.sources.compaction import bloom_writer, log_of

LOG_FOLDERS = ["config_hash", "run_id"]


def record_json(df: DataFrame) -> DataFrame:
    """Adds ``record_json``: all columns of the row as one JSON text, nulls kept."""
    return df.withColumn(
        "record_json", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    )


def log_rows(records: DataFrame, run_id: str, cost: DataFrame | None = None) -> DataFrame:
    """Evaluation records as log rows. The id depends only on paper, config and run, so a
    retried append can be recognised."""
    from peerlight import __version__

    base = record_json(records)
    if cost is not None:
        base = base.join(cost.select("paper_id", "config_id", "cost_usd"), ["paper_id", "config_id"], "left")
    else:
        base = base.withColumn("cost_usd", F.lit(0.0))
    return base.select(
        F.sha2(F.concat_ws("|", "paper_id", "config_hash", F.lit(run_id)), 256).alias("evaluation_id"),
        "paper_id",
        "config_id",
        "created_at",
        F.lit(__version__).alias("engine_version"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        "word_count",
        F.col("raw_total").alias("rubric_raw_total"),
        F.col("bias_adjusted_total").alias("rubric_adjusted_total"),
        F.col("triage").alias("compliance_triage"),
        F.col("total_claims").cast("int").alias("total_claims"),
        F.col("hallucination_count").cast("int").alias("hallucination_count"),
        "record_json",
        "config_hash",
        F.lit(run_id).alias("run_id"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows, one directory per config and run.

    Rows are spread by (config, paper) so that the one config that holds most rows still
    writes from many tasks, and sorted so that Parquet statistics prune by paper.
    """
    bloom_writer(_spread(rows).write.mode("append")).partitionBy(*LOG_FOLDERS).parquet(path)


def replace_run(rows: DataFrame, path: str) -> None:
    """Write the rows of a run in place of what the log holds of it (a retried batch)."""
    writer = _spread(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    bloom_writer(writer).partitionBy(*LOG_FOLDERS).parquet(path)


def _spread(rows: DataFrame) -> DataFrame:
    return rows.repartition("config_hash", "paper_id").sortWithinPartitions(
        *LOG_FOLDERS, "paper_id"
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log: compacted ones and those of runs since (``sources.compaction``)."""
    return log_of(spark, path)


def once(log: DataFrame) -> DataFrame:
    """Log without the duplicates a retried append may have left.

    Ids that are there twice are found on ids alone; only their rows are gathered, the others,
    with their records, stay where they are.
    """
    ids = log.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("evaluation_id")
    single = log.join(ids, "evaluation_id", "left_anti").select(*log.columns)
    double = log.join(ids, "evaluation_id", "left_semi").select(*log.columns)
    return single.unionByName(double.dropDuplicates(["evaluation_id"]))


def load_record(
    log: DataFrame, evaluation_id: str, paper_id: str | None = None, config_hash: str | None = None
) -> DataFrame:
    """One record by id, read once. Missing ids are an error.

    The Bloom filter of each row group's ids skips those that do not hold it; ``config_hash``
    also prunes folders and ``paper_id`` row groups, as the files are sorted by paper.
    """
    row = log.filter(F.col("evaluation_id") == evaluation_id)
    for name, value in (("paper_id", paper_id), ("config_hash", config_hash)):
        if value is not None:
            row = row.filter(F.col(name) == value)
    found = row.limit(1).collect()
    if not found:
        raise KeyError(f"no evaluation with id {evaluation_id}")
    return parse_records(log.sparkSession.createDataFrame(found, log.schema))


def parse_records(log: DataFrame) -> DataFrame:
    """Typed records from ``record_json``; a broken record is an error."""
    parsed = F.from_json("record_json", schemas.RECORD, {"mode": "FAILFAST"})
    return log.select("evaluation_id", parsed.alias("r")).select("evaluation_id", "r.*")


def record_fields(log: DataFrame, fields: dict[str, str]) -> DataFrame:
    """evaluation_id and single fields of the records: name to (JSON path, type) as "path type".

    The record becomes a VARIANT, of which only the named paths are read and typed. Records of
    other versions of the schema stay readable: a field that one lacks, or holds in another
    type, is NULL there, and fields it has besides do no harm. A record that is no JSON is NULL
    in every field.
    """
    known = log.select("evaluation_id", F.try_parse_json("record_json").alias("r"))
    typed = []
    for name, field in fields.items():
        path, kind = field.split(" ", 1)
        typed.append(F.try_variant_get(F.col("r"), path, kind).alias(name))
    return known.select("evaluation_id", *typed)


def scan_records(log: DataFrame) -> DataFrame:
    """All records in id order."""
    return parse_records(log).orderBy("evaluation_id")


def count_records(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("n_records"))


def query_scores(log: DataFrame) -> DataFrame:
    """Flat score rows in id order; ``record_json`` is never read."""
    return log.select(
        "evaluation_id",
        "paper_id",
        "created_at",
        "rubric_raw_total",
        "rubric_adjusted_total",
        "compliance_triage",
        "total_claims",
        "hallucination_count",
        "cost_usd",
    ).orderBy("evaluation_id")


def export_jsonl(log: DataFrame, out: str) -> int:
    """Write every record as a JSON line; returns how many."""
    log.select(F.col("record_json").alias("value")).write.mode("overwrite").text(out)
    return log.sparkSession.read.text(out).count()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Saved records from JSON lines with a fixed schema; anything else is an error."""
    return spark.read.schema(schemas.RECORD).option("mode", "FAILFAST").json(path)


def latest_records(log: DataFrame) -> DataFrame:
    """Newest record per paper x config.

    The newest (time, id) is found on narrow columns; only the rows that win carry their
    record, and no record text is compared.
    """
    keys = ["paper_id", "config_hash"]
    newest = log.groupBy(*keys).agg(
        F.max(F.struct("created_at", "evaluation_id")).alias("newest")
    )
    winners = newest.select(*keys, "newest.created_at", "newest.evaluation_id")
    return once(log.join(winners, [*keys, "created_at", "evaluation_id"], "left_semi")).select(
        *keys, *[c for c in log.columns if c not in keys]
    )
