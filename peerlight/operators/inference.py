"""Model calls as a deduplicated request table plus a user-supplied batch function.

Requests carry a content key. Distinct keys that the response table does not hold yet are
sent through the user's function inside ``mapInPandas``; answers should be written
(``write_responses``) before they are used, so that a lost executor never repeats paid work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight import schemas
from peerlight.functions.numbers import token_estimate
from peerlight.operators.bloom import key_filter, may_hold
from peerlight.operators.joins import attach_by_key, key_counts
from peerlight.session import bounded_batches, stage

KEY_FIELDS = ["max_tokens", "model", "prompt", "provider", "seed", "stop", "system", "temperature"]


def request_key() -> Column:
    """SHA-256 of the canonical JSON of all request fields; any change gives a new key."""
    body = F.to_json(F.struct(*KEY_FIELDS), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def request_rows(
    rows: DataFrame,
    kind: str,
    system: str | None,
    model: str,
    max_tokens: int | Column,
    provider: str = "stub",
    temperature: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """Complete (paper_id, unit_id, prompt) rows to request rows."""
    if not 0.0 <= temperature <= 2.0:
        raise ValueError("temperature must be in [0, 2]")
    tokens = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    return (
        rows.withColumn("kind", F.lit(kind))
        .withColumn("system", F.lit(system).cast("string"))
        .withColumn("model", F.lit(model))
        .withColumn("temperature", F.lit(float(temperature)))
        .withColumn("max_tokens", tokens.cast("int"))
        .withColumn("stop", F.lit(None).cast("array<string>"))
        .withColumn("seed", F.lit(seed))
        .withColumn("provider", F.lit(provider))
        .withColumn("cache_key", request_key())
        .select(
            "cache_key", "kind", *[c for c in rows.columns if c != "prompt"], "system", "prompt",
            "model", "temperature", "max_tokens", "stop", "seed", "provider",
        )
    )


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per key. Rows with one key are equal in every request field, so any will do;
    the partial aggregation keeps exact copies from crossing the shuffle."""
    fields = ["kind", "system", "prompt", "model", "temperature", "max_tokens", "stop", "seed", "provider"]
    one = F.first(F.struct(*fields)).alias("r")
    return requests.groupBy("cache_key").agg(one).select("cache_key", "r.*")


def missing_requests(requests: DataFrame, *caches: DataFrame | None) -> DataFrame:
    """Distinct requests that none of the caches can answer.

    What is missing is settled on keys alone and stored at once. A Bloom filter of the missing
    keys drops answered requests before anything is exchanged. Of what is left, only requests that
    may share their key with another row or may be answered (a second filter) are exchanged to be
    made distinct and held against the keys, which drops the first filter's few errors; the others
    pass from where they are, so most prompts never move.
    """
    held = [c.select("cache_key") for c in caches if c is not None]
    if not held:
        return distinct_requests(requests)
    known = reduce(DataFrame.union, held).distinct().withColumn("answered", F.lit(True))
    keys = key_counts(requests, "cache_key").join(known, "cache_key", "left").select(
        "cache_key", F.col("answered").isNull().alias("missing"),
        (F.col("answered").isNotNull() | (F.col("key_rows") > 1)).alias("doubtful"),
    )
    keys = stage(keys, "keys", f"missing-{uuid.uuid4().hex}")
    missing = keys.filter("missing").select("cache_key")
    wanted, doubtful = (key_filter(k, "cache_key") for k in (missing, keys.filter("doubtful")))
    asked = requests.filter(may_hold(requests, "cache_key", wanted)).withColumn(
        "doubtful", may_hold(requests, "cache_key", doubtful)
    )
    alone = asked.filter(~F.col("doubtful")).drop("doubtful")
    shared = distinct_requests(asked.filter("doubtful")).join(missing, "cache_key", "left_semi")
    return alone.select(*shared.columns).unionByName(shared)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.replace("array<array<double>>", "v").split(", ")]


def run_model(
    requests: DataFrame,
    factory: Callable[[], Callable],
    schema: str = schemas.RESPONSES,
    journal: str | None = None,
    chunk: int = 16,
    parts: int | None = None,
) -> DataFrame:
    """Apply a user model: ``factory()`` runs once per task and returns a function from a
    pandas batch of requests to a pandas batch of responses.

    With ``journal``, a folder that all machines share, the answers of every ``chunk`` requests
    are written there as they arrive, and a task that is run again reads them instead of asking:
    a lost executor costs the chunk it was at. Chunks are cut from ``parts`` parts of the keys (as
    many as shuffle partitions, if not said), whatever plan the rows are read in and however they
    are batched. A later run passes ``journal_responses`` as cache.
    """
    names = _names(schema)
    bounded_batches(requests.sparkSession)
    if journal is not None:
        factory = journaled(factory, journal, names, chunk)
        # The same rows in the same order for every attempt, so chunks keep their names. Without
        # the number Spark merges parts, by sizes and by what else the plan holds; the same number
        # of the key itself may be there already, for a join or group, and be merged as well.
        parts = parts or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        requests = requests.repartition(parts, F.xxhash64("cache_key")).sortWithinPartitions("cache_key")

    def whole_chunks(batches: Iterator) -> Iterator:
        """The same rows in batches that end where a chunk does."""
        import pandas as pd

        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            full = len(rows) - len(rows) % chunk
            rest = rows.iloc[full:]
            if full:
                yield rows.iloc[:full]
        if rest is not None and len(rest):
            yield rest

    def apply(batches: Iterator) -> Iterator:
        model = factory()
        for batch in whole_chunks(batches) if journal is not None else batches:
            yield model(batch)[names]

    return requests.mapInPandas(apply, schema)


def journaled(factory: Callable[[], Callable], journal: str, names: list[str], chunk: int) -> Callable:
    """A factory whose model keeps the answers of every chunk in a Parquet file of its own.

    A file is named by the keys of its requests and moved into place when whole, so it is there
    in full or not at all; two attempts at one chunk write the same file.
    """

    def start() -> Callable:
        import hashlib
        import uuid

        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(journal if "://" in journal else f"file://{journal}")
        files.create_dir(base, recursive=True)
        model: list[Callable] = []

        def one(part: pd.DataFrame) -> pd.DataFrame:
            digest = hashlib.sha256("\n".join(part["cache_key"]).encode()).hexdigest()
            path = f"{base}/{digest}.parquet"
            if files.get_file_info(path).type == fs.FileType.File:
                return pq.ParquetFile(files.open_input_file(path)).read().to_pandas()[names]
            if not model:  # a task whose answers are all there starts no model
                model.append(factory())
            answers = model[0](part)[names]
            fresh = f"{base}/_{digest}-{uuid.uuid4().hex}"
            pq.write_table(pa.Table.from_pandas(answers, preserve_index=False), fresh, filesystem=files)
            files.move(fresh, path)
            return answers

        def answer(batch: pd.DataFrame) -> pd.DataFrame:
            parts = [one(batch.iloc[at : at + chunk]) for at in range(0, len(batch), chunk)]
            return pd.concat(parts, ignore_index=True) if parts else batch

        return answer

    return start


def journal_responses(spark: SparkSession, journal: str, schema: str = schemas.RESPONSES) -> DataFrame:
    """All answers a journal holds, one row a key; none if the folder does not exist yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(journal)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(journal).dropDuplicates(["cache_key"])


def run_embedder(
    requests: DataFrame, factory: Callable[[], Callable], schema: str = schemas.EMBEDDINGS
) -> DataFrame:
    """Apply a user embedder: as ``run_model``, from batches of (cache_key, texts, model) to
    batches with one vector per text."""
    return run_model(requests, factory, schema)


def stub_completions(requests: DataFrame) -> DataFrame:
    """Deterministic completions without any model: a template keyed by the prompt hash."""
    digest = F.substring(
        F.sha2(F.concat(F.coalesce("system", F.lit("")), F.lit("\n"), F.col("prompt")), 256), 1, 12
    )
    text = F.concat(F.lit("STUB["), digest, F.lit("] "), F.substring("prompt", 1, 120))
    return requests.select(
        "cache_key",
        text.alias("text"),
        "model",
        F.lit("stub").alias("provider"),
        token_estimate(F.col("prompt")).cast("bigint").alias("prompt_tokens"),
        token_estimate(text).cast("bigint").alias("completion_tokens"),
        F.lit(0.0).alias("cost_usd"),
        F.lit("stop").alias("finish_reason"),
    )


def stub_vector(text: Column, dim: int = 16) -> Column:
    """Unit vector derived from the SHA-256 of the text (at most 32 dimensions)."""
    if not 1 <= dim <= 32:
        raise ValueError("dim must be in [1, 32]")
    digest = F.sha2(text, 256)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (
            F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - F.lit(127.5)
        )
        / F.lit(127.5),
    )

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))

    return F.get(F.transform(F.array(raw), scaled), F.lit(0))


def stub_embeddings(requests: DataFrame, dim: int = 16) -> DataFrame:
    """Rows (cache_key, texts, model) to one vector per text."""
    return requests.select(
        "cache_key",
        F.transform("texts", lambda t: stub_vector(t, dim)).alias("vectors"),
        "model",
        F.lit("stub").alias("provider"),
        F.aggregate(
            "texts", F.lit(0), lambda acc, t: acc + token_estimate(t)
        ).cast("bigint").alias("prompt_tokens"),
        F.lit(0.0).alias("cost_usd"),
    )


def embed_key(provider: str = "stub") -> Column:
    body = F.to_json(
        F.struct(
            F.lit("embed").alias("kind"), "model", F.lit(provider).alias("provider"), "texts"
        )
    )
    return F.sha2(body, 256)


def with_cache(
    requests: DataFrame,
    cache: DataFrame | None,
    infer: Callable[[DataFrame], DataFrame],
    hot_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """Read-through cache: (answers per request row with ``cache_hit``, fresh responses).

    Write the fresh responses and use the table that was written (see ``plans.review``);
    they are also what the cost log records, as hits cost nothing.
    """
    fresh = infer(missing_requests(requests, cache))
    return answer(requests, cache, fresh, hot_rows), fresh


def answer(
    requests: DataFrame, cache: DataFrame | None, fresh: DataFrame, hot_rows: int = 1_000_000
) -> DataFrame:
    """Responses for every request row; copies of one prompt share one answer."""
    new = fresh.withColumn("cache_hit", F.lit(False))
    known = new if cache is None else new.unionByName(
        cache.select(*fresh.columns).withColumn("cache_hit", F.lit(True))
    )
    keys = key_counts(requests, "cache_key")
    found = keys.join(known, "cache_key")
    ids = [c for c in requests.columns if c in ("paper_id", "unit_id", "config_id", "claim_id", "ref_id", "ref_pos")]
    return attach_by_key(
        requests.select("cache_key", "kind", *ids), found, keys, "cache_key", ids, how="inner",
        hot_rows=hot_rows,
    )


def write_responses(fresh: DataFrame, path: str) -> None:
    fresh.write.mode("append").parquet(path)


def usage_entries(fresh: DataFrame, kind: str = "complete") -> DataFrame:
    """Cost-log entries of fresh responses."""
    done = F.col("completion_tokens") if "completion_tokens" in fresh.columns else F.lit(0)
    return fresh.select(
        F.current_timestamp().alias("timestamp"),
        "provider",
        "model",
        "prompt_tokens",
        done.cast("bigint").alias("completion_tokens"),
        "cost_usd",
        F.lit(kind).alias("kind"),
    )


def run_chain(
    requests: DataFrame, chain: list[tuple[str, Callable[[], Callable]]]
) -> DataFrame:
    """Try several providers in order, batch by batch.

    A provider that cannot start or fails on a batch hands it to the next one. When all
    fail the rows come back without text (the parsers then fall back to heuristics) and
    with provider ``heuristic``; ``finish_reason`` says why.
    """

    def apply(batches: Iterator) -> Iterator:
        ready: dict[str, Callable] = {}
        for batch in batches:
            problems = []
            for name, factory in chain:
                try:
                    if name not in ready:
                        ready[name] = factory()
                    out = ready[name](batch)
                    if problems:
                        out = out.assign(finish_reason="downgraded: " + "; ".join(problems))
                    yield out
                    break
                except Exception as exc:  # noqa: BLE001 - any provider failure downgrades
                    problems.append(f"{name}: {type(exc).__name__}")
            else:
                empty = batch[["cache_key", "model"]].assign(
                    text=None, provider="heuristic", prompt_tokens=0, completion_tokens=0,
                    cost_usd=0.0, finish_reason="failed: " + "; ".join(problems),
                )
                yield empty[
                    ["cache_key", "text", "model", "provider", "prompt_tokens",
                     "completion_tokens", "cost_usd", "finish_reason"]
                ]

    bounded_batches(requests.sparkSession)
    return requests.mapInPandas(apply, schemas.RESPONSES)


def downgrades(responses: DataFrame) -> DataFrame:
    """Warnings with counts: which responses came from a fallback, and why."""
    return (
        responses.filter(
            F.startswith("finish_reason", F.lit("downgraded"))
            | F.startswith("finish_reason", F.lit("failed"))
        )
        .groupBy("provider", F.col("finish_reason").alias("warning"))
        .agg(F.count(F.lit(1)).alias("n_responses"))
    )
