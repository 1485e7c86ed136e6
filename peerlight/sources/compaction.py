"""Compaction of the evaluation log: many small run folders become few large files.

A log is a folder of run folders, which batches append to and retried batches replace. Next to
it stand ``<log>.compacted/<number>`` with rewritten rows and ``<log>.manifests/<number>.json``.
The manifest with the highest number says which rewritten folders are part of the log and which
run folders they replace. It is moved into place in one step, so a reader sees the log before or
after a compaction and never half of it; what a manifest no longer names is removed only by
``remove_replaced``, when readers of the manifest before have had their time.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight import schemas

#: Rows of a rewritten file, and rewritten folders before they are merged into one.
ROWS_PER_FILE, MOST_FOLDERS = 1_000_000, 8
#: Bytes of records, as text, that a task sorts and writes to one file. Records are long: a
#: million of them are gigabytes.
BYTES_PER_FILE = 128 << 20


@dataclass
class Manifest:
    number: int = 0
    folders: list[str] = field(default_factory=list)
    replaced: list[str] = field(default_factory=list)  # run ids whose folders no longer count


class _Files:
    """The few file operations needed, on whatever store Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._make(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._store.exists(self._make(path))

    def names(self, pattern: str) -> list[str]:
        found = self._store.globStatus(self._make(pattern))
        return sorted(s.getPath().getName() for s in found or [])

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def write_once(self, path: str, text: str) -> bool:
        """The file in one step; false if there is one already."""
        fresh = f"{path}.{uuid.uuid4().hex}.new"
        out = self._store.create(self._make(fresh))
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(path):
            self.remove(fresh)
            return False
        return self._store.rename(self._make(fresh), self._make(path))

    def remove(self, path: str) -> None:
        self._store.delete(self._make(path), True)


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest of a log; an empty one if it was never compacted."""
    files = _Files(spark, path)
    names = [n for n in files.names(f"{path}.manifests/*.json")]
    return Manifest(**json.loads(files.read(f"{path}.manifests/{names[-1]}"))) if names else Manifest()


def _folder(spark: SparkSession, path: str, name: str) -> DataFrame:
    # Many runs share a file here, so the run id is a column of it.
    return spark.read.schema(schemas.AUDIT_LOG).parquet(f"{path}.compacted/{name}")


def log_of(spark: SparkSession, path: str, known: Manifest | None = None) -> DataFrame:
    """All rows of a log under a manifest (the newest, if none is given)."""
    known = known or manifest(spark, path)
    parts = [_folder(spark, path, name) for name in known.folders]
    if _Files(spark, path).exists(path) or not parts:
        live = spark.read.schema(schemas.AUDIT_LOG).parquet(path)
        # Run ids are folders: those left out are not opened.
        parts.append(live.filter(~F.col("run_id").isin(known.replaced)) if known.replaced else live)
    return reduce(DataFrame.unionByName, parts)


def compact(
    spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE, most_folders: int = MOST_FOLDERS
) -> Manifest:
    """Rewrite the run folders that no manifest has replaced yet into large files.

    The rows stay the same ones. Only new runs are read; when ``most_folders`` rewritten folders
    have gathered, they are merged as well. Files are sorted by config and paper; their number is
    at most rows / ``rows_per_file`` or their records' bytes / ``BYTES_PER_FILE``, whichever is more,
    plus the configs. If another compaction was faster, this one
    is an error and changes nothing.
    """
    files, known = _Files(spark, path), manifest(spark, path)
    runs = {n.removeprefix("run_id=") for n in files.names(f"{path}/config_hash=*/run_id=*")}
    fresh = sorted(runs - set(known.replaced))
    if not fresh:
        return known
    merge = len(known.folders) >= most_folders
    live = spark.read.schema(schemas.AUDIT_LOG).parquet(path).filter(F.col("run_id").isin(fresh))
    rows = reduce(DataFrame.unionByName, [_folder(spark, path, n) for n in known.folders] if merge else [], live)
    name = f"{known.number + 1:08d}-{uuid.uuid4().hex[:8]}"
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("record_json")), F.lit(0))).first()
    count = max(1, math.ceil(n / rows_per_file), math.ceil(size / BYTES_PER_FILE))
    order = ["config_hash", "paper_id", "evaluation_id"]
    sorted_rows = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    bloom_writer(sorted_rows.write).partitionBy("config_hash").parquet(f"{path}.compacted/{name}")
    new = Manifest(known.number + 1, [*([] if merge else known.folders), name], sorted({*known.replaced, *fresh}))
    if not files.write_once(f"{path}.manifests/{new.number:08d}.json", json.dumps(vars(new))):
        files.remove(f"{path}.compacted/{name}")
        raise RuntimeError("another compaction of this log came first")
    return new


def remove_replaced(spark: SparkSession, path: str) -> None:
    """Remove what the newest manifest does not name: replaced run folders, merged folders, older
    manifests. Readers that opened the log before the last compaction must be done."""
    files, known = _Files(spark, path), manifest(spark, path)
    for config in files.names(f"{path}/config_hash=*"):
        for run in files.names(f"{path}/{config}/run_id=*"):
            if run.removeprefix("run_id=") in set(known.replaced):
                files.remove(f"{path}/{config}/{run}")
    for name in files.names(f"{path}.compacted/*"):
        if name not in known.folders:
            files.remove(f"{path}.compacted/{name}")
    for name in files.names(f"{path}.manifests/*.json"):
        if name != f"{known.number:08d}.json":
            files.remove(f"{path}.manifests/{name}")


def bloom_writer(writer):
    """Log files carry a Bloom filter of their ids, as small as the rows of a row group allow: a
    record is found by its id alone without reading the row groups that do not hold it."""
    return (
        writer.option("parquet.bloom.filter.enabled#evaluation_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        # Ids are all different: a dictionary of them is as large as the column.
        .option("parquet.enable.dictionary#evaluation_id", "false")
    )
