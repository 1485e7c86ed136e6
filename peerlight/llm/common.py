"""Helpers the corpus operators share: the shared folder, stored tables, held-out folds."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlight.session import BATCH_ROWS, bounded_batches  # noqa: F401


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a session in one process (tests) gets a folder of its own;
    any other session is refused, since a machine-local folder would lose rows there.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for rows that hold texts."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stores tables as ``stored`` does and removes them at the end of the block.

    Only for tables that nothing reads any more by then: what leaves the block is stored outside.
    """
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores in front if ``df`` has such a column already."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


class Shipped:
    """A broadcast value that carries its own classes, so executors need no copy of the package.

    A plain broadcast pickles classes by name; this one sends them by value and builds the value
    once a task.
    """

    def __init__(self, spark: SparkSession, value: object):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"_sent": self._sent}

    @property
    def value(self) -> Any:
        if "_built" not in self.__dict__:
            self._built = cloudpickle.loads(self._sent.value)
        return self._built


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
