"""Folders of many small files, listed and read by tasks.

Spark's readers list on the driver, which then holds every file, and read a small file at the
price of a large one. Here the driver holds neither names nor statuses. Which files count, their
names and their bytes are those of Spark's text reader.
"""

from __future__ import annotations

import os
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel with their jobs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["peerlight"])

FILES = "file binary, length bigint"
#: Bytes of file contents that a task hands on at a time.
CHUNK = 8 << 20
GLOB = re.compile(r"[{}\[\]*?\\]")
#: Characters that a Java URI escapes in a path.
ESCAPED = re.compile(
    r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def local_root(spark: SparkSession, path: str) -> str | None:
    """The folder if all machines see it as a folder of their own; None if only Spark's readers
    can list ``path`` (another file system, a pattern, or nothing there)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if GLOB.search(path) or system.getUri().getScheme() != "file" or not system.exists(where):
        return None
    return system.makeQualified(where).toUri().getPath()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, length) of the files anywhere under ``root`` that hold something.

    The folders of the first two levels are dealt to tasks; what lies deeper is listed by the task
    of the folder above it.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.createDataFrame([(os.fsencode(root), None)], FILES)
    for level in range(3):
        if level:
            found = found.repartition(parts, "file")
        found = found.mapInArrow(_lister(deep=level == 2), FILES)
    return found.filter("length > 0")


def hidden(name: bytes) -> bool:
    """Names that Spark's readers pass over."""
    if name.startswith((b"_metadata", b"_common_metadata")):
        return False
    return name.startswith(b".") or name.endswith(b"._COPYING_") or (name.startswith(b"_") and b"=" not in name)


def _entries(folder: bytes):
    """(file, length) of what lies in ``folder``; folders and links to them have no length."""
    with os.scandir(folder) as entries:
        for entry in entries:
            if hidden(entry.name):
                continue
            try:
                if entry.is_dir():
                    yield entry.path, None
                elif not entry.name.startswith(b"_") or b"=" in entry.name:
                    yield entry.path, entry.stat().st_size
            except FileNotFoundError:  # a link to nothing, or removed since
                continue


def _lister(deep: bool):
    """Puts the content in place of every folder, of all below it too if ``deep``."""

    def contents(path, length):
        if length is not None:
            yield path, length
        elif not os.path.isdir(path):  # the root may be a file
            yield path, os.stat(path).st_size
        else:
            open_ = [path]
            while open_:
                for name, size in _entries(open_.pop()):
                    if deep and size is None:
                        open_.append(name)
                    else:
                        yield name, size

    def run(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                ["file", "length"],
            )

        rows = []
        for given in batches:
            for path, length in zip(given["file"].to_pylist(), given["length"].to_pylist()):
                for row in contents(path, length):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return run


def file_uri(file: bytes) -> str:
    """The name as Spark's readers give it in ``_metadata.file_path``."""
    name = os.fsdecode(file).encode(errors="replace").decode()
    return "file:" + ESCAPED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name)


def name_uri(file: Column) -> Column:
    @F.arrow_udf("string")
    def uris(files):
        import pyarrow as pa

        return pa.array([file_uri(f) for f in files.to_pylist()], pa.string())

    return uris(file)


def read_files(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """(path, md) of the files with one of the suffixes; the others are not opened.

    Names are dealt anew, so that a folder of many files is read by many tasks.
    """
    wanted = tuple(f".{s}" for s in suffixes)

    def run(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                ["path", "content"],
            )

        rows, size = [], 0
        for given in batches:
            for file in given["file"].to_pylist():
                uri = file_uri(file)
                if not uri.lower().endswith(wanted):
                    continue
                with open(file, "rb") as opened:
                    content = opened.read()
                rows.append((uri, content))
                size += len(content)
                if size >= CHUNK:
                    yield batch(rows)
                    rows, size = [], 0
        yield batch(rows)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = files.select("file").repartition(parts, "file").mapInArrow(run, "path string, content binary")
    return read.select(F.col("content").cast("string").alias("md"), "path")
