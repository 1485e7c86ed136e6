import os

from pyspark.sql import functions as F

from peerlight.sources import auditlog, papers
from peerlight.sources.files import list_files, local_root
from peerlight.streaming import intake
from peerlight.streaming.intake import listed_files, review_stream

NAMES = [
    b"a.md", b"B.MD", b"with blank.txt", b"per%20cent.md", b"hash#q?.md", b"br[a]{c}.md", b"\xc3\xbc \xe2\x80\x94.txt",
    b"no_suffix", b"x.bin", b".hidden.md", b"_hidden.md", b"_k=1.md", b"_metadata.md", b"c.md._COPYING_", b"empty.md",
    b"k=v/deep/er/est/a.md", b"_off/a.md", b".off/a.md", b"sub/md", b"two.dots.markdown", b"quote'\"^`|.txt", b"a+b&c=d;e.md",
]
TEXTS = [b"plain\n", b"\xef\xbb\xbfwith a mark", b"\xff\xfe broken \x80", b"one\r\ntwo\rthree\n\n", b"nul \x00 in it", b" "]


def _write(root):
    for n, name in enumerate(NAMES):
        file = os.path.join(os.fsencode(str(root)), name)
        os.makedirs(os.path.dirname(file), exist_ok=True)
        with open(file, "wb") as out:
            out.write(b"" if name == b"empty.md" else TEXTS[n % len(TEXTS)])
    os.symlink(root / "a.md", root / "link.md")
    os.symlink(root / "sub", root / "linked")
    os.symlink(root / "nothing", root / "broken.md")


def _old(spark, path):
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    files = papers.file_parts(read.select(F.col("value").alias("md"), F.col("_metadata.file_path").alias("path")))
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return (
        papers.from_text(files.filter(papers.is_text())).select("paper_id", F.hex("md"), "source_name", "path"),
        papers.reject_rows(papers.file_parts(binary.select("path", "length"))),
    )


def test_tasks_list_and_read_what_spark_reads(spark, tmp_path):
    _write(tmp_path)
    for path in (str(tmp_path), f"file://{tmp_path}", str(tmp_path / "a.md"), str(tmp_path / "k=v")):
        texts, others = _old(spark, path)
        assert local_root(spark, path)
        got = papers.read_papers(spark, path).select("paper_id", F.hex("md"), "source_name", "path")
        assert sorted(got.collect()) == sorted(texts.collect()) and got.count() > 0
        assert sorted(papers.rejected_files(spark, path).collect()) == sorted(others.collect())


def test_names_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    # Spark's readers hold a status of every file on the driver.
    for n in range(300):
        file = tmp_path / f"{n % 3}" / f"{n % 5}" / f"{n % 7}" / f"{n}.md"
        os.makedirs(file.parent, exist_ok=True)
        file.write_text(f"text {n}")
    read = papers.read_papers(spark, str(tmp_path))
    assert read.inputFiles() == [] and read.select("md").distinct().count() == 300
    assert list_files(spark, str(tmp_path)).count() == 300


def _run(spark, tmp_path):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    review_stream(spark, str(tmp_path / "in"), ["arxiv"], log, checkpoint).awaitTermination()
    batches = len(os.listdir(f"{checkpoint}/commits"))
    return {r.paper_id for r in auditlog.read_log(spark, log).collect()}, batches


def test_a_stream_keeps_no_names_on_the_driver(spark, tmp_path):
    # Spark's file source logs every name and reads that log into the driver's memory.
    for n in range(40):
        file = tmp_path / "in" / f"{n % 4}" / f"paper {n}.md"
        os.makedirs(file.parent, exist_ok=True)
        file.write_text(f"## Introduction\nabout {n}")
    seen, batches = _run(spark, tmp_path)
    assert len(seen) == 40
    sources = tmp_path / "checkpoint" / "sources" / "0"
    assert not any(b"paper" in file.read_bytes() for file in sources.iterdir())
    assert _run(spark, tmp_path) == (seen, batches)  # nothing new: no batch
    # A listing that was written by a run which died before its stream is not lost, nor repeated.
    (tmp_path / "in" / "late.md").write_text("## Introduction\nlate")
    listed_files(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"))
    (tmp_path / "in" / "later.md").write_text("## Introduction\nlater")
    later, _ = _run(spark, tmp_path)
    assert seen < later and len(later) == 42
    assert spark.read.parquet(str(tmp_path / "checkpoint" / "listed")).count() == 42


def test_a_stream_of_sparks_file_source_goes_on(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("## Introduction\nold")
    monkeypatch.setattr(intake, "local_root", lambda *_: None)
    first, _ = _run(spark, tmp_path)
    monkeypatch.undo()
    (tmp_path / "in" / "b.md").write_text("## Introduction\nnew")
    both, batches = _run(spark, tmp_path)
    assert len(first) == 1 and len(both) == 2
    assert _run(spark, tmp_path) == (both, batches)
