import glob

from checks import queries
from peerlight.sources import papers


def test_papers_become_files_in_few_folders(spark):
    rows = spark.createDataFrame([(f"p{i}", f"text {i}" if i else None) for i in range(200)], "paper_id string, md string")
    path = queries._paper_files(spark, rows, "paper_id")
    assert len(glob.glob(f"{path}/*")) <= 64 and len(glob.glob(f"{path}/*/*.txt")) == 200
    read = {r.source_name: r.md for r in papers.read_papers(spark, path).collect()}
    assert read == {f"p{i}": f"text {i}\n" if i else "\n" for i in range(200)}
