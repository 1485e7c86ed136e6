from pyspark.sql.classic.dataframe import DataFrame

from peerlight.sources import auditlog
from peerlight.streaming.intake import review_stream


def test_a_batch_is_read_once(spark, tmp_path, monkeypatch):
    # Asking first whether a batch holds rows reads all its files once more.
    def asked(self):
        raise AssertionError("read twice")

    monkeypatch.setattr(DataFrame, "isEmpty", asked)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n## Introduction\n" + "word " * 50)
    log = f"{tmp_path}/log"
    review_stream(spark, f"{tmp_path}/in", ["ieee"], log, f"{tmp_path}/cp").awaitTermination()
    assert auditlog.read_log(spark, log).count() == 1
