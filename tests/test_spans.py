from pyspark.sql import functions as F

from peerlight.functions import text as T
from peerlight.operators import claims as CL

TEXTS = ["", " ", "short", "Ünïcode TEXT with İ inside and a tail " * 3, "x" * 39, "y" * 40, "The model reaches " + "a result of note " * 8]
CLAIMS = [
    "", "  ", "short", "SHORT ", "xx", "y" * 40, "y" * 41, "nowhere", "İ INSIDE",
    "the model reaches a result of note a result of note and then something else entirely, at some length",
    "The model reaches a result of note a resul", "The model reaches a result of note a result, cut otherwise " * 2,
]


def _span(claim, text):
    n, low = claim.strip().lower(), text.lower()
    for length in (len(n), max(40, len(n) // 2), 40):
        if 0 < length <= len(n) and n[:length] in low:
            at = low.index(n[:length])
            return at, min(at + length, len(text))
    return 0, len(text)


def test_spans_are_those_of_the_longest_start_found(spark):
    df = spark.createDataFrame([(c, t) for c in CLAIMS for t in TEXTS], "claim string, text string")
    got = df.select("claim", "text", CL.span_of(F.col("claim"), F.col("text")).alias("s")).select("claim", "text", "s.*")
    for r in got.collect():
        assert (r.char_start, r.char_end) == _span(r.claim, r.text), r


def test_a_text_without_the_start_of_a_claim_is_searched_once(spark):
    # It was searched for the whole claim, for half of it and for its start.
    plan = spark.range(1).select(CL.span_of(F.lit("c"), F.concat("id", F.lit("t"))).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(concat(") == 1 and "contains(" in plan.lower()


def test_blank_texts(spark):
    texts = [None, "", " \t\n \x1f", "a", " a", "a ", "​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.is_blank(F.col("t")).alias("new"), (T.strip(F.col("t")) == "").alias("old")).collect()
    assert [r.new for r in got] == [r.old for r in got] == [None, True, True, False, False, False, False]
