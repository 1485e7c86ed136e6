from pyspark.sql import functions as F

from peerlight.functions import text as T
from peerlight.operators import entailment as EN

ODD = [
    None, "", " ", "the of", "A plain word", "3d-model 2-a x1 ab abc AB-", "--dash -x9y- 12ab34 a-", "Kelvin Kelvin İstanbul",
    "naïve cafés über-cool", "nul \x00 byte", "Word word WORD wOrD", "we can have our models", "tab\tline\nfeed\rend",
    "The model improves scores by 12 points on average (see model-v2).",
]


def test_words_are_counted_as_sets_of_content_words(spark):
    pairs = [(f"{i}", c, a) for i, (c, a) in enumerate((c, a) for a in ODD for c in ODD)]
    df = spark.createDataFrame(pairs, "id string, claim_text string, abstract string")
    c, a = T.content_words(F.col("claim_text")), T.content_words(F.col("abstract"))
    want = df.select("id", F.size(c).alias("c"), F.size(a).alias("a"), F.size(F.array_intersect(c, a)).alias("shared"),
                     F.size(F.array_union(c, a)).alias("both"))
    got = df.select("id", EN.shared_words(F.col("claim_text"), F.col("abstract")).alias("n")).select("id", "n.*")
    got = got.withColumn("both", F.expr("c + a - shared"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_an_abstract_is_searched_once_for_its_claims(spark):
    # Its words were found, and hashed three times, for every pair again.
    df = spark.createDataFrame([("p", "c", 0, "r", "some claim", "some text")], "paper_id string, claim_id string, ref_pos int, ref_id string, claim_text string, abstract string")
    plan = EN.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("ArrowEvalPython") == 1
    assert EN.judged(df).first().k.verdict == "SUPPORTED"
