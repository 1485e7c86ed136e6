from pyspark.sql import functions as F

from checks import model
from peerlight.operators.parsing import block_array
from peerlight.operators.rubric_requests import excerpts


def _plan(spark, column):
    return spark.range(1).select(column.alias("x"))._jdf.queryExecution().analyzed().toString()


def test_a_reply_reads_its_prompt_once(spark):
    # Section text, length and stock text were found again for each of the twelve items of a reply.
    assert _plan(spark, model.claim_reply(F.concat("id", F.lit("")))).count("regexp_extract(") == 2


def test_headers_are_told_by_their_first_line(spark):
    # Patterns were tried on copies of the whole text of a block.
    plan = _plan(spark, block_array(F.concat("id", F.lit(""))))
    assert "rlike(substring_index(lambda" in plan.lower()
    text = "#\n# \n#x\n# T\n## \r\n##  A  \nbody # no\n####### seven\n\t# tab\n## B \n"
    df = spark.createDataFrame([(text,)], "md string")
    blocks = df.select(block_array(F.col("md")).alias("b")).first().b
    assert [(b.level, b.title, b.body) for b in blocks] == [
        (0, "", "#\n# \n#x"), (1, "T", "##"), (2, "A", "body # no\n####### seven\n\t# tab"), (2, "B", ""),
    ]


def test_excerpts_are_built_once(spark):
    one = spark.createDataFrame([([("Method", "text", 0)],)], "sections array<struct<title:string,text:string,ord:int>>")
    got = one.select(excerpts(F.col("sections")).alias("e"))
    assert got._jdf.queryExecution().analyzed().toString().count("filter(sections") == 1
    assert got.first().e == "### Method\ntext"
