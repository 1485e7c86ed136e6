"""Does the cited abstract support the claim? Model verdicts with a keyword fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import patterns as P
from peerlight.functions import text as T
from peerlight.functions.numbers import clamp, fixed, round_exact
from peerlight.operators.claims import embedded, json_object, strip_fences
from peerlight.operators.inference import request_rows
from peerlight.operators.verification import claim_refs
from peerlight.session import bounded_batches
from peerlight.sources.configs import Configs, config_array

# The prompt texts.
SYSTEM = """You are a careful scientific reviewer.
Given a claim from a paper and the abstract of the paper it cites, decide
whether the abstract SUPPORTS the claim.

Output rules:
- Return ONLY JSON, no prose.
- Schema: {"supported": true|false, "confidence": 0..1, "rationale": "..."}
- "supported" is true ONLY if the abstract clearly endorses the claim.
- "confidence" reflects how sure you are, not how true the claim is in the world.
- "rationale" is one sentence max, quoting the relevant span if possible.
"""


def entailment_pairs(claims: DataFrame, lookups: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(claim, cited ref) pairs whose reference was FOUND, with the abstract if known."""
    found = claim_refs(claims, lookups).filter("status = 'FOUND'")
    return (
        found.select("paper_id", "claim_id", "ref_pos", "ref_id")
        .join(claims.select("paper_id", "claim_id", F.col("text").alias("claim_text")), ["paper_id", "claim_id"])
        .join(abstracts.select("paper_id", "ref_id", "abstract"), ["paper_id", "ref_id"], "left")
        .withColumn("abstract", T.blank_to_null(T.strip(F.col("abstract"))))
    )


def shared_words(claim: Column, abstract: Column) -> Column:
    """(c, a, shared): distinct content words (``functions.text.content_words``) of a claim, of an
    abstract, and of both; NULL for a NULL text.

    Most claims that cite a reference stand together, so an abstract's words are found once for
    many pairs, by the row before.
    """
    # Words are ASCII and start at the first letter of a run, so bytes in lower case give the same.
    stop = frozenset(w.encode() for w in P.STOPWORDS)
    word = r"[a-z][a-z0-9\-]{2,}"

    @F.arrow_udf("c int, a int, shared int")
    def counts(claims, abstracts):
        import re

        import pyarrow as pa

        find = re.compile(word.encode()).findall

        def words(text):
            return None if text is None else set(find(text.lower())) - stop

        c, a, shared = [], [], []
        texts = [x.cast(pa.binary()).to_pylist() for x in (claims, abstracts)]
        last, of_last = None, None
        for claim_text, abstract_text in zip(*texts):
            if abstract_text != last:
                last, of_last = abstract_text, words(abstract_text)
            of_claim = words(claim_text)
            c.append(None if of_claim is None else len(of_claim))
            a.append(None if of_last is None else len(of_last))
            shared.append(None if of_claim is None or of_last is None else len(of_claim & of_last))
        arrays = [pa.array(x, pa.int32()) for x in (c, a, shared)]
        return pa.StructArray.from_arrays(arrays, ["c", "a", "shared"])

    return counts(claim, abstract)


def keyword_verdict(claim: Column, abstract: Column) -> Column:
    """(verdict, confidence, rationale) from shared content words."""

    def judge(n: Column) -> Column:
        recall = n["shared"] / n["c"]
        overlap = n["shared"] / (n["c"] + n["a"] - n["shared"])
        empty = (n["c"] == 0) | (n["a"] == 0)
        return F.when(
            empty,
            F.struct(
                F.lit("INSUFFICIENT").alias("verdict"),
                F.lit(0.0).alias("confidence"),
                F.lit("Keyword fallback: empty tokenization.").alias("rationale"),
            ),
        ).otherwise(
            F.struct(
                F.when(recall >= P.KEYWORD_SUPPORT, F.lit("SUPPORTED"))
                .otherwise(F.lit("NOT_SUPPORTED"))
                .alias("verdict"),
                round_exact(F.least(F.lit(1.0), F.greatest(overlap, recall / 2))).alias("confidence"),
                F.concat(
                    F.lit("Keyword fallback: "), n["shared"].cast("string"), F.lit("/"),
                    n["c"].cast("string"),
                    F.lit(" claim tokens found in abstract (recall="), fixed(recall, 2), F.lit(")"),
                ).alias("rationale"),
            )
        )

    return T.let(shared_words(claim, abstract), judge)


def judged(pairs: DataFrame) -> DataFrame:
    """Pairs with their keyword verdict ``k`` beside the texts, to be stored once."""
    bounded_batches(pairs.sparkSession)
    return pairs.withColumn("k", keyword_verdict(F.col("claim_text"), F.col("abstract")))


def keyword_entailment(pairs: DataFrame) -> DataFrame:
    """Keyword verdict for every pair with an abstract."""
    return judged(pairs).select(
        *[c for c in pairs.columns if c not in ("claim_text", "abstract")], "k.*"
    )


def entailment_requests(
    pairs: DataFrame, model: str = P.DEFAULT_MODEL, provider: str = "stub"
) -> DataFrame:
    """One request per pair that has an abstract."""
    # The wording of the prompt.
    prompt = F.concat(
        F.lit("Claim: "), F.col("claim_text"),
        F.lit("\n\nAbstract of cited paper:\n---\n"), F.col("abstract"),
        F.lit("\n---\n\nReturn JSON now."),
    )
    asked = pairs.filter(F.col("abstract").isNotNull())
    return request_rows(
        asked.select("paper_id", "claim_id", "ref_pos", "ref_id", prompt.alias("prompt")),
        kind="entailment", system=SYSTEM, model=model, max_tokens=256, provider=provider,
    )


def response_object(text: Column) -> Column:
    """Fields of the JSON object in a response, fenced or embedded in prose."""
    return T.let(
        strip_fences(text),
        lambda b: F.coalesce(json_object(b), json_object(embedded(b, "{", "}"))),
    )


def _truthy(c: Column) -> Column:
    """JSON text as a truth value: false, null, 0 and empty values are false."""
    return ~F.coalesce(c.isin("false", "null", "", "0", "0.0", "[]", "{}"), F.lit(True))


#: Characters of a model's rationale that are kept for a verdict and for a rubric dimension.
VERDICT_CHARS, DIMENSION_CHARS = 500, 1000


def parse_entailment(responses: DataFrame, rationale_chars: int = VERDICT_CHARS) -> DataFrame:
    """Adds ``parsed`` (verdict, confidence, rationale) to response rows; NULL if unusable.

    The response's own text stays in the row, with the whole rationale.
    """
    obj = F.col("_o")
    number = F.when(
        F.map_contains_key(obj, "confidence"), F.try_element_at(obj, F.lit("confidence")).try_cast("double")
    ).otherwise(F.lit(0.5))
    has = F.coalesce(F.map_contains_key(obj, "supported"), F.lit(False)) & number.isNotNull()
    parsed = F.struct(
        F.when(_truthy(F.try_element_at(obj, F.lit("supported"))), F.lit("SUPPORTED"))
        .otherwise(F.lit("NOT_SUPPORTED"))
        .alias("verdict"),
        clamp(number, 0.0, 1.0).alias("confidence"),
        F.substring(F.coalesce(F.try_element_at(obj, F.lit("rationale")), F.lit("")), 1, rationale_chars).alias(
            "rationale"
        ),
    )
    return (
        responses.withColumn("_o", response_object(F.col("text")))
        .withColumn("parsed", F.when(has, parsed))
        .drop("_o")
    )


def entailment(pairs: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Final verdict per pair: no abstract, model verdict, or keyword fallback.

    Pairs that hold their keyword verdict ``k`` (``judged``) are not judged again. Texts are left
    behind before the join with the responses.
    """
    keys = ["paper_id", "claim_id", "ref_pos", "ref_id"]
    rows = pairs if "k" in pairs.columns else judged(pairs)
    base = rows.select(*keys, "k", F.col("abstract").isNull().alias("no_abstract"))
    kind = "struct<verdict:string,confidence:double,rationale:string>"
    if responses is not None:
        said = parse_entailment(responses).select(*keys, "parsed")
        base = base.join(said, keys, "left")
    else:
        base = base.withColumn("parsed", F.lit(None).cast(kind))
    none = F.struct(
        F.lit("INSUFFICIENT").alias("verdict"),
        F.lit(0.0).alias("confidence"),
        F.lit("No abstract available for cited paper.").alias("rationale"),
    )
    chosen = F.when(F.col("no_abstract"), none).otherwise(F.coalesce("parsed", "k"))
    method = (
        F.when(F.col("no_abstract"), F.lit("no_abstract"))
        .when(F.col("parsed").isNotNull(), F.lit("llm"))
        .otherwise(F.lit("keyword"))
    )
    return base.select(*keys, chosen.alias("c"), method.alias("method")).select(*keys, "c.*", "method")


def parse_rubric(
    responses: DataFrame, configs: Configs = None, rationale_chars: int = DIMENSION_CHARS
) -> DataFrame:
    """Rubric responses (paper_id, config_id, text) to ``model_dims`` maps.

    A dimension with a missing or malformed entry is left out.
    """
    mine = F.filter(config_array(configs), lambda c: c["config_id"] == F.col("config_id"))
    opened = responses.select(
        "paper_id",
        "config_id",
        F.transform(F.get(mine, F.lit(0))["dims"], lambda d: d["name"]).alias("names"),
        response_object(F.col("text")).alias("o"),
    )

    def entry(name: Column) -> Column:
        return T.let(
            json_object(F.try_element_at("o", name)),
            lambda e: F.struct(
                name.alias("name"),
                F.struct(
                    F.try_element_at(e, F.lit("score")).try_cast("double").alias("score"),
                    F.substring(
                        F.coalesce(F.try_element_at(e, F.lit("rationale")), F.lit("")), 1, rationale_chars
                    ).alias("rationale"),
                ).alias("v"),
            ),
        )

    entries = F.filter(
        F.transform("names", entry), lambda x: x["v"]["score"].isNotNull()
    )
    return opened.select(
        "paper_id",
        "config_id",
        F.coalesce(
            F.map_from_entries(entries),
            F.create_map().cast("map<string,struct<score:double,rationale:string>>"),
        ).alias("model_dims"),
    )
