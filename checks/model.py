"""A deterministic stand-in for a language model: replies are SQL functions of the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlight.functions import text as T

STOCK = [
    "We reach 95.3% accuracy, the first to do so.",
    "Since 2015 the field has grown.",
    "The method can scale to large inputs.",
    "Scores improve by 12 points on average.",
    "Prior work [3] outperforms all baselines.",
    "A plain observation.",
    "Our novel model beats (Smith, 2019).",
]


def _pick(n: Column, texts: list[str]) -> Column:
    return F.get(F.array(*[F.lit(t) for t in texts]), (n % len(texts)).cast("int"))


def _claim(text: Column, ids: Column) -> Column:
    return F.to_json(F.struct(text.alias("text"), ids.alias("ref_ids")))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def claim_reply(prompt: Column) -> Column:
    """Replies in every shape a model may use: bare, fenced, in prose, broken, mixed, too long."""
    title = F.regexp_extract(prompt, r"(?s)^Section title: (.*?)\n\nReference ids", 1)
    text = F.regexp_extract(prompt, r"(?s)Section text:\n---\n(.*)\n---\n\nReturn the JSON array now\.$", 1)
    return T.let(F.struct(title.alias("title"), text.alias("text")), _claim_reply)


def _claim_reply(section: Column) -> Column:
    # The length and the stock text are found once, not for every item of a reply.
    return T.let(
        F.length(section["text"]),
        lambda n: T.let(_pick(n, STOCK), lambda stock: _claims_of(section["title"], section["text"], n, stock)),
    )


def _claims_of(title: Column, text: Column, n: Column, stock: Column) -> Column:
    none = F.array().cast("array<string>")
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    a = _claim(F.substring(text, 1, 90), ids("ref-1", "ref-2", "ref-99"))
    b = _claim(stock, none)
    c = _claim(_cat("Reported under ", title), ids("ref-3", "ref-3", "ref-1"))
    many = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda i: _claim(
            _cat("Item ", i.cast("string"), ": ", stock),
            F.array(_cat("ref-", (i + 1).cast("string"))),
        ),
    )
    return (
        F.when(n % 6 == 0, _cat("[", a, ", ", b, "]"))
        .when(n % 6 == 1, _cat("```json\n[", a, "]\n```"))
        .when(n % 6 == 2, _cat("Here you go: [", b, ",", c, "] - done."))
        .when(n % 6 == 3, F.lit("I cannot help [with that"))
        .when(
            n % 6 == 4,
            _cat('["loose", {"text": ""}, {"text": 5, "ref_ids": []}, ', b, ', {"ref_ids": []}]'),
        )
        .otherwise(_cat("[", F.array_join(many, ","), "]"))
    )


def entailment_reply(prompt: Column) -> Column:
    n = F.length(F.regexp_extract(prompt, r"(?s)^Claim: (.*?)\n\nAbstract of cited paper:", 1))
    return _pick(
        n,
        [
            '{"supported": false, "confidence": 0.9, "rationale": "it says no"}',
            '```json\n{"supported": true}\n```',
            "cannot tell",
            '{"supported": false, "confidence": 1.7}',
            'Sure: {"supported": 0, "confidence": 0.65, "rationale": "weak"} ok',
        ],
    )


def rubric_reply(prompt: Column) -> Column:
    n = F.length(F.regexp_extract(prompt, r"(?s)^Paper title: (.*?)\n\nAbstract:", 1))
    return _pick(
        n,
        [
            '{"soundness": {"score": 9, "rationale": "solid"}, "clarity": {"score": "2.5"}}',
            '```json\n{"presentation": {"score": 3, "rationale": "fine"}, '
            '"significance": {"score": 1.25, "rationale": "meh"}, "soundness": 4}\n```',
            '{"soundness": {"rationale": "no score"}}',
            "no idea",
        ],
    )


def replies(requests: DataFrame) -> DataFrame:
    """Requests (cache_key, kind, prompt, model) to response rows."""
    text = (
        F.when(F.col("kind") == "decompose", claim_reply(F.col("prompt")))
        .when(F.col("kind") == "entailment", entailment_reply(F.col("prompt")))
        .otherwise(rubric_reply(F.col("prompt")))
    )
    return requests.select(
        "cache_key",
        text.alias("text"),
        "model",
        F.lit("check").alias("provider"),
        F.length("prompt").cast("bigint").alias("prompt_tokens"),
        F.length(text).cast("bigint").alias("completion_tokens"),
        F.lit(0.0).alias("cost_usd"),
        F.lit("stop").alias("finish_reason"),
    )
