"""Venue configs, weight presets and prices: small and bounded.

Configs are plain dictionaries (the fixed values of the shipped venues are below); they are
validated on the driver and become one row each, so their number is bounded by what a
caller types in.
"""

from __future__ import annotations

import copy
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlight.functions import patterns as P

MAX_CONFIGS = 1000
Configs = list[dict | str] | DataFrame | None

CONFIG_SCHEMA = (
    "config_id string, config_ord int, config_hash string, "
    "required_sections array<array<string>>, word_count_min int, word_count_max int, "
    "min_references int, require_ethics boolean, ethics_aliases array<string>, "
    "require_anonymization boolean, rubric_id string, "
    "dims array<struct<name:string,weight:double,max_score:double,description:string>>, "
    "length_adjust boolean, penalty_start int, penalty_full int, max_penalty double, "
    "weights struct<compliance:double,verification:double,depth:double,rubric:double>"
)

# The shipped venues.
NEURIPS = {
    "venue": "neurips",
    "compliance": {
        "required_sections": [
            ["abstract"],
            ["introduction", "background"],
            ["method", "methods", "methodology", "approach", "model"],
            ["experiment", "experiments", "evaluation", "results"],
            ["conclusion", "conclusions", "discussion"],
        ],
        "word_count_min": 3000,
        "word_count_max": 15000,
        "min_references": 10,
        "require_ethics": True,
        "ethics_aliases": [
            "ethics", "ethical considerations", "broader impact", "broader impacts",
            "societal impact", "limitations",
        ],
        "require_anonymization": True,
    },
    "rubric": {
        "id": "neurips-reviewer-v1",
        "dimensions": [
            {
                "name": "soundness",
                "weight": 0.3,
                "max_score": 4.0,
                "description": (
                    "Technical correctness, appropriate experimental design, and the extent to which "
                    "claims are supported by evidence.\n"
                ),
            },
            {
                "name": "presentation",
                "weight": 0.2,
                "max_score": 4.0,
                "description": "Clarity of exposition, figures, tables, and writing.\n",
            },
            {
                "name": "contribution",
                "weight": 0.25,
                "max_score": 4.0,
                "description": "Originality and the size of the step taken beyond prior work.\n",
            },
            {
                "name": "significance",
                "weight": 0.25,
                "max_score": 4.0,
                "description": "Expected impact on the research community.\n",
            },
        ],
        "bias_adjustment": {
            "enable_length_adjustment": True,
            "length_penalty_start": 10000,
            "length_penalty_full": 20000,
            "max_penalty": 0.3,
        },
    },
}
IEEE = {
    "venue": "ieee",
    "compliance": {
        "required_sections": [
            ["abstract"],
            ["introduction", "background"],
            [
                "method", "methods", "methodology", "approach", "proposed", "system",
                "architecture", "design",
            ],
            ["experiment", "experiments", "evaluation", "results", "analysis", "implementation"],
            ["conclusion", "conclusions", "discussion"],
        ],
        "word_count_min": 2000,
        "word_count_max": 10000,
        "min_references": 10,
        "require_ethics": False,
        "ethics_aliases": ["ethics", "broader impact", "limitations"],
        "require_anonymization": False,
    },
    "rubric": {
        "id": "ieee-tpc-v1",
        "dimensions": [
            {
                "name": "novelty",
                "weight": 0.3,
                "max_score": 5.0,
                "description": (
                    "Originality of the contribution relative to prior work. Does the paper introduce a "
                    "new technique, insight, or combination that hasn't appeared before?\n"
                ),
            },
            {
                "name": "technical_quality",
                "weight": 0.3,
                "max_score": 5.0,
                "description": (
                    "Rigor of the methodology, soundness of claims, completeness of experiments, and "
                    "correctness of analysis.\n"
                ),
            },
            {
                "name": "clarity",
                "weight": 0.2,
                "max_score": 5.0,
                "description": (
                    "Quality of writing, organization, figures, and tables. Would a practitioner be able "
                    "to understand and reproduce the work?\n"
                ),
            },
            {
                "name": "significance",
                "weight": 0.2,
                "max_score": 5.0,
                "description": (
                    "Likely impact on the community. Does this paper address an important problem, and do"
                    " the results materially advance the field?\n"
                ),
            },
        ],
        "bias_adjustment": {
            "enable_length_adjustment": True,
            "length_penalty_start": 7000,
            "length_penalty_full": 12000,
            "max_penalty": 0.2,
        },
    },
}
ARXIV = {
    "venue": "arxiv",
    "compliance": {
        "required_sections": [
            ["abstract"],
            ["introduction", "background", "overview"],
            [
                "method", "methods", "methodology", "approach", "technique", "model",
                "architecture", "framework",
            ],
            [
                "experiment", "experiments", "evaluation", "results", "analysis", "training",
                "empirical",
            ],
            ["conclusion", "conclusions", "discussion", "future work"],
        ],
        "word_count_min": 1000,
        "word_count_max": 40000,
        "min_references": 5,
        "require_ethics": False,
        "ethics_aliases": [
            "ethics", "broader impact", "broader impacts", "societal impact", "limitations",
        ],
        "require_anonymization": False,
    },
    "rubric": {
        "id": "arxiv-generic-v1",
        "dimensions": [
            {
                "name": "soundness",
                "weight": 0.3,
                "max_score": 4.0,
                "description": (
                    "Technical correctness, appropriate experimental design, and the extent to which "
                    "claims are supported by evidence.\n"
                ),
            },
            {
                "name": "presentation",
                "weight": 0.2,
                "max_score": 4.0,
                "description": "Clarity of exposition, figures, tables, and writing.",
            },
            {
                "name": "contribution",
                "weight": 0.25,
                "max_score": 4.0,
                "description": "Originality and the size of the step beyond prior work.",
            },
            {
                "name": "significance",
                "weight": 0.25,
                "max_score": 4.0,
                "description": "Expected impact on the field.",
            },
        ],
        "bias_adjustment": {
            "enable_length_adjustment": True,
            "length_penalty_start": 15000,
            "length_penalty_full": 30000,
            "max_penalty": 0.2,
        },
    },
}
TEMPLATE = {
    "venue": "my-venue-id",
    "compliance": {
        "required_sections": [
            ["abstract"],
            ["introduction"],
            ["method", "methods", "methodology"],
            ["experiment", "experiments", "results"],
            ["conclusion", "conclusions", "discussion"],
        ],
        "word_count_min": 3000,
        "word_count_max": 15000,
        "min_references": 10,
        "require_ethics": False,
        "ethics_aliases": ["ethics", "broader impact", "limitations"],
        "require_anonymization": False,
    },
    "rubric": {
        "id": "my-venue-rubric-v1",
        "dimensions": [
            {
                "name": "soundness",
                "weight": 0.3,
                "max_score": 4.0,
                "description": "Is the technical content correct? Are claims supported by evidence?\n",
            },
            {
                "name": "presentation",
                "weight": 0.2,
                "max_score": 4.0,
                "description": "Clarity of writing, figures, and exposition.",
            },
            {
                "name": "contribution",
                "weight": 0.25,
                "max_score": 4.0,
                "description": "Originality and significance of the contribution.",
            },
            {
                "name": "significance",
                "weight": 0.25,
                "max_score": 4.0,
                "description": "Expected impact on the field.",
            },
        ],
        "bias_adjustment": {
            "enable_length_adjustment": True,
            "length_penalty_start": 10000,
            "length_penalty_full": 20000,
            "max_penalty": 0.3,
        },
    },
}
SHIPPED = {"neurips": NEURIPS, "ieee": IEEE, "arxiv": ARXIV, "template": TEMPLATE}
DEFAULT_VENUES = ["neurips", "ieee", "arxiv"]


class ConfigError(ValueError):
    """A venue config breaks the config contract."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _only(block: dict, allowed: dict, where: str) -> dict:
    unknown = sorted(set(block) - set(allowed))
    _need(not unknown, f"unknown keys in {where}: {unknown}")
    return {**allowed, **block}


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Exactly the four stage keys, none negative, a positive sum."""
    unknown = sorted(set(weights) - set(P.SCORING_KEYS))
    _need(not unknown, f"unknown weight keys: {unknown}")
    for key in P.SCORING_KEYS:
        _need(key in weights, f"weights must include {key}")
        _need(weights[key] >= 0, f"weight for {key} must be >= 0")
    _need(sum(weights.values()) > 0, "at least one weight must be > 0")
    return {k: float(weights[k]) for k in weights}


def merge_weights(overrides: dict[str, float]) -> dict[str, float]:
    """Overrides over the defaults; unknown keys are rejected."""
    return check_weights({**P.DEFAULT_WEIGHTS, **overrides})


def complete_config(raw: dict) -> dict:
    """Validate a config and fill in defaults."""
    top = _only(raw, {"venue": "", "compliance": None, "rubric": None, "scoring": {}}, "config")
    _need(bool(top["venue"]), "venue must not be empty")
    _need(isinstance(top["compliance"], dict), "config has no compliance block")
    _need(isinstance(top["rubric"], dict), "config has no rubric block")
    compliance = _only(
        copy.deepcopy(top["compliance"]),
        {
            "required_sections": [], "word_count_min": None, "word_count_max": None,
            "min_references": None, "require_ethics": False, "ethics_aliases": [],
            "require_anonymization": False,
        },
        "compliance",
    )
    for key in ("word_count_min", "word_count_max", "min_references"):
        _need(compliance[key] is None or compliance[key] >= 0, f"{key} must be >= 0")
    rubric = _only(
        copy.deepcopy(top["rubric"]), {"id": "", "dimensions": [], "bias_adjustment": {}}, "rubric"
    )
    _need(bool(rubric["id"]), "rubric id must not be empty")
    _need(len(rubric["dimensions"]) > 0, "rubric needs at least one dimension")
    dims = []
    for raw_dim in rubric["dimensions"]:
        dim = _only(
            raw_dim, {"name": "", "weight": 0.0, "max_score": 0.0, "description": ""}, "dimension"
        )
        _need(bool(dim["name"]), "dimension name must not be empty")
        _need(dim["weight"] > 0 and dim["max_score"] > 0, "weight and max_score must be > 0")
        _need(len(dim["description"]) <= 2000, "description is limited to 2000 characters")
        dim["weight"], dim["max_score"] = float(dim["weight"]), float(dim["max_score"])
        dims.append(dim)
    bias = _only(
        rubric["bias_adjustment"],
        {
            "enable_length_adjustment": True, "length_penalty_start": 10000,
            "length_penalty_full": 20000, "max_penalty": 0.3,
        },
        "bias_adjustment",
    )
    _need(
        bias["length_penalty_full"] > bias["length_penalty_start"],
        "length_penalty_full must exceed length_penalty_start",
    )
    _need(0.0 <= bias["max_penalty"] <= 1.0, "max_penalty must be in [0, 1]")
    scoring = _only(top["scoring"], {"weights": dict(P.DEFAULT_WEIGHTS)}, "scoring")
    return {
        "venue": top["venue"],
        "compliance": compliance,
        "rubric": {"id": rubric["id"], "dimensions": dims, "bias_adjustment": bias},
        "scoring": {"weights": check_weights(scoring["weights"])},
    }


def config_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of the canonical JSON."""
    payload = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(payload.encode("utf-8")).hexdigest()[:16]


def config_rows(configs: Configs = None) -> list[tuple]:
    """Validated config tuples in caller order. Names refer to the shipped venues."""
    if isinstance(configs, DataFrame):
        rows = [tuple(r) for r in configs.limit(MAX_CONFIGS + 1).collect()]
        _need(len(rows) <= MAX_CONFIGS, f"more than {MAX_CONFIGS} configs")
        return rows
    chosen = configs if configs is not None else DEFAULT_VENUES
    _need(len(chosen) <= MAX_CONFIGS, f"more than {MAX_CONFIGS} configs")
    rows = []
    for ord_, item in enumerate(chosen):
        if isinstance(item, str):
            _need(item in SHIPPED, f"unknown config {item!r}")
            name, raw = item, SHIPPED[item]
        else:
            name, raw = item.get("venue", ""), item
        cfg = complete_config(raw)
        comp, rub, bias = cfg["compliance"], cfg["rubric"], cfg["rubric"]["bias_adjustment"]
        rows.append(
            (
                name, ord_, config_hash(cfg), comp["required_sections"], comp["word_count_min"],
                comp["word_count_max"], comp["min_references"], comp["require_ethics"],
                comp["ethics_aliases"], comp["require_anonymization"], rub["id"],
                [(d["name"], d["weight"], d["max_score"], d["description"]) for d in rub["dimensions"]],
                bias["enable_length_adjustment"], bias["length_penalty_start"],
                bias["length_penalty_full"], float(bias["max_penalty"]),
                tuple(cfg["scoring"]["weights"][k] for k in P.SCORING_KEYS),
            )
        )
    _need(len({r[0] for r in rows}) == len(rows), "config ids must be unique")
    return rows


def venue_configs(spark: SparkSession, configs: Configs = None) -> DataFrame:
    """The configs as a table, one row each."""
    return spark.createDataFrame(config_rows(configs), CONFIG_SCHEMA)


def config_array(configs: Configs = None) -> Column:
    """The configs as one constant array of structs.

    A paper meets every config by exploding this constant, so papers x configs is a narrow
    step without any join. The array is folded into the plan; MAX_CONFIGS bounds it.
    """
    names = [f.name for f in _schema().fields]
    items = [dict(zip(names, row, strict=True)) for row in config_rows(configs)]
    for item in items:
        item["dims"] = [
            dict(zip(("name", "weight", "max_score", "description"), d, strict=True))
            for d in item["dims"]
        ]
        item["weights"] = dict(zip(P.SCORING_KEYS, item["weights"], strict=True))
    kind = T.ArrayType(_schema()).simpleString()
    return F.from_json(F.lit(json.dumps(items)), kind, {"mode": "FAILFAST"})


def _schema() -> T.StructType:
    return T.StructType.fromDDL(CONFIG_SCHEMA)


def times_configs(df: DataFrame, configs: Configs = None) -> DataFrame:
    """Every row once per config, with the config's columns."""
    return df.select("*", F.inline(config_array(configs)))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Venue configs from JSON files (one config per file); more than ``MAX_CONFIGS`` are an
    error, as every paper meets every config."""
    files = spark.read.text(path, wholetext=True).limit(MAX_CONFIGS + 1).collect()
    return venue_configs(spark, [json.loads(r.value) for r in files])


def weight_presets(spark: SparkSession) -> DataFrame:
    """The named weight sets (preset, preset_ord, four weights)."""
    rows = [(n, i, a, b, c, d) for i, (n, a, b, c, d) in enumerate(P.WEIGHT_PRESETS)]
    return spark.createDataFrame(
        rows,
        "preset string, preset_ord int, compliance double, verification double, depth double, "
        "rubric double",
    )


def model_prices(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """USD per million tokens by model; ``overrides`` (same columns) win over defaults."""
    base = spark.createDataFrame(
        P.MODEL_PRICES, "model string, input_per_mtok double, output_per_mtok double"
    )
    if overrides is None:
        return base
    fresh = overrides.select("model", "input_per_mtok", "output_per_mtok")
    return base.join(fresh, "model", "left_anti").unionByName(fresh)
