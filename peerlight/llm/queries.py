"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from peerlight.llm import (
    ann,
    bpe,
    langid,
    license_scan,
    mixing,
    periodic_runs,
    quality_qda,
    quality_rules,
    resampling,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sharding": sharding.op2_sharding,
    "op3_bpe": bpe.op3_bpe,
    "op4_ann": ann.op4_ann,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality_qda.op6_quality,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_langid": langid.op8_langid,
    "op9_simhash": simhash.op9_simhash,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {"op1_mixing": mixing.OP1_SQL, "op11_resampling": resampling.OP11_SQL}
