"""Schemas of the stored tables and of the JSON that crosses system borders."""

AUDIT_LOG = (
    "evaluation_id string, paper_id string, config_id string, created_at timestamp, "
    "engine_version string, cost_usd double, word_count int, rubric_raw_total double, "
    "rubric_adjusted_total double, compliance_triage string, total_claims int, "
    "hallucination_count int, record_json string, config_hash string, run_id string"
)
COST_LOG = (
    "timestamp timestamp, provider string, model string, prompt_tokens bigint, "
    "completion_tokens bigint, cost_usd double, kind string"
)
REQUESTS = (
    "cache_key string, kind string, paper_id string, unit_id string, system string, "
    "prompt string, model string, temperature double, max_tokens int, stop array<string>, "
    "seed int"
)
RESPONSES = (
    "cache_key string, text string, model string, provider string, prompt_tokens bigint, "
    "completion_tokens bigint, cost_usd double, finish_reason string"
)
EMBEDDINGS = (
    "cache_key string, vectors array<array<double>>, model string, provider string, "
    "prompt_tokens bigint, cost_usd double"
)
CATALOG = (
    "source string, source_rank int, catalog_id string, title string, authors array<string>, "
    "year int, venue string, doi string, arxiv_id string, abstract string"
)
CHECK = "struct<name:string,passed:boolean,detail:string>"
CLAIM = (
    "struct<claim_id:string,text:string,claim_type:string,severity:string,section_id:string,"
    "char_start:int,char_end:int,ref_ids:array<string>>"
)
RESULT = (
    "struct<claim_id:string,verified:boolean,confidence:double,source:string,evidence:string,"
    "hallucination_flag:boolean,notes:string>"
)
DIMENSION = (
    "struct<name:string,score:double,max_score:double,weight:double,rationale:string>"
)
# A saved evaluation record.
RECORD = (
    "paper_id string, config_id string, config_hash string, title string, abstract string, "
    "word_count int, n_refs int, triage string, "
    f"section_checks array<{CHECK}>, format_checks array<{CHECK}>, issues array<string>, "
    "n_passed int, n_checks int, total_claims int, verified_count int, "
    "hallucination_count int, mean_confidence double, methodology double, "
    "limitations double, reproducibility double, logical_soundness double, "
    "rationales map<string,string>, rubric_id string, "
    f"dimensions array<{DIMENSION}>, raw_total double, bias_adjusted_total double, "
    "adjustment_notes array<string>, composite double, recommendation string, "
    "breakdown map<string,double>, banner string, created_at timestamp"
)
