"""Regular expressions, word lists and thresholds.

Every pattern carries ``(?U)`` so that ``\\b``, ``\\w``, ``\\d`` and ``\\s`` have the
Unicode meaning the expected results were produced with.
"""

from __future__ import annotations

# Whitespace characters that count for trimming and word splitting.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# As a regex class: single Latin-1 characters (a bit set in Java's engine) and, behind a
# range guard that ordinary letters fail at once, the wide ones.
WS_CLASS = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WS = f"[{WS_CLASS}]"
NOT_WS = f"[^{WS_CLASS}]"
WORD = r"(?U)[\S&&[^\x1c\x1d\x1e\x1f]]+"
INLINE_WS = "[" + WS_CLASS.replace(r"\n", "") + "]"

# --- document structure -----------------------------------------------------
# Line separators besides the newline: Latin-1 ones (as a regex) and wide ones.
LINE_BREAKS = r"\r\n?|[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LATIN_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x85]"
WIDE_BREAKS = ["\u2028", "\u2029"]
HEADER_START = rf"^#{{1,6}}{INLINE_WS}[^\n]"
HEADER_SPLIT = rf"(?m)(?={HEADER_START})"
SECTION_NUMBER = (
    r"(?i)^(?:[A-Z]\.?" + WS + r"*\d+(?:\.\d+)*\.?" + WS + r"+"
    r"|\d+(?:\.\d+)*\.?" + WS + r"+"
    r"|[IVXLCDM]{1,5}\.?" + WS + r"+)"
)
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
_ROW = rf"{INLINE_WS}*\|[^\n]+\|{INLINE_WS}*"
_RULE = rf"{INLINE_WS}*\|?{INLINE_WS}*:?-+:?{INLINE_WS}*(?:\|{INLINE_WS}*:?-+:?{INLINE_WS}*)+\|?{INLINE_WS}*"
PIPE_TABLE = rf"(?m)^{_ROW}\n{_RULE}$(?:\n{_ROW}$)*"
TABLE_CAPTION = rf"(?Ui)^{WS}*\*?\*?Table{WS}+\d+[:.]"

REFERENCE_HEADERS = ["references", "bibliography", "works cited", "citations"]

# Lines of page text that are really section headers.
PAGE_HEADERS = [
    r"^\s*([IVX]{1,4})\.\s+([A-Z][A-Z\s\-&/]{2,60})\s*$",
    r"^\s*(\d+(?:\.\d+)*\.?)\s+([A-Z][A-Za-z0-9\s\-:,'&/()]{2,80})\s*$",
    r"(?i)^\s*(Abstract|Introduction|Related\s+Work|Background|Method(?:ology|s)?|"
    r"Approach|Experiments?|Results?|Discussion|Conclusions?|"
    r"References|Bibliography|Acknowledgm?ents?|Appendix|Limitations?|"
    r"Broader\s+Impact|Societal\s+Impact|Ethics)\s*$",
]
WORD_ANCHOR = r'(?Um)^\s*<a id="[^"]*"></a>\s*'
WORD_ESCAPE = r"\\([-\\().*_\[\]!])"

# --- references -------------------------------------------------------------
REF_MARKER = r"(?:\[\d+\]|\(\d+\)|\d+\.|\*|-)"
REF_MARKER_SPLIT = rf"(?Um)(?=^{REF_MARKER}{INLINE_WS}+{NOT_WS})"
REF_MARKER_LINE = rf"(?Um)^{REF_MARKER}{INLINE_WS}+{NOT_WS}"
REF_MARKER_PREFIX = rf"(?U)^{REF_MARKER}{WS}+"
DOI = r"(?Ui)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"
ARXIV_EXPLICIT = (
    r"(?Ui)arxiv[:\s]+((?:\d{4}\.\d{4,5})(?:v\d+)?|(?:[a-z\-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?)"
)
ARXIV_NEW = r"(?U)\b(\d{4}\.\d{4,5})(v\d+)?\b"
ARXIV_OLD = r"(?Ui)\b([a-z\-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?\b"
ARXIV_VERSION = r"(?Ui)v\d+$"
YEAR = r"(?U)\b((?:19|20)\d{2})\b"
BEFORE_YEAR = r"(?Us)^(.*?)\b(?:19|20)\d{2}\b"
TITLE_LEAD = rf"^(?:[).,]|{WS})*"
TITLE_END = r"(?Us)^(.*?)\.(?=\s+(?:[A-Z]|In\b|arXiv\b|Proceedings\b|Advances\b|https?:))"
AUTHOR_SPLIT = r"(?U),\s+(?=[A-Z])|\s+and\s+"

# --- claims -----------------------------------------------------------------
SKIP_SECTION = (
    r"(?Ui)^\s*(?:references|bibliography|acknowledg(?:e?ments?|ments)|"
    r"appendix(?:\s+[A-Z])?|author\s+contributions|funding)\s*$"
)
STAT_STRONG = (
    r"(?U)\b(?:\d+(?:\.\d+)?\s*%|[Pp]\s*[<>=]\s*0\.\d+"
    r"|(?:F1|BLEU|ROUGE|AUC|mAP|Top-?\d|AP|PR-AUC|R\^2|R-squared)\s*(?:score)?\s*[:=]?\s*\d+(?:\.\d+)?"
    r"|\d+(?:\.\d+)?\s*(?:times|fold|x)\s+(?:better|faster|higher|lower))"
)
STAT_NUMBER = r"(?U)\b\d+\.\d+\b|\b\d{2,}\b"
STAT_CUE = (
    r"(?Ui)\b(?:accuracy|precision|recall|score|loss|error|improve|gain|reduce|"
    r"increase|decrease|outperform|compared|average|mean|median|std)\b"
)
TEMPORAL = (
    r"(?Ui)\b(?:since|before|after|prior\s+to|as\s+of)\s+(?:19|20)\d{2}\b|\b(?:19|20)\d{2}\b"
)
CAPABILITY = r"(?Ui)\b(?:can|could|able\s+to|capable\s+of|enables?|allows?|achieves?\s+to)\b"
_NAME = r"[A-Z][A-Za-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][A-Za-z]+))?"
INLINE_CITATION = (
    rf"(?U)\[{_NAME},\s*(?:19|20)\d{{2}}\]"
    rf"|\({_NAME},\s*(?:19|20)\d{{2}}\)"
    rf"|\b{_NAME}\s*\(\s*(?:19|20)\d{{2}}[a-z]?\s*\)"
    r"|\[\d+\]"
)
NOVELTY = (
    r"(?Ui)\b(?:state[-\s]of[-\s]the[-\s]art|SOTA|first\s+to|"
    r"outperforms?\s+(?:all|every|prior|existing|the\s+best)|"
    r"novel(?:ly)?|breakthrough|proves?|guarantees?|"
    r"best(?:\s+ever)?\s+reported|unprecedented)\b"
)
BASE_SEVERITY = {
    "CITATION": "HIGH",
    "STATISTICAL": "HIGH",
    "CAPABILITY": "MEDIUM",
    "EMPIRICAL": "MEDIUM",
    "TEMPORAL": "LOW",
}
CODE_FENCE = r"(?Uim)^```(?:json)?\s*|\s*```$"
MAX_CLAIMS_PER_SECTION = 10

# --- depth ------------------------------------------------------------------
METHOD_TITLES = ["method", "methods", "methodology", "approach", "model", "architecture"]
LIMITATION_TITLES = [
    "limitations", "limitation", "broader impact", "broader impacts", "discussion", "ethics",
]
RESULT_TITLES = ["results", "experiments", "experiment", "evaluation", "analysis"]
INTRO_TITLES = ["introduction", "background"]
CONCLUSION_TITLES = ["conclusion", "conclusions", "future work"]
DATASET_CUE = (
    r"(?Ui)\b(?:dataset|benchmark|corpus|MNIST|CIFAR|ImageNet|GLUE|SuperGLUE|"
    r"WMT|SQuAD|COCO|LibriSpeech|OpenReview|arXiv)\b"
)
BASELINE_CUE = r"(?Ui)\b(?:baseline|baselines|comparison|compared\s+to|vs\.?)\b"
ABLATION_CUE = r"(?Ui)\babla(?:tion|te|ted)\b"
METRIC_CUE = (
    r"(?Ui)\b(?:accuracy|precision|recall|F1|BLEU|ROUGE|AUC|mAP|perplexity|error\s+rate)\b"
)
CODE_URL = (
    r"(?U)https?://(?:github\.com|gitlab\.com|huggingface\.co|zenodo\.org|codeocean\.com)/\S+"
)
SEED_CUE = r"(?Ui)\b(?:random\s+seed|np\.random|torch\.manual_seed|seed\s*=\s*\d+)\b"
HYPERPARAM_CUE = (
    r"(?Ui)\b(?:learning\s+rate|batch\s+size|hyperparameter|optimizer|Adam|SGD|"
    r"dropout|weight\s+decay|epoch|warmup)\b"
)
LIMITATION_WORDS = (
    r"(?Ui)\b(?:limitation|shortcoming|caveat|weakness|does\s+not\s+generalize|"
    r"fails\s+to|cannot|future\s+work|broader\s+impact)\b"
)

# --- compliance and venue detection -------------------------------------------
ANONYMOUS_MARKERS = ["anonymous", "anon", "anonymized"]
ROMAN_HEADER = r"(?Um)^\s*[IVX]+\.\s+[A-Z][A-Z \-]{2,}\s*$"
ARXIV_MENTION = (
    r"(?Ui)\barXiv[:\s]\d{4}\.\d{4,5}(?:v\d+)?|arxiv\.org/abs/\d{4}\.\d{4,5}(?:v\d+)?"
)
IMPACT_LANGUAGE = r"(?Ui)broader\s+impact|societal\s+impact|checklist\s+for\s+authors"

# --- entailment, matching -------------------------------------------------------
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "from", "by",
    "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "we",
    "our", "us", "it", "its", "as", "can", "may", "has", "have", "had",
]
CONTENT_TOKEN = r"[A-Za-z][A-Za-z0-9\-]+"
NAME_TOKEN = r"[A-Za-z][A-Za-z\-']+"
KEYWORD_SUPPORT = 0.25
REFUTE_CONFIDENCE = 0.7
MATCH_WEIGHTS = {"title": 0.5, "author": 0.25, "year": 0.15, "venue": 0.10}
MATCH_THRESHOLD = 0.6
TEMPORAL_CAP = 0.3
ORCID_ID = r"(?U)^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"
AUTHOR_MATCH_FLOOR = 0.34

# --- scoring ----------------------------------------------------------------
SCORING_KEYS = ["compliance", "verification", "depth", "rubric"]
DEFAULT_WEIGHTS = {"compliance": 0.15, "verification": 0.20, "depth": 0.20, "rubric": 0.45}
WEIGHT_PRESETS = [
    ("defaults", 0.15, 0.20, 0.20, 0.45),
    ("rubric-heavy", 0.05, 0.10, 0.10, 0.75),
    ("compliance-heavy", 0.40, 0.20, 0.15, 0.25),
    ("verification-heavy", 0.10, 0.45, 0.15, 0.30),
    ("equal", 0.25, 0.25, 0.25, 0.25),
    ("content-only", 0.00, 0.30, 0.30, 0.40),
]
TIPPING_ORDER = ["rubric-heavy", "verification-heavy", "content-only", "compliance-heavy", "equal"]
RECOMMENDATION_BANDS = [
    (0.85, "STRONG_ACCEPT"),
    (0.70, "ACCEPT"),
    (0.55, "WEAK_ACCEPT"),
    (0.45, "BORDERLINE"),
    (0.30, "WEAK_REJECT"),
    (0.15, "REJECT"),
]
LOWEST_BAND = "STRONG_REJECT"
ACCEPT_THRESHOLD = 0.55
FOUR_FIFTHS = 0.8

# USD per million tokens: (model, input, output).
MODEL_PRICES = [
    ("claude-opus-4-6", 15.0, 75.0),
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("claude-haiku-4-5", 1.0, 5.0),
    ("gpt-4o", 2.50, 10.0),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4.1", 2.0, 8.0),
    ("gpt-4.1-mini", 0.40, 1.60),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
]
DEFAULT_MODEL = "claude-sonnet-4-6"

# Closed value sets of the data contract.
ENUMS = {
    "claim_type": ["CITATION", "STATISTICAL", "CAPABILITY", "EMPIRICAL", "TEMPORAL"],
    "severity": ["CRITICAL", "HIGH", "MEDIUM", "LOW"],
    "source": ["crossref", "semantic_scholar", "openalex", "orcid", "llm", "heuristic", "none"],
    "triage": ["PASS", "CONDITIONAL", "FAIL"],
    "recommendation": [
        "STRONG_ACCEPT", "ACCEPT", "WEAK_ACCEPT", "BORDERLINE", "WEAK_REJECT", "REJECT",
        "STRONG_REJECT",
    ],
    "status": ["FOUND", "NOT_FOUND", "ERROR"],
    "verdict": ["SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT"],
}
SOURCE_RANKS = {"crossref": 0, "semantic_scholar": 1, "openalex": 2}
