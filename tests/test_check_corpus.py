"""Check papers are built and parsed once by a query, however many steps read them."""

import pytest

from checks import corpus, queries
from peerlight.operators.parsing import parse_papers

SF = "/root/testdata/sf0.001"


def test_a_paper_is_built_once(spark):
    plan = parse_papers(corpus.papers(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("# Study of ") == 1  # the filter on blank texts had a copy of it


@pytest.mark.parametrize("name", ["r23_bucketed_claims", "a2_verify_claims", "j9b_entailment_keyword_only"])
def test_papers_are_parsed_once(spark, monkeypatch, name):
    parsed = []
    plain = queries._parsed
    monkeypatch.setattr(queries, "_parsed", lambda *a: parsed.append(1) or plain(*a))
    assert queries.QUERIES[name](spark, SF).columns and parsed == [1]
