"""A lookup of references builds their keys once, however many searches read them."""

from peerlight.operators import citations


def test_reference_keys_are_built_once(spark, monkeypatch):
    built = []
    plain = citations.ref_keys
    monkeypatch.setattr(citations, "ref_keys", lambda *a: built.append(1) or plain(*a))
    refs = spark.createDataFrame(
        [("p", f"ref-{i}", f"A. (2001). Work number {i} of many", f"Work number {i} of many", ["A"], 2001, None, f"10.1/{i}", None) for i in range(9)],
        "paper_id string, ref_id string, raw string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string",
    )
    catalog = spark.createDataFrame(
        [("crossref", f"cr-{i}", f"Work number {i} of many", ["A"], 2001, "V", f"10.1/{i}", None, None) for i in range(3)],
        "source string, catalog_id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, abstract string",
    )
    found = citations.lookup_refs(refs, catalog)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert built == [1] and "raw#" not in plan  # no search goes back to the references
    assert found.filter("status = 'FOUND' AND meta.doi IS NOT NULL").count() >= 3
