"""Benchmark: headline jobs over the check corpus; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks import corpus, model
from checks import queries as registered
from peerlight.operators import citations, claims, fairness, parsing, references
from peerlight.plans import review
from peerlight.session import build_session, stage
from peerlight.sources import auditlog


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = f"bench-{int(time.time())}"
    # One file per core, as a corpus of many splits would have.
    papers = stage(corpus.papers(spark, sf_dir).repartition(int(cpus)), "papers", run)
    n_papers = papers.count()
    # Inputs of the later jobs are stored tables, as they are between the stages of a run.
    parsed = stage(parsing.parse_papers(papers), "parsed", run)
    refs = stage(references.refs(parsed), "refs", run)
    catalog = stage(corpus.catalog(spark, sf_dir), "catalog", run)
    log = stage(auditlog.log_rows(review.heuristic_review(parsed), "run"), "log", run)
    unique = review.Options(distinct_ids=True)

    def full_review():
        options = review.Options(
            distinct_ids=True, provider="bench", run_id=f"{run}-full", current_year=2020, max_age=20
        )
        return review.evaluate_papers(
            papers, catalog=catalog, infer=model.replies, options=options
        ).evaluations

    jobs = {
        "parse": lambda: parsing.parse_papers(papers),
        "evaluate_papers": lambda: review.evaluate_papers(papers, options=unique).evaluations,
        "evaluate_papers_with_copies": lambda: review.evaluate_papers(papers).evaluations,
        "full_review": full_review,
        "references": lambda: references.refs(parsed),
        "lookup_refs": lambda: citations.lookup_refs(refs, catalog),
        "claims": lambda: claims.build_claims(
            claims.parse_claims(
                claims.decompose_requests(parsed).select(
                    "paper_id",
                    F.col("unit_id").cast("int").alias("ord"),
                    model.claim_reply(F.col("prompt")).alias("text"),
                )
            ),
            parsed,
        ),
        "fairness_report": lambda: fairness.fairness_report(log),
        "cost_totals": lambda: registered.QUERIES["a10_cost_totals"](spark, sf_dir),
        "content_ids": lambda: registered.QUERIES["s2_content_ids"](spark, sf_dir),
    }
    times: dict[str, float] = {}
    planning: dict[str, float] = {}
    for name, job in jobs.items():
        start = time.time()
        result = job()
        planning[name] = round(time.time() - start, 3)
        result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline jobs, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "building_plans": planning,
                "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
                "papers": n_papers,
                "papers_per_sec": round(n_papers / times["evaluate_papers"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
