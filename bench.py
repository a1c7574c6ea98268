"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and fully executed into a no-op sink once, in a session warmed by one
small query; no intermediate table is carried over from one query to the next.
"""

from __future__ import annotations

import json
import os
import re
import time

from carelattice.plans.catalog import QUERIES, forget
from carelattice.session import local_session

HEADLINE = ["worsening_trends", "trend_stats", "normalized_events", "clinical_facts", "contradictions_status", "entities",
            "relationships", "risk_alerts", "specialty_report", "patient_digest", "bm25_topk", "vector_topk",
            "hybrid_search", "conversation_context", "chunks", "evidence_subgraph"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")

    def run(name: str) -> float:
        forget()
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t, 3)

    run("patient_digest")
    times = {name: run(name) for name in names}
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None, "cpus": int(cpus),
                      "spark": spark.version}))


if __name__ == "__main__":
    main()
