"""Headline timings: prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores.  Every query is written to
the ``noop`` sink, so all rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clauselens.catalogue.registry import QUERIES  # noqa: E402
from clauselens.session import local_session  # noqa: E402

HEADLINE = (
    "c1_c3_chunks", "c2_page_chunks", "e1_e7_entities", "r3_r7_hits", "r13_r14_clauses", "r15_collapse",
    "r21_reports", "r21_page_reports", "q7_portfolio", "q17_link_chunks", "l4_locate",
    "v1_cosine_topk", "v2_approx_topk", "s4_exact_duplicates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    chunks, clauses = (QUERIES[name](spark, sf_dir).count() for name in ("c1_c3_chunks", "r13_r14_clauses"))
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total headline query time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None, "cores": cpus,
        "documents": docs, "report_documents_per_sec": round(docs / times["r21_reports"], 1),
        "chunks_per_sec": round(chunks / times["c1_c3_chunks"], 1),
        "clause_rows_per_sec": round(clauses / times["r13_r14_clauses"], 1),
    }))


if __name__ == "__main__":
    main()
