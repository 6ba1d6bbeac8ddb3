"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vellum.registry import everything  # noqa: E402
from vellum.session import local_session  # noqa: E402

HEADLINE = [
    "a4_corpus_stats", "l1_dense_top_k", "l2_bm25_top_k", "p3_hybrid_search", "p5_suggest", "x11_html_to_text", "g1_text_splitter",
    "p2_vectorize", "t4_idempotent_consumption", "t5_projection", "t6_state_machine", "w6_batch_packing", "j9_reconcile", "j14_upsert", "p1_unpack_books", "p4_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = everything()
    # one small query first, so that session start is not charged to a query
    registry.queries["j14_upsert"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.time()
        registry.queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
