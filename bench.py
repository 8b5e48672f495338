"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full (noop sink, no collect); the JVM is warmed by one
untimed run of the first query. Per-query seconds are wall-clock.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shotweave.plans import registry  # noqa: E402
from shotweave.session import build_session  # noqa: E402

HEADLINE = [
    "knn_cosine", "knn_preskeleton_backfill", "bm25_topk", "hybrid_interleave", "best_pair",
    "sql_skeleton", "sql_features", "calibrate_threshold", "catalog_ddl", "q_group_having",
    "q_join_group_order",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    registry.load_all()
    names = [n for n in HEADLINE if n in registry.QUERIES]
    registry.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
