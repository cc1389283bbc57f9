"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ate_orders", "retail_features", "rule_filter_documents", "mention_filter_documents", "keep_first_documents",
    "thread_stitch_conversations", "discretize_email_orders", "discretize_liraglutide_hard",
    "ipw_full_embeddings", "ipw_hybrid_embeddings", "trials_orders", "resample_orders", "stratified_split_orders",
    "dialog_render_conversations", "curate_documents", "discretize_retail_customers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from causeway.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="causeway-bench")
    from causeway.plans.queries import QUERIES
    names = [q for q in HEADLINE if q in QUERIES]
    # warm-up: JVM start, class loading, parquet footers
    QUERIES["ate_orders"](spark, sf_dir).collect()
    times = {}
    for name in names:
        spark.catalog.clearCache()      # every query starts from an empty cache
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
