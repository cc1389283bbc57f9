"""Summarise the physical plans of registered queries: shuffles, broadcasts, joins,
aggregate kinds, windows, Python stages, and the filters / columns reaching the scans.

    python tools/plan_report.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = ("Exchange hashpartitioning", "Exchange RoundRobinPartitioning", "Exchange SinglePartition",
         "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "ArrowEvalPython", "MapInPandas")


def summarise(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = {k: len(re.findall(re.escape(k), plan)) for k in KINDS}
    out = {k: v for k, v in out.items() if v}
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    out["scans"] = len(scans)
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from causeway.plans.queries import QUERIES
    from causeway.session import get_session
    spark = get_session("local[8]", 16)
    names = sys.argv[2:] or list(QUERIES)
    for n in names:
        df = QUERIES[n](spark, sf)
        s = summarise(df)
        print(f"{n}: " + ", ".join(f"{k} x{v}" for k, v in s.items()))


if __name__ == "__main__":
    main()
