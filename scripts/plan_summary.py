"""Summarise the physical plan of every registered query on a plain and a
bucketed snapshot: shuffles, broadcasts, sort-merge joins, partial per-user
limits and bucketed scans.  Prints a Markdown table.

Usage: python scripts/plan_summary.py [--sf DIR] [--buckets N] [names]
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"stream_wear_ingest"}  # runs a stream; its plans are the record_wears ones


def summary(df) -> dict[str, int]:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "partial_topk": plan.count("WindowGroupLimit") // 2,
        "bucketed_scans": plan.count("Bucketed: true"),
        "reused": plan.count("ReusedExchange"),
    }


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--buckets", type=int, default=16)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from wearhouse.plans.session import build_session
    from wearhouse.registered import REGISTRY
    from wearhouse.sources.derive import derive_tables
    from wearhouse.sources.tables import load_tables, write_tables

    spark = build_session("local[8]", 16, **{"spark.sql.files.maxPartitionBytes": str(2 << 20),
                                              "spark.sql.files.openCostInBytes": str(2 << 20)})
    root = tempfile.mkdtemp(prefix="plan-summary-")
    d = derive_tables(spark, a.sf)
    write_tables(d, f"{root}/plain", version=0, row_group_bytes=2 << 20)
    write_tables(d, f"{root}/bk", version=0, row_group_bytes=2 << 20, buckets=a.buckets)
    plain, bk = load_tables(spark, f"{root}/plain"), load_tables(spark, f"{root}/bk")
    print("| query | shuffles plain | shuffles bucketed | broadcasts | sort-merge joins | partial per-user limits | bucketed scans |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for n in a.names or [n for n in REGISTRY if n not in SKIP]:
        p, b = summary(REGISTRY[n](plain)), summary(REGISTRY[n](bk))
        print(f"| `{n}` | {p['shuffles']} | {b['shuffles']} | {b['broadcasts']} | {b['smj']} | {b['partial_topk']} | {b['bucketed_scans']} |")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
