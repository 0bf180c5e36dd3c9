"""Every registered query gives the same rows on the derived tables, on a
plain snapshot and on a bucketed snapshot.  Usage: check_layouts.py [--sf DIR] [names]"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--buckets", type=int, default=8)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from wearhouse.plans.session import build_session
    from wearhouse.registered import REGISTRY
    from wearhouse.sources.derive import derive_tables
    from wearhouse.sources.tables import load_tables, write_tables

    spark = build_session()
    root = tempfile.mkdtemp(prefix="layouts-")
    derived = derive_tables(spark, a.sf)
    write_tables(derived, f"{root}/plain", version=0)
    write_tables(derived, f"{root}/bk", version=0, buckets=a.buckets)
    layouts = {"plain": load_tables(spark, f"{root}/plain"), "bucketed": load_tables(spark, f"{root}/bk")}
    bad = 0
    for n in a.names or list(REGISTRY):
        want = rows(REGISTRY[n](derived))
        for label, t in layouts.items():
            if rows(REGISTRY[n](t)) != want:
                print(f"FAIL {n} on {label}")
                bad += 1
        print(f"done {n} ({len(want)} rows)")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
