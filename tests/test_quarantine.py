"""Lines that are no change are set aside with a reason; S7 writes and reads back."""

from __future__ import annotations

import tempfile

from pyspark.sql.types import LongType, StringType, StructField, StructType

from wearhouse.operators import changes
from wearhouse.sources.tables import NOT_PARSED, SURPLUS, WRONG_TYPE, quarantined

SCHEMA = StructType([StructField("change_id", LongType()), StructField("u_id", LongType()), StructField("note", StringType())])


def files(lines: list[str]) -> str:
    folder = tempfile.mkdtemp(prefix="wearhouse-test-")
    with open(f"{folder}/changes.txt", "w") as f:
        f.write("\n".join(lines) + "\n")
    return folder


def test_json_lines(spark):
    lines = [
        '{"change_id":1,"u_id":2,"note":"a \\"quoted\\" one"}', '{"change_id":2}', '{"change_id":3,"note":7}', "{oops", "", "  ", "[1, 2]", '"text"', "null",
        '{"change_id":4,"extra":1,"u_id":2}', '{"change_id":5,"u_id":"me"}', '{"change_id":6,"u_id":2', "{}",
    ]
    good, bad = quarantined(spark, files(lines), SCHEMA)
    assert good.columns == ["change_id", "u_id", "note"]
    assert sorted(map(tuple, good.collect()), key=str) == sorted([(1, 2, 'a "quoted" one'), (2, None, None), (3, None, "7"), (None, None, None)], key=str)
    assert {r.raw: r.reason for r in bad.collect()} == {
        "{oops": NOT_PARSED, "[1, 2]": NOT_PARSED, '"text"': NOT_PARSED, "null": NOT_PARSED, '{"change_id":6,"u_id":2': NOT_PARSED,
        '{"change_id":4,"extra":1,"u_id":2}': SURPLUS + "extra", '{"change_id":5,"u_id":"me"}': WRONG_TYPE,
    }


def test_csv_with_a_header(spark):
    good, bad = quarantined(spark, files(["change_id,u_id,note", "1,2,fine", "2,,", "x,2,y", "3,2,a,b"]), SCHEMA, fmt="csv")
    assert sorted(map(tuple, good.collect())) == [(1, 2, "fine"), (2, None, None)]
    assert {r.raw: r.reason for r in bad.collect()} == {"x,2,y": WRONG_TYPE, "3,2,a,b": SURPLUS + "more than the header"}


def test_digest_sees_rows_not_their_order(spark, golden):
    key = lambda t: {r.table_name: (r.n_rows, r.digest) for r in changes.table_digests(t).collect()}
    base = key(golden)
    assert key(golden.with_tables(w_rec=golden.w_rec.orderBy("mood").repartition(3))) == base
    once = key(golden.with_tables(w_rec=golden.w_rec.withColumn("mood", golden.w_rec["weather"])))
    assert once["w_rec"][0] == base["w_rec"][0] and once["w_rec"][1] != base["w_rec"][1]
    twice = key(golden.with_tables(w_tag=golden.w_tag.unionByName(golden.w_tag.limit(1))))
    assert twice["w_tag"] != base["w_tag"] and {k: v for k, v in twice.items() if k != "w_tag"} == {k: v for k, v in base.items() if k != "w_tag"}
