"""last_worn through the touch log: no item is rewritten, replay, order and
compaction do not matter, and a rewrite of the items takes the log over."""

from __future__ import annotations

import tempfile

import pytest

from tests.test_changes import ITEM_CHANGE, constraints_hold, wear_batch
from wearhouse.operators import changes
from wearhouse.operators.changes import publish
from wearhouse.sources.tables import TOUCHES, compact_tables, latest_version, load_tables, manifest, write_tables
from wearhouse.streaming.ingest import apply_wear_batch


def worn(t):
    return {r.item_id: r.last_worn for r in t.w_item.select("item_id", "last_worn").collect()}


@pytest.fixture
def root(golden):
    path = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, path, version=0)
    return path


WEARS = [
    dict(change_id=1, u_id=2, outfit_id="2", datetime="2026-06-09"),
    dict(change_id=2, u_id=2, item_ids="5", datetime="2026-06-01 10:00:00"),
    dict(change_id=3, u_id=2, outfit_id="1", datetime="2020-01-01"),  # late: raises nothing of item 1, but item 2 has no day yet
    dict(change_id=4, u_id=3, outfit_id="3", datetime="2026-06-02"),
]


def test_micro_batches_write_no_item_part(spark, golden, root):
    want = worn(changes.record_wears(golden, wear_batch(spark, WEARS)).tables)
    for k in range(4):
        assert apply_wear_batch(spark, wear_batch(spark, WEARS[k : k + 1]), k, root)
    parts = manifest(spark, root, latest_version(spark, root))
    assert [p.split("/")[0] for p in parts["w_item"]] == ["v=0"] and len(parts[TOUCHES]) == 4
    t = load_tables(spark, root)
    assert worn(t) == want and want[1] == "2024-11-02" and want[2] == "2020-01-01" and want[5] == "2026-06-01"
    constraints_hold(t)
    for k in range(4):  # replay
        assert not apply_wear_batch(spark, wear_batch(spark, WEARS[k : k + 1]), k, root)
    assert worn(load_tables(spark, root)) == want
    v = compact_tables(spark, root, max_parts=3)
    parts = manifest(spark, root, v)
    assert len(parts[TOUCHES]) == 1 and [p.split("/")[0] for p in parts["w_item"]] == ["v=0"]
    assert worn(load_tables(spark, root)) == want
    assert worn(load_tables(spark, root, 0)) == worn(golden)  # older versions read as before


def test_order_does_not_matter(spark, golden, root):
    want = worn(changes.record_wears(golden, wear_batch(spark, WEARS)).tables)
    for k, row in enumerate(reversed(WEARS)):
        apply_wear_batch(spark, wear_batch(spark, [row]), k, root)
    assert worn(load_tables(spark, root)) == want


def test_rewriting_the_items_takes_the_log_over(spark, root):
    apply_wear_batch(spark, wear_batch(spark, WEARS), 0, root)
    v = latest_version(spark, root)
    base = load_tables(spark, root)
    lower = spark.createDataFrame([(1, 2, 3, None, None, None, "2021-01-01", None, None, None, None)], ITEM_CHANGE)
    v = publish(changes.update_items(base, lower, mode="merge"), base, root, v)
    assert TOUCHES not in manifest(spark, root, v)
    got = worn(load_tables(spark, root))
    assert got[3] == "2021-01-01" and got[4] == "2026-06-09"  # set by hand, and kept from the log


def test_added_items_keep_the_log(spark, root):
    apply_wear_batch(spark, wear_batch(spark, WEARS), 0, root)
    base, v = load_tables(spark, root), latest_version(spark, root)
    add = spark.createDataFrame([(1, 2, None, 2, "Scarf", None, "2026-01-01", None, None, None, None)], ITEM_CHANGE)
    v = publish(changes.add_items(base, add), base, root, v)
    parts = manifest(spark, root, v)
    assert len(parts["w_item"]) == 2 and len(parts[TOUCHES]) == 1
    got = worn(load_tables(spark, root))
    assert got[10] == "2026-01-01" and got[4] == "2026-06-09"


def test_bucketed_items_keep_the_log(spark, golden):
    path = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, path, version=0, buckets=4)
    apply_wear_batch(spark, wear_batch(spark, WEARS), 0, path)
    assert worn(load_tables(spark, path)) == worn(changes.record_wears(golden, wear_batch(spark, WEARS)).tables)


def test_readers_without_last_worn_skip_the_log(spark, root):
    apply_wear_batch(spark, wear_batch(spark, WEARS), 0, root)
    plan = load_tables(spark, root).w_item.select("item_id", "item_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_marks_spare_the_scan_only_while_tables_are_as_loaded(spark, root, golden):
    t = load_tables(spark, root)
    assert t.highest_id("w_outfit") == 4
    more = t.with_tables(w_outfit=t.w_outfit.unionByName(golden.w_outfit.selectExpr("outfit_id + 10 AS outfit_id", "u_id", "outfit_name", "note", "created_date")))
    assert more.highest_id("w_outfit") == 14 and golden.highest_id("w_item") == 9
