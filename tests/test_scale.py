"""What keeps the change sets' shuffles, sorts and parsing small; results are as before."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from wearhouse.functions.columns import split_values, to_integer, trim9, trimmed_integer
from wearhouse.operators import changes, outfits, wear_counts
from wearhouse.operators.changes import ChangeResult, each_once, reject_later
from wearhouse.plans.session import materialize
from wearhouse.sources.derive import PARTITION_BYTES, _dealt, derive_tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_changes_with_their_own_ids_are_not_shuffled(spark):
    @each_once
    def job(t, batch):
        return ChangeResult(t, batch, batch.select("change_id", F.lit("x").alias("reason")).limit(0))

    rows = materialize(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "change_id long, note string"))
    result = job(None, rows)
    assert "Exchange hashpartitioning" not in plan(result.applied)
    assert [tuple(r) for r in result.applied.collect()] == [(1, "a")]
    assert sorted((r.change_id or 0) for r in result.rejects.collect()) == [0, 2, 2]


def test_later_changes_are_found_without_moving_the_others(spark):
    rows = [(1, 7, None), (2, 7, "bad"), (3, 7, None), (4, 8, None), (5, None, None), (6, None, None), (7, 7, None)]
    v = materialize(spark.createDataFrame(rows, "change_id long, k long, reason string"))
    out = reject_later(v, ["k"], "again")
    assert "Exchange hashpartitioning" not in plan(out)
    assert sorted((r.change_id, r.reason) for r in out.collect()) == [(1, None), (2, "bad"), (3, "again"), (4, None), (5, None), (6, None), (7, "again")]


def test_ids_leave_nothing_persisted_and_no_checkpoint(spark):
    df = spark.range(50, numPartitions=7).select((F.col("id") * 3).alias("change_id"))
    out = changes.assign_ids(df, "new_id", ["change_id"], 10)
    assert plan(out).count("Scan ExistingRDD") == 1  # the partitions' first ids; the rows are a table, not a checkpointed RDD
    assert sorted((r.change_id, r.new_id) for r in out.collect()) == [(3 * i, 10 + i) for i in range(50)]


def test_wears_of_a_delta_are_one_row_for_each_link(spark, golden):
    records = spark.createDataFrame([(1, f"2026-01-0{d}", 1) for d in range(1, 6)] + [(1, "2024-11-02 06:00:00", -1)], "outfit_id long, datetime string, sign long")
    delta = wear_counts.WearDelta(records, golden.w_inc.limit(0).selectExpr("*", "1L AS sign"))
    got = sorted(map(tuple, wear_counts._wears(golden, delta).collect()))
    assert got == [(1, 4, "2026-01-05", "2024-11-02 06:00:00"), (2, 4, "2026-01-05", "2024-11-02 06:00:00")]


def test_links_that_go_take_their_records_along(spark, golden):
    links = spark.createDataFrame([(2, 9, -1), (4, 9, 1)], "outfit_id long, item_id long, sign long")
    delta = wear_counts.WearDelta(golden.w_rec.limit(0).selectExpr("outfit_id", "datetime", "1L AS sign"), links)
    old = wear_counts.wear_state(golden)
    inc = golden.w_inc.where("NOT (outfit_id = 2 AND item_id = 9)").unionByName(links.where("sign = 1").select("outfit_id", "item_id"))
    new = golden.with_tables(w_inc=inc)
    state, want = wear_counts.apply_delta(old, golden, new, delta), wear_counts.wear_state(new)
    assert sorted(map(tuple, state.items.collect())) == sorted(map(tuple, want.items.select(*state.items.columns).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_derived_links_and_records_meet_without_another_shuffle(spark):
    t = derive_tables(spark, SF)
    both = t.w_inc.join(t.w_rec.select("outfit_id", "datetime").hint("merge"), "outfit_id")
    assert plan(both).count("Exchange hashpartitioning") == 2  # one of lineitem for each


@pytest.mark.parametrize("dtype", ["int", "bigint"])
def test_integers_are_read_as_if_trimmed(spark, dtype):
    texts = ["1", "+7", "-03", " 5 ", "5\n", "5\u0085", " 9", "", " ", None, "x", "1_0", "1.0", "99999999999999999999", "3000000000", "٣", "1 2"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert all(r.same for r in df.select(trimmed_integer(F.col("x"), dtype).eqNullSafe(to_integer(trim9("x"), dtype)).alias("same")).collect())


def test_outfit_filter_joins_each_table_on_its_own(spark, golden):
    got = outfits.outfit_filter(golden, season="Summer")
    assert "LeftSemi" not in plan(got)  # the chosen outfits' rows were written before
    want = outfits.outfit_list(golden).where(F.array_contains(split_values("season"), "Summer"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_references_of_many_items_are_dealt_by_item_once(spark, golden, monkeypatch):
    t = golden.with_tables(w_inc=golden.w_inc.unionByName(golden.w_inc.limit(3)), w_outfit=golden.w_outfit.unionByName(golden.w_outfit))
    requests = golden.w_inc.join(golden.w_outfit, "outfit_id").select("item_id", "u_id")
    few = changes.item_reference_counts(t, requests)
    assert "LeftSemi" in plan(few)
    monkeypatch.setattr(changes, "FEW_ITEMS", 0)
    many = changes.item_reference_counts(t, requests)
    assert "LeftSemi" not in plan(many)
    want = requests.join(golden.w_inc, "item_id").join(golden.w_outfit, ["outfit_id", "u_id"]).groupBy("item_id", "u_id").agg(F.count_distinct("outfit_id").alias("_refs"))
    rows = sorted(map(tuple, want.select("item_id", "u_id", "_refs").collect()))
    assert rows and all(sorted(map(tuple, x.select("item_id", "u_id", "_refs").collect())) == rows for x in (few, many))


def test_partitions_of_a_large_table_follow_its_size(spark):
    df = spark.range(1000)
    assert _dealt(df, 70 * PARTITION_BYTES - 5, "id").rdd.getNumPartitions() == 70
    assert _dealt(df, 10, "id").rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert _dealt(df, 70 * PARTITION_BYTES, "id").count() == 1000
