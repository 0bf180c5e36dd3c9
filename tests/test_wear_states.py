"""Wears and the states kept up by deltas do less over, with the same rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_changes import wear_batch
from tests.test_deltas import WEARS, cut, key, same_state
from wearhouse import registered
from wearhouse.functions.columns import optional_id, trimmed_integer
from wearhouse.operators import changes, wear_counts
from wearhouse.sources import derive_changes as dc


def written(monkeypatch, module) -> list[tuple[int, list[str]]]:
    """Rows and columns of every table that ``module`` writes from now on."""
    seen, real = [], module.materialize

    def spy(df):
        out = real(df)
        seen.append((out.count(), out.columns))
        return out

    monkeypatch.setattr(module, "materialize", spy)
    return seen


def test_tables_that_gained_rows_are_not_written_again(spark, golden, monkeypatch):
    result = changes.record_wears(golden, wear_batch(spark, WEARS))
    added = {n: result.appends[n].count() for n in ("w_rec", "w_inc")}
    seen = written(monkeypatch, registered)
    new, result = registered._advanced(golden, result, "w_rec", "w_inc")
    assert [n for n, _ in seen] == [added[n] for n in ("w_rec", "w_inc")] or [n for n, _ in seen] == [added[n] for n in ("w_inc", "w_rec")]
    assert new.w_rec.count() == golden.w_rec.count() + added["w_rec"] and 0 < added["w_inc"] < golden.w_inc.count()
    state = wear_counts.apply_delta(wear_counts.stored_wear_state(golden), golden, new, wear_counts.inserted(result))
    same_state(state, new)


def test_whole_changes_of_reused_outfits_are_not_written(spark, golden, monkeypatch):
    seen = written(monkeypatch, changes)
    batch = wear_batch(spark, WEARS + [dict(change_id=5, u_id=2, outfit_id="2", datetime="2026-06-09"), dict(change_id=6, u_id=2, outfit_id="x")])
    result = changes.record_wears(golden, batch)
    assert [n for n, columns in seen if "outfit_name" in columns] == [1, 1]  # the new outfit's alone: before and with its id
    assert {r.change_id: r.reason for r in result.rejects.collect()} == {5: changes.MSG_DUPLICATE_RECORD, 6: changes.MSG_INVALID_OUTFIT}
    applied = result.applied
    assert set(batch.columns) <= set(applied.columns)
    assert sorted(r.change_id for r in applied.collect()) == [1, 2, 3, 4]


def test_stored_records_are_found_for_few_and_many_changes(spark, golden, monkeypatch):
    batch = wear_batch(spark, [dict(change_id=i, u_id=r.u_id, outfit_id=str(r.outfit_id), datetime=r.datetime) for i, r in enumerate(
        golden.w_rec.join(golden.w_outfit, "outfit_id").collect())] + [dict(change_id=99, u_id=2, outfit_id="2", datetime="2031-01-01")])
    got = []
    for many in (1_000_000, 0):
        monkeypatch.setattr(changes, "MANY_CHANGES", many)
        result = changes.record_wears(golden, batch)
        got.append((key(result.rejects), key(result.tables.w_rec), key(result.tables.w_item)))
    assert got[0] == got[1] and len(got[0][0]) == golden.w_rec.count()


@pytest.mark.parametrize("few", [100_000, 0])
def test_lost_dates_of_few_and_many_keys(spark, golden, monkeypatch, few):
    monkeypatch.setattr(wear_counts, "FEW_KEYS", few)
    state, old = wear_counts.stored_wear_state(golden), golden
    for job, batch, delta in (
        (changes.delete_records, dc.record_changes(golden), wear_counts.records_deleted),
        (changes.delete_outfits, dc.outfit_deletes(golden), wear_counts.outfits_deleted),
    ):
        result = job(old, batch)
        new = cut(result.tables)
        state = wear_counts.apply_delta(state, old, new, delta(old, result))
        same_state(state, new)
        old = new


def test_ids_are_read_as_before(spark):
    texts = ["1", "+7", "-03", "0", "00", "-0", " 0 ", " 5 ", "5\n", "5\u0085", " 9", "", " ", None, "x", "1_0", "1.0", "9" * 20, "9223372036854775807", "0" * 30 + "4", "10", "٣", "1 2"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    old = F.nullif(trimmed_integer(F.col("x")), F.lit(0).cast("bigint"))
    assert all(r.same for r in df.select(optional_id("x").eqNullSafe(old).alias("same")).collect())
    # the text is tested and read once, not once for each use of its value
    plan = df.where(optional_id("x").isNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2
