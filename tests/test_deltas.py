"""States kept up by deltas equal what whole tables give, after every change."""

from __future__ import annotations

import pytest

from tests.test_changes import ITEM_CHANGE, REC_CHANGE, wear_batch
from wearhouse.operators import catalog, changes, facet_counts, reports, wear_counts
from wearhouse.plans.session import materialize


def key(df):
    return sorted(map(tuple, df.collect()), key=repr)


def cut(t):
    return t.with_tables(**{n: materialize(df) for n, df in t.as_dict().items()})


def same_state(state, t):
    want = wear_counts.wear_state(t)
    assert key(state.items.select(*want.items.columns)) == key(want.items)
    assert key(state.outfits.select(*want.outfits.columns)) == key(want.outfits)


WEARS = [
    dict(change_id=1, u_id=2, outfit_id="2", datetime="2026-06-09"),
    dict(change_id=2, u_id=2, item_ids="5,9", datetime="2023-06-01 10:00:00"),  # a new outfit, worn long ago
    dict(change_id=3, u_id=2, outfit_id="1", datetime="2020-01-01"),
    dict(change_id=4, u_id=3, outfit_id="3", datetime="2026-06-02"),
]


@pytest.fixture(scope="module")
def worn(spark, golden):
    """(state, tables) after wears."""
    result = changes.record_wears(golden, wear_batch(spark, WEARS))
    t = cut(result.tables)
    return wear_counts.apply_delta(wear_counts.wear_state(golden), golden, t, wear_counts.inserted(result)), t


def test_wears(worn):
    state, t = worn
    same_state(state, t)
    assert {r.item_id: r.wear_count for r in state.items.collect()}[9] == 3


def test_deleted_records_give_back_earlier_dates(spark, worn):
    state, t = worn
    rows = [(1, 2, 2, "2026-06-09"), (2, 2, 1, "2024-11-02 06:00:00"), (3, 3, 3, "2026-06-02"), (4, 3, 3, "2024-10-05 19:00:00"), (5, 2, 1, "1999-01-01")]
    result = changes.delete_records(t, spark.createDataFrame([(*r, None, None, None, None) for r in rows], REC_CHANGE))
    new = cut(result.tables)
    state = wear_counts.apply_delta(state, t, new, wear_counts.records_deleted(t, result))
    same_state(state, new)
    latest = {r.item_id: r.last_recorded for r in state.items.collect()}
    assert latest[3] == "2024-08-17 15:00:00" and latest[1] == "2024-11-01 06:00:00" and 6 not in latest  # nothing is left of item 6's
    # an insertion and the deletion of the same record in one delta cancel out
    both = wear_counts.WearDelta(
        spark.createDataFrame([(1, "2027-01-01", 1), (1, "2027-01-01", -1)], "outfit_id long, datetime string, sign long"), new.w_inc.limit(0).selectExpr("*", "1L AS sign")
    )
    same_state(wear_counts.apply_delta(state, new, new, both), new)


def test_deleted_outfits(spark, worn):
    state, t = worn
    batch = spark.createDataFrame([(1, 2, 1), (2, 2, 5), (3, 3, 2)], "change_id long, u_id long, outfit_id long")
    result = changes.delete_outfits(t, batch)
    new = cut(result.tables)
    state = wear_counts.apply_delta(state, t, new, wear_counts.outfits_deleted(t, result))
    same_state(state, new)
    assert key(wear_counts.item_usage(new, state)) == key(reports.item_usage(new))
    assert key(wear_counts.item_usage(new, state, "ASC")) == key(reports.item_usage(new, "ASC"))
    assert key(wear_counts.item_usage_all(new, state)) == key(reports.item_usage_all(new))
    assert key(wear_counts.outfit_reuse(new, state)) == key(reports.outfit_reuse(new))
    plan = wear_counts.item_usage(new, wear_counts.WearState(materialize(state.items), materialize(state.outfits)))._jdf.queryExecution().optimizedPlan().toString()
    assert "datetime" not in plan  # no record is read


def test_any_change_by_difference(spark, worn):
    state, t = worn
    new = cut(changes.cascade_delete(t, items=spark.createDataFrame([(1,), (9,)], "item_id long")))
    same_state(wear_counts.apply_delta(state, t, new, wear_counts.difference(t, new)), new)


def test_facets_follow_item_changes(spark, edge):
    state, old = facet_counts.facet_counts(edge), edge
    assert key(facet_counts.facet_options(state)) == key(catalog.facet_options(edge))
    rows = [(1, 2, 1, 2, None, None, None, "wet", "Coat", "Teal", None), (2, 3, 6, None, None, None, None, "show", None, None, None)]
    steps = [
        (changes.update_items, spark.createDataFrame(rows, ITEM_CHANGE), {"mode": "replace"}),
        (changes.add_items, spark.createDataFrame([(1, 2, None, 2, "Scarf", None, None, "fan,wet", "Layer", None, None)], ITEM_CHANGE), {}),
        (changes.delete_items, spark.createDataFrame([(1, 2, 5), (2, 3, 8), (3, 2, 12)], "change_id long, u_id long, item_id long"), {}),
    ]
    for job, batch, kw in steps:
        result = job(old, batch, **kw)
        new = cut(result.tables)
        state = facet_counts.updated(state, old, new, items=result.applied)
        assert key(state) == key(facet_counts.facet_counts(new)), job
        old = new
    values = {(r.u_id, r.facet, r.value) for r in state.collect()}
    assert (2, "tags", "sea") in values and (2, "tags", "snow") not in values and (3, "colors", "Gold") not in values


def test_facets_follow_outfit_changes(spark, edge):
    from wearhouse.operators import outfits

    state = facet_counts.facet_counts(edge)
    assert key(facet_counts.occasions(state)) == key(outfits.occasion_facet(edge))
    assert key(facet_counts.other_seasons(state)) == [(2, "Monsoon")]
    batch = spark.createDataFrame([(1, 2, 6), (2, 2, 4)], "change_id long, u_id long, outfit_id long")
    result = changes.delete_outfits(edge, batch)
    new = cut(result.tables)
    state = facet_counts.updated(state, edge, new, outfits=result.applied)
    assert key(state) == key(facet_counts.facet_counts(new)) and key(facet_counts.other_seasons(state)) == []
    assert {r.occasion for r in facet_counts.occasions(state).where("u_id = 2").collect()} == {"Work", "Party"}
