"""Expected outputs on the golden rows, worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearhouse.operators import catalog, history, reports
from wearhouse.operators.catalog import search_order


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_category_counts_of_a_user(golden):
    df = reports.category_counts(golden, user_id=2).orderBy(F.col("item_count").desc(), "category")
    want = [("Formal", 2), ("Coat", 1), ("Hat", 1), ("Shoes", 1), ("Suit", 1), ("Uncategorized", 1)]
    assert rows(df, "category", "item_count") == want


def test_totals_of_a_user(golden):
    r = reports.totals(golden, user_id=2).first()
    assert (r.closet_count, r.item_count, r.outfit_count, r.record_count) == (3, 6, 3, 4)


def test_admin_users(golden):
    df = reports.admin_users(golden).orderBy("u_id")
    assert rows(df, "u_id", "username", "gender", "role", "closet_count", "item_count") == [
        (1, "tove", "", "admin", 0, 0), (2, "bram", "male", "user", 3, 6), (3, "ines", "female", "user", 1, 3),
    ]


def test_user_roles(golden):
    assert rows(reports.user_roles(golden, user_id=3), "u_id", "username", "role") == [(3, "ines", "user")]


def test_outfits_min_items(golden):
    df = reports.outfits_min_items(golden).orderBy(F.col("created_date").desc())
    assert rows(df, "outfit_id", "outfit_name") == [(4, "Regatta"), (2, "Garden Party")]


def test_item_usage_all(golden):
    df = reports.item_usage_all(golden).orderBy(F.col("wear_count").desc(), "item_name")
    watch, party, night = "2024-11-02 06:00:00", "2024-08-17 15:00:00", "2024-10-05 19:00:00"
    assert rows(df, "item_id", "wear_count", "last_recorded") == [
        (2, 3, watch), (1, 3, watch), (4, 2, "2024-09-20 10:00:00"), (9, 1, party), (3, 1, party), (6, 1, night), (7, 1, night), (8, 0, None), (5, 0, None),
    ]


def test_most_and_least_worn(golden):
    most = reports.item_usage(golden, "DESC", user_id=2).orderBy(*reports.usage_order("DESC"))
    assert rows(most, "item_id", "wear_count") == [(2, 3), (1, 3), (4, 2), (9, 1), (3, 1)]  # NULL last_worn first, then the name
    least = reports.item_usage(golden, "ASC", user_id=2).orderBy(*reports.usage_order("ASC"))
    assert rows(least, "item_id", "wear_count") == [(5, 0), (9, 1), (3, 1), (4, 2), (2, 3)]
    suit = {r.item_id: r for r in most.collect()}[3]
    assert (suit.category, suit.color) == ("Formal,Suit", "Cream")


def test_search_no_filter_order(golden):
    df = catalog.search(golden, user_id=2).orderBy(*search_order())
    assert [r.item_id for r in df.collect()] == [2, 5, 9, 3, 4, 1]


def test_wear_history(golden):
    df = history.wear_history(golden).orderBy(F.col("datetime").desc(), "outfit_id")
    watch = (1, 2, "Autumn", "Work")
    assert rows(df, "outfit_id", "item_count", "season", "occasion") == [
        watch, watch, (3, 2, "Autumn,Winter", "Theatre"), (4, 3, None, "Race,Work"), (2, 3, "Summer", "Party"),
    ]


def test_item_references(golden):
    df = catalog.item_outfit_refs(golden)
    assert {r.item_id: r.outfit_count for r in df.where("u_id = 2").collect()} == {1: 2, 2: 2, 3: 1, 4: 2, 9: 1}


def test_closet_references(golden):
    assert {r.c_id: r.outfit_count for r in catalog.closet_outfit_refs(golden).collect()} == {1: 2, 2: 2, 3: 1, 4: 0}


def test_outfit_reuse_and_recent(golden):
    reuse = reports.outfit_reuse(golden, user_id=2).collect()
    assert {(r.outfit_id, r.worn_times) for r in reuse} == {(1, 2), (2, 1), (4, 1)}
    recent = history.recent_records(golden, user_id=2).orderBy(F.col("datetime").desc()).collect()
    assert [r.outfit_id for r in recent] == [1, 1, 4, 2]


def test_overview_is_one_table(golden):
    got = {}
    for r in reports.overview(golden, user_id=2).collect():
        got.setdefault(r.report, []).append((r.position, r.label, r.value))
    got = {k: sorted(v) for k, v in got.items()}
    assert got["totals"] == [(1, "closet_count", 3), (2, "item_count", 6), (3, "outfit_count", 3), (4, "record_count", 4)]
    assert got["categories"][:2] == [(1, "Formal", 2), (2, "Coat", 1)]
    assert [x[1:] for x in got["most_worn"]][:2] == [("Deck Shoes", 3), ("Oilskin Coat", 3)]
    assert got["reuse"] == [(1, "Harbour Watch", 2), (2, "Regatta", 1), (3, "Garden Party", 1)]
    assert got["recent"][0] == (1, "2024-11-02 06:00:00 Harbour Watch", None)
    assert set(got) == {"totals", "categories", "most_worn", "least_worn", "reuse", "recent"}


def test_building_reports_runs_no_job(spark, golden):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run")
    try:
        reports.overview(golden)
        reports.report_rows(golden, user_id=2)
        reports.item_usage(golden)
        history.recent_records(golden)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_one_user_restricts_every_child(spark, golden):
    """No table is aggregated before it is cut to the user's rows."""
    from wearhouse.operators import outfits

    for df in (outfits.outfit_list(golden, 2), history.wear_history(golden, 2), reports.most_worn(golden, 2), catalog.search(golden, tag="show")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Aggregate [" in line:
                below = []
                for x in lines[i + 1 :]:
                    if depth(x) <= depth(line):
                        break
                    below.append(x)
                assert any("LeftSemi" in x or "Filter" in x and "= 2" in x or "Inner" in x for x in below), line
