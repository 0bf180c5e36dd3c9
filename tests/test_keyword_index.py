"""The keyword index gives the rows of the plain search, reads only its own
tables to find the items, and follows changes."""

from __future__ import annotations

import tempfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.test_search_bruteforce import as_set
from tests.test_search_property import catalogs
from wearhouse.operators import catalog, changes, keyword_index
from wearhouse.sources.tables import latest_version, load_tables, tables_from_rows, write_tables

WORDS = ["a", "snug", "coat", "%%", "____________", "0%_o", "É", "\\", "l%r", "zzz", "one"]


@pytest.fixture(scope="module")
def index(edge):
    return keyword_index.stored(keyword_index.build_index(edge))


@pytest.mark.parametrize("q", WORDS)
def test_equals_the_plain_search(edge, index, q):
    assert as_set(keyword_index.search_indexed(edge, index, q)) == as_set(catalog.search(edge, q=q))


def test_with_other_filters(edge, index):
    for f in ({"category": "Coat", "color": "Gold"}, {"tag": "show"}, {"user_id": 2, "closet_id": 5}):
        assert as_set(keyword_index.search_indexed(edge, index, "o", **f)) == as_set(catalog.search(edge, q="o", **f))


def test_pattern_grams():
    assert keyword_index.pattern_grams("Coat") == ["coa", "oat"]
    assert keyword_index.pattern_grams("ab%cdef_g") == ["ab", "cde", "def", "g"]
    assert keyword_index.pattern_grams("_%") == []


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(rows=catalogs(), q=st.sampled_from(["re", "e", "t%p", "_", "é", "m", "ite", "ed it"]))
def test_property(spark, rows, q):
    t = tables_from_rows(spark, rows)
    assert as_set(keyword_index.search_indexed(t, keyword_index.build_index(t), q)) == as_set(catalog.search(t, q=q))


def test_items_are_found_from_the_index_alone(spark, golden):
    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, f"{root}/tables", version=0)
    t = load_tables(spark, f"{root}/tables")
    keyword_index.write_index(keyword_index.build_index(t), f"{root}/index")
    index = keyword_index.read_index(spark, f"{root}/index")
    found = keyword_index.matching_items(index, "shoe")
    assert {r.item_id for r in found.collect()} == {2, 7}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and all(f"{root}/index" in x for x in scans)
    assert any("In(gram, [" in x for x in scans)  # only the pattern's grams are read
    with pytest.raises(Exception):
        keyword_index.write_index(keyword_index.build_index(t), f"{root}/index")


def test_index_follows_changes(spark, golden):
    old = keyword_index.build_index(golden)
    rows = [(1, 2, 1, None, "Sou'wester", None, None, "storm", None, None, None), (2, 2, 3, None, None, None, None, "summer,garden", None, None, None)]
    cols = ("change_id long, u_id long, item_id long, c_id long, item_name string, size string, last_worn string, "
            "tag string, category string, color string, image_url string")
    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, root, version=0)

    def after(job, batch, **kw):
        base, v = load_tables(spark, root), latest_version(spark, root)
        changes.publish(job(base, batch, **kw), base, root, v)

    after(changes.update_items, spark.createDataFrame(rows, cols), mode="merge")
    after(changes.delete_items, spark.createDataFrame([(1, 2, 5)], "change_id long, u_id long, item_id long"))
    after(changes.add_items, spark.createDataFrame([(1, 2, None, 2, "Mitten Clip", "S", None, "snow", None, None, None)], cols))
    t = load_tables(spark, root)
    changed = spark.createDataFrame([(1,), (3,), (5,), (10,)], "item_id long")
    new = keyword_index.updated(old, t, changed)
    new = keyword_index.stored(new)
    for q in ("storm", "oilskin", "mitt", "s"):
        assert as_set(keyword_index.search_indexed(t, new, q)) == as_set(catalog.search(t, q=q)), q
    whole = keyword_index.build_index(t)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(new.postings) == key(whole.postings)
    grams = key(new.grams)
    assert set(key(whole.grams)) <= set(grams) and len(set(grams)) == len(grams)
