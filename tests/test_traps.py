"""Edge rows for the semantic traps (filter-before-group, NULL vs '', text
datetimes, LIKE wildcards, case folding, images, unknown seasons)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearhouse.functions import columns as C
from wearhouse.operators import audit, catalog, history, outfits, reports
from wearhouse.operators.catalog import search_order


def by_id(df):
    return {r.item_id: r for r in df.collect()}


def test_tag_filter_shows_only_matching_tag(edge):
    assert by_id(catalog.search(edge, tag="snug"))[10].tag == "snug"
    assert by_id(catalog.search(edge, tag="loud"))[6].tag == "loud"


def test_keyword_shows_only_matching_values(edge):
    # 'snug' is a tag of item 10 and in no name, size, category or color
    liner = by_id(catalog.search(edge, q="snug"))[10]
    assert (liner.tag, liner.category) == ("snug", "Layer")


def test_keyword_category_match_keeps_all_tags(edge):
    assert by_id(catalog.search(edge, q="layer"))[10].tag == "inner,snug"


def test_unworn_first_null_before_blank(edge):
    order = [r.item_id for r in catalog.search(edge, user_id=2).orderBy(*search_order()).collect()]
    assert order[:4] == [2, 10, 11, 5]  # NULL and '' rank 0, NULL sorts first, then the name


def test_datetime_text_keys_are_distinct(edge):
    h = history.wear_history(edge).where("outfit_id = 6").collect()
    assert sorted(r.datetime for r in h) == ["2025-01-03", "2025-01-03 00:00:00"]
    kit = {r.outfit_id: r for r in outfits.outfit_list(edge).collect()}[6]
    assert kit.worn_count == 2 and kit.last_worn == "2025-01-03 00:00:00"


def test_empty_outfit_and_images(edge):
    lst = {r.outfit_id: r for r in outfits.outfit_list(edge).collect()}
    assert lst[5].item_count == 0 and lst[5].item_names is None and lst[5].worn_count == 0
    # outfit 6 has no image of its own; its preview is the smallest non-blank item image
    assert lst[6].preview_image == "/p/liner.jpg"
    assert by_id(catalog.item_catalog(edge))[10].image_url == ",/p/liner.jpg"


def test_like_wildcards_and_backslash(edge):
    assert 12 in by_id(catalog.search(edge, q="0%_o"))  # '%' and '_' stay wildcards
    assert set(by_id(catalog.search(edge, q="\\x"))) == {12}  # a typed backslash is an ordinary character


def test_unicode_case_folding(edge):
    assert 12 in by_id(catalog.search(edge, q="éven"))


def test_unknown_season_audit_and_facet(edge):
    assert [(r.outfit_id, r.season) for r in audit.unknown_seasons(edge).collect()] == [(6, "Monsoon")]
    facet = outfits.season_facet(edge).where("u_id = 2").orderBy("position").collect()
    assert [r.season for r in facet] == ["Spring", "Summer", "Autumn", "Winter", "Monsoon"]


def test_zero_closet_user_kept(edge):
    adm = {r.u_id: r for r in reports.admin_users(edge).collect()}
    assert adm[4].closet_count == 0 and adm[4].gender == ""
    rows = reports.report_rows(edge).where("u_id = 4").collect()
    assert {(r.report, r.label, r.value_text) for r in rows} == {
        ("categoryReport", "No data", "-"), ("mostWornReport", "No data", "-"), ("leastWornReport", "No data", "-")
    }


def test_uncategorized(edge):
    got = {(r.u_id, r.category): r.item_count for r in reports.category_counts(edge).collect()}
    assert got[(2, "Uncategorized")] == 2 and got[(3, "Uncategorized")] == 1


def test_column_helpers(spark):
    df = spark.createDataFrame(
        [(" 1, x,2,1", " a , b,,a ", "SUMMER, spring", " 3 "), ("1.0", "", "Monsoon", "0"), (None, None, None, "x")],
        "ids string, vals string, seasons string, rating string",
    )
    out = df.select(
        C.item_id_list("ids").alias("ids"), C.as_list("vals").alias("vals"), C.split_values("vals").alias("raw"),
        C.first_value("vals").alias("first"), C.season_values("seasons").alias("s"), C.season_error("seasons").alias("se"),
        C.rating_value("rating").alias("r"), C.rating_error("rating").alias("re"), C.trim9(F.lit("\t x \n")).alias("t"),
    ).collect()
    assert out[0].ids == [1, 2] and out[0].vals == ["a", "b"] and out[0].raw == ["a", "b", "a"] and out[0].first == "a"
    assert out[0].s == ["Summer", "Spring"] and not out[0].se and out[0].r == 3 and not out[0].re and out[0].t == "x"
    assert out[1].ids == [] and out[1].vals == [] and out[1].first == "" and out[1].se and out[1].r is None and not out[1].re
    assert out[2].ids == [] and out[2].re


def test_image_extension(spark):
    df = spark.createDataFrame([("a.PNG",), ("b.txt",), ("noext",), ("x.tar.webp",)], "u string")
    assert [r.ok for r in df.select(C.image_allowed("u").alias("ok")).collect()] == [True, False, False, True]


def test_rating_blank_check_before_trim(spark):
    df = spark.createDataFrame([(" 0",), ("  ",), ("0",), ("",), (" 4 ",)], "r string")
    got = [(x.v, x.e) for x in df.select(C.rating_value("r").alias("v"), C.rating_error("r").alias("e")).collect()]
    assert got == [(None, True), (None, True), (None, False), (None, False), (4, False)]
