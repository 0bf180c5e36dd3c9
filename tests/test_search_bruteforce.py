"""The factorised search equals the direct form (row filter over the item x
tag x category x color x image product, then GROUP BY) on the edge fixture,
for many filter combinations."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from wearhouse.functions.columns import concat_distinct, like_contains
from wearhouse.operators import catalog


def direct(t, q=None, category=None, color=None, tag=None, user_id=None):
    rows = (
        t.w_item.join(t.w_closet.select("c_id", "u_id", "c_name"), "c_id")
        .join(t.w_tag, "item_id", "left").join(t.w_cat, "item_id", "left")
        .join(t.w_color, "item_id", "left").join(t.w_img, "item_id", "left")
    )
    if user_id is not None:
        rows = rows.where(F.col("u_id") == user_id)
    if q:
        cols = [F.col("item_name")] + [F.coalesce(F.col(c), F.lit("")) for c in ("tag", "category", "color", "size")]
        cond = cols and like_contains(cols[0], q)
        for c in cols[1:]:
            cond = cond | like_contains(c, q)
        rows = rows.where(cond)
    for value, c in ((category, "category"), (color, "color"), (tag, "tag")):
        if value:
            rows = rows.where(F.col(c) == value)
    return rows.groupBy("item_id", "c_id", "u_id", "item_name", "size", "last_worn", "c_name").agg(
        concat_distinct("tag").alias("tag"), concat_distinct("category").alias("category"),
        concat_distinct("color").alias("color"), concat_distinct("image_url").alias("image_url"),
    )


def as_set(df):
    return {tuple(r[c] for c in catalog.CATALOG_COLUMNS) for r in df.collect()}


QS = [None, "a", "snug", "coat", "o", "%", "0%_o", "é"]
CATS = [None, "Layer", "Coat"]
TAGS = [None, "inner", "show"]
COLORS = [None, "Cream"]


@pytest.mark.parametrize("q,category,tag,color", [c for c in itertools.product(QS, CATS, TAGS, COLORS)][::5])
def test_factorised_equals_direct(edge, q, category, tag, color):
    assert as_set(catalog.search(edge, q=q, category=category, tag=tag, color=color)) == as_set(
        direct(edge, q=q, category=category, tag=tag, color=color)
    )
