"""Outfit queries (Q16-Q20) and the outfit-page projections.

The outfit list row joins an outfit to seasons, occasions, images, its items,
their images and its records.  Each of those is first reduced to one row per
``outfit_id`` (three aggregates, all hash-partitioned on ``outfit_id``), so
the final joins are 1:1 and co-partitioned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearhouse.functions.columns import first_value, join_sorted, split_values
from wearhouse.plans.factorised import outfit_attrs, outfit_item_summary, outfit_wears
from wearhouse.plans.session import materialize
from wearhouse.plans.topk import ranked
from wearhouse.sources.schemas import SEASONS
from wearhouse.sources.tables import Tables


def _user_filter(df: DataFrame, user_id: int | None) -> DataFrame:
    return df if user_id is None else df.where(F.col("u_id") == F.lit(user_id))


def outfit_list(t: Tables, user_id: int | None = None) -> DataFrame:
    """Q16: every outfit with its season/occasion/image lists, distinct item
    names, preview image (first non-blank outfit image, else first non-blank
    item image), distinct item count, wear count and last wear.
    Display order: created_date desc, outfit_id desc."""
    if user_id is not None:
        t = t.only_outfits(t.w_outfit.where(F.col("u_id") == F.lit(user_id)))
        t = t.only_items(t.w_inc)
    df = (
        t.w_outfit.join(outfit_attrs(t), "outfit_id", "left")
        .join(outfit_item_summary(t), "outfit_id", "left")
        .join(outfit_wears(t), "outfit_id", "left")
    )
    return df.select(
        "outfit_id", "u_id", "outfit_name", "note", "created_date",
        join_sorted("seasons").alias("season"),
        join_sorted("occasions").alias("occasion"),
        join_sorted("images").alias("image_url"),
        join_sorted("item_names").alias("item_names"),
        F.coalesce("outfit_preview", "item_preview").alias("preview_image"),
        F.coalesce(F.col("item_count"), F.lit(0)).cast("bigint").alias("item_count"),
        F.coalesce(F.col("worn_count"), F.lit(0)).cast("bigint").alias("worn_count"),
        "last_worn",
    )


def outfit_item_ids(t: Tables) -> DataFrame:
    """Q19: per outfit, its INCLUDES item ids as a sorted array."""
    return t.w_inc.groupBy("outfit_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def outfit_detail(t: Tables, outfit_id: int | None = None, user_id: int | None = None) -> DataFrame:
    """Q17: one outfit (or all), optionally owner-checked: lists, INCLUDES item
    count, wear count, last wear, plus its item ids (Q19) as comma text."""
    o = t.w_outfit
    if outfit_id is not None:
        o = o.where(F.col("outfit_id") == F.lit(outfit_id))
    o = _user_filter(o, user_id)
    df = o.join(outfit_attrs(t), "outfit_id", "left").join(outfit_item_ids(t), "outfit_id", "left").join(
        outfit_wears(t), "outfit_id", "left"
    )
    return df.select(
        "outfit_id", "u_id", "outfit_name", "note", "created_date",
        join_sorted("seasons").alias("season"),
        join_sorted("occasions").alias("occasion"),
        join_sorted("images").alias("image_url"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("item_count"),
        F.coalesce(F.col("worn_count"), F.lit(0)).cast("bigint").alias("worn_count"),
        "last_worn",
        F.when(F.size("item_ids") > 0, F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",")).alias("item_ids"),
    )


def outfit_items(t: Tables, outfit_id: int | None = None) -> DataFrame:
    """Q18: the full catalog rows of each outfit's items (display order: item_name)."""
    from wearhouse.operators.catalog import item_catalog

    inc = t.w_inc
    if outfit_id is not None:
        inc = inc.where(F.col("outfit_id") == F.lit(outfit_id))
        t = t.only_items(inc)
    items = item_catalog(t)
    return inc.join(items, "item_id").select("outfit_id", *items.columns)


def outfit_detail_nested(t: Tables, outfit_id: int | None = None, user_id: int | None = None) -> DataFrame:
    """Q20: Q17 plus ``item_ids`` (array) and ``items`` (array of catalog structs ordered by name, id)."""
    from wearhouse.operators.catalog import item_catalog

    base = outfit_detail(t, outfit_id, user_id).drop("item_ids")
    cat = item_catalog(t)
    inc = t.w_inc if outfit_id is None else t.w_inc.where(F.col("outfit_id") == F.lit(outfit_id))
    items = (
        inc.join(cat, "item_id")
        .groupBy("outfit_id")
        .agg(
            F.array_sort(F.collect_list("item_id")).alias("item_ids"),
            F.array_sort(F.collect_list(F.struct("item_name", *[c for c in cat.columns if c != "item_name"]))).alias("items"),
        )
    )
    return base.join(items, "outfit_id", "left").select(
        *base.columns,
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        "items",
    )


# ------------------------------------------------------------ C5 / C9
def outfit_filter(t: Tables, q: str | None = None, season: str | None = None, occasion: str | None = None, user_id: int | None = None) -> DataFrame:
    """The outfit page filter over Q16 rows: substring over name, note and
    item names joined by spaces; season and occasion by list membership."""
    keys = None  # the season and occasion scans choose the outfits first
    for value, table, column in ((season, "w_season", "season"), (occasion, "w_occ", "occasion")):
        if value:
            found = t.get(table).where(F.array_contains(split_values(column), value)).select("outfit_id").distinct()
            keys = found if keys is None else keys.join(found, "outfit_id", "left_semi")
    if keys is not None:
        # Written one by one: else a task sorts and holds the rows of all these joins at once.
        t = t.only_outfits(materialize(keys))
        if not t.bucketed:
            t = t.with_tables(**{n: materialize(t.get(n)) for n in t.OUTFIT_KEYED})
    df = outfit_list(t, user_id)
    query = (q or "").strip().lower()
    if query:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("outfit_name", "note", "item_names")]))
        df = df.where(hay.contains(query))
    return df


def outfit_cards(t: Tables, user_id: int | None = None) -> DataFrame:
    """Outfit card fields: first three item names, "+N more", image,
    season label ('Any season'), occasions, times worn (0) and last worn ('Never')."""
    df = outfit_list(t, user_id)
    names = split_values("item_names")
    visible = F.slice(names, 1, 3)
    total = F.coalesce(F.nullif(F.col("item_count"), F.lit(0)), F.size(names).cast("bigint"))
    seasons = split_values("season")
    return df.select(
        "outfit_id", "u_id", "outfit_name",
        F.when(F.size(seasons) > 0, F.array_join(seasons, ",")).otherwise(F.lit("Any season")).alias("season_label"),
        F.array_join(split_values("occasion"), ",").alias("occasion_label"),
        F.array_join(visible, ", ").alias("visible_items"),
        F.greatest(F.lit(0).cast("bigint"), total - F.size(visible)).cast("bigint").alias("more_items"),
        F.coalesce(F.nullif(first_value("preview_image"), F.lit("")), first_value("image_url")).alias("image"),
        F.coalesce(F.col("worn_count"), F.lit(0)).cast("bigint").alias("times_worn"),
        F.coalesce(F.nullif(F.col("last_worn"), F.lit("")), F.lit("Never")).alias("last_worn_label"),
    )


# ------------------------------------------------------------ C6 / C7
def _user_values(t: Tables, table: str, column: str) -> DataFrame:
    """(u_id, value): every stored value of an outfit list, split and trimmed as the page does."""
    return (
        t.get(table).select("outfit_id", F.explode(split_values(column)).alias("value"))
        .join(t.w_outfit.select("outfit_id", "u_id"), "outfit_id")
        .select("u_id", "value")
        .distinct()
    )


def season_facet(t: Tables, rank: Callable = ranked) -> DataFrame:
    """Per user, the four canonical seasons in fixed order, then any other
    stored season in sorted order: (u_id, position, season).  ``rank`` places the
    others: ``ranking.ranked_by_ranges`` for users with very many."""
    canon = t.w_user.select("u_id", F.posexplode(F.array(*[F.lit(s) for s in SEASONS])).alias("pos", "season")).select(
        "u_id", (F.col("pos") + 1).cast("bigint").alias("position"), "season"
    )
    extra = _user_values(t, "w_season", "season").where(~F.col("value").isin(*SEASONS))
    extra = rank(extra, ["u_id"], [F.col("value").asc()], "_place").select(
        "u_id", (F.lit(len(SEASONS)) + F.col("_place")).cast("bigint").alias("position"), F.col("value").alias("season")
    )
    return canon.unionByName(extra)


def occasion_facet(t: Tables) -> DataFrame:
    """Per user, the distinct stored occasions (display order: sorted)."""
    return _user_values(t, "w_occ", "occasion").select("u_id", F.col("value").alias("occasion"))
