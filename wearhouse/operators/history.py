"""Wear history (Q21) and the most recent records per user (Q22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearhouse.functions.columns import join_sorted
from wearhouse.plans.factorised import OUTFIT_ATTRS, keyed_arrays
from wearhouse.plans.topk import top_k_per_group
from wearhouse.sources.tables import Tables

HISTORY_SPEC = OUTFIT_ATTRS[:2]  # seasons, occasions


def _outfit_side(t: Tables) -> DataFrame:
    """Per outfit: name, owner, season/occasion arrays and INCLUDES item count."""
    outfits = t.w_outfit.select("outfit_id", "u_id", "outfit_name")
    attrs = keyed_arrays(t, HISTORY_SPEC, "outfit_id")
    counts = t.w_inc.groupBy("outfit_id").agg(F.count("item_id").alias("n_items"))
    return outfits.join(attrs, "outfit_id", "left").join(counts, "outfit_id", "left")


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "outfit_id", "u_id", "datetime", "weather", "mood", "rating", "note", "outfit_name",
        join_sorted("seasons").alias("season"),
        join_sorted("occasions").alias("occasion"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("bigint").alias("item_count"),
    )


def wear_history(t: Tables, user_id: int | None = None) -> DataFrame:
    """Q21: every record with its outfit's name, season and occasion lists and
    INCLUDES item count.  Display order: datetime desc, then outfit_id."""
    if user_id is not None:  # cuts every table to the user's outfits first
        t = t.only_outfits(t.w_outfit.where(F.col("u_id") == F.lit(user_id)))
    return _shape(t.w_rec.join(_outfit_side(t), "outfit_id"))


def recent_records(t: Tables, user_id: int | None = None, k: int = 5) -> DataFrame:
    """Q22: each user's k most recent records (datetime desc, outfit_id asc),
    limited *before* the outfit lists are attached."""
    owners = t.w_outfit.select("outfit_id", "u_id")
    if user_id is not None:
        owners = owners.where(F.col("u_id") == F.lit(user_id))
    recs = t.w_rec.join(owners, "outfit_id")
    top = top_k_per_group(recs, ["u_id"], [F.col("datetime").desc(), F.col("outfit_id").asc()], k)
    side = _outfit_side(t.only_outfits(top)).drop("u_id")
    return _shape(top.join(side, "outfit_id", "left"))
