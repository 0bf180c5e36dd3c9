"""Q11, C6, C7 and C8 as counted sets that are kept up by deltas.

The facets are sets of values per user, so a change that takes a value from one
item cannot say by itself whether the value leaves the set.  Kept with the
number of items (or outfits) behind each value, it can: a change subtracts what
the changed entities contributed before and adds what they contribute now,
and a value whose count falls to 0 leaves with its last item.  Only the changed
entities' rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearhouse.functions.columns import concat_distinct, first_value, split_values
from wearhouse.operators.catalog import FACETS
from wearhouse.plans.factorised import items_with_owner, long_attrs
from wearhouse.plans.session import materialize
from wearhouse.sources.schemas import SEASONS
from wearhouse.sources.tables import Tables

KEY = ("u_id", "facet", "value")


def item_values(t: Tables) -> DataFrame:
    """(u_id, facet, value) once for every item and value: its categories, colors
    and tags (Q11) and its primary category (C8); blanks are no values."""
    owner = items_with_owner(t).select("item_id", "u_id")
    long = long_attrs(t, FACETS, "item_id").join(owner, "item_id").select("u_id", F.col("kind").alias("facet"), "value")
    primary = t.w_cat.groupBy("item_id").agg(concat_distinct("category").alias("category")).join(owner, "item_id")
    primary = primary.select("u_id", F.lit("primary").alias("facet"), first_value("category").alias("value"))
    return long.unionByName(primary).where("value <> ''")


def outfit_values(t: Tables) -> DataFrame:
    """(u_id, facet, value) once for every outfit and value: its occasions
    and its seasons (C6), split and trimmed as the page does."""
    owner = t.w_outfit.select("outfit_id", "u_id")
    parts = [
        t.get(table).select("outfit_id", F.explode(split_values(column)).alias("value")).distinct().join(owner, "outfit_id")
        .select("u_id", F.lit(facet).alias("facet"), "value")
        for table, column, facet in (("w_season", "season", "seasons"), ("w_occ", "occasion", "occasions"))
    ]
    return parts[0].unionByName(parts[1])


def facet_counts(t: Tables) -> DataFrame:
    """(u_id, facet, value, n) of whole tables; n entities have the value."""
    return item_values(t).unionByName(outfit_values(t)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def _signed(df: DataFrame, sign: int) -> DataFrame:
    return df.groupBy(*KEY).agg((F.lit(sign) * F.count(F.lit(1))).alias("n"))


def updated(state: DataFrame, old: Tables, new: Tables, items: DataFrame | None = None, outfits: DataFrame | None = None) -> DataFrame:
    """The counts after a change set that turned ``old`` into ``new`` and touched
    only the given items (item_id) and outfits (outfit_id): added, changed,
    moved or deleted ones."""
    parts = [state.select(*KEY, "n")]
    if items is not None:
        keys = items.select("item_id").distinct()
        parts += [_signed(item_values(old.only_items(keys)), -1), _signed(item_values(new.only_items(keys)), 1)]
    if outfits is not None:
        keys = outfits.select("outfit_id").distinct()
        parts += [_signed(outfit_values(old.only_outfits(keys)), -1), _signed(outfit_values(new.only_outfits(keys)), 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n > 0"))


# ------------------------------------------------------ the facets on a state
def facet_options(state: DataFrame) -> DataFrame:
    """Q11 from the counts."""
    return state.where(F.col("facet").isin(*(kind for _, _, kind in FACETS))).select(*KEY)


def primary_categories(state: DataFrame) -> DataFrame:
    """C8 from the counts."""
    return state.where("facet = 'primary'").select("u_id", F.col("value").alias("category"))


def occasions(state: DataFrame) -> DataFrame:
    """C7 from the counts."""
    return state.where("facet = 'occasions'").select("u_id", F.col("value").alias("occasion"))


def other_seasons(state: DataFrame) -> DataFrame:
    """C6 from the counts, without the four seasons that every user has."""
    return state.where("facet = 'seasons'").where(~F.col("value").isin(*SEASONS)).select("u_id", F.col("value").alias("season"))
