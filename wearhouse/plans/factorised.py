"""Factorised building blocks shared by the catalog, outfit, history and report queries.

The source application joins an entity to several multi-valued child tables
in one chain and lets DISTINCT aggregates undo the fan-out (tags x categories x
colors x images x ... per item).  Here every child is reduced to one row per
key *before* it meets the entity, so each join is 1:1 and no cross product is
ever built:

* multi-valued attributes of one entity are unioned into one long table
  ``(key, kind, value)`` and aggregated by the key once (one shuffle for all
  attributes instead of one per attribute, and no join between them);
* wear counts are reduced per outfit first (one row per outfit) and only then
  spread to items through INCLUDES, so the per-item count is a sum of
  per-outfit counts.

Counts rely on the primary keys (RECORD (outfit_id, datetime), INCLUDES
(outfit_id, item_id), child tables (key, value)), which make ``COUNT`` equal
``COUNT(DISTINCT)``; the audits in :mod:`wearhouse.operators.audit` verify them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearhouse.sources.tables import Tables

ITEM_ATTRS = (("w_tag", "tag", "tags"), ("w_cat", "category", "categories"), ("w_color", "color", "colors"), ("w_img", "image_url", "images"))
OUTFIT_ATTRS = (("w_season", "season", "seasons"), ("w_occ", "occasion", "occasions"), ("w_oimg", "image_url", "images"))


def _sorted_set(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def items_with_owner(t: Tables) -> DataFrame:
    """CLOTH_ITEM inner-joined to CLOSET: item columns plus ``u_id`` and ``c_name``.

    CLOSET is tiny next to CLOTH_ITEM; Spark broadcasts it by its file size.
    """
    return t.w_item.join(t.w_closet.select("c_id", "u_id", "c_name"), "c_id")


def long_attrs(t: Tables, spec=ITEM_ATTRS, key: str = "item_id") -> DataFrame:
    """Union of the child tables as ``(key, kind, value)``."""
    parts = [t.get(tbl).select(F.col(key), F.lit(kind).alias("kind"), F.col(colname).alias("value")) for tbl, colname, kind in spec]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attrs_by_key(long: DataFrame, spec=ITEM_ATTRS, key: str = "item_id", extra: list[Column] | None = None) -> DataFrame:
    """One row per key with a sorted distinct array per attribute.

    An attribute the key has no value for is an empty array; a key with no
    child row at all is absent, so after a left join its arrays are NULL.
    Callers treat NULL and empty alike.
    """
    aggs = [_sorted_set(F.when(F.col("kind") == kind, F.col("value"))).alias(kind) for _, _, kind in spec]
    return long.groupBy(key).agg(*aggs, *(extra or []))


_ENTITY = {"item_id": "w_item", "outfit_id": "w_outfit"}


def keyed_arrays(
    t: Tables,
    spec=ITEM_ATTRS,
    key: str = "item_id",
    restrict: DataFrame | None = None,
    preview: bool = False,
) -> DataFrame:
    """Per key, a sorted distinct array per child table of ``spec`` (and, with
    ``preview``, the smallest non-blank outfit image as ``outfit_preview``).

    Plain tables: one union + one aggregate (a single shuffle for all
    children).  Bucketed tables: one aggregate per child, each local to its
    bucket, left-joined onto the entity's keys; every join is co-partitioned,
    so nothing is shuffled.  (A union of renamed columns would lose the
    bucket partitioning.)  ``restrict`` limits the keys first (a semi join; AQE
    broadcasts its keys when they turn out small).  Keys without children have NULL or
    empty arrays; callers treat both as empty.
    """
    if restrict is not None:
        restrict = restrict.select(key).distinct()
    if not t.bucketed:
        long = long_attrs(t, spec, key)
        if restrict is not None:
            long = long.join(restrict, key, "left_semi")
        extra = [F.min(F.when(F.col("kind") == "images", F.nullif(F.col("value"), F.lit("")))).alias("outfit_preview")] if preview else None
        return attrs_by_key(long, spec, key, extra)
    out = t.get(_ENTITY[key]).select(key)
    if restrict is not None:
        out = out.join(restrict, key, "left_semi")
    for tbl, colname, kind in spec:
        child = t.get(tbl)
        if restrict is not None:
            child = child.join(restrict, key, "left_semi")
        aggs = [_sorted_set(F.col(colname)).alias(kind)]
        if preview and kind == "images":
            aggs.append(F.min(F.nullif(F.col(colname), F.lit(""))).alias("outfit_preview"))
        out = out.join(child.groupBy(key).agg(*aggs), key, "left")
    return out


def item_attrs(t: Tables) -> DataFrame:
    """``item_id, tags, categories, colors, images`` (sorted distinct arrays)."""
    return keyed_arrays(t, ITEM_ATTRS, "item_id")


def outfit_wears(t: Tables) -> DataFrame:
    """Per outfit: ``worn_count`` (records) and ``last_worn`` (latest datetime text)."""
    return t.w_rec.groupBy("outfit_id").agg(F.count("datetime").alias("worn_count"), F.max("datetime").alias("last_worn"))


def item_wears(t: Tables, wears: DataFrame | None = None) -> DataFrame:
    """Per item that has at least one record: ``wear_count`` and ``last_recorded``.

    wear_count = number of distinct (outfit, datetime) records over the outfits
    that include the item = sum over those outfits of their record counts.
    The per-outfit reduction comes first, so INCLUDES meets one row per outfit;
    ``wears`` is that reduction where it is stored already.
    """
    ow = outfit_wears(t) if wears is None else wears
    return (
        t.w_inc.join(ow, "outfit_id")
        .groupBy("item_id")
        .agg(F.sum("worn_count").alias("wear_count"), F.max("last_worn").alias("last_recorded"))
    )


def outfit_attrs(t: Tables) -> DataFrame:
    """``outfit_id, seasons, occasions, images, outfit_preview`` from the three outfit child tables."""
    return keyed_arrays(t, OUTFIT_ATTRS, "outfit_id", preview=True)


def outfit_item_summary(t: Tables) -> DataFrame:
    """Per outfit with items: ``item_names`` (sorted distinct), ``item_count`` (existing items),
    ``item_preview`` (smallest non-blank image of any of its items)."""
    item_img = t.w_img.groupBy("item_id").agg(F.min(F.nullif(F.col("image_url"), F.lit(""))).alias("img"))
    items = t.w_item.select("item_id", "item_name").join(item_img, "item_id", "left")
    return (
        t.w_inc.join(items, "item_id")
        .groupBy("outfit_id")
        .agg(
            _sorted_set(F.col("item_name")).alias("item_names"),
            F.count("item_id").alias("item_count"),
            F.min("img").alias("item_preview"),
        )
    )


def includes_count(t: Tables) -> DataFrame:
    """Per outfit: number of INCLUDES rows (``COUNT(item_id)``)."""
    return t.w_inc.groupBy("outfit_id").agg(F.count("item_id").alias("n_includes"))
