"""Catalog and lookup queries (Q1-Q11) and the item-picker/label projections.

The item catalog row (Q3) joins an item to its closet and to four multi-valued
child tables.  Instead of the LEFT JOIN chain (a tags x categories x colors x
images product per item, undone by DISTINCT), the children are unioned into
one long table and reduced to sorted arrays with a single aggregate keyed by
``item_id`` (see :mod:`wearhouse.plans.factorised`).  The arrays are rendered
as the sorted comma text of ``GROUP_CONCAT(DISTINCT ...)`` at the output edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearhouse.functions.columns import all_of, first_value, join_sorted, like_contains
from wearhouse.plans.factorised import ITEM_ATTRS, item_attrs, items_with_owner, keyed_arrays, long_attrs
from wearhouse.sources.tables import Tables

CATALOG_COLUMNS = ("item_id", "c_id", "u_id", "item_name", "size", "last_worn", "c_name", "tag", "category", "color", "image_url")

# Search order: never-worn ('' or NULL) first, then oldest-worn, name, and the id for a total order.
def search_order() -> list[Column]:
    return [
        F.when(F.col("last_worn").isNull() | (F.col("last_worn") == ""), 0).otherwise(1).asc(),
        F.col("last_worn").asc_nulls_first(),
        F.col("item_name").asc(),
        F.col("item_id").asc(),
    ]


# ------------------------------------------------------------------ Q1 / Q2
def closets(t: Tables, user_id: int | None = None, closet_id: int | None = None) -> DataFrame:
    """Q1 (a user's closets, or all) and Q2 (one closet by id); display order ``c_id``."""
    df = t.w_closet.select("c_id", "c_name", "u_id")
    if user_id is not None:
        df = df.where(F.col("u_id") == F.lit(user_id))
    if closet_id is not None:
        df = df.where(F.col("c_id") == F.lit(closet_id))
    return df


# ------------------------------------------------------------------ Q3 / Q6
def _render(df: DataFrame, tags="tags", cats="categories", colors="colors", images="images") -> DataFrame:
    return df.select(
        "item_id", "c_id", "u_id", "item_name", "size", "last_worn", "c_name",
        join_sorted(tags).alias("tag"), join_sorted(cats).alias("category"),
        join_sorted(colors).alias("color"), join_sorted(images).alias("image_url"),
    )


def item_catalog(t: Tables, item_id: int | None = None) -> DataFrame:
    """Q3: every item with closet, owner and its tag/category/color/image lists.
    Q6 is ``item_id=x``: the filter is pushed below the aggregate to the scans."""
    items = items_with_owner(t)
    if item_id is not None:
        items = items.where(F.col("item_id") == F.lit(item_id))
    return _render(items.join(item_attrs(t), "item_id", "left"))


# ------------------------------------------------------------------ Q4 / Q5
def _arr(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def search(
    t: Tables,
    q: str | None = None,
    category: str | None = None,
    color: str | None = None,
    tag: str | None = None,
    user_id: int | None = None,
    closet_id: int | None = None,
) -> DataFrame:
    """Q4: item search with the source application's row-level semantics.

    The reference filters the item x tag x category x color x image rows and
    then groups, so a filtered search shows only the values that matched.  The
    same result from per-item arrays:

    * an equality filter keeps items whose array holds the value and narrows
      that array to the value;
    * with keyword ``q`` let ``im`` = name or size matches and ``mT/mK/mL`` =
      some tag/category/color matches (an absent list counts as one '').  The
      item is kept when any of them holds; the tag list shown is complete when
      ``im or mK or mL`` and otherwise only the matching tags (categories and
      colors alike); images are never narrowed.

    Blank parameters are ignored, as the request cleaning drops them (F5).
    """
    q, category, color, tag = (None if v is None or str(v).strip() == "" else str(v).strip() for v in (q, category, color, tag))
    items = items_with_owner(t)
    preds = []
    if closet_id is not None:
        preds.append(F.col("c_id") == F.lit(closet_id))
    if user_id is not None:
        preds.append(F.col("u_id") == F.lit(user_id))
    items = items.where(all_of(preds)) if preds else items

    # Equality filters choose the items first (the child scan has the value
    # pushed down); then only the chosen items' children are aggregated.
    for value, (table, column) in ((category, ("w_cat", "category")), (color, ("w_color", "color")), (tag, ("w_tag", "tag"))):
        if value is not None:
            items = items.join(t.get(table).where(F.col(column) == F.lit(value)).select("item_id"), "item_id", "left_semi")
    chosen = bool(preds) or any(v is not None for v in (category, color, tag))
    attrs = keyed_arrays(t, ITEM_ATTRS, "item_id", restrict=items.select("item_id") if chosen else None)
    df = items.join(attrs, "item_id", "left")
    cols = {k: _arr(k) for k in ("tags", "categories", "colors", "images")}

    for value, key in ((category, "categories"), (color, "colors"), (tag, "tags")):
        if value is not None:
            cols[key] = F.array(F.lit(value))

    if q is not None:
        def m(x: Column) -> Column:
            return like_contains(x, q)

        def some(a: Column) -> Column:
            return F.exists(F.when(F.size(a) == 0, F.array(F.lit(""))).otherwise(a), m)

        im = m(F.col("item_name")) | m(F.coalesce(F.col("size"), F.lit("")))
        mt, mk, ml = some(cols["tags"]), some(cols["categories"]), some(cols["colors"])
        df = df.where(im | mt | mk | ml)
        cols["tags"] = F.when(im | mk | ml, cols["tags"]).otherwise(F.filter(cols["tags"], m))
        cols["categories"] = F.when(im | mt | ml, cols["categories"]).otherwise(F.filter(cols["categories"], m))
        cols["colors"] = F.when(im | mt | mk, cols["colors"]).otherwise(F.filter(cols["colors"], m))

    df = df.select("item_id", "c_id", "u_id", "item_name", "size", "last_worn", "c_name", *[c.alias(k) for k, c in cols.items()])
    return _render(df)


def items_by_closet(t: Tables, closet_id: int, **filters) -> DataFrame:
    """Q5: Q4 fixed to one closet."""
    return search(t, closet_id=closet_id, **filters)


def search_top(t: Tables, k: int = 5, **filters) -> DataFrame:
    """The first ``k`` search results of every user in search order, with their position."""
    from wearhouse.plans.topk import top_k_per_group

    return top_k_per_group(search(t, **filters), ["u_id"], search_order(), k, rank_col="position").withColumn(
        "position", F.col("position").cast("bigint")
    )


# ------------------------------------------------------------------ Q7 / Q8
def owned_requests(t: Tables, requests: DataFrame) -> DataFrame:
    """Q7: the requested (u_id, item_id) rows whose item belongs to that user."""
    owned = items_with_owner(t).select("u_id", "item_id")
    return requests.join(owned, ["u_id", "item_id"], "left_semi")


def ownership_violations(t: Tables, requests: DataFrame) -> DataFrame:
    """Q8: the requested rows whose item does not belong to the user (set inequality as an anti join)."""
    owned = items_with_owner(t).select("u_id", "item_id")
    return requests.join(owned, ["u_id", "item_id"], "left_anti")


def outfit_requests(t: Tables) -> DataFrame:
    """Requests derived from the tables: every outfit asks for its INCLUDES items on behalf of its owner."""
    return t.w_inc.join(t.w_outfit.select("outfit_id", "u_id"), "outfit_id").select("outfit_id", "u_id", "item_id")


# ----------------------------------------------------------------- Q9 / Q10
def item_outfit_refs(t: Tables) -> DataFrame:
    """Q9: per item and outfit owner, the number of distinct outfits using the item."""
    return (
        t.w_inc.join(t.w_outfit.select("outfit_id", "u_id"), "outfit_id")
        .groupBy("item_id", "u_id")
        .agg(F.count("outfit_id").alias("outfit_count"))  # the key of INCLUDES makes it exact
    )


def closet_outfit_refs(t: Tables) -> DataFrame:
    """Q10: per closet, the number of distinct outfits (of any user) using one of its items (0 when none).

    The distinct is planned on (c_id, outfit_id), so a closet holding most
    items does not concentrate the dedup in one task.
    """
    refs = (
        t.w_item.select("item_id", "c_id").join(t.w_inc, "item_id")
        .groupBy("c_id").agg(F.count_distinct("outfit_id").alias("outfit_count"))
    )
    return t.w_closet.select("c_id").join(refs, "c_id", "left").select(
        "c_id", F.coalesce(F.col("outfit_count"), F.lit(0)).cast("bigint").alias("outfit_count")
    )


# ---------------------------------------------------------------------- Q11
FACETS = (("w_cat", "category", "categories"), ("w_color", "color", "colors"), ("w_tag", "tag", "tags"))


def facet_options(t: Tables, user_id: int | None = None) -> DataFrame:
    """Q11: distinct non-blank categories, colors and tags per user, as (u_id, facet, value)."""
    owner = items_with_owner(t).select("item_id", "u_id")
    if user_id is not None:
        owner = owner.where(F.col("u_id") == F.lit(user_id))
    long = long_attrs(t, FACETS, "item_id").where(F.col("value") != "")
    return long.join(owner, "item_id").select("u_id", F.col("kind").alias("facet"), "value").distinct()


# ------------------------------------------------------- C3 / C4 / C10
def picker_filter(t: Tables, q: str | None = None, category: str | None = None, closet_id: int | None = None) -> DataFrame:
    """C3 (with ``category``) / C4 (without): the item picker's client-side filter
    over catalog rows: closet equality, *primary* category equality, and a
    literal substring over name, category, color and tag joined by spaces."""
    if closet_id:
        t = t.only_items(t.w_item.where(F.col("c_id") == F.lit(closet_id)))
    df = item_catalog(t)
    preds = []
    if category:
        preds.append(first_value("category") == F.lit(category))
    query = (q or "").strip().lower()
    if query:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("item_name", "category", "color", "tag")]))
        preds.append(hay.contains(query))
    return df.where(all_of(preds)) if preds else df


def item_labels(t: Tables) -> DataFrame:
    """The card labels of every item: type (first category, else first tag,
    else 'Item'), first image, first color or 'No color', size or 'No size',
    last worn or 'Not recorded'."""
    df = item_catalog(t)
    return df.select(
        "item_id", "u_id", "item_name",
        F.coalesce(F.nullif(first_value("category"), F.lit("")), F.nullif(first_value("tag"), F.lit("")), F.lit("Item")).alias("type_label"),
        first_value("image_url").alias("image"),
        F.coalesce(F.nullif(first_value("color"), F.lit("")), F.lit("No color")).alias("color_label"),
        F.coalesce(F.nullif(F.col("size"), F.lit("")), F.lit("No size")).alias("size_label"),
        F.coalesce(F.nullif(F.col("last_worn"), F.lit("")), F.lit("Not recorded")).alias("last_worn_label"),
    )


def primary_category_facet(t: Tables) -> DataFrame:
    """Per user, the distinct non-blank primary (first) categories of the user's items.

    Only the category list is needed, so only CLOTH_CATEGORY is aggregated.
    """
    from wearhouse.functions.columns import concat_distinct

    cats = t.w_cat.groupBy("item_id").agg(concat_distinct("category").alias("category"))
    return (
        items_with_owner(t).select("item_id", "u_id").join(cats, "item_id", "left")
        .select("u_id", first_value("category").alias("category"))
        .where(F.col("category") != "").distinct()
    )
