"""Reports (R1-R12) and the account queries (Q12-Q15), for all users at once.

A one-user report (``user_id=``) cuts the tables to the user's items or outfits
before anything is aggregated.  Building a report runs no job.  Top-5 reports use a total order
(the id is the last key) so they are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearhouse.functions.columns import join_sorted
from wearhouse.plans.factorised import ITEM_ATTRS, includes_count, item_wears, items_with_owner, keyed_arrays, outfit_wears
from wearhouse.plans.topk import ranked, top_k_per_group
from wearhouse.sources.tables import Tables

TOP_K = 5


def _user_filter(df: DataFrame, user_id: int | None) -> DataFrame:
    return df if user_id is None else df.where(F.col("u_id") == F.lit(user_id))


# ---------------------------------------------------------------- R1 totals
def totals(t: Tables, user_id: int | None = None) -> DataFrame:
    """Closets, items, outfits and records per user (0 when none), one row per user."""
    closets = t.w_closet.groupBy("u_id").agg(F.count(F.lit(1)).alias("closet_count"))
    items = items_with_owner(t).groupBy("u_id").agg(F.count(F.lit(1)).alias("item_count"))
    outfits = t.w_outfit.groupBy("u_id").agg(F.count(F.lit(1)).alias("outfit_count"))
    # Records are reduced per outfit first, then summed per owner (no record-level join).
    recs = (
        t.w_rec.groupBy("outfit_id").agg(F.count(F.lit(1)).alias("n"))
        .join(t.w_outfit.select("outfit_id", "u_id"), "outfit_id")
        .groupBy("u_id").agg(F.sum("n").alias("record_count"))
    )
    out = t.w_user.select("u_id")
    for df in (closets, items, outfits, recs):
        out = out.join(df, "u_id", "left")
    counts = ["closet_count", "item_count", "outfit_count", "record_count"]
    out = out.select("u_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts])
    return _user_filter(out, user_id)


# ------------------------------------------------------- R2 / R9 categories
def category_counts(t: Tables, user_id: int | None = None) -> DataFrame:
    """R2: per user and category, the number of the user's items in it; items
    without a category count under 'Uncategorized'.  Order: count desc, category."""
    items = _user_filter(items_with_owner(t).select("item_id", "u_id"), user_id)
    cat = F.coalesce(F.col("category"), F.lit("Uncategorized")).alias("category")
    return (
        items.join(t.w_cat, "item_id", "left")
        .groupBy("u_id", cat)
        .agg(F.count("item_id").alias("item_count"))  # the key of CLOTH_CATEGORY makes it exact
    )


def category_counts_all(t: Tables) -> DataFrame:
    """Category counts over every item (no owner join)."""
    cat = F.coalesce(F.col("category"), F.lit("Uncategorized")).alias("category")
    return t.w_item.select("item_id").join(t.w_cat, "item_id", "left").groupBy(cat).agg(
        F.count("item_id").alias("item_count")
    )


# --------------------------------------------------- R3 / R4 item usage top-5
def usage_order(direction: str) -> list[Column]:
    wc = F.col("wear_count")
    first = wc.asc() if direction.upper() == "ASC" else wc.desc()
    return [first, F.col("last_worn").asc_nulls_first(), F.col("item_name").asc(), F.col("item_id").asc()]


def item_usage_base(t: Tables, user_id: int | None = None) -> DataFrame:
    """Every item (of one user) with its wear count, 0 when never worn.  For one
    user INCLUDES is cut to the user's items and RECORD to their outfits first."""
    items = _user_filter(items_with_owner(t).select("item_id", "u_id", "item_name", "last_worn"), user_id)
    if user_id is not None:
        inc = t.w_inc.join(items.select("item_id"), "item_id", "left_semi")
        t = t.with_tables(w_inc=inc, w_rec=t.w_rec.join(inc.select("outfit_id"), "outfit_id", "left_semi"))
    wears = item_wears(t).select("item_id", "wear_count")
    return items.join(wears, "item_id", "left").withColumn("wear_count", F.coalesce(F.col("wear_count"), F.lit(0)).cast("bigint"))


def item_usage(t: Tables, direction: str = "DESC", user_id: int | None = None, k: int = TOP_K, base: DataFrame | None = None) -> DataFrame:
    """R3 (DESC) / R4 (ASC): each user's k most / least worn items.

    wear_count = distinct (outfit, datetime) records of outfits containing the
    item (0 when never worn); ties by last_worn (NULL first), name, id.  The
    category and color lists are attached only to the k surviving rows, whose
    ids restrict the child tables before they are aggregated.
    """
    base = item_usage_base(t, user_id) if base is None else base
    top = top_k_per_group(base, ["u_id"], usage_order(direction), k)
    attrs = keyed_arrays(t, ITEM_ATTRS[1:3], "item_id", restrict=top)
    return top.join(attrs, "item_id", "left").select(
        "u_id", "item_id", "item_name",
        join_sorted("categories").alias("category"),
        join_sorted("colors").alias("color"),
        "last_worn", "wear_count",
    )


def most_worn(t: Tables, user_id: int | None = None, k: int = TOP_K) -> DataFrame:
    return item_usage(t, "DESC", user_id, k)


def least_worn(t: Tables, user_id: int | None = None, k: int = TOP_K) -> DataFrame:
    return item_usage(t, "ASC", user_id, k)


# ------------------------------------------------------- R6 outfit reuse top-5
def REUSE_ORDER() -> list[Column]:
    return [F.col("worn_times").desc(), F.col("created_date").desc(), F.col("outfit_id").desc()]


def outfit_reuse(
    t: Tables, user_id: int | None = None, k: int = TOP_K, keep_created: bool = False, wears: DataFrame | None = None
) -> DataFrame:
    """Each user's k most worn outfits; ties by newest created_date, then newest
    id.  ``wears``: stored counts (outfit_id, worn_count, last_worn) to use instead of counting."""
    if user_id is not None:
        t = t.only_outfits(t.w_outfit.where(F.col("u_id") == F.lit(user_id)))
    o = t.w_outfit.select("outfit_id", "u_id", "outfit_name", "created_date")
    base = o.join(outfit_wears(t) if wears is None else wears, "outfit_id", "left").select(
        "u_id", "outfit_id", "outfit_name", "created_date",
        F.coalesce(F.col("worn_count"), F.lit(0)).cast("bigint").alias("worn_times"),
        F.col("last_worn").alias("last_recorded"),
    )
    top = top_k_per_group(base, ["u_id"], REUSE_ORDER(), k)
    return top if keep_created else top.drop("created_date")


# ------------------------------------------------------------ R7 bundle
def overview(t: Tables, user_id: int | None = None, rank: Callable = ranked) -> DataFrame:
    """The dashboard as one long table (report, u_id, position, label, value):
    the totals, the category counts, the most and least worn items, the most
    worn outfits and the most recent records (value: the rating, label: date
    text and outfit name).  Most and least worn items share one wear aggregate.
    ``rank`` places the categories (see ``report_rows``)."""
    from wearhouse.operators.history import recent_records

    base = item_usage_base(t, user_id)
    parts = [
        totals(t, user_id).select("u_id", F.posexplode(F.create_map(*[
            x for c in ("closet_count", "item_count", "outfit_count", "record_count") for x in (F.lit(c), F.col(c))
        ])).alias("at", "label", "value")).select(F.lit("totals").alias("report"), "u_id", (F.col("at") + 1).alias("position"), "label", "value"),
    ]

    def add(report: str, rows: DataFrame, order: list[Column], label: Column, value: str, rank: Callable = ranked) -> None:
        placed = rank(rows, ["u_id"], order, "position")
        parts.append(placed.select(F.lit(report).alias("report"), "u_id", "position", label.alias("label"), F.col(value).cast("bigint").alias("value")))

    add("categories", category_counts(t, user_id), [F.col("item_count").desc(), F.col("category").asc()], F.col("category"), "item_count", rank)
    for report, direction in (("most_worn", "DESC"), ("least_worn", "ASC")):
        add(report, top_k_per_group(base, ["u_id"], usage_order(direction), TOP_K), usage_order(direction), F.col("item_name"), "wear_count")
    reuse = outfit_reuse(t, user_id, keep_created=True)
    add("reuse", reuse, REUSE_ORDER(), F.col("outfit_name"), "worn_times")
    recent = recent_records(t, user_id)
    add("recent", recent, [F.col("datetime").desc(), F.col("outfit_id").asc()], F.concat_ws(" ", "datetime", "outfit_name"), "rating")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("position", F.col("position").cast("bigint"))


# --------------------------------------------------- R8 join report (rows)
def items_joined(t: Tables) -> DataFrame:
    """One row per item x category x color x tag combination with owner and
    closet; missing attribute values show as ''."""
    return (
        t.w_item.join(t.w_closet.select("c_id", "c_name", "u_id"), "c_id")
        .join(t.w_user.select("u_id", "username"), "u_id")
        .join(t.w_cat, "item_id", "left")
        .join(t.w_color, "item_id", "left")
        .join(t.w_tag, "item_id", "left")
        .select(
            "username", F.col("c_name").alias("closet_name"), "item_name", "size",
            F.coalesce("category", F.lit("")).alias("category"),
            F.coalesce("color", F.lit("")).alias("color"),
            F.coalesce("tag", F.lit("")).alias("tag"),
            "last_worn",
        )
    )


# ---------------------------------------------- R10 outfits with >= n items
def outfits_min_items(t: Tables, n: int = 3) -> DataFrame:
    """Outfits whose INCLUDES row count is at least ``n`` (a semi join)."""
    big = includes_count(t).where(F.col("n_includes") >= n).select("outfit_id")
    return t.w_outfit.join(big, "outfit_id", "left_semi").select("outfit_id", "outfit_name", "created_date")


# ------------------------------------------------------- R11 usage, all items
def item_usage_all(t: Tables) -> DataFrame:
    """Every item's wear count (records through its outfits) and last record."""
    return t.w_item.select("item_id", "item_name").join(item_wears(t), "item_id", "left").select(
        "item_id", "item_name",
        F.coalesce(F.col("wear_count"), F.lit(0)).cast("bigint").alias("wear_count"),
        "last_recorded",
    )


# --------------------------------------------------------- R12 row shaping
# The names of the dashboard's lists.
REPORT_LISTS = (
    ("categoryReport", "category", "item_count", "items"),
    ("mostWornReport", "item_name", "wear_count", "wears"),
    ("leastWornReport", "item_name", "wear_count", "wears"),
)


def report_rows(t: Tables, user_id: int | None = None, rank: Callable = ranked) -> DataFrame:
    """Dashboard list rows per user: label ('Untitled' when blank), value
    (0 when NULL) and "N <suffix>" text; a user with an empty list gets one
    'No data' / '-' row.  Positions follow each list's own order.  ``rank`` places
    the categories: ``ranking.ranked_by_ranges`` for users with very many."""
    cats = rank(category_counts(t, user_id), ["u_id"], [F.col("item_count").desc(), F.col("category").asc()], "position")
    base = item_usage_base(t, user_id)  # one wear aggregate for both lists, whose exchange is reused
    most = top_k_per_group(base, ["u_id"], usage_order("DESC"), TOP_K, "position")
    least = top_k_per_group(base, ["u_id"], usage_order("ASC"), TOP_K, "position")
    frames = {"categoryReport": cats, "mostWornReport": most, "leastWornReport": least}
    users = _user_filter(t.w_user.select("u_id"), user_id)
    out = None
    for report, label, value, suffix in REPORT_LISTS:
        df = frames[report]
        rows = df.select(
            "u_id", F.lit(report).alias("report"), F.col("position").cast("bigint").alias("position"),
            F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("Untitled")).alias("label"),
            F.concat(F.coalesce(F.col(value), F.lit(0)).cast("string"), F.lit(" " + suffix)).alias("value_text"),
        )
        empty = users.join(df.select("u_id"), "u_id", "left_anti").select(
            "u_id", F.lit(report).alias("report"), F.lit(1).cast("bigint").alias("position"),
            F.lit("No data").alias("label"), F.lit("-").alias("value_text"),
        )
        part = rows.unionByName(empty)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------ Q12-Q15 accounts
def admin_users(t: Tables) -> DataFrame:
    """Q14: every user with distinct closet and item counts (0 for none); gender '' for NULL."""
    closets = t.w_closet.groupBy("u_id").agg(F.count("c_id").alias("closet_count"))
    items = items_with_owner(t).groupBy("u_id").agg(F.count("item_id").alias("item_count"))
    return (
        t.w_user.join(closets, "u_id", "left").join(items, "u_id", "left")
        .select(
            "u_id", "username", F.coalesce(F.col("gender"), F.lit("")).alias("gender"), "role",
            F.coalesce(F.col("closet_count"), F.lit(0)).cast("bigint").alias("closet_count"),
            F.coalesce(F.col("item_count"), F.lit(0)).cast("bigint").alias("item_count"),
        )
    )


def accounts(t: Tables) -> DataFrame:
    """Q12: usernames (sort with ``orderBy('username')`` for display)."""
    return t.w_user.select("username")


def user_roles(t: Tables, user_id: int | None = None) -> DataFrame:
    """Q13: name and role of one user (or of all)."""
    return _user_filter(t.w_user, user_id).select("u_id", "username", "role")


def user_count(t: Tables) -> DataFrame:
    """Q15: the number of registered users (one row)."""
    return t.w_user.agg(F.count(F.lit(1)).alias("user_count"))


def gender_labels(t: Tables) -> DataFrame:
    """Q15: each user's gender label, 'not set' when NULL or blank."""
    return t.w_user.select(
        "u_id", "username", F.coalesce(F.nullif(F.col("gender"), F.lit("")), F.lit("not set")).alias("gender_label")
    )
