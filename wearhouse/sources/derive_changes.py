"""Change batches derived deterministically from the wardrobe tables.

They drive the registered change-set queries: each batch grows with the
tables it is derived from, and each rule is simple enough to restate in the
DuckDB oracle.  Change ids are arithmetic on the source keys (unique, no
global ranking).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearhouse.functions.columns import join_sorted
from wearhouse.plans.factorised import OUTFIT_ATTRS, items_with_owner, keyed_arrays
from wearhouse.sources.tables import Tables


def _days(dt: Column) -> Column:
    return F.datediff(F.to_date(F.substring(dt, 1, 10)), F.lit("1970-01-01").cast("date")).cast("bigint")


def _outfit_lists(t: Tables) -> DataFrame:
    """Per outfit: season/occasion/image comma text and sorted item ids text."""
    attrs = keyed_arrays(t, OUTFIT_ATTRS, "outfit_id")
    ids = t.w_inc.groupBy("outfit_id").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    return t.w_outfit.join(attrs, "outfit_id", "left").join(ids, "outfit_id", "left").select(
        "outfit_id", "u_id", "outfit_name", "note",
        join_sorted("seasons").alias("season"), join_sorted("occasions").alias("occasion"),
        join_sorted("images").alias("image_url"),
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"),
    )


def _ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def outfit_deletes(t: Tables) -> DataFrame:
    """Every outfit is asked to be deleted by the owner of its lowest item id
    (its own owner when it has no existing item): requests from another user
    are rejected, the rest cascade."""
    first_item = t.w_inc.groupBy("outfit_id").agg(F.min("item_id").alias("item_id"))
    owner_of_item = items_with_owner(t).select("item_id", F.col("u_id").alias("_iu"))
    req = t.w_outfit.select("outfit_id", "u_id").join(first_item, "outfit_id", "left").join(owner_of_item, "item_id", "left")
    return req.select(F.col("outfit_id").alias("change_id"), F.coalesce("_iu", "u_id").alias("u_id"), "outfit_id")


def item_deletes(t: Tables) -> DataFrame:
    """Every item is asked to be deleted by its owner (items used by the owner's outfits are restricted)."""
    return items_with_owner(t).select(
        F.col("item_id").alias("change_id"), "u_id", "item_id"
    )


def outfit_updates(t: Tables) -> DataFrame:
    """Every outfit is re-saved with its own lists, dropping its highest item
    id when it has two or more items (a composition change)."""
    o = _outfit_lists(t)
    ids = F.when(F.size("ids") >= 2, F.slice("ids", 1, F.size("ids") - 1)).otherwise(F.col("ids"))
    return o.select(
        F.col("outfit_id").alias("change_id"), "u_id", "outfit_id", "outfit_name", "note",
        "season", "occasion", "image_url", _ids_text(ids).alias("item_ids"),
    )


def wear_changes(t: Tables) -> DataFrame:
    """One wear change per record and one per outfit; the row's own values say
    what kind of change it is.

    Per record, by its weather: 'N' the exact record again (a duplicate), with
    a blank as the outfit id when its mood is 'F' (invalid); 'A' the outfit at
    the date-only text of the record (another key than 'date 00:00:00'), with
    the invalid rating '9' where the record has none; else the outfit at a
    blank datetime, that is now (all but the first of an outfit are duplicates
    within the batch).

    Per outfit: a new outfit from its items, dated its created_date at noon,
    with the invalid rating '9' for note '1-URGENT', an unknown season for note
    '5-LOW' and season 'summer' (made canonical) for the others.  Outfits without
    items ask for nothing, and most hold items of other users.
    """
    rec = t.w_rec.select("outfit_id", "datetime", "rating", "weather", "mood").join(
        t.w_outfit.select("outfit_id", "u_id"), "outfit_id"
    )
    base = (F.col("outfit_id") * 100000 + _days(F.col("datetime"))) * 4
    common = [F.lit(None).cast("string").alias(c) for c in ("note", "outfit_name", "outfit_note", "season", "occasion", "image_url", "item_ids")]
    weather, rating = F.col("weather"), F.col("rating").cast("string")
    again = rec.select(
        base.alias("change_id"), "u_id",
        F.when((weather == "N") & (F.col("mood") == "F"), F.lit(" ")).otherwise(F.col("outfit_id").cast("string")).alias("outfit_id"),
        F.when(weather == "N", F.col("datetime")).when(weather == "A", F.substring("datetime", 1, 10)).otherwise(F.lit("")).alias("datetime"),
        F.when((weather == "A") & F.col("rating").isNull(), F.lit("9")).otherwise(rating).alias("rating"),
        "weather", "mood", *common,
    )
    o = _outfit_lists(t).join(t.w_outfit.select("outfit_id", "created_date"), "outfit_id")
    new = o.select(
        (F.col("outfit_id") * 100000 * 4 + 2).alias("change_id"), "u_id", F.lit(None).cast("string").alias("outfit_id"),
        F.concat("created_date", F.lit(" 12:00:00")).alias("datetime"),
        F.when(F.col("note") == "1-URGENT", F.lit("9")).otherwise(F.lit("3")).alias("rating"),
        F.lit("Sunny").alias("weather"), F.lit("Happy").alias("mood"), F.lit(None).cast("string").alias("note"),
        F.concat(F.lit("Worn "), F.col("outfit_name")).alias("outfit_name"), F.lit(None).cast("string").alias("outfit_note"),
        F.when(F.col("note") == "5-LOW", F.lit("Monsoon")).otherwise(F.lit("summer")).alias("season"),
        "occasion", "image_url", _ids_text("ids").alias("item_ids"),
    )
    return again.unionByName(new)


def sign_ups(t: Tables) -> DataFrame:
    """One sign-up per outfit, named after it; blank for note '5-LOW', the name of
    its owner (taken) for '1-URGENT', the note itself for '2-HIGH' (all but the
    first are taken)."""
    o = t.w_outfit.join(t.w_user.select("u_id", F.col("username").alias("_owner")), "u_id")
    name = F.when(F.col("note") == "5-LOW", F.lit("  ")).when(F.col("note") == "1-URGENT", F.col("_owner"))
    name = name.when(F.col("note") == "2-HIGH", F.col("note")).otherwise(F.concat(F.lit(" "), "outfit_name"))
    return o.select(F.col("outfit_id").alias("change_id"), name.alias("username"), F.col("u_id").cast("string").alias("gender"))


def closet_adds(t: Tables) -> DataFrame:
    """One new closet per outfit, named after it; blank for note '5-LOW', for an
    unknown user for '1-URGENT'."""
    return t.w_outfit.select(
        F.col("outfit_id").alias("change_id"),
        F.when(F.col("note") == "1-URGENT", F.lit(-1).cast("bigint")).otherwise(F.col("u_id")).alias("u_id"),
        F.when(F.col("note") == "5-LOW", F.lit(" ")).otherwise(F.concat(F.lit(" "), "outfit_name")).alias("c_name"),
    )


def closet_renames(t: Tables) -> DataFrame:
    """Every item has its closet renamed after it by its owner; a blank name when it
    was never worn, by another user when its size is odd."""
    other = F.when(F.col("size").cast("int") % 2 == 1, F.col("u_id") + 1).otherwise(F.col("u_id"))
    never = F.coalesce(F.col("last_worn"), F.lit("")) == ""
    return items_with_owner(t).select(
        F.col("item_id").alias("change_id"), other.alias("u_id"), "c_id", F.when(never, F.lit("")).otherwise(F.col("item_name")).alias("c_name")
    )


def closet_deletes(t: Tables) -> DataFrame:
    """Every closet is asked to be deleted twice by its owner."""
    c = t.w_closet.select("c_id", "u_id")
    return c.select((F.col("c_id") * 2).alias("change_id"), "u_id", "c_id").unionByName(
        c.select((F.col("c_id") * 2 + 1).alias("change_id"), "u_id", "c_id")
    )


def item_adds(t: Tables) -> DataFrame:
    """Every item is added again with its lists (repeated and padded); without a
    name when it was never worn, in another user's closet when its size is odd."""
    attrs = keyed_arrays(t, key="item_id")
    i = items_with_owner(t).join(attrs, "item_id", "left")
    twice = lambda c: F.concat_ws(", ", join_sorted(c), join_sorted(c))
    never = F.coalesce(F.col("last_worn"), F.lit("")) == ""
    return i.select(
        F.col("item_id").alias("change_id"), F.when(F.col("size").cast("int") % 2 == 1, F.col("u_id") + 1).otherwise(F.col("u_id")).alias("u_id"),
        "c_id", F.when(never, F.lit("  ")).otherwise(F.concat(F.lit(" "), "item_name")).alias("item_name"), "size", "last_worn",
        twice("tags").alias("tag"), twice("categories").alias("category"), twice("colors").alias("color"), twice("images").alias("image_url"),
    )


def item_updates(t: Tables) -> DataFrame:
    """Two changes of every item by its owner: the first (even id) gives a new size
    and color 'Black' and asks for closet 0, its own; the second gives a tag and
    the date of last wear '2026-02-02'.  The second comes from another user when the size is odd."""
    i = items_with_owner(t).select("item_id", "u_id", "size")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    zero, same = F.lit(0).cast("bigint").alias("c_id"), F.lit(None).cast("bigint").alias("c_id")
    first = i.select((F.col("item_id") * 2).alias("change_id"), "u_id", "item_id", zero, F.concat(F.lit("X"), "size").alias("size"),
                     F.lit("Black").alias("color"), *none("item_name", "last_worn", "tag", "category", "image_url"))
    second = i.select((F.col("item_id") * 2 + 1).alias("change_id"), F.when(F.col("size").cast("int") % 2 == 1, F.col("u_id") + 1).otherwise(F.col("u_id")).alias("u_id"),
                      "item_id", same, F.lit("new, ,new,hot").alias("tag"), F.lit("2026-02-02").alias("last_worn"), *none("item_name", "size", "category", "color", "image_url"))
    return first.unionByName(second.select(*first.columns))


def outfit_adds(t: Tables) -> DataFrame:
    """Every outfit is added again by its owner from those of its items that are
    the owner's (most have few); without a name for note '5-LOW'."""
    mine = t.w_inc.join(items_with_owner(t).select("item_id", "u_id"), "item_id").join(t.w_outfit.select("outfit_id", "u_id"), ["outfit_id", "u_id"])
    ids = mine.groupBy("outfit_id").agg(F.array_sort(F.collect_set("item_id")).alias("own"))
    o = _outfit_lists(t).join(ids, "outfit_id", "left")
    return o.select(
        F.col("outfit_id").alias("change_id"), "u_id", F.when(F.col("note") == "5-LOW", F.lit(" ")).otherwise(F.col("outfit_name")).alias("outfit_name"),
        "note", "season", "occasion", "image_url", F.coalesce(_ids_text(F.col("own")), F.lit("")).alias("item_ids"),
    )


def record_changes(t: Tables) -> DataFrame:
    """Every record is changed by its outfit's owner; by another user when the
    weather is 'N'; at a time that has no record when the mood is 'F'; with the
    invalid rating '7' where the record has none."""
    rec = t.w_rec.join(t.w_outfit.select("outfit_id", "u_id"), "outfit_id")
    return rec.select(
        (F.col("outfit_id") * 100000 + _days(F.col("datetime"))).alias("change_id"),
        F.when(F.col("weather") == "N", F.col("u_id") + 1).otherwise(F.col("u_id")).alias("u_id"), "outfit_id",
        F.when(F.col("mood") == "F", F.concat("datetime", F.lit("Z"))).otherwise(F.col("datetime")).alias("datetime"),
        F.coalesce((6 - F.col("rating")).cast("string"), F.lit("7")).alias("rating"),
        F.lit("Windy").alias("weather"), F.lit(None).cast("string").alias("mood"), F.concat(F.lit("was "), "weather").alias("note"),
    )


def tag_rows(t: Tables) -> DataFrame:
    """Tags to insert: every (item, tag) that is there, and the color of every item as a tag, twice."""
    old = t.w_tag.select((F.col("item_id") * 4).alias("change_id"), "item_id", "tag")
    new = t.w_color.select((F.col("item_id") * 4 + 1).alias("change_id"), "item_id", F.col("color").alias("tag"))
    return old.unionByName(new).unionByName(new.withColumn("change_id", F.col("change_id") + 1))


def raw_payloads(t: Tables) -> DataFrame:
    """Messy form payloads per record: rating text, season text, item id text."""
    o = _outfit_lists(t)
    rec = t.w_rec.select("outfit_id", "datetime", "rating", "weather", "mood").join(o.select("outfit_id", "season", "ids"), "outfit_id")
    # The record's own flags decide how messy its payload is.
    rating_raw = (
        F.when(F.col("weather") == "A", F.lit("0"))
        .when(F.col("weather") == "R", F.concat(F.lit(" "), F.col("rating").cast("string"), F.lit(" ")))
        .when(F.col("mood") == "O", F.lit("x"))
        .otherwise(F.col("rating").cast("string"))
    )
    ids_raw = F.concat(F.lit(" "), _ids_text("ids"), F.lit(", x,"), F.coalesce(F.get("ids", 0).cast("string"), F.lit("")))
    return rec.select(
        "outfit_id", "datetime", rating_raw.alias("rating_raw"),
        F.concat(F.upper(F.coalesce("season", F.lit(""))), F.lit(", ,")).alias("season_raw"),
        ids_raw.alias("ids_raw"),
    )
