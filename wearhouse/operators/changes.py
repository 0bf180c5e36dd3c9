"""Batch change sets (M1-M17), re-aimed from the application's row-at-a-time writes.

Every job takes the current :class:`Tables` and a DataFrame of changes (one
row per request, identified by ``change_id``) and returns a
:class:`ChangeResult`: the new tables (lazy, built from the old snapshot by
anti joins and unions), the applied changes and the rejected ones with the
reason the application would have answered with.  Publishing is
:func:`wearhouse.sources.tables.write_tables` to a new version directory.

Checks run in the order the application runs them, and the first failing
check names the reason.  Within one batch changes apply in ``change_id``
order, as if the requests had arrived one by one: of two conflicting inserts
the first wins, updates of one row are folded field by field, and a second
delete of a row is rejected as not found.  An update that a later one overrides
still counts as applied, so every change is either applied or rejected.
Every change is all-or-nothing (a rejected wear record creates no outfit).
Rows without a change id, and all rows that share one, are rejected as
malformed before anything else looks at them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wearhouse.functions.columns import (
    as_list,
    date_part,
    item_id_list,
    now_text,
    optional_id,
    optional_id_error,
    rating_error,
    rating_value,
    required_name,
    season_error,
    season_values,
    today_text,
)
from wearhouse.plans.factorised import items_with_owner, outfit_wears
from wearhouse.plans.session import materialize
from wearhouse.sources.schemas import SEASONS
from wearhouse.sources.tables import Tables, with_touches

# The messages the application answers with.
MSG_USER_REQUIRED = "Username and password are required."
MSG_USER_EXISTS = "Username already exists."
MSG_CLOSET_NAME = "Wardrobe name is required."
MSG_CLOSET_NOT_FOUND = "Wardrobe not found."
MSG_ITEM_NAME = "Item name is required."
MSG_ITEM_NOT_FOUND = "Item not found."
MSG_OUTFIT_NAME = "Outfit name is required."
MSG_OUTFIT_ITEMS = "Select at least one clothing item."
MSG_RECORD_ITEMS = "Select at least one clothing item for the outfit."
MSG_NOT_OWNED = "One or more clothing items do not belong to this user."
MSG_LOCKED = "Clothing items cannot be changed after an outfit has wear records. Create a new outfit instead."
MSG_SEASON = f"Season must be one of: {', '.join(SEASONS)}."
MSG_OUTFIT_NOT_FOUND = "Outfit not found."
MSG_INVALID_OUTFIT = "Invalid outfit."
MSG_RATING = "Rating must be between 1 and 5."
MSG_DUPLICATE_RECORD = "This outfit already has a record for that date."
MSG_RECORD_DATE = "Record date is required."
MSG_RECORD_NOT_FOUND = "Record not found."
MSG_USER_NOT_FOUND = "User not found."
MSG_MALFORMED = "Malformed change."


def MSG_CLOSET_IN_USE(n: Column) -> Column:
    return F.concat(F.lit("This wardrobe contains items used by "), n.cast("string"),
                    F.lit(" outfit(s). Update or delete those outfits first."))


def MSG_ITEM_IN_USE(n: Column) -> Column:
    return F.concat(F.lit("This item is used by "), n.cast("string"), F.lit(" outfit(s). Update or delete those outfits first."))


@dataclass(frozen=True)
class ChangeResult:
    """New tables, applied and rejected changes.  ``appends`` holds, for tables
    that only gained rows, just those rows (so publishing can add one part
    instead of rewriting the table).  ``touches`` (item_id, last_worn) holds the
    days that M13 brings, where that is all that changes of CLOTH_ITEM: they are
    published as a part of its touch log."""

    tables: Tables
    applied: DataFrame
    rejects: DataFrame
    appends: dict[str, DataFrame] = field(default_factory=dict)
    touches: DataFrame | None = None


def publish(result: ChangeResult, base: Tables, root: str, base_version: int, **kw) -> int:
    """Publish ``result`` on top of snapshot ``base_version`` (which ``base`` was
    loaded from): untouched tables keep their files, insert-only tables get one
    new part, the rest are rewritten."""
    from wearhouse.sources.tables import write_tables

    new, old = result.tables.as_dict(), base.as_dict()
    unchanged = [n for n in new if new[n] is old[n]]
    return write_tables(
        result.tables, root, base_version=base_version, unchanged=unchanged, appends=result.appends, touches=result.touches, **kw
    )


def first_failure(*checks: tuple[Column, Column | str]) -> Column:
    """The reason of the first check whose condition is TRUE, else NULL."""
    out = None
    for cond, reason in checks:
        r = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(cond, r) if out is None else out.when(cond, r)
    return out


def first_of(df: DataFrame, key: list[str], where: Column | None = None) -> DataFrame:
    """(change_id, _first): whether a change is the lowest ``change_id`` among the
    changes sharing ``key`` (rows with a NULL key part, or not matching
    ``where``, are not ranked).  A min aggregate, so a hot key is not one task."""
    cand = df.where(F.lit(True) if where is None else where)
    for k in key:
        cand = cand.where(F.col(k).isNotNull())
    firsts = cand.groupBy(*key).agg(F.min("change_id").alias("_min"))
    return cand.join(firsts, key).select("change_id", (F.col("change_id") == F.col("_min")).alias("_first"))


def last_per(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``df`` with the highest ``change_id`` of their ``key`` (a max aggregate + join)."""
    lasts = df.groupBy(*key).agg(F.max("change_id").alias("change_id"))
    return df.join(lasts, [*key, "change_id"], "left_semi")


def alternate(df: DataFrame, *names: str) -> Column:
    """the first of the alternate payload fields present in ``df`` that is
    neither NULL nor '' (``username | name``, ``c_name | name``, ``c_id | closet_id``)."""
    present = [n for n in names if n in df.columns]
    if len(present) == 1:
        return F.col(present[0])
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in present])


def _split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = validated.where(F.col("reason").isNull()).drop("reason")
    bad = validated.where(F.col("reason").isNotNull()).select("change_id", "reason")
    return ok, bad


def each_once(job: Callable[..., ChangeResult]) -> Callable[..., ChangeResult]:
    """Splits off the rows whose ``change_id`` is NULL or occurs more than once,
    so that no join on it can multiply rows, and rejects every one of them.  The
    repeated ids are written first: mostly none or few, they are broadcast by
    their file size and the changes stay where they are."""

    @functools.wraps(job)
    def run(t: Tables, changes: DataFrame, *args, **kw) -> ChangeResult:
        again = changes.where("change_id IS NOT NULL").groupBy("change_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("change_id")
        again = materialize(again)
        once = changes.where("change_id IS NOT NULL").join(again, "change_id", "left_anti").select(*changes.columns)
        result = job(t, once, *args, **kw)
        repeated = changes.select("change_id").join(again, "change_id", "left_semi")
        bad = repeated.unionByName(changes.where("change_id IS NULL").select("change_id")).withColumn("reason", F.lit(MSG_MALFORMED))
        return replace(result, rejects=result.rejects.unionByName(bad))

    return run


def reject_later(v: DataFrame, key: list[str], message: str) -> DataFrame:
    """Of the valid changes sharing ``key`` all but the first get ``message``.
    ``v`` is read twice, so it has to be materialized.  Only the keys that repeat
    are looked up; they are written, so that few of them are broadcast and ``v``
    stays where it is."""
    valid = F.col("reason").isNull()
    firsts = v.where(valid).groupBy(*key).agg(F.min("change_id").alias("_min"), F.count(F.lit(1)).alias("_n"))
    firsts = materialize(firsts.where("_n > 1").drop("_n"))
    later = valid & F.coalesce(F.col("change_id") != F.col("_min"), F.lit(False))
    return v.join(firsts, key, "left").withColumn("reason", F.when(later, F.lit(message)).otherwise(F.col("reason"))).drop("_min")


def latest(column: str) -> Column:
    """The value of the last change that gives one (aggregate over a row's changes)."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("change_id")))


# ------------------------------------------------------------------- M17
def assign_ids(df: DataFrame, id_col: str, order: list[str], start: int) -> DataFrame:
    """Dense ids ``start, start+1, ...`` in ``order`` without a global window.

    The batch is range-sorted (partition i holds the i-th key range, rows in
    order) and written once together with each row's partition and position in
    it (from ``monotonically_increasing_id``); the running sum of the
    per-partition row counts gives each partition's first id, and a row's id is
    that offset plus its position.
    """
    tagged = materialize(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    # One count per partition (as zipWithIndex does): a number per partition,
    # not per row, turned into each partition's first id.
    counts = sorted(tuple(r) for r in tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, running = [], 0
    for p, n in counts:
        offsets.append((p, running))
        running += n
    spark = df.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], "_p int, _off bigint")
    return (
        tagged.join(F.broadcast(off), "_p")
        .withColumn(id_col, (F.lit(start) + F.col("_off") + (F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33))).cast(LongType()))
        .drop("_p", "_m", "_off")
    )


# ------------------------------------------------------------- M14 - M16
def insert_or_ignore(old: DataFrame, new: DataFrame, pk: list[str]) -> DataFrame:
    """``INSERT OR IGNORE``: an existing key wins, and of new rows with one
    key that of the lowest ``change_id`` (a column ``new`` must have; ties go to
    the smallest values).  Returns the rows to insert.  The winner is a min
    aggregate, so a hot key is not one task."""
    cols = list(old.columns)
    others = [c for c in cols if c not in pk]
    first = new.groupBy(*pk).agg(F.min(F.struct("change_id", *others)).alias("_w"))
    rows = first.select(*pk, *[F.col(f"_w.{c}").alias(c) for c in others]).select(*cols)
    return rows.join(old.select(*pk), pk, "left_anti").select(*cols)


def replace_values(child: DataFrame, key: str, column: str, changes: DataFrame, values: str = "values") -> DataFrame:
    """For every key in ``changes``, drop its old values and insert the new
    list (``values``: an already cleaned distinct array)."""
    kept = child.join(changes.select(key).distinct(), key, "left_anti")
    new = changes.select(key, F.explode(values).alias(column)).distinct()
    return kept.unionByName(new.select(*child.columns))


def cascade_delete(
    t: Tables,
    users: DataFrame | None = None,
    closets: DataFrame | None = None,
    items: DataFrame | None = None,
    outfits: DataFrame | None = None,
) -> Tables:
    """``ON DELETE CASCADE`` along USER -> CLOSET -> CLOTH_ITEM -> {children,
    INCLUDES} and USER -> OUTFIT -> {children, INCLUDES, RECORD}: a fixed
    three-level chain of anti joins (each argument is a one-column key frame)."""

    def union(a: DataFrame | None, b: DataFrame) -> DataFrame:
        return b if a is None else a.unionByName(b)

    out = t.as_dict()
    out_flag = t.bucketed
    if users is not None:
        users = users.select("u_id").distinct()
        closets = union(closets.select("c_id") if closets is not None else None, t.w_closet.join(users, "u_id", "left_semi").select("c_id"))
        outfits = union(outfits.select("outfit_id") if outfits is not None else None, t.w_outfit.join(users, "u_id", "left_semi").select("outfit_id"))
        out["w_user"] = t.w_user.join(users, "u_id", "left_anti")
    if closets is not None:
        closets = closets.select("c_id").distinct()
        items = union(items.select("item_id") if items is not None else None, t.w_item.join(closets, "c_id", "left_semi").select("item_id"))
        out["w_closet"] = t.w_closet.join(closets, "c_id", "left_anti")
    if items is not None:
        items = items.select("item_id").distinct()
        for name in ("w_item", "w_tag", "w_cat", "w_color", "w_img", "w_inc"):
            out[name] = out[name].join(items, "item_id", "left_anti")
    if outfits is not None:
        outfits = outfits.select("outfit_id").distinct()
        for name in ("w_outfit", "w_oimg", "w_season", "w_occ", "w_inc", "w_rec"):
            out[name] = out[name].join(outfits, "outfit_id", "left_anti")
    return Tables(**out, bucketed=out_flag, id_marks=t.id_marks)


# ------------------------------------------------------------------- M13
def touch_worn(t: Tables, wears: DataFrame) -> Tables:
    """Raise ``last_worn`` of each worn item to the wear date (first ten
    characters) when it is NULL, '' or an older text.  ``wears``: (item_id,
    datetime).  Never lowers it; one aggregate per item, one left join."""
    return t.with_tables(w_item=with_touches(t.w_item, worn_days(wears)))


def worn_days(wears: DataFrame) -> DataFrame:
    """(item_id, last_worn): the days of ``wears`` (item_id, datetime)."""
    return wears.select("item_id", date_part("datetime").alias("last_worn"))


# ------------------------------------------------------------- M1 - M4
@each_once
def add_users(t: Tables, changes: DataFrame) -> ChangeResult:
    """M1: sign-ups (change_id, username | name, gender): role 'user', a default
    closet "<name>'s Closet"; blank names and taken usernames are rejected."""
    c = changes.withColumn("username", required_name(alternate(changes, "username", "name")))
    taken = t.w_user.select(F.col("username").alias("_u"), F.lit(True).alias("_taken"))
    c = c.join(taken, c["username"] == taken["_u"], "left").join(first_of(c, ["username"]), "change_id", "left")
    v = c.withColumn("reason", first_failure(
        (F.col("username").isNull(), MSG_USER_REQUIRED),
        (F.coalesce(F.col("_taken"), F.lit(False)) | ~F.coalesce(F.col("_first"), F.lit(True)), MSG_USER_EXISTS),
    )).drop("_u", "_taken", "_first")
    ok, bad = _split(materialize(v))
    ok = assign_ids(ok, "u_id", ["change_id"], t.highest_id("w_user") + 1)
    ok = assign_ids(ok, "c_id", ["change_id"], t.highest_id("w_closet") + 1)
    new_users = ok.select("u_id", "username", F.coalesce("gender", F.lit("")).alias("gender"), F.lit("user").alias("role"))
    new_closets = ok.select("c_id", F.concat("username", F.lit("'s Closet")).alias("c_name"), "u_id")
    tables = t.with_tables(w_user=t.w_user.unionByName(new_users), w_closet=t.w_closet.unionByName(new_closets))
    return ChangeResult(tables, ok, bad, {"w_user": new_users, "w_closet": new_closets})


@each_once
def add_closets(t: Tables, changes: DataFrame) -> ChangeResult:
    """M2: new closets (change_id, u_id, c_name | name); trimmed name required, user must exist."""
    c = changes.withColumn("c_name", required_name(alternate(changes, "c_name", "name"))).join(
        t.w_user.select("u_id", F.lit(True).alias("_user")), "u_id", "left"
    )
    v = c.withColumn("reason", first_failure((F.col("_user").isNull(), MSG_USER_NOT_FOUND), (F.col("c_name").isNull(), MSG_CLOSET_NAME))).drop("_user")
    ok, bad = _split(materialize(v))
    ok = assign_ids(ok, "c_id", ["change_id"], t.highest_id("w_closet") + 1)
    new = ok.select("c_id", "c_name", "u_id")
    return ChangeResult(t.with_tables(w_closet=t.w_closet.unionByName(new)), ok, bad, {"w_closet": new})


def _closet_owner(t: Tables, changes: DataFrame) -> DataFrame:
    return changes.join(t.w_closet.select("c_id", F.col("u_id").alias("_owner")), "c_id", "left")


@each_once
def rename_closets(t: Tables, changes: DataFrame) -> ChangeResult:
    """M3: rename (change_id, u_id, c_id, c_name); owner must match, name required;
    the last rename of a closet in the batch wins."""
    changes = changes.withColumn("c_id", alternate(changes, "c_id", "closet_id").cast("bigint"))
    c = _closet_owner(t, changes).withColumn("c_name", required_name(alternate(changes, "c_name", "name")))
    v = c.withColumn("reason", first_failure(
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_CLOSET_NOT_FOUND),
        (F.col("c_name").isNull(), MSG_CLOSET_NAME),
    )).drop("_owner")
    ok, bad = _split(materialize(v))
    last = ok.groupBy("c_id").agg(F.max_by("c_name", "change_id").alias("_new"))
    closets = t.w_closet.join(last, "c_id", "left").select("c_id", F.coalesce("_new", "c_name").alias("c_name"), "u_id")
    return ChangeResult(t.with_tables(w_closet=closets), ok, bad)


def closet_reference_counts(t: Tables, closets: DataFrame) -> DataFrame:
    """Q10 for the given closets: distinct outfits using any of their items."""
    items = t.w_item.select("item_id", "c_id").join(closets.select("c_id").distinct(), "c_id", "left_semi")
    return items.join(t.w_inc, "item_id").groupBy("c_id").agg(F.count_distinct("outfit_id").alias("_refs"))


@each_once
def delete_closets(t: Tables, changes: DataFrame) -> ChangeResult:
    """M4: delete (change_id, u_id, c_id); owner must match; **restricted** while
    any outfit uses one of its items; else the closet and its items go (M16)."""
    c = _closet_owner(t, changes).join(closet_reference_counts(t, changes), "c_id", "left")
    v = c.withColumn("reason", first_failure(
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_CLOSET_NOT_FOUND),
        (F.coalesce(F.col("_refs"), F.lit(0)) > 0, MSG_CLOSET_IN_USE(F.col("_refs"))),
    )).drop("_owner", "_refs")
    ok, bad = _split(reject_later(materialize(v), ["c_id"], MSG_CLOSET_NOT_FOUND))
    return ChangeResult(cascade_delete(t, closets=ok.select("c_id")), ok, bad)


# ------------------------------------------------------------- M5 - M7
ITEM_CHILDREN = (("w_tag", "tag"), ("w_cat", "category"), ("w_color", "color"), ("w_img", "image_url"))


def _owned_closet(t: Tables, df: DataFrame, c_col: str = "c_id") -> DataFrame:
    owners = t.w_closet.select(F.col("c_id").alias("_cid"), F.col("u_id").alias("_cowner"))
    return df.join(owners, F.col(c_col) == F.col("_cid"), "left").withColumn(
        "_closet_ok", F.coalesce(F.col("_cowner") == F.col("u_id"), F.lit(False))
    ).drop("_cid", "_cowner")


@each_once
def add_items(t: Tables, changes: DataFrame) -> ChangeResult:
    """M5: new items with their multi-valued lists (comma text, cleaned by F1);
    name required; the closet must be the user's."""
    c = _owned_closet(t, changes.withColumn("item_name", required_name("item_name")))
    v = c.withColumn("reason", first_failure((F.col("item_name").isNull(), MSG_ITEM_NAME), (~F.col("_closet_ok"), MSG_CLOSET_NOT_FOUND))).drop("_closet_ok")
    ok, bad = _split(materialize(v))
    ok = assign_ids(ok, "item_id", ["change_id"], t.highest_id("w_item") + 1)
    delta = {"w_item": ok.select(
        "item_id", "c_id", "item_name", F.coalesce("size", F.lit("")).alias("size"), F.coalesce("last_worn", F.lit("")).alias("last_worn")
    )}
    for table, col in ITEM_CHILDREN:
        delta[table] = ok.select("item_id", F.explode(as_list(col)).alias(col))
    out = {n: t.get(n).unionByName(d) for n, d in delta.items()}
    return ChangeResult(t.with_tables(**out), ok, bad, delta)


@each_once
def update_items(t: Tables, changes: DataFrame, mode: str = "replace") -> ChangeResult:
    """M6: update (change_id, u_id, item_id, c_id?, item_name, size, last_worn, lists).

    ``mode='replace'`` is the HTTP PUT/PATCH behaviour: every absent field
    becomes '' (even the name, which is not re-checked) and every list is
    replaced.  ``mode='merge'`` is the library behaviour: absent (NULL) fields
    and lists keep their current value.  The item must be the user's, and the
    target closet (the current one when absent or 0) must be too.  Several
    changes of one item are folded in order: a closet move holds until the next
    one, in ``merge`` mode so does every field; in ``replace`` mode the last
    change gives all other fields.
    """
    cur = items_with_owner(t).select("item_id", F.col("c_id").alias("_cur_c"), F.col("u_id").alias("_owner"),
                                     F.col("item_name").alias("_cur_name"), F.col("size").alias("_cur_size"),
                                     F.col("last_worn").alias("_cur_lw"))
    # No closet, and closet 0, mean the item's own.
    c = changes.withColumn("_to", F.nullif(F.col("c_id"), F.lit(0).cast("bigint"))).join(cur, "item_id", "left")
    c = _owned_closet(t, c.withColumn("c_id", F.coalesce("_to", "_cur_c")))
    v = c.withColumn("reason", first_failure(
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_ITEM_NOT_FOUND),
        (~F.col("_closet_ok"), MSG_CLOSET_NOT_FOUND),
    )).drop("_closet_ok")
    ok, bad = _split(materialize(v))
    lists = [col for _, col in ITEM_CHILDREN]
    fields = {"item_name": "_cur_name", "size": "_cur_size", "last_worn": "_cur_lw"}
    last = F.max_by(F.struct(*fields, *lists), "change_id")
    folded = ok.groupBy("item_id").agg(
        F.coalesce(latest("_to"), F.first("_cur_c")).alias("c_id"), last.alias("_last"),
        *[latest(x).alias(x) for x in (*fields, *lists)], *[F.first(x).alias(x) for x in fields.values()],
    )
    if mode == "replace":
        new_rows = folded.select("item_id", "c_id", *[F.coalesce(f"_last.{k}", F.lit("")).alias(k) for k in fields])
    else:
        new_rows = folded.select("item_id", "c_id", F.coalesce("item_name", "_cur_name").alias("item_name"),
                                 *[F.coalesce(k, fields[k], F.lit("")).alias(k) for k in ("size", "last_worn")])
    items = t.w_item.join(folded.select("item_id"), "item_id", "left_anti").unionByName(new_rows)
    out = {"w_item": items}
    for table, col in ITEM_CHILDREN:
        if mode == "replace":
            target = folded.select("item_id", F.col(f"_last.{col}").alias(col))
        else:
            target = folded.where(F.col(col).isNotNull())
        out[table] = replace_values(t.get(table), "item_id", col, target.select("item_id", as_list(col).alias("values")))
    return ChangeResult(t.with_tables(**out), ok.drop("_to"), bad)


#: So many requested items are broadcast.
FEW_ITEMS = 100_000


def item_reference_counts(t: Tables, requests: DataFrame) -> DataFrame:
    """Q9 for the requested items, and others where many are asked for: per
    (item_id, u_id) the distinct outfits of that user using the item.  Few
    requested items are broadcast and cut INCLUDES first; else it meets the
    outfits as it lies, by outfit_id, and is dealt by item only once."""
    asked = materialize(requests.select("item_id").distinct())
    links = t.w_inc
    if asked.count() <= FEW_ITEMS:
        links = links.join(F.broadcast(asked), "item_id", "left_semi")
    uses = links.join(t.w_outfit.select("outfit_id", "u_id"), "outfit_id")
    return uses.groupBy("item_id", "u_id").agg(F.count_distinct("outfit_id").alias("_refs"))


@each_once
def delete_items(t: Tables, changes: DataFrame) -> ChangeResult:
    """M7: delete (change_id, u_id, item_id); the item must be the user's;
    **restricted** while one of the user's outfits uses it; else cascade (M16)."""
    owner = items_with_owner(t).select("item_id", F.col("u_id").alias("_owner"))
    c = changes.join(owner, "item_id", "left").join(item_reference_counts(t, changes), ["item_id", "u_id"], "left")
    v = c.withColumn("reason", first_failure(
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_ITEM_NOT_FOUND),
        (F.coalesce(F.col("_refs"), F.lit(0)) > 0, MSG_ITEM_IN_USE(F.col("_refs"))),
    )).drop("_owner", "_refs")
    ok, bad = _split(reject_later(materialize(v), ["item_id"], MSG_ITEM_NOT_FOUND))
    return ChangeResult(cascade_delete(t, items=ok.select("item_id")), ok, bad)


# ------------------------------------------------------------- M8 - M10
OUTFIT_CHILDREN = (("w_oimg", "image_url"), ("w_season", "season"), ("w_occ", "occasion"))


def unowned_counts(t: Tables, changes: DataFrame, ids_col: str = "_ids") -> DataFrame:
    """Q8 per change: how many of its requested item ids the user does not own."""
    req = changes.select("change_id", "u_id", F.explode(ids_col).alias("item_id"))
    owned = items_with_owner(t).select("u_id", "item_id", F.lit(True).alias("_own"))
    return req.join(owned, ["u_id", "item_id"], "left").groupBy("change_id").agg(
        F.count(F.when(F.col("_own").isNull(), 1)).alias("_unowned")
    )


def _outfit_payload(changes: DataFrame) -> DataFrame:
    return changes.withColumn("_ids", item_id_list("item_ids")).withColumn("_name", required_name("outfit_name"))


def _outfit_children(t: Tables, rows: DataFrame, replace: bool) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """New child tables and, for inserts, just the added rows."""
    out, delta = {}, {}
    lists = {"image_url": as_list("image_url"), "season": season_values("season"), "occasion": as_list("occasion")}
    for table, col in OUTFIT_CHILDREN:
        vals = rows.select("outfit_id", lists[col].alias("values"))
        if replace:
            out[table] = replace_values(t.get(table), "outfit_id", col, vals)
        else:
            delta[table] = vals.select("outfit_id", F.explode("values").alias(col))
            out[table] = t.get(table).unionByName(delta[table])
    inc = rows.select("outfit_id", F.col("_ids").alias("values"))
    if replace:
        out["w_inc"] = replace_values(t.w_inc, "outfit_id", "item_id", inc)
    else:
        delta["w_inc"] = inc.select("outfit_id", F.explode("values").alias("item_id")).distinct()
        out["w_inc"] = t.w_inc.unionByName(delta["w_inc"])
    return out, delta


@each_once
def add_outfits(t: Tables, changes: DataFrame, as_of: str | None = None) -> ChangeResult:
    """M8: new outfits (change_id, u_id, outfit_name, note, season, occasion,
    image_url, item_ids): name and at least one item required, every item the
    user's, seasons canonical; created_date = today."""
    c = _outfit_payload(changes)
    c = c.join(unowned_counts(t, c), "change_id", "left")
    v = c.withColumn("reason", first_failure(
        (F.col("_name").isNull(), MSG_OUTFIT_NAME),
        (F.size("_ids") == 0, MSG_OUTFIT_ITEMS),
        (F.coalesce(F.col("_unowned"), F.lit(0)) > 0, MSG_NOT_OWNED),
        (season_error("season"), MSG_SEASON),
    )).drop("_unowned")
    ok, bad = _split(materialize(v))
    ok = assign_ids(ok, "outfit_id", ["change_id"], t.highest_id("w_outfit") + 1)
    new = ok.select(
        "outfit_id", "u_id", F.col("_name").alias("outfit_name"), F.coalesce("note", F.lit("")).alias("note"),
        today_text(as_of).alias("created_date"),
    )
    children, delta = _outfit_children(t, ok, replace=False)
    delta["w_outfit"] = new
    return ChangeResult(t.with_tables(w_outfit=t.w_outfit.unionByName(new), **children), ok, bad, delta)


@each_once
def update_outfits(t: Tables, changes: DataFrame) -> ChangeResult:
    """M9: update (change_id, u_id, outfit_id, ...): the outfit must be the user's;
    name and items required; items owned; **composition lock**: once an outfit
    has records its item set may not change; seasons canonical.  Name and note
    are replaced, created_date kept, all lists replaced."""
    cur = t.w_outfit.select("outfit_id", F.col("u_id").alias("_owner"), "created_date")
    wanted = changes.select("outfit_id").distinct()
    cur_ids = t.w_inc.join(wanted, "outfit_id", "left_semi").groupBy("outfit_id").agg(F.array_sort(F.collect_set("item_id")).alias("_cur_ids"))
    c = _outfit_payload(changes).join(cur, "outfit_id", "left").join(cur_ids, "outfit_id", "left").join(
        t.w_rec.join(wanted, "outfit_id", "left_semi").groupBy("outfit_id").agg(F.count(F.lit(1)).alias("worn_count")), "outfit_id", "left"
    )
    c = c.join(unowned_counts(t, c), "change_id", "left")
    changed = F.array_sort(F.col("_ids")) != F.coalesce(F.col("_cur_ids"), F.array().cast("array<bigint>"))
    v = c.withColumn("reason", first_failure(
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_OUTFIT_NOT_FOUND),
        (F.col("_name").isNull(), MSG_OUTFIT_NAME),
        (F.size("_ids") == 0, MSG_OUTFIT_ITEMS),
        (F.coalesce(F.col("_unowned"), F.lit(0)) > 0, MSG_NOT_OWNED),
        ((F.coalesce(F.col("worn_count"), F.lit(0)) > 0) & changed, MSG_LOCKED),
        (season_error("season"), MSG_SEASON),
    )).drop("_unowned", "_owner", "_cur_ids", "worn_count")
    ok, bad = _split(materialize(v))
    last = last_per(ok, ["outfit_id"])  # replaces everything that earlier ones of the batch set
    new_rows = last.select("outfit_id", "u_id", F.col("_name").alias("outfit_name"), F.coalesce("note", F.lit("")).alias("note"), "created_date")
    outfits = t.w_outfit.join(last.select("outfit_id"), "outfit_id", "left_anti").unionByName(new_rows)
    children, _ = _outfit_children(t, last, replace=True)
    return ChangeResult(t.with_tables(w_outfit=outfits, **children), ok, bad)


@each_once
def delete_outfits(t: Tables, changes: DataFrame) -> ChangeResult:
    """Delete (change_id, u_id, outfit_id) of the owner; images, seasons,
    occasions, INCLUDES and records go with it (M16); items stay."""
    c = changes.join(t.w_outfit.select("outfit_id", F.col("u_id").alias("_owner")), "outfit_id", "left")
    v = c.withColumn("reason", first_failure((F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_OUTFIT_NOT_FOUND))).drop("_owner")
    ok, bad = _split(reject_later(materialize(v), ["outfit_id"], MSG_OUTFIT_NOT_FOUND))
    return ChangeResult(cascade_delete(t, outfits=ok.select("outfit_id")), ok, bad)


# ------------------------------------------------------------ M11 / M12
@each_once
def record_wears(t: Tables, changes: DataFrame, as_of: str | None = None) -> ChangeResult:
    """M11 + M13: wear records (change_id, u_id, outfit_id?, datetime, rating,
    weather, mood, note, outfit_name, outfit_note, season, occasion,
    image_url, item_ids).

    A change naming an outfit reuses it (it must be the user's; the given items
    are ignored and the outfit's INCLUDES are worn); otherwise a new outfit is
    created from the items (at least one, all owned, seasons canonical; name
    default 'Outfit Record'; created_date = the first ten characters of the
    datetime).  A blank datetime is "now".  A record whose (outfit, datetime)
    exists, or repeats an earlier change of the batch, is rejected together
    with the outfit it would have created.  Worn items get M13.
    """
    # An outfit id of 0 is "no outfit" (a falsy id creates a new outfit).
    c = changes.withColumn("_oid", optional_id("outfit_id")).withColumn("_oid_bad", optional_id_error("outfit_id"))
    c = c.withColumn("_dt", F.coalesce(F.nullif(F.col("datetime"), F.lit("")), now_text(as_of)))
    values = {"rating": rating_value("rating")} | {n: F.coalesce(n, F.lit("")) for n in ("weather", "note", "mood")}
    values = [v.alias(n) for n, v in values.items()]
    reuse = _checked_reuse(t, c.where("_oid IS NOT NULL"), values)

    # The checks see the few columns they need; a new outfit's whole change meets the outcome once.
    fresh = c.where("_oid IS NULL")
    unowned = unowned_counts(t, fresh.select("change_id", "u_id", item_id_list("item_ids").alias("_ids")))  # none without items
    v = fresh.select("change_id", "u_id", "_oid_bad", "_dt", rating_error("rating").alias("_rating_bad"), season_error("season").alias("_season_bad"))
    v = materialize(v.join(unowned, "change_id", "left").select("change_id", "_dt", first_failure(
        (F.col("u_id").isNull(), MSG_MALFORMED),
        (F.col("_oid_bad"), MSG_INVALID_OUTFIT),
        (F.col("_unowned").isNull(), MSG_RECORD_ITEMS),
        (F.col("_unowned") > 0, MSG_NOT_OWNED),
        (F.col("_rating_bad"), MSG_RATING),
        (F.col("_season_bad"), MSG_SEASON),
    ).alias("reason")))
    ok, bad = _split(v)
    ok = materialize(ok)  # few are broadcast by their file size
    new = fresh.drop("_oid", "_oid_bad", "_dt").join(ok, "change_id")  # the same "now" as was checked
    new = materialize(new.withColumn("_ids", item_id_list("item_ids")))
    new = assign_ids(new, "outfit_id", ["change_id"], t.highest_id("w_outfit") + 1)
    new_outfits = new.select(
        "outfit_id", "u_id", F.coalesce(F.col("outfit_name"), F.lit("Outfit Record")).alias("outfit_name"),
        F.coalesce("outfit_note", F.lit("")).alias("note"),
        date_part(F.coalesce(F.col("datetime"), F.lit(""))).alias("created_date"),
    )
    children, delta = _outfit_children(t, new, replace=False)
    delta["w_outfit"] = new_outfits
    t2 = t.with_tables(w_outfit=t.w_outfit.unionByName(new_outfits), **children)
    reused, bad_reuse = _split(reuse)
    record = ("outfit_id", F.col("_dt").alias("datetime"))
    recs = reused.select(*record, "rating", "weather", "note", "mood").unionByName(new.select(*record, *values))
    delta["w_rec"] = recs
    t2 = t2.with_tables(w_rec=t.w_rec.unionByName(recs))
    # An outfit's latest text has its latest day: one row per outfit meets its items.
    last = reused.groupBy("outfit_id").agg(F.max("_dt").alias("datetime"))
    worn = last.join(t.w_inc, "outfit_id").select("item_id", "datetime").unionByName(
        new.select(F.explode("_ids").alias("item_id"), F.col("_dt").alias("datetime"))
    )
    # The whole changes, for those who ask for them.
    outcome = reused.select("change_id", "outfit_id", "_dt").unionByName(new.select("change_id", "outfit_id", "_dt"))
    ids = F.when(F.col("_oid").isNull(), item_id_list("item_ids")).otherwise(F.array().cast("array<bigint>"))
    applied = c.withColumn("_ids", ids).drop("outfit_id", "_oid_bad", "_dt").join(outcome, "change_id").select(*changes.columns, "_oid", "_ids", "_dt")
    return ChangeResult(touch_worn(t2, worn), applied, bad.unionByName(bad_reuse), delta, worn_days(worn))


#: With so many changes of outfits, the stored records are not cut to these first.
MANY_CHANGES = 1_000_000


def _checked_reuse(t: Tables, c: DataFrame, values: list[Column]) -> DataFrame:
    """The changes that name an outfit as (change_id, outfit_id, _dt, *values,
    reason), written.  A record's ``values`` go along with the checks, so that the
    changes are read once."""
    names = ("change_id", "_oid", "_dt", "rating", "weather", "note", "mood")
    owners = t.w_outfit.select(F.col("outfit_id").alias("_oid"), F.col("u_id").alias("_owner"))
    v = c.select("change_id", "u_id", "_oid", "_dt", rating_error("rating").alias("_rating_bad"), *values).join(owners, "_oid", "left")
    v = materialize(v.select(*names, first_failure(
        (F.col("u_id").isNull(), MSG_MALFORMED),
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_OUTFIT_NOT_FOUND),
        (F.col("_rating_bad"), MSG_RATING),
    ).alias("reason")))
    # A record exists already (change id NULL) or an earlier change of the batch
    # makes it: one aggregate over both says which of them comes first.
    asked = v.where("reason IS NULL").select("_oid", "_dt", "change_id")
    # Only the records of the batch's outfits are looked at: their id range prunes
    # row groups (snapshots are sorted by it), a semi join does the rest; for very many
    # changes it would move the records once more than the aggregate alone.
    n, low, high = asked.agg(F.count(F.lit(1)), F.min("_oid"), F.max("_oid")).first()
    near = t.w_rec.where(F.col("outfit_id").between(0 if low is None else low, -1 if high is None else high))
    if n <= MANY_CHANGES:
        near = near.join(asked.select(F.col("_oid").alias("outfit_id")).distinct(), "outfit_id", "left_semi")
    stored = near.select(F.col("outfit_id").alias("_oid"), F.col("datetime").alias("_dt"), F.lit(None).cast("bigint").alias("change_id"))
    there = asked.unionByName(stored).groupBy("_oid", "_dt").agg(
        F.max(F.col("change_id").isNull()).alias("_stored"), F.min("change_id").alias("_min")
    ).where("_min IS NOT NULL")
    taken = F.coalesce(F.col("_stored") | (F.col("change_id") != F.col("_min")), F.lit(False))
    reason = F.when(F.col("reason").isNull() & taken, F.lit(MSG_DUPLICATE_RECORD)).otherwise(F.col("reason")).alias("reason")
    return materialize(v.join(there, ["_oid", "_dt"], "left").select(*names, reason).withColumnRenamed("_oid", "outfit_id"))


@each_once
def update_records(t: Tables, changes: DataFrame) -> ChangeResult:
    """M12 update: (change_id, u_id, outfit_id, datetime, rating, weather, mood,
    note) by the exact datetime text; rating valid; the record must exist."""
    c = changes.join(t.w_outfit.select("outfit_id", F.col("u_id").alias("_owner")), "outfit_id", "left")
    keys = t.w_rec.select("outfit_id", "datetime", F.lit(True).alias("_exists"))
    c = c.join(keys, ["outfit_id", "datetime"], "left")
    v = c.withColumn("reason", first_failure(
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_OUTFIT_NOT_FOUND),
        (F.coalesce(F.col("datetime"), F.lit("")) == "", MSG_RECORD_DATE),
        (rating_error("rating"), MSG_RATING),
        (F.col("_exists").isNull(), MSG_RECORD_NOT_FOUND),
    )).drop("_owner", "_exists")
    ok, bad = _split(materialize(v))
    last = ok.groupBy("outfit_id", "datetime").agg(F.max_by(F.struct("rating", "weather", "mood", "note"), "change_id").alias("_n"))
    new = last.select(
        "outfit_id", "datetime", rating_value("_n.rating").alias("rating"),
        F.coalesce("_n.weather", F.lit("")).alias("weather"), F.coalesce("_n.note", F.lit("")).alias("note"),
        F.coalesce("_n.mood", F.lit("")).alias("mood"),
    )
    recs = t.w_rec.join(new.select("outfit_id", "datetime"), ["outfit_id", "datetime"], "left_anti").unionByName(new)
    return ChangeResult(t.with_tables(w_rec=recs), ok, bad)


@each_once
def delete_records(t: Tables, changes: DataFrame) -> ChangeResult:
    """M12 delete: (change_id, u_id, outfit_id, datetime); the owner check is the
    correlated EXISTS, here a semi join on (outfit_id, u_id); the outfit stays.
    Other columns of the changes are not carried along."""
    c = changes.select("change_id", "u_id", "outfit_id", "datetime").join(t.w_outfit.select("outfit_id", F.col("u_id").alias("_owner")), "outfit_id", "left")
    keys = t.w_rec.select("outfit_id", "datetime", F.lit(True).alias("_exists"))
    c = c.join(keys, ["outfit_id", "datetime"], "left")
    v = c.withColumn("reason", first_failure(
        (F.col("_owner").isNull() | (F.col("_owner") != F.col("u_id")), MSG_OUTFIT_NOT_FOUND),
        (F.coalesce(F.col("datetime"), F.lit("")) == "", MSG_RECORD_DATE),
        (F.col("_exists").isNull(), MSG_RECORD_NOT_FOUND),
    )).drop("_owner", "_exists")
    ok, bad = _split(reject_later(materialize(v), ["outfit_id", "datetime"], MSG_RECORD_NOT_FOUND))
    recs = t.w_rec.join(ok.select("outfit_id", "datetime").distinct(), ["outfit_id", "datetime"], "left_anti")
    return ChangeResult(t.with_tables(w_rec=recs), ok, bad)


def table_digests(t: Tables) -> DataFrame:
    """(table_name, n_rows, digest) of every table.  The digest does not depend on
    the order of rows but on each of them, repeats included: the sums of the two
    halves of the rows' 120-bit hashes.  One aggregate per table, no sort."""
    frames = []
    for n, df in t.conform().as_dict().items():  # columns in their declared order
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
        half = lambda at: F.coalesce(F.sum(F.conv(F.substring(F.col("_h"), at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
        frames.append(
            df.select(F.md5(text).alias("_h")).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", half(1), half(16)).alias("digest"))
            .select(F.lit(n).alias("table_name"), "n_rows", "digest")
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def table_counts(t: Tables) -> DataFrame:
    """Row count of every table (one aggregate per table), for summaries and properties."""
    frames = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in t.as_dict().items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

