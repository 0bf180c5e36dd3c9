"""The registered queries: one entry per operator of the inventory.

Each entry maps a name to a function of a :class:`Tables` bundle.  Parameters
(a keyword, a closet, a user) are fixed values chosen so that every entry
still reads its whole tables; the matching DuckDB statements live in
:mod:`wearhouse.oracle_sql` under the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from wearhouse.operators import reports
from wearhouse.sources.tables import Tables

QueryFn = Callable[[Tables], DataFrame]

REGISTRY: dict[str, QueryFn] = {}


def register(name: str, fn: QueryFn) -> None:
    REGISTRY[name] = fn


# Step 1-2: reports
register("report_most_worn", lambda t: reports.item_usage(t, "DESC"))
register("report_least_worn", lambda t: reports.item_usage(t, "ASC"))
register("report_totals", reports.totals)
register("report_category_counts", reports.category_counts)
register("report_outfit_reuse", reports.outfit_reuse)
register("items_joined", reports.items_joined)
register("category_counts_all", reports.category_counts_all)
register("outfits_min_items", reports.outfits_min_items)
register("item_usage_all", reports.item_usage_all)
register("admin_users", reports.admin_users)
register("accounts", reports.accounts)
register("user_count", reports.user_count)
register("gender_labels", reports.gender_labels)

# Step 3-4: catalog, lookups, search
from wearhouse.operators import catalog, keyword_index  # noqa: E402


def indexed_search(t, q, **filters):
    """Q4 answered from the keyword index of all items, built and stored first."""
    return keyword_index.search_indexed(t, keyword_index.stored(keyword_index.build_index(t)), q, **filters)


register("closets", catalog.closets)
register("item_catalog", catalog.item_catalog)
register("items_by_closet", lambda t: catalog.items_by_closet(t, 3))
register("search_keyword", lambda t: catalog.search(t, q="re"))
register("search_wildcard", lambda t: catalog.search(t, q="r_d"))
register("search_category_keyword", lambda t: catalog.search(t, q="econ"))
register("search_keyword_indexed", lambda t: indexed_search(t, "re"))
register("search_wildcard_indexed", lambda t: indexed_search(t, "r_d"))
register("search_category_indexed", lambda t: indexed_search(t, "econ"))
register("search_letter_indexed", lambda t: indexed_search(t, "g%z", category="LARGE"))
register("search_tag", lambda t: catalog.search(t, tag="hot"))
register("search_combined", lambda t: catalog.search(t, q="ge", category="LARGE", color="Blue", user_id=1))
register("search_unworn_first", lambda t: catalog.search_top(t, 5))
register("owned_items", lambda t: catalog.owned_requests(t, catalog.outfit_requests(t)))
register("ownership_violations", lambda t: catalog.ownership_violations(t, catalog.outfit_requests(t)))
register("item_outfit_refs", catalog.item_outfit_refs)
register("closet_outfit_refs", catalog.closet_outfit_refs)
register("facet_options", catalog.facet_options)
register("picker_filter", lambda t: catalog.picker_filter(t, q="old", category="SMALL"))
register("picker_filter_closet", lambda t: catalog.picker_filter(t, q="GE", closet_id=7))
register("item_labels", catalog.item_labels)
register("primary_category_facet", catalog.primary_category_facet)

# Step 5-6: outfits, history, outfit page
from wearhouse.operators import history, outfits  # noqa: E402

register("outfit_list", outfits.outfit_list)
register("outfit_list_user", lambda t: outfits.outfit_list(t, user_id=1))
register("outfit_detail", outfits.outfit_detail)
register("outfit_items", outfits.outfit_items)
register("outfit_filter", lambda t: outfits.outfit_filter(t, q="Outfit 1", season="Summer", occasion="1-URGENT"))
register("outfit_cards", outfits.outfit_cards)
register("season_facet", outfits.season_facet)
register("occasion_facet", outfits.occasion_facet)
register("wear_history", history.wear_history)
register("wear_history_user", lambda t: history.wear_history(t, user_id=1))
register("recent_records", history.recent_records)

# Step 7: audits
from wearhouse.operators import audit  # noqa: E402

register("audit_pk", audit.primary_keys)
register("audit_not_null", audit.not_null)
register("audit_check", audit.checks)
register("audit_fk", audit.foreign_keys)
register("audit_fd", audit.functional_dependencies)
register("audit_ownership", audit.ownership)
register("audit_season", audit.unknown_seasons)
register("report_rows", reports.report_rows)
register("report_overview", reports.overview)
register("report_most_worn_user", lambda t: reports.most_worn(t, user_id=1))
register("user_roles", reports.user_roles)

# Step 8: change sets over batches derived from the tables
from pyspark.sql import functions as F  # noqa: E402

from wearhouse.functions.columns import item_id_list, rating_error, rating_value, season_error, season_values  # noqa: E402
from wearhouse.operators import changes  # noqa: E402
from wearhouse.plans.factorised import items_with_owner, outfit_wears  # noqa: E402
from wearhouse.plans.session import materialize, scratch_path, shuffles_removed  # noqa: E402
from wearhouse.sources import derive_changes as dc  # noqa: E402

AS_OF = "2026-01-01 00:00:00"


def _outcomes(batch, result, ok_text: str, keep=("change_id",), applied_cols=()):
    out = batch.select(*keep).join(result.applied.select("change_id", *applied_cols), "change_id", "left")
    return out.join(result.rejects, "change_id", "left").select(
        *keep, *applied_cols, F.coalesce(F.col("reason"), F.lit(ok_text)).alias("outcome")
    )


def _with_rejects(result):
    n = result.rejects.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("rejects").alias("table_name"), "n_rows")
    return changes.table_counts(result.tables).unionByName(n)


def _contents(result, batch, ok_text: str, tables: dict[str, tuple[str, ...]]):
    """The outcome of every change and the rows of the given tables afterwards, as
    one long relation (relation, k, v): ``tables`` names the key column first."""
    out = _outcomes(batch, result, ok_text).select(F.lit("outcome").alias("relation"), F.col("change_id").alias("k"), F.col("outcome").alias("v"))
    for name, (key, *columns) in tables.items():
        rest = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
        out = out.unionByName(result.tables.get(name).select(F.lit(name).alias("relation"), F.col(key).alias("k"), rest.alias("v")))
    return out


ITEM_TABLES = {
    "w_item": ("item_id", "c_id", "item_name", "size", "last_worn"), "w_tag": ("item_id", "tag"), "w_cat": ("item_id", "category"),
    "w_color": ("item_id", "color"), "w_img": ("item_id", "image_url"),
}
OUTFIT_TABLES = {
    "w_outfit": ("outfit_id", "u_id", "outfit_name", "note", "created_date"), "w_season": ("outfit_id", "season"), "w_occ": ("outfit_id", "occasion"),
    "w_oimg": ("outfit_id", "image_url"), "w_inc": ("outfit_id", "item_id"),
}


def _change_query(job, derive, ok_text, tables, **kw):
    def run(t):
        batch = _batch(derive(t))
        return _contents(job(t, batch, **kw), batch, ok_text, tables)

    return run


def q_delete_closets(t):
    """Closets named N to Z have let go of their outfits: they can be deleted
    with their items; the others are still used."""
    free = t.w_item.join(t.w_closet.where(F.col("c_name") >= "N"), "c_id").select("item_id")
    t = t.with_tables(w_inc=t.w_inc.join(free, "item_id", "left_anti"))
    batch = _batch(dc.closet_deletes(t))
    return _contents(changes.delete_closets(t, batch), batch, "deleted", {"w_closet": ("c_id", "c_name"), **ITEM_TABLES})


def q_insert_or_ignore(t):
    return changes.insert_or_ignore(t.w_tag, dc.tag_rows(t), ["item_id", "tag"])


def q_delete_users(t):
    """M16 from the top: the users without a gender go, with all that is theirs."""
    return changes.table_counts(changes.cascade_delete(t, users=t.w_user.where("gender IS NULL AND role = 'user'").select("u_id")))


register("add_users", _change_query(changes.add_users, dc.sign_ups, "added", {
    "w_user": ("u_id", "username", "gender", "role"), "w_closet": ("c_id", "c_name", "u_id")}))
register("add_closets", _change_query(changes.add_closets, dc.closet_adds, "added", {"w_closet": ("c_id", "c_name", "u_id")}))
register("rename_closets", _change_query(changes.rename_closets, dc.closet_renames, "renamed", {"w_closet": ("c_id", "c_name", "u_id")}))
register("delete_closets", q_delete_closets)
register("add_items", _change_query(changes.add_items, dc.item_adds, "added", ITEM_TABLES))
register("update_items_merge", _change_query(changes.update_items, dc.item_updates, "updated", ITEM_TABLES, mode="merge"))
register("update_items_replace", _change_query(changes.update_items, dc.item_updates, "updated", ITEM_TABLES, mode="replace"))
register("add_outfits", _change_query(changes.add_outfits, dc.outfit_adds, "added", OUTFIT_TABLES, as_of=AS_OF))
register("update_records", _change_query(changes.update_records, dc.record_changes, "updated", {
    "w_rec": ("outfit_id", "datetime", "rating", "weather", "note", "mood")}))
register("delete_records", _change_query(changes.delete_records, dc.record_changes, "deleted", {"w_rec": ("outfit_id", "datetime")}))
register("insert_or_ignore", q_insert_or_ignore)
register("delete_users", q_delete_users)


def q_touch_worn(t):
    # An outfit's latest text has its latest day: one row per outfit meets its items.
    latest = outfit_wears(t).select("outfit_id", F.col("last_worn").alias("datetime"))
    wears = t.w_inc.join(latest, "outfit_id").select("item_id", "datetime")
    return changes.touch_worn(t, wears).w_item.select("item_id", "last_worn")


def q_cascade_delete_outfits(t):
    return _with_rejects(changes.delete_outfits(t, dc.outfit_deletes(t)))


def q_delete_items_restricted(t):
    batch = dc.item_deletes(t)
    return _outcomes(batch, changes.delete_items(t, batch), "deleted", keep=("change_id", "item_id", "u_id"))


def q_delete_items_tables(t):
    return _with_rejects(changes.delete_items(t, dc.item_deletes(t)))


def _batch(df):
    """A derived change batch is written once (as a real batch would arrive as
    files) so the job's several reads of it do not re-derive it."""
    return materialize(df)


def q_outfit_update_lock(t):
    batch = _batch(dc.outfit_updates(t))
    return _outcomes(batch, changes.update_outfits(t, batch), "updated", keep=("change_id", "u_id"))


def q_outfit_update_tables(t):
    return _with_rejects(changes.update_outfits(t, _batch(dc.outfit_updates(t))))


def q_record_wears(t):
    batch = _batch(dc.wear_changes(t))
    return _outcomes(batch, changes.record_wears(t, batch, as_of=AS_OF), "recorded", applied_cols=("outfit_id",))


def q_record_wears_tables(t):
    return _with_rejects(changes.record_wears(t, _batch(dc.wear_changes(t)), as_of=AS_OF))


def q_clean_lists(t):
    raw = dc.raw_payloads(t)
    return raw.select(
        "outfit_id", "datetime",
        rating_value("rating_raw").alias("rating"),
        rating_error("rating_raw").alias("rating_error"),
        F.when(~season_error("season_raw"), F.array_join(season_values("season_raw"), ",")).alias("seasons"),
        season_error("season_raw").alias("season_error"),
        F.array_join(F.transform(item_id_list("ids_raw"), lambda x: x.cast("string")), ",").alias("item_ids"),
    )


register("touch_worn", q_touch_worn)
register("cascade_delete_outfits", q_cascade_delete_outfits)
register("delete_items_restricted", q_delete_items_restricted)
register("delete_items_tables", q_delete_items_tables)
register("outfit_update_lock", q_outfit_update_lock)
register("outfit_update_tables", q_outfit_update_tables)
register("record_wears", q_record_wears)
register("record_wears_tables", q_record_wears_tables)
register("clean_lists", q_clean_lists)

# Payloads that use the alternate field names
def _either(batch, first, second, key="change_id"):
    """The batch with ``first`` blank in every other change, where ``second`` has its
    value; in the others ``second`` holds something else (nothing where ``first`` is blank)."""
    even = F.col(key) % 2 == 0
    return batch.withColumn(second, F.when(even, F.col(first).cast("string")).otherwise(F.when(F.col(first).cast("string") != "", F.lit("-1")))).withColumn(
        first, F.when(even, F.lit("")).otherwise(F.col(first).cast("string"))
    )


register("add_users_alternate", _change_query(changes.add_users, lambda t: _either(dc.sign_ups(t), "username", "name"), "added", {
    "w_user": ("u_id", "username", "gender", "role"), "w_closet": ("c_id", "c_name", "u_id")}))
register("rename_closets_alternate", _change_query(
    changes.rename_closets, lambda t: _either(_either(dc.closet_renames(t), "c_name", "name"), "c_id", "closet_id"), "renamed",
    {"w_closet": ("c_id", "c_name", "u_id")}))


# Whole tables after a change, compared by digest
def _digests(result):
    return changes.table_digests(result.tables)


register("cascade_delete_digests", lambda t: _digests(changes.delete_outfits(t, dc.outfit_deletes(t))))
register("delete_items_digests", lambda t: _digests(changes.delete_items(t, dc.item_deletes(t))))
register("outfit_update_digests", lambda t: _digests(changes.update_outfits(t, _batch(dc.outfit_updates(t)))))
register("record_wears_digests", lambda t: _digests(changes.record_wears(t, _batch(dc.wear_changes(t)), as_of=AS_OF)))
register("delete_users_digests", lambda t: changes.table_digests(
    changes.cascade_delete(t, users=t.w_user.where("gender IS NULL AND role = 'user'").select("u_id"))))


# Audits on tables with planted faults
def planted_faults(t):
    """The tables with faults that follow from the rows: repeated keys, NULLs,
    values outside their domain, dangling references, two values for one key, odd images."""
    item, outfit = F.col("item_id"), F.col("outfit_id")
    twice = lambda df, which: df.unionByName(df.where(which))
    rec = t.w_rec.withColumn("rating", F.when(outfit % 19 == 3, F.lit(6)).otherwise(F.col("rating")))
    return t.with_tables(
        w_tag=twice(t.w_tag, item % 11 == 4).withColumn("tag", F.when(item % 13 == 5, F.lit(None)).otherwise(F.col("tag"))),
        w_item=t.w_item.withColumn("c_id", F.when(item % 17 == 6, F.lit(-5)).otherwise(F.col("c_id")).cast("bigint")),
        w_user=t.w_user.withColumn("role", F.when(F.col("u_id") == 2, F.lit("guest")).otherwise(F.col("role"))),
        w_outfit=t.w_outfit.unionByName(t.w_outfit.where(outfit % 23 == 7).withColumn("note", F.lit("other"))),
        w_inc=t.w_inc.withColumn("item_id", F.when(outfit % 29 == 8, -item).otherwise(item)),
        w_rec=rec,
        w_img=t.w_img.withColumn("image_url", F.when(item % 7 == 2, F.concat("image_url", F.lit(".svg"))).when(item % 7 == 3, F.lit("noname")).otherwise(F.col("image_url"))),
    )


for _name, _audit in (
    ("audit_pk_faults", audit.primary_keys), ("audit_not_null_faults", audit.not_null), ("audit_check_faults", audit.checks),
    ("audit_fk_faults", audit.foreign_keys), ("audit_fd_faults", audit.functional_dependencies), ("audit_images_faults", audit.images),
):
    register(_name, lambda t, run=_audit: run(planted_faults(t)))
register("audit_images", audit.images)


# S5 and S7 through files
from wearhouse.sources.tables import quarantined, write_json  # noqa: E402


def q_change_quarantine(t):
    """The wear changes as JSON lines, some cut short, some with an unknown
    field, some with text for a number, read back: every change by its id, and why
    it was set aside."""
    from wearhouse.streaming.ingest import WEAR_CHANGE_SCHEMA

    batch = dc.wear_changes(t)  # read once: the lines are the batch as it arrives
    line, kind = F.to_json(F.struct(*batch.columns)), F.col("change_id") / 4 % 10
    path = scratch_path(t.spark, "changes")
    lines = batch.select(
        F.when(kind == 1, F.concat(F.lit("{"), line)).when(kind == 2, F.concat(F.lit('{"colour":"x",'), F.substring(line, 2, 1 << 20)))
        .when(kind == 3, F.regexp_replace(line, '"u_id":[0-9]+', '"u_id":"me"')).otherwise(line).alias("value")
    )
    with shuffles_removed(t.spark):
        lines.write.option("compression", "gzip").text(path)
    good, bad = quarantined(t.spark, path, WEAR_CHANGE_SCHEMA)
    number = F.regexp_extract("raw", '"change_id":([0-9]+)', 1).cast("bigint")
    return good.select("change_id", F.lit("good").alias("state")).unionByName(bad.select(number.alias("change_id"), F.col("reason").alias("state")))


def q_catalog_json(t):
    """The item catalog written as JSON lines and read back."""
    items = catalog.item_catalog(t)
    path = scratch_path(t.spark, "catalog")
    write_json(items, path)
    return t.spark.read.schema(items.schema).json(path)


register("change_quarantine", q_change_quarantine)
register("item_catalog_json", q_catalog_json)

# States kept up by deltas
from wearhouse.operators import facet_counts, wear_counts  # noqa: E402
from wearhouse.plans.ranking import ranked_by_ranges  # noqa: E402


def _cut(t, *names):
    """The bundle with the named tables written, so that one job's plan does not
    carry the jobs before it."""
    return t.with_tables(**{n: materialize(t.get(n)) for n in names})


def _advanced(old, result, *names):
    """(tables, result) of a job on ``old``, with the named tables written: of a table
    that only gained rows these alone are, beside the rows it had."""
    added = {n: materialize(rows) for n, rows in result.appends.items() if n in names}
    new = {n: old.get(n).unionByName(added[n]) if n in added else materialize(result.tables.get(n)) for n in names}
    return result.tables.with_tables(**new), replace(result, appends=result.appends | added)


def _worn_three_times(t):
    """(tables, state) after M11, M12's deletes and M10, each over whole tables,
    the state following by deltas."""
    t = _cut(t, "w_rec", "w_inc", "w_outfit", "w_item")
    state = wear_counts.stored_wear_state(t)
    new, result = _advanced(t, changes.record_wears(t, _batch(dc.wear_changes(t)), as_of=AS_OF), "w_rec", "w_inc", "w_outfit", "w_item")
    state = wear_counts.apply_delta(state, t, new, wear_counts.inserted(result))
    old, result = new, changes.delete_records(new, _batch(dc.record_changes(t)))
    new = _cut(result.tables, "w_rec")
    state = wear_counts.apply_delta(state, old, new, wear_counts.records_deleted(old, result))
    old, result = new, changes.delete_outfits(new, _batch(dc.outfit_deletes(t)))
    new = _cut(result.tables, "w_rec", "w_inc", "w_outfit")
    return new, wear_counts.apply_delta(state, old, new, wear_counts.outfits_deleted(old, result))


def q_wear_counts_by_deltas(t):
    """R11's counts and R6's, as one relation (kind, id, worn, latest), kept up by deltas."""
    _, state = _worn_three_times(t)
    items = state.items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("wear_count").alias("worn"), F.col("last_recorded").alias("latest"))
    return items.unionByName(state.outfits.select(F.lit("outfit"), "outfit_id", "worn_count", "last_worn").toDF(*items.columns))


def q_most_worn_by_deltas(t):
    """R3 after the same changes, from the state alone."""
    return wear_counts.item_usage(*_worn_three_times(t))


def q_facet_counts_by_deltas(t):
    """Q11 and C8 with counts after M5, M6 and M7 over whole tables, kept up by deltas."""
    tables = ("w_item", "w_tag", "w_cat", "w_color", "w_img", "w_inc")
    state = materialize(facet_counts.facet_counts(t))
    old = t
    for job, batch in ((changes.add_items, dc.item_adds(t)), (changes.update_items, dc.item_updates(t)), (changes.delete_items, dc.item_deletes(t))):
        result = job(old, _batch(batch))
        new = _cut(result.tables, *tables)
        state = facet_counts.updated(state, old, new, items=result.applied)
        old = new
    return state.where("facet NOT IN ('seasons', 'occasions')")


register("wear_counts_by_deltas", q_wear_counts_by_deltas)
register("most_worn_by_deltas", q_most_worn_by_deltas)
register("facet_counts_by_deltas", q_facet_counts_by_deltas)
register("facet_counts", facet_counts.facet_counts)
register("report_rows_ranges", lambda t: reports.report_rows(t, rank=ranked_by_ranges))
register("season_facet_ranges", lambda t: outfits.season_facet(t, rank=ranked_by_ranges))


def q_item_places(t):
    """Every item's place among its user's items by name: a ranking of whole,
    large groups."""
    items = items_with_owner(t).select("u_id", "item_id", "item_name")
    return ranked_by_ranges(items, ["u_id"], [F.col("item_name").asc(), F.col("item_id").asc()], "place")


register("item_places", q_item_places)


# Step 9: stream ingest (same batch job per micro-batch)
from wearhouse.sources.tables import load_tables, read_beside, write_tables  # noqa: E402
from wearhouse.streaming.ingest import start_wear_ingest  # noqa: E402


def q_stream_wear_ingest(t):
    """Publish the tables as snapshot 0, stream the derived wear changes in two
    files (one micro-batch each) and return the final snapshot's table counts."""
    spark = t.spark
    root = scratch_path(spark, "wear-ingest")
    write_tables(t, f"{root}/tables", version=0)
    src = f"{root}/incoming"
    # Written by the tasks that derive them, with no shuffle to deal them anew; half of
    # the files make one micro-batch.
    with shuffles_removed(spark):
        dc.wear_changes(t).write.option("compression", "gzip").json(src)
    files = len(spark.read.text(src).inputFiles())
    query = start_wear_ingest(spark, src, f"{root}/tables", f"{root}/_stream", as_of=AS_OF, max_files_per_trigger=-(-files // 2))
    query.awaitTermination()
    final = load_tables(spark, f"{root}/tables")
    rejects = read_beside(spark, f"{root}/tables", "rejects").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("rejects").alias("table_name"), "n_rows"
    )
    return changes.table_counts(final).unionByName(rejects)


register("stream_wear_ingest", q_stream_wear_ingest)


def q_outfit_detail_nested(t):
    """Q20 with its arrays as text: item ids, and name, id, closet and lists of each item."""
    nested = outfits.outfit_detail_nested(t)
    shown = ("item_name", "item_id", "c_name", "tag", "category", "color", "image_url")
    one = lambda x: F.concat_ws("|", *[F.coalesce(x[c].cast("string"), F.lit("~")) for c in shown])
    return nested.withColumn("item_ids", F.concat_ws(",", F.transform("item_ids", lambda x: x.cast("string")))).withColumn(
        "items", F.array_join(F.transform("items", one), ";")
    )


register("outfit_detail_nested", q_outfit_detail_nested)


def q_outfit_detail_nested_items(t):
    """Q20's nested ``items`` array flattened back to rows: it must equal Q18."""
    nested = outfits.outfit_detail_nested(t)
    return nested.select("outfit_id", F.inline("items"))


register("outfit_detail_nested_items", q_outfit_detail_nested_items)
