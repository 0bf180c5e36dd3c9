"""Properties of the change-set jobs: constraints hold afterwards, every change
is either applied or rejected, restricted deletes, the composition lock,
insert-or-ignore, ids, last_worn never lowered, stream replay is a no-op."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from wearhouse.operators import audit, changes
from wearhouse.sources.tables import load_tables, write_tables
from wearhouse.streaming.ingest import WEAR_CHANGE_SCHEMA, apply_wear_batch


def constraints_hold(t):
    assert all(r.dup_keys == 0 for r in audit.primary_keys(t).collect())
    assert all(r.null_count == 0 for r in audit.not_null(t).collect())
    assert all(r.violations == 0 for r in audit.checks(t).collect())
    assert all(r.orphan_rows == 0 for r in audit.foreign_keys(t).collect())


def accounted(batch, result):
    assert batch.count() == result.applied.count() + result.rejects.count()
    ids = {r.change_id for r in batch.select("change_id").collect()}
    ok = {r.change_id for r in result.applied.select("change_id").collect()}
    bad = {r.change_id for r in result.rejects.select("change_id").collect()}
    assert ok | bad == ids and not ok & bad
    return ok, {r.change_id: r.reason for r in result.rejects.collect()}


def wear_batch(spark, rows):
    cols = [f.name for f in WEAR_CHANGE_SCHEMA.fields]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(full, WEAR_CHANGE_SCHEMA)


def test_golden_constraints(golden):
    constraints_hold(golden)


def test_add_users_and_closets(spark, golden):
    batch = spark.createDataFrame(
        [(1, " ann ", None), (2, "bram", "x"), (3, "  ", None), (4, "ann", "f")], "change_id long, username string, gender string"
    )
    r = changes.add_users(golden, batch)
    ok, bad = accounted(batch, r)
    assert ok == {1} and bad[2] == changes.MSG_USER_EXISTS and bad[3] == changes.MSG_USER_REQUIRED and bad[4] == changes.MSG_USER_EXISTS
    new = r.tables.w_user.where("username = 'ann'").first()
    assert new.u_id == 4 and new.role == "user"
    assert r.tables.w_closet.where("u_id = 4").first().c_name == "ann's Closet"
    constraints_hold(r.tables)


def test_delete_closet_restricted_then_cascade(spark, golden):
    batch = spark.createDataFrame([(1, 2, 1), (2, 2, 4), (3, 3, 2)], "change_id long, u_id long, c_id long")
    r = changes.delete_closets(golden, batch)
    ok, bad = accounted(batch, r)
    assert ok == {2} and bad[1].startswith("This wardrobe contains items used by 2 outfit(s)") and bad[3] == changes.MSG_CLOSET_NOT_FOUND
    assert r.tables.w_item.where("item_id = 5").count() == 0 and r.tables.w_tag.where("item_id = 5").count() == 0
    constraints_hold(r.tables)


def test_delete_items_restricted(spark, golden):
    batch = spark.createDataFrame([(1, 2, 4), (2, 2, 5)], "change_id long, u_id long, item_id long")
    r = changes.delete_items(golden, batch)
    ok, bad = accounted(batch, r)
    assert ok == {2} and bad[1].startswith("This item is used by 2 outfit(s)")
    constraints_hold(r.tables)


def test_outfit_add_update_lock_delete(spark, golden):
    add = spark.createDataFrame(
        [(1, 2, "New", "", "spring, WINTER", "Date", "", "5,9"), (2, 2, "Bad", "", "Monsoon", "", "", "5"),
         (3, 2, "Theirs", "", "", "", "", "5,6"), (4, 2, " ", "", "", "", "", "5")],
        "change_id long, u_id long, outfit_name string, note string, season string, occasion string, image_url string, item_ids string",
    )
    r = changes.add_outfits(golden, add, as_of="2026-06-01 10:00:00")
    ok, bad = accounted(add, r)
    assert ok == {1} and bad[2] == changes.MSG_SEASON and bad[3] == changes.MSG_NOT_OWNED and bad[4] == changes.MSG_OUTFIT_NAME
    o = r.tables.w_outfit.where("outfit_id = 5").first()
    assert o.created_date == "2026-06-01" and o.outfit_name == "New"
    assert sorted(x.season for x in r.tables.w_season.where("outfit_id = 5").collect()) == ["Spring", "Winter"]
    constraints_hold(r.tables)

    upd = spark.createDataFrame(
        [(1, 2, 1, "Quay", "", "", "", "", "1,5"), (2, 2, 2, "Fete", "n", "Winter", "", "", "9,4,3")],
        "change_id long, u_id long, outfit_id long, outfit_name string, note string, season string, occasion string, image_url string, item_ids string",
    )
    r2 = changes.update_outfits(golden, upd)
    ok, bad = accounted(upd, r2)
    assert ok == {2} and bad[1] == changes.MSG_LOCKED
    assert r2.tables.w_outfit.where("outfit_id = 2").first().outfit_name == "Fete"

    dele = spark.createDataFrame([(1, 2, 1), (2, 3, 2)], "change_id long, u_id long, outfit_id long")
    r3 = changes.delete_outfits(golden, dele)
    ok, bad = accounted(dele, r3)
    assert ok == {1} and bad[2] == changes.MSG_OUTFIT_NOT_FOUND
    assert r3.tables.w_rec.where("outfit_id = 1").count() == 0 and r3.tables.w_item.count() == 9
    constraints_hold(r3.tables)


def test_record_wears(spark, golden):
    batch = wear_batch(spark, [
        dict(change_id=1, u_id=2, outfit_id="1", datetime="2024-11-01 06:00:00"),  # duplicate key
        dict(change_id=2, u_id=2, outfit_id="1", datetime="2026-06-02", rating="5"),
        dict(change_id=3, u_id=2, outfit_id="1", datetime="2026-06-02"),  # in-batch duplicate
        dict(change_id=4, u_id=2, item_ids="3, 5", datetime="2026-06-03 09:00:00", season="summer"),
        dict(change_id=5, u_id=2, item_ids="3", datetime="2026-06-04", rating="7"),
        dict(change_id=6, u_id=2, outfit_id="abc"),
        dict(change_id=7, u_id=2, item_ids=""),
    ])
    r = changes.record_wears(golden, batch, as_of="2026-07-01 00:00:00")
    ok, bad = accounted(batch, r)
    assert ok == {2, 4}
    assert bad[1] == bad[3] == changes.MSG_DUPLICATE_RECORD and bad[5] == changes.MSG_RATING
    assert bad[6] == changes.MSG_INVALID_OUTFIT and bad[7] == changes.MSG_RECORD_ITEMS
    t = r.tables
    new = t.w_outfit.where("outfit_id = 5").first()
    assert new.outfit_name == "Outfit Record" and new.created_date == "2026-06-03"
    lw = {x.item_id: x.last_worn for x in t.w_item.collect()}
    assert lw[1] == lw[2] == "2026-06-02" and lw[3] == lw[5] == "2026-06-03" and lw[9] == "2024-08-17" and lw[8] is None
    constraints_hold(t)


def test_touch_worn_never_lowers(spark, golden):
    wears = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (2, "2030-01-01")], "item_id long, datetime string")
    lw = {x.item_id: x.last_worn for x in changes.touch_worn(golden, wears).w_item.collect()}
    assert lw[1] == "2024-11-02" and lw[2] == "2030-01-01" and lw[5] == ""


def test_insert_or_ignore_and_ids(spark, golden):
    new = spark.createDataFrame([(9, 1, "casual"), (8, 1, "extra"), (7, 1, "extra")], "change_id long, item_id long, tag string")
    out = changes.insert_or_ignore(golden.w_tag, new, ["item_id", "tag"])
    assert sorted(map(tuple, out.collect())) == [(1, "casual"), (1, "extra")]
    old = spark.createDataFrame([(1, 1, "wet")], "change_id long, item_id long, tag string")
    assert changes.insert_or_ignore(golden.w_tag, old, ["item_id", "tag"]).count() == 0
    df = spark.range(0, 50, numPartitions=4).withColumnRenamed("id", "change_id")
    ids = sorted((r.change_id, r.new_id) for r in changes.assign_ids(df, "new_id", ["change_id"], 100).collect())
    assert [i for _, i in ids] == list(range(100, 150))


def test_stream_batch_replay_is_noop(spark, golden):
    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, root, version=0)
    batch = wear_batch(spark, [dict(change_id=1, u_id=2, item_ids="3", datetime="")])  # creates an outfit at "now"
    assert apply_wear_batch(spark, batch, 0, root, as_of="2026-07-01 00:00:00")
    assert not apply_wear_batch(spark, batch, 0, root, as_of="2026-07-01 00:00:00")
    t = load_tables(spark, root)
    assert t.w_outfit.count() == 5 and t.w_rec.count() == 6
    assert t.w_rec.where(F.col("datetime") == "2026-07-01 00:00:00").count() == 1


def test_publish_writes_only_changes(spark, golden):
    from wearhouse.operators.changes import publish
    from wearhouse.sources.tables import compact_tables, latest_version, manifest

    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, root, version=0)
    base = load_tables(spark, root)
    batch = wear_batch(spark, [dict(change_id=1, u_id=2, outfit_id="2", datetime="2026-06-09")])
    v = publish(changes.record_wears(base, batch), base, root, 0)
    parts = manifest(spark, root, v)
    versions = {n: [x.split("/")[0] for x in p] for n, p in parts.items()}
    assert versions["w_user"] == ["v=0"] and versions["w_tag"] == ["v=0"]  # untouched: not rewritten
    assert versions["w_rec"] == ["v=0", f"v={v}"]  # insert-only: one new part
    assert versions["w_item"] == ["v=0"] and versions["w_touch"] == [f"v={v}"]  # last_worn: a part of the touch log
    t = load_tables(spark, root)
    assert t.w_rec.count() == 6 and t.w_item.where("item_id = 3").first().last_worn == "2026-06-09"
    v2 = compact_tables(spark, root, max_parts=1)
    assert v2 == latest_version(spark, root) and len(manifest(spark, root, v2)["w_rec"]) == 1
    assert load_tables(spark, root).w_rec.count() == 6


def test_closets_add_rename(spark, golden):
    add = spark.createDataFrame([(1, 3, " Gym "), (2, 3, " "), (3, 9, "X")], "change_id long, u_id long, c_name string")
    r = changes.add_closets(golden, add)
    ok, bad = accounted(add, r)
    assert ok == {1} and bad[2] == changes.MSG_CLOSET_NAME and bad[3] == changes.MSG_USER_NOT_FOUND
    assert r.tables.w_closet.where("c_id = 5").first().c_name == "Gym"
    ren = spark.createDataFrame([(1, 2, 1, "Daily"), (2, 2, 1, "Everyday"), (3, 3, 2, "Mine")], "change_id long, u_id long, c_id long, c_name string")
    r2 = changes.rename_closets(golden, ren)
    ok, bad = accounted(ren, r2)
    assert ok == {1, 2} and bad[3] == changes.MSG_CLOSET_NOT_FOUND
    assert r2.tables.w_closet.where("c_id = 1").first().c_name == "Everyday"  # last rename wins


ITEM_CHANGE = ("change_id long, u_id long, item_id long, c_id long, item_name string, size string, last_worn string, "
               "tag string, category string, color string, image_url string")


def test_items_add_update(spark, golden):
    add = spark.createDataFrame([(1, 2, None, 2, "Scarf", None, None, "warm, soft,warm", "Accessory", "", None),
                                 (2, 2, None, 9, "Bad", None, None, None, None, None, None)], ITEM_CHANGE)
    r = changes.add_items(golden, add)
    ok, bad = accounted(add, r)
    assert ok == {1} and bad[2] == changes.MSG_CLOSET_NOT_FOUND
    assert sorted(x.tag for x in r.tables.w_tag.where("item_id = 10").collect()) == ["soft", "warm"]
    assert r.tables.w_color.where("item_id = 10").count() == 0
    constraints_hold(r.tables)
    upd = spark.createDataFrame([(1, 2, 1, None, None, "XS", None, "new", None, None, None)], ITEM_CHANGE)
    rep = changes.update_items(golden, upd, mode="replace").tables
    row = rep.w_item.where("item_id = 1").first()
    assert (row.item_name, row.size, row.c_id) == ("", "XS", 1)  # PUT: absent name becomes ''
    assert rep.w_cat.where("item_id = 1").count() == 0 and [x.tag for x in rep.w_tag.where("item_id = 1").collect()] == ["new"]
    mer = changes.update_items(golden, upd, mode="merge").tables
    row = mer.w_item.where("item_id = 1").first()
    assert (row.item_name, row.size) == ("Oilskin Coat", "XS") and mer.w_cat.where("item_id = 1").count() == 1


REC_CHANGE = "change_id long, u_id long, outfit_id long, datetime string, rating string, weather string, mood string, note string"


def test_records_update_delete(spark, golden):
    upd = spark.createDataFrame([(1, 2, 1, "2024-11-01 06:00:00", "2", "Rain", None, "meh"),
                                 (2, 2, 1, "2026-05-20", None, None, None, None),
                                 (3, 2, 2, "2024-08-17 15:00:00", "8", None, None, None),
                                 (4, 3, 1, "2024-11-01 06:00:00", None, None, None, None)], REC_CHANGE)
    r = changes.update_records(golden, upd)
    ok, bad = accounted(upd, r)
    assert ok == {1} and bad[2] == changes.MSG_RECORD_NOT_FOUND and bad[3] == changes.MSG_RATING and bad[4] == changes.MSG_OUTFIT_NOT_FOUND
    rec = r.tables.w_rec.where("outfit_id = 1 AND datetime < '2024-11-02'").first()
    assert (rec.rating, rec.weather, rec.mood, rec.note) == (2, "Rain", "", "meh")
    dele = spark.createDataFrame([(1, 2, 2, "2024-08-17 15:00:00", None, None, None, None),
                                  (2, 2, 2, "", None, None, None, None)], REC_CHANGE)
    r2 = changes.delete_records(golden, dele)
    ok, bad = accounted(dele, r2)
    assert ok == {1} and bad[2] == changes.MSG_RECORD_DATE
    assert r2.tables.w_rec.count() == 4 and r2.tables.w_outfit.count() == 4


def test_change_file_source_and_json_sink(spark, golden):
    import json
    import os

    from wearhouse.sources.tables import read_changes, rows_as_json, write_json

    d = tempfile.mkdtemp(prefix="wearhouse-test-")
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write(json.dumps({"change_id": 1, "u_id": 1, "outfit_id": "1", "datetime": "2026-06-01"}) + "\n")
        f.write("{not json\n")
    df = read_changes(spark, d, WEAR_CHANGE_SCHEMA)
    rows = df.collect()
    assert len(rows) == 2 and rows[1]["_corrupt_record"] == "{not json" and rows[0]["_corrupt_record"] is None
    js = golden.w_user.select(rows_as_json(golden.w_user).alias("j")).where("j like '%bram%'").first().j
    assert json.loads(js) == {"u_id": 2, "username": "bram", "gender": "male", "role": "user"}
    write_json(golden.w_outfit.select("outfit_id", F.lit(None).cast("string").alias("gap")), f"{d}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"{d}/out").collect()]
    assert sorted(x["outfit_id"] for x in lines) == [1, 2, 3, 4] and all(x["gap"] is None for x in lines)


def test_alternate_fields(spark, golden):
    """the first given one of two payload names counts."""
    df = spark.createDataFrame([(1, "", "bob"), (2, "ann", "x")], "change_id long, username string, name string")
    r = changes.add_users(golden, df.withColumn("gender", F.lit(None).cast("string")))
    assert {x.username for x in r.applied.collect()} == {"bob", "ann"}


def test_repeated_change_ids_are_rejected(spark, golden):
    batch = wear_batch(spark, [dict(change_id=1, u_id=2, outfit_id="1", datetime="2026-06-02"), dict(change_id=1, u_id=2, outfit_id="2", datetime="2026-06-03"),
                               dict(change_id=2, u_id=2, outfit_id="2", datetime="2026-06-04"), dict(u_id=2, outfit_id="2", datetime="2026-06-05")])
    r = changes.record_wears(golden, batch)
    assert r.applied.count() + r.rejects.count() == 4 and r.tables.w_rec.count() == 6
    assert sorted((x.change_id or 0, x.reason) for x in r.rejects.collect()) == [(0, changes.MSG_MALFORMED), (1, changes.MSG_MALFORMED), (1, changes.MSG_MALFORMED)]
    constraints_hold(r.tables)


def test_later_updates_do_not_undo_earlier_ones(spark, golden):
    rows = [(1, 2, 1, 2, None, "XL", None, None, None, "Teal", None), (2, 2, 1, None, "Poncho", None, "2026-01-01", None, None, None, None),
            (3, 2, 1, 0, None, None, None, "dry", None, None, None)]
    batch = spark.createDataFrame(rows, ITEM_CHANGE)
    for mode, want in (("merge", (2, "Poncho", "XL", "2026-01-01")), ("replace", (2, "", "", ""))):
        r = changes.update_items(golden, batch, mode=mode)
        assert accounted(batch, r)[0] == {1, 2, 3}  # overridden ones are applied, too
        row = r.tables.w_item.where("item_id = 1").first()
        assert (row.c_id, row.item_name, row.size, row.last_worn) == want
        colors = [x.color for x in r.tables.w_color.where("item_id = 1").collect()]
        assert colors == (["Teal"] if mode == "merge" else [])
        constraints_hold(r.tables)
    out = spark.createDataFrame([(1, 2, 2, "A", "", "", "", "", "3,4,9"), (2, 2, 2, "B", "", "", "", "", "9,4,3")],
                                "change_id long, u_id long, outfit_id long, outfit_name string, note string, season string, occasion string, image_url string, item_ids string")
    r = changes.update_outfits(golden, out)
    assert accounted(out, r)[0] == {1, 2} and r.tables.w_outfit.where("outfit_id = 2").first().outfit_name == "B"


def test_second_delete_is_not_found(spark, golden):
    twice = lambda *row: [(1, *row), (2, *row)]
    cases = [
        (changes.delete_closets, spark.createDataFrame(twice(2, 4), "change_id long, u_id long, c_id long"), changes.MSG_CLOSET_NOT_FOUND),
        (changes.delete_items, spark.createDataFrame(twice(2, 5), "change_id long, u_id long, item_id long"), changes.MSG_ITEM_NOT_FOUND),
        (changes.delete_outfits, spark.createDataFrame(twice(2, 2), "change_id long, u_id long, outfit_id long"), changes.MSG_OUTFIT_NOT_FOUND),
        (changes.delete_records, spark.createDataFrame(twice(2, 2, "2024-08-17 15:00:00", None, None, None, None), REC_CHANGE), changes.MSG_RECORD_NOT_FOUND),
    ]
    for job, batch, reason in cases:
        ok, bad = accounted(batch, job(golden, batch))
        assert ok == {1} and bad == {2: reason}


def test_blank_outfit_ids(spark, golden):
    batch = wear_batch(spark, [dict(change_id=k, u_id=2, outfit_id=o, item_ids="3", datetime=f"2026-06-0{k}") for k, o in enumerate((" ", "", None, "0", " 2 "), 1)])
    ok, bad = accounted(batch, changes.record_wears(golden, batch))
    assert ok == {2, 3, 4, 5} and bad == {1: changes.MSG_INVALID_OUTFIT}


def test_unreadable_marker_is_an_error(spark, golden):
    import glob

    import pytest
    from wearhouse.sources.tables import last_batch_id, latest_version

    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    assert latest_version(spark, root) is None and last_batch_id(spark, root) is None
    write_tables(golden, root, version=0)
    for f in glob.glob(f"{root}/commits/v=0/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"not parquet")
    for f in glob.glob(f"{root}/commits/v=0/.*.crc"):
        with open(f, "wb") as out:
            out.write(b"")
    for call in (latest_version, last_batch_id):
        with pytest.raises(Exception):
            call(spark, root)
    with pytest.raises(Exception):
        write_tables(golden, root)


def test_versions_are_never_overwritten(spark, golden):
    import pytest
    from wearhouse.sources import tables as T

    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, root, version=0)
    with pytest.raises(FileExistsError):
        write_tables(golden, root, version=0)
    # two writers that both see version 0 as the latest: the marker decides
    seen = T.path_exists
    fewer = golden.with_tables(w_rec=golden.w_rec.limit(0))
    write_tables(golden, root, version=1)
    try:
        T.path_exists = lambda spark, path: False if path.endswith("commits/v=1") else seen(spark, path)
        with pytest.raises(Exception):
            write_tables(fewer, root, version=1)
    finally:
        T.path_exists = seen
    assert load_tables(spark, root, 1).w_rec.count() == 5


def test_crash_before_the_marker_loses_nothing(spark, golden, monkeypatch):
    """The parts and rejects of a writer that died are ignored; the replay writes both."""
    import pytest
    from wearhouse.sources import tables as T

    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, root, version=0)
    batch = wear_batch(spark, [dict(change_id=1, u_id=2, outfit_id="1", datetime="2026-06-02"), dict(change_id=2, u_id=2, outfit_id="x")])
    real = T.SparkSession.createDataFrame

    def dies(self, data, schema=None, *a, **k):
        if isinstance(schema, str) and schema.startswith("committed"):
            raise RuntimeError("the driver is gone")
        return real(self, data, schema, *a, **k)

    monkeypatch.setattr(T.SparkSession, "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        apply_wear_batch(spark, batch, 0, root)
    monkeypatch.undo()
    assert load_tables(spark, root).w_rec.count() == 5
    assert apply_wear_batch(spark, batch, 0, root) and not apply_wear_batch(spark, batch, 0, root)
    assert load_tables(spark, root).w_rec.count() == 6
    assert [(r.change_id, r.reason) for r in T.read_beside(spark, root, "rejects").collect()] == [(2, changes.MSG_INVALID_OUTFIT)]


def test_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    import types

    import pytest
    from wearhouse.plans import session

    class Conf:
        def get(self, *_):
            return None

    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=Conf, master="spark://host:7077")
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(types.SimpleNamespace(sparkContext=sc, conf=Conf()))


def test_bucketed_snapshot_same_results(spark, golden):
    from wearhouse.operators import outfits, reports
    from wearhouse.operators.changes import publish
    from wearhouse.sources.tables import manifest

    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, root, version=0, buckets=4)
    t = load_tables(spark, root)
    plan = outfits.outfit_detail(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # co-partitioned on outfit_id
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(outfits.outfit_list(t)) == key(outfits.outfit_list(golden))
    assert key(reports.item_usage(t)) == key(reports.item_usage(golden))
    batch = wear_batch(spark, [dict(change_id=1, u_id=2, outfit_id="2", datetime="2026-06-09")])
    v = publish(changes.record_wears(t, batch), t, root, 0)
    assert len(manifest(spark, root, v)["w_rec"]) == 2
    t2 = load_tables(spark, root)
    assert t2.w_rec.count() == 6 and key(outfits.outfit_list(t2)) == key(outfits.outfit_list(changes.record_wears(golden, batch).tables))


def test_replayed_wear_batch_only_adds_rejects(spark, golden):
    batch = wear_batch(spark, [
        dict(change_id=1, u_id=2, outfit_id="1", datetime="2026-06-02", rating="5"),
        dict(change_id=2, u_id=2, outfit_id="2", datetime="2026-06-03 10:00:00"),
    ])
    once = changes.record_wears(golden, batch, as_of="2026-07-01 00:00:00")
    t1 = once.tables
    again = changes.record_wears(t1, batch, as_of="2026-07-01 00:00:00")
    ok, bad = accounted(batch, again)
    assert not ok and set(bad.values()) == {changes.MSG_DUPLICATE_RECORD}
    before = {r.table_name: r.n_rows for r in changes.table_counts(t1).collect()}
    after = {r.table_name: r.n_rows for r in changes.table_counts(again.tables).collect()}
    assert before == after


def test_stream_ingest_with_malformed_line(spark, golden):
    import json
    import os

    from wearhouse.sources.tables import read_beside
    from wearhouse.streaming.ingest import start_wear_ingest

    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, f"{root}/tables", version=0)
    os.makedirs(f"{root}/in")
    with open(f"{root}/in/a.json", "w") as f:
        f.write(json.dumps({"change_id": 1, "u_id": 2, "outfit_id": "2", "datetime": "2026-06-10"}) + "\n")
        f.write("{oops\n")
        f.write(json.dumps({"change_id": 2, "u_id": 2, "item_ids": "3", "datetime": "2026-06-11 08:00:00"}) + "\n")
    q = start_wear_ingest(spark, f"{root}/in", f"{root}/tables", f"{root}/ckpt", as_of="2026-07-01 00:00:00")
    q.awaitTermination()
    t = load_tables(spark, f"{root}/tables")
    assert t.w_rec.count() == 7 and t.w_outfit.count() == 5
    bad = read_beside(spark, f"{root}/tables", "rejects").collect()
    assert len(bad) == 1 and bad[0].raw == "{oops" and bad[0].reason == changes.MSG_MALFORMED


def test_deleted_ids_are_not_reused(spark, golden):
    from wearhouse.operators.changes import publish

    root = tempfile.mkdtemp(prefix="wearhouse-test-")
    write_tables(golden, root, version=0)
    base = load_tables(spark, root)
    assert base.id_marks["w_outfit"] == 4
    dele = spark.createDataFrame([(1, 2, 4)], "change_id long, u_id long, outfit_id long")
    v = publish(changes.delete_outfits(base, dele), base, root, 0)
    t = load_tables(spark, root, v)
    assert t.w_outfit.count() == 3 and t.id_marks["w_outfit"] == 4
    r = changes.record_wears(t, wear_batch(spark, [dict(change_id=1, u_id=2, item_ids="3", datetime="2026-06-11")]))
    assert [x.outfit_id for x in r.applied.collect()] == [5]  # not 4 again
