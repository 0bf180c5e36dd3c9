"""What is left on disk: no shuffle files of written tables, no stages of a published batch, compressed lines."""

from __future__ import annotations

import glob
import tempfile

from pyspark.sql import functions as F

from tests.test_changes import wear_batch
from wearhouse import registered
from wearhouse.plans.session import ensure_checkpoint_dir, materialize, stages_removed
from wearhouse.sources.tables import _write, load_tables, write_tables
from wearhouse.streaming.ingest import apply_wear_batch


def shuffle_files(spark) -> set[str]:
    files = spark._jsparkSession.sparkContext().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def stages(spark, name="stage") -> set[str]:
    return set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + f"/{name}-*"))


def test_written_tables_leave_no_shuffle_files(spark, golden):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, asked = shuffle_files(spark), spark.conf.get(setting)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    _write(golden.w_tag.distinct(), "w_tag", tempfile.mkdtemp(prefix="wearhouse-test-") + "/t", None)
    assert not shuffle_files(spark) - before and out.count() == 7
    assert spark.conf.get(setting) == asked


def test_stages_inside_go_and_others_stay(spark):
    kept = materialize(spark.range(3))
    before = stages(spark)
    with stages_removed(spark):
        inner = materialize(spark.range(5))
        assert inner.count() == 5 and len(stages(spark) - before) == 1
    assert stages(spark) == before and kept.count() == 3
    materialize(spark.range(2))
    assert len(stages(spark) - before) == 1


def test_a_published_batch_leaves_no_stages(spark, golden):
    root = tempfile.mkdtemp(prefix="wearhouse-test-") + "/t"
    write_tables(golden, root, version=0)
    before = stages(spark)
    batch = wear_batch(spark, [dict(change_id=1, u_id=2, outfit_id="2", datetime="2031-01-01"), dict(change_id=2, u_id=2, item_ids="5,9", datetime="2023-06-01 10:00:00")])
    assert apply_wear_batch(spark, batch, 0, root)
    assert stages(spark) == before
    after = load_tables(spark, root)
    assert after.w_rec.count() == golden.w_rec.count() + 2 and after.w_outfit.count() == golden.w_outfit.count() + 1
    assert after.w_item.where("last_worn = '2031-01-01'").count() > 0


def test_stream_of_derived_changes_is_not_dealt_anew(spark, golden, monkeypatch):
    # Changes whose id repeats meet in one micro-batch, as in one batch.
    t = golden.with_tables(w_outfit=golden.w_outfit.unionByName(golden.w_outfit))
    monkeypatch.setattr(registered.dc, "wear_changes", lambda tables, real=registered.dc.wear_changes: real(tables).coalesce(3))
    counts = {r.table_name: r.n_rows for r in registered.q_stream_wear_ingest(t).collect()}
    assert counts == {r.table_name: r.n_rows for r in registered.q_record_wears_tables(t).collect()}
    root = max(stages(spark, "wear-ingest"), key=lambda p: int(p.split("-")[-1]))
    assert 1 <= len(glob.glob(root + "/incoming/part-*")) <= 3  # as many files as tasks that derive them


def test_lines_with_faults_are_written_compressed_and_once(spark, golden):
    stage, lines = stages(spark), stages(spark, "changes")
    got = registered.q_change_quarantine(golden)
    assert len(stages(spark) - stage) == 1  # the parsed lines; not the batch as well
    (folder,) = stages(spark, "changes") - lines
    files = glob.glob(folder + "/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    batch = registered.dc.wear_changes(golden)
    assert sorted(r.change_id for r in got.collect()) == sorted(r.change_id for r in batch.collect())
