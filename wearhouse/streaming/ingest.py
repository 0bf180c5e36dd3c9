"""ST1: wear-event ingest as a Structured Streaming job.

New wear changes arrive as JSON-lines files in a folder.  Each micro-batch is
applied with the same batch job as everything else
(:func:`wearhouse.operators.changes.record_wears`, which includes the
last_worn update) and published as a new snapshot version.  The batch id is
stored in the snapshot's commit marker, so a micro-batch that is replayed
after a failure (same ``batch_id``) is skipped: the primary-key check alone
would not protect changes that create an outfit or default to "now".

There is no watermark: the application accepts a wear at any date, and the
last_worn update takes a maximum, so late events are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wearhouse.operators.changes import MSG_MALFORMED, publish, record_wears
from wearhouse.plans.session import materialize, stages_removed
from wearhouse.sources.tables import compact_tables, last_batch_id, latest_version, load_tables, manifest, parsed_changes

#: Parts a table may have before the ingest merges them.
MAX_PARTS = 32

WEAR_CHANGE_SCHEMA = StructType(
    [StructField("change_id", LongType()), StructField("u_id", LongType())]
    + [
        StructField(c, StringType())
        for c in ("outfit_id", "datetime", "rating", "weather", "mood", "note", "outfit_name",
                  "outfit_note", "season", "occasion", "image_url", "item_ids")
    ]
)


def apply_wear_batch(spark: SparkSession, batch: DataFrame, batch_id: int, snapshot_root: str, as_of: str | None = None) -> bool:
    """Apply one micro-batch; returns False when ``batch_id`` was already published."""
    last = last_batch_id(spark, snapshot_root)
    if last is not None and batch_id <= last:
        return False
    # The snapshot holds what is kept of the batch; the tables written on the way go.
    with stages_removed(spark):
        base_version = latest_version(spark, snapshot_root)
        tables = load_tables(spark, snapshot_root, base_version)
        malformed = None
        if "_reason" in batch.columns:  # lines set aside, and changes without an id
            bad = F.col("_reason").isNotNull() | F.col("change_id").isNull()
            batch = materialize(batch.withColumn("_raw", F.when(bad, F.col("_raw"))))  # good lines are not kept twice
            malformed = batch.where(bad).select(
                "change_id", F.lit(MSG_MALFORMED).alias("reason"), F.col("_raw").alias("raw"), F.col("_reason").alias("detail"), F.lit(batch_id).alias("batch_id")
            )
            batch = batch.where(~bad).drop("_reason", "_raw")
        result = record_wears(tables, batch, as_of=as_of)
        none = F.lit(None).cast("string")
        rejects = result.rejects.select("change_id", "reason", none.alias("raw"), none.alias("detail"), F.lit(batch_id).alias("batch_id"))
        if malformed is not None:
            rejects = rejects.unionByName(malformed)
        # New records and outfits are appended as one part each, last_worn as a part
        # of the touch log: nothing is rewritten.  The rejects become visible with the same marker.
        publish(result, tables, snapshot_root, base_version, batch_id=batch_id, beside={"rejects": rejects})
        if any(len(p) > MAX_PARTS for p in manifest(spark, snapshot_root, latest_version(spark, snapshot_root)).values()):
            compact_tables(spark, snapshot_root, MAX_PARTS)
    return True


def start_wear_ingest(
    spark: SparkSession,
    source_dir: str,
    snapshot_root: str,
    checkpoint_location: str,
    as_of: str | None = None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest.  ``available_now`` processes what is there and stops
    (each micro-batch writes a full snapshot, so a continuous trigger would
    only add versions); ``checkpoint_location`` must be a shared folder."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = parsed_changes(reader.text(source_dir), WEAR_CHANGE_SCHEMA)  # lines that are no change become rejects

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_wear_batch(spark, batch, batch_id, snapshot_root, as_of)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
