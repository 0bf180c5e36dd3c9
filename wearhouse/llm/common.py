"""Helpers the operators share: folds, bounded label samples, text batches."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.plans.session import materialize

__all__ = ["documents", "fold", "label_sample", "map_arrow", "materialize", "rows_of", "emit", "table"]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the session's Python workers (once per
    application), as a zip file that Spark itself distributes."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="wearhouse-"), "wearhouse_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("wearhouse", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def _give_back() -> None:
    """Hands memory that the allocators keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` on workers that have this package.  Spark reuses its
    workers, and an executor pays for what each of them keeps, so they keep
    nothing after a task."""
    ship(df.sparkSession)

    @functools.wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(lean, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def label_sample(labels: DataFrame, label: str, max_rows: int, folds: int = 5, held: int = 0) -> DataFrame:
    """At most ``max_rows`` labelled training rows (doc_id, y), picked by a hash
    of the id, so the sample is bounded and does not depend on the layout.

    NULL labels or ids are no training rows.  A doc_id labelled several times
    counts once, with its largest label.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id"), folds) != held)
    )
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple[list, ...]]:
    """The batches' columns as Python lists, ``size`` rows at a time, so that
    long texts never pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield tuple(c.to_pylist() for c in part.columns)


def emit(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
