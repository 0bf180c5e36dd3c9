"""Session settings and the shared checkpoint folder.

The library never sets cluster-wide options on a session it did not create,
except the time zone (ids and text dates are compared as text; the only
time-zone-dependent step is formatting timestamps in the test adapter).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading

from pyspark.sql import SparkSession

# Settings for sessions this package creates (tests, bench, examples).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "wearhouse", **extra: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is only
    read here; a cluster session without it is an error, since a folder of the
    driver's machine would not be seen by the executors.  Only in local mode,
    as in tests, an unset folder is replaced by a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="wearhouse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


#: Spark's setting that removes a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes started inside leave no shuffle files behind; otherwise these stay
    until the driver happens to collect the plans they belong to."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write_stored(df, path: str, mode: str = "errorifexists", **options) -> None:
    """``df`` as Parquet at ``path``, leaving no shuffle files behind."""
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).options(**options).parquet(path)


_scratch = threading.local()


@contextlib.contextmanager
def stages_removed(spark: SparkSession):
    """What :func:`materialize` writes inside (in this thread) is removed at the end,
    so nothing that is read later may come from it."""
    before, paths = getattr(_scratch, "paths", None), []
    _scratch.paths = paths
    try:
        yield
    finally:
        _scratch.paths = before
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def materialize(df):
    """Cut lineage by writing ``df`` once as Parquet into the shared checkpoint
    folder and reading it back.

    Used for a validated change batch that several outputs read: it is
    computed once (a reliable ``checkpoint()`` would compute it twice and
    serialise rows one by one), and the result survives the loss of an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    write_stored(df, path, mode="overwrite", compression="zstd")
    return spark.read.parquet(path)
