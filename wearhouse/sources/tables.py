"""S2/S5/S7 and snapshots: the ``Tables`` bundle, scans, change-set sources, JSON sinks.

Plain Parquet has no row-level DELETE/UPDATE, and a path cannot be overwritten
while it is being read, so a change job publishes ``old snapshot + changes`` as
a *new* version and then writes a one-row commit marker
``<root>/commits/v=<N>``.  Readers take the highest committed version, so they
never see a half-written snapshot.  Parts lie in a folder named after the
version and the writing attempt and are never overwritten.

The marker holds a manifest: for every table, the list of Parquet directories
(relative to ``root``) that together hold its rows.  A version therefore only
writes what changed: a table the job did not touch keeps its parts, an
insert-only change adds one part with just the new rows, and only a table with
updated or deleted rows is rewritten (into ``v=<N>/<attempt>/<table>``).
:func:`compact_tables` merges tables whose part list has grown long.

Optionally every part is written *bucketed* on its table's key (``item_id``
for the item tables, ``outfit_id`` for the outfit tables, INCLUDES and
RECORD) with one bucket count for the whole snapshot.  Readers register each
part as an external table and read it through the catalog, so aggregates and
joins on those keys find their input already co-partitioned and need no
shuffle; a union of equally bucketed parts stays co-partitioned.

Wears raise CLOTH_ITEM.last_worn (M13).  A job that changes nothing else of the
items appends the days to a touch log (``w_touch`` in the manifest: item_id,
last_worn) instead of rewriting the items; readers merge it by taking the later
text.  As a maximum does not depend on order, late and repeated entries are
harmless, and a rewrite of CLOTH_ITEM for any other reason takes the merged values
over and starts an empty log.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wearhouse.plans.session import materialize, write_stored
from wearhouse.sources.schemas import SCHEMAS


@dataclass(frozen=True)
class Tables:
    """The thirteen wardrobe tables as DataFrames (short names as in the schema module)."""

    w_user: DataFrame
    w_closet: DataFrame
    w_item: DataFrame
    w_tag: DataFrame
    w_cat: DataFrame
    w_color: DataFrame
    w_img: DataFrame
    w_outfit: DataFrame
    w_oimg: DataFrame
    w_season: DataFrame
    w_occ: DataFrame
    w_inc: DataFrame
    w_rec: DataFrame
    # True when the tables were read from a bucketed snapshot (item tables on
    # item_id, outfit tables on outfit_id): plans then prefer bucket-local
    # aggregates and co-partitioned joins over a union.
    bucketed: bool = False
    # Highest id ever issued per id-keyed table (from the snapshot's commit
    # marker): new ids continue above it, so ids of deleted rows are never reused.
    id_marks: dict = field(default_factory=dict)
    # The frames as they were loaded: an id mark holds for a frame as long as it is this one.
    loaded: dict = field(default_factory=dict, compare=False, repr=False)

    #: The tables keyed by outfit_id.
    OUTFIT_KEYED: ClassVar[tuple[str, ...]] = ("w_outfit", "w_oimg", "w_season", "w_occ", "w_inc", "w_rec")

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_tables(self, **changed: DataFrame) -> "Tables":
        return replace(self, **changed)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name in SCHEMAS}

    @property
    def spark(self) -> SparkSession:
        return self.w_user.sparkSession

    def only_outfits(self, keys: DataFrame) -> Tables:
        """The bundle with every outfit-keyed table cut to the ``outfit_id`` in
        ``keys`` (a semi join in front of whatever aggregates them)."""
        return self.with_tables(**{n: self.get(n).join(keys.select("outfit_id"), "outfit_id", "left_semi") for n in self.OUTFIT_KEYED})

    def only_items(self, keys: DataFrame, links: bool = False) -> Tables:
        """The bundle with every item-keyed table (INCLUDES with ``links``) cut to
        the ``item_id`` in ``keys``."""
        names = ("w_item", "w_tag", "w_cat", "w_color", "w_img") + (("w_inc",) if links else ())
        return self.with_tables(**{n: self.get(n).join(keys.select("item_id"), "item_id", "left_semi") for n in names})

    def conform(self) -> "Tables":
        """Project every table to its declared column order and types."""
        return Tables(**{n: conform(df, SCHEMAS[n]) for n, df in self.as_dict().items()}, bucketed=self.bucketed,
                      id_marks=self.id_marks)

    def highest_id(self, name: str) -> int:
        """The highest id ever issued for a table: the snapshot's mark alone
        while the table is as it was loaded, else the larger of mark and maximum."""
        mark = self.id_marks.get(name)
        if mark is not None and self.loaded.get(name) is self.get(name):
            return int(mark)
        top = self.get(name).agg(F.max(ID_COLUMNS[name]).alias("m")).first()["m"]
        return max(int(top or 0), int(mark or 0))


def later_worn(stored: Column, day: Column) -> Column:
    """``day`` where ``stored`` is NULL, '' or an older text, else ``stored``."""
    return F.when(day.isNotNull() & (stored.isNull() | (stored == "") | (stored < day)), day).otherwise(stored)


def latest_touches(touches: DataFrame) -> DataFrame:
    """(item_id, last_worn): the latest day of every item in ``touches``."""
    return touches.groupBy("item_id").agg(F.max("last_worn").alias("last_worn"))


def with_touches(items: DataFrame, touches: DataFrame) -> DataFrame:
    """CLOTH_ITEM with its touch log merged in.  A reader that does not ask for
    last_worn does not read the log (Catalyst drops the join)."""
    days = latest_touches(touches).withColumnRenamed("last_worn", "_day")
    merged = later_worn(F.col("last_worn"), F.col("_day"))
    return items.join(days, "item_id", "left").select(*[merged.alias(c) if c == "last_worn" else F.col(c) for c in items.columns])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def tables_from_rows(spark: SparkSession, rows: dict[str, list[tuple]]) -> Tables:
    """S3: build a bundle from literal rows (fixtures and tests only)."""
    return Tables(**{n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in SCHEMAS})


def scan(spark: SparkSession, *paths: str, name: str) -> DataFrame:
    """Read one stored table with its declared schema; pruning and pushdown are Catalyst's."""
    return spark.read.schema(SCHEMAS[name]).parquet(*paths)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in the store it names.  Any other trouble raises."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the file or folder ``path`` in the store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    """The commit markers, or None while the folder does not exist.  A marker
    that cannot be read raises: it must never look like "nothing committed"."""
    if not path_exists(spark, f"{root}/commits"):
        return None
    return spark.read.schema(
        "committed boolean, batch_id bigint, tables map<string, array<string>>, buckets map<string, int>, id_marks map<string, bigint>, v int"
    ).parquet(f"{root}/commits")


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest committed snapshot version under ``root`` (None when there is none)."""
    commits = _commits(spark, root)
    if commits is None:
        return None
    # the markers themselves are read, not only the folder names
    v = commits.where("committed").agg(F.max("v").alias("v")).first()["v"]
    return None if v is None else int(v)


def manifest(spark: SparkSession, root: str, version: int) -> dict[str, list[str]]:
    """Table -> part directories (relative to ``root``) of a committed version."""
    return _marker(spark, root, version)[0]


#: The touch log's name in the manifest, and its columns.
TOUCHES = "w_touch"
TOUCH_SCHEMA = "item_id bigint, last_worn string"

ID_COLUMNS = {"w_user": "u_id", "w_closet": "c_id", "w_item": "item_id", "w_outfit": "outfit_id"}


def _marker(spark: SparkSession, root: str, version: int) -> tuple[dict[str, list[str]], dict[str, int]]:
    parts, buckets, _ = _marker_full(spark, root, version)
    return parts, buckets


def _marker_full(spark: SparkSession, root: str, version: int):
    commits = _commits(spark, root)
    rows = commits.where(F.col("v") == version).limit(1).collect() if commits is not None else []
    if not rows:
        raise FileNotFoundError(f"version {version} is not committed under {root}")
    r = rows[0].asDict()
    return {k: list(v) for k, v in r["tables"].items()}, dict(r.get("buckets") or {}), dict(r.get("id_marks") or {})


def _catalog_name(path: str) -> str:
    return "wh_" + hashlib.sha1(path.encode()).hexdigest()[:20]


def _read_part(spark: SparkSession, name: str, path: str, buckets: int | None) -> DataFrame:
    schema = SCHEMAS[name]
    if not buckets:
        return spark.read.schema(schema).parquet(path)
    key = _CLUSTER[name]
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    tname = _catalog_name(path)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {tname} ({cols}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(tname)


def read_touches(spark: SparkSession, root: str, parts: dict[str, list[str]]) -> DataFrame:
    return spark.read.schema(TOUCH_SCHEMA).parquet(*[f"{root}/{p}" for p in parts[TOUCHES]])


def load_tables(spark: SparkSession, root: str, version: int | None = None) -> Tables:
    """Read a committed snapshot (the latest when ``version`` is None)."""
    v = latest_version(spark, root) if version is None else version
    if v is None:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    parts, buckets, marks = _marker_full(spark, root, v)
    out = {}
    for n in SCHEMAS:
        b = buckets.get(n)
        if b:
            frames = [_read_part(spark, n, f"{root}/{p}", b) for p in parts[n]]
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f)
        else:
            df = scan(spark, *[f"{root}/{p}" for p in parts[n]], name=n)
        out[n] = df
    if parts.get(TOUCHES):
        out["w_item"] = with_touches(out["w_item"], read_touches(spark, root, parts))
    return Tables(**out, loaded=dict(out), bucketed=bool(buckets) and all(buckets.get(n) for n in ("w_item", "w_outfit")), id_marks=marks)


# The key by which a snapshot's files are sorted (and bucketed, where asked for):
# within a file, rows of one key lie together, so its row groups can be skipped.
_CLUSTER = {
    "w_user": "u_id", "w_closet": "c_id", "w_item": "item_id", "w_tag": "item_id",
    "w_cat": "item_id", "w_color": "item_id", "w_img": "item_id", "w_outfit": "outfit_id",
    "w_oimg": "outfit_id", "w_season": "outfit_id", "w_occ": "outfit_id",
    "w_inc": "outfit_id", "w_rec": "outfit_id",
}


def _write(df: DataFrame, name: str, path: str, row_group_bytes: int | None, buckets: int | None = None) -> None:
    key = _CLUSTER[name]
    if buckets:
        # bucketBy needs a catalog table: an external one whose files stay after the drop.
        tname = _catalog_name(path)
        # One task per bucket (same hash as the bucketing), so each bucket is one file.
        w = df.repartition(int(buckets), key).write.mode("errorifexists").format("parquet")
        w = w.bucketBy(int(buckets), key).sortBy(key).option("path", path)
        if row_group_bytes:
            w = w.option("parquet.block.size", str(row_group_bytes))
        w.saveAsTable(tname)
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {tname}")
        return
    options = {"parquet.block.size": str(row_group_bytes)} if row_group_bytes else {}
    write_stored(df.sortWithinPartitions(key), path, compression="zstd", **options)


def write_tables(
    tables: Tables,
    root: str,
    version: int | None = None,
    batch_id: int | None = None,
    row_group_bytes: int | None = None,
    base_version: int | None = None,
    unchanged: tuple[str, ...] | list[str] = (),
    appends: dict[str, DataFrame] | None = None,
    buckets: int | None = None,
    beside: dict[str, DataFrame] | None = None,
    touches: DataFrame | None = None,
    merge_touches: bool = False,
) -> int:
    """Publish ``tables`` as snapshot ``version`` (default: latest + 1) and commit it.

    With ``base_version``, tables named in ``unchanged`` keep the base
    version's parts and tables in ``appends`` get one new part holding only
    the given rows; every other table is written in full.  The commit marker
    is written last and records the manifest and the stream ``batch_id``
    that produced the snapshot (NULL for batch jobs).  ``row_group_bytes``
    overrides the Parquet row-group size.  ``beside`` frames (rejects) are
    written under the version's folder too, before the marker.

    Nothing is ever overwritten: a version whose marker exists is refused, and
    so is a marker that another writer wrote meanwhile.  What a writer that
    died left of the same version stays unused, under its own attempt's name.
    ``buckets`` writes every new part bucketed on the table key (default: the
    base version's bucket count).  ``touches`` (item_id, last_worn): the only
    change of CLOTH_ITEM since ``base_version``; it becomes a part of the touch
    log (its only one with ``merge_touches``) and the items keep their parts.
    Returns the version.
    """
    spark = tables.spark
    if version is None:
        last = latest_version(spark, root)
        version = 0 if last is None else last + 1
    if path_exists(spark, f"{root}/commits/v={version}"):
        raise FileExistsError(f"version {version} is already committed under {root}")
    attempt = uuid.uuid4().hex[:12]
    base_parts, base_buckets, base_marks = _marker_full(spark, root, base_version) if base_version is not None else ({}, {}, {})
    marks = {k: max(int(v), int(tables.id_marks.get(k) or 0)) for k, v in base_marks.items()}
    for k, v in tables.id_marks.items():
        marks[k] = max(int(v or 0), marks.get(k, 0))
    if buckets is None and base_buckets:
        buckets = next(iter(base_buckets.values()))
    appends = appends or {}
    parts: dict[str, list[str]] = {}
    nbuckets: dict[str, int] = {}
    log = list(base_parts.get(TOUCHES, []))
    if touches is not None and "w_item" in base_parts:
        rel = f"v={version}/{attempt}/{TOUCHES}"
        write_stored(latest_touches(touches).sortWithinPartitions("item_id"), f"{root}/{rel}", compression="zstd")
        log = [rel] if merge_touches else [*log, rel]
        unchanged = [*unchanged, "w_item"]
    for name, df in tables.conform().as_dict().items():
        rel = f"v={version}/{attempt}/{name}"
        if name in unchanged and name in base_parts:
            parts[name] = base_parts[name]
            if name in base_buckets:
                nbuckets[name] = base_buckets[name]
            continue
        if name in appends and name in base_parts and base_buckets.get(name) == buckets:
            _write(conform(appends[name], SCHEMAS[name]), name, f"{root}/{rel}", row_group_bytes, buckets)
            parts[name] = base_parts[name] + [rel]
        else:
            _write(df, name, f"{root}/{rel}", row_group_bytes, buckets)
            parts[name] = [rel]
            if name == "w_item":
                log = []  # its rows hold the merged values now
        if name in ID_COLUMNS:
            # The highest id in what was just written (read back: one column, no recomputation).
            written = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{rel}").agg(F.max(ID_COLUMNS[name]).alias("m")).first()["m"]
            marks[name] = max(marks.get(name, 0), int(written or 0))
        if buckets:
            nbuckets[name] = int(buckets)
    if log:
        parts[TOUCHES] = log
    for name in ID_COLUMNS:
        if name not in marks:  # unchanged table carried from a base without marks
            m = load_part_max(spark, root, parts[name], ID_COLUMNS[name], name)
            marks[name] = m
    for name, df in (beside or {}).items():
        write_stored(df, f"{root}/v={version}/{attempt}/{name}", compression="zstd")
        parts[name] = [f"v={version}/{attempt}/{name}"]
    spark.createDataFrame(
        [(True, batch_id, parts, nbuckets, marks)],
        "committed boolean, batch_id bigint, tables map<string, array<string>>, buckets map<string, int>, "
        "id_marks map<string, bigint>",
    ).coalesce(1).write.mode("errorifexists").parquet(f"{root}/commits/v={version}")
    return version


def load_part_max(spark: SparkSession, root: str, parts: list[str], col: str, name: str | None = None) -> int:
    reader = spark.read.schema(SCHEMAS[name]) if name else spark.read
    row = reader.parquet(*[f"{root}/{p}" for p in parts]).agg(F.max(col).alias("m")).first()
    return int(row["m"] or 0)


def compact_tables(spark: SparkSession, root: str, max_parts: int = 32, row_group_bytes: int | None = None) -> int | None:
    """Publish a new version in which every table with more than ``max_parts``
    parts is rewritten as one part, and a touch log with more as one part with
    each item's latest day; returns the new version (None if nothing to do)."""
    v = latest_version(spark, root)
    if v is None:
        return None
    parts = manifest(spark, root, v)
    long = [n for n, p in parts.items() if len(p) > max_parts]
    if not long:
        return None
    t = load_tables(spark, root, v)
    merged = read_touches(spark, root, parts) if TOUCHES in long and "w_item" not in long else None
    return write_tables(
        t, root, base_version=v, unchanged=[n for n in parts if n not in long], row_group_bytes=row_group_bytes, touches=merged, merge_touches=True
    )


def last_batch_id(spark: SparkSession, root: str) -> int | None:
    """The highest stream batch id already published under ``root``."""
    commits = _commits(spark, root)
    b = None if commits is None else commits.agg(F.max("batch_id").alias("b")).first()["b"]
    return None if b is None else int(b)


def read_beside(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All frames that committed versions wrote beside their tables as ``name``."""
    rows = _commits(spark, root).select(F.explode(F.col("tables")[name]).alias("part")).collect()  # one per version
    return spark.read.parquet(*[f"{root}/{r['part']}" for r in rows])


# Why a change line is set aside.
NOT_PARSED = "The line could not be parsed."
SURPLUS = "Unknown field: "
WRONG_TYPE = "A field has the wrong type."


def parsed_changes(lines: DataFrame, schema: StructType, fmt: str = "json") -> DataFrame:
    """Text lines (``value``) as changes: the columns of ``schema``, the line as
    ``_raw`` and, for lines to set aside, ``_reason``.

    Set aside are lines that are no JSON object (or CSV record), objects with a
    field that the schema does not have (the first of them is named; CSV records
    with too many fields), and values that do not fit their column's type.
    Blank lines are no changes.  Column functions only, so a stream can use it.
    """
    marked = StructType(schema.fields + [StructField("_bad", StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = lines.where(F.trim("value") != "")
    if fmt == "csv":
        got = F.from_csv("value", marked.simpleString()[7:-1].replace(":", " "), options)
        fields = F.size(F.split("_raw", ","))  # of a record that did not fit; a quoted comma may count
        surplus, whole = F.lit(None).cast("string"), F.lit(True)
        reason = F.when(F.col("_got._bad").isNotNull(), F.when(fields > len(schema.fields), F.lit(SURPLUS + "more than the header")).otherwise(F.lit(WRONG_TYPE)))
    else:
        got = F.from_json("value", marked, options)
        keys = F.expr("json_object_keys(value)")
        whole = F.expr("try_parse_json(value)").isNotNull() & keys.isNotNull()
        surplus = F.get(F.array_except(keys, F.array(*[F.lit(f.name) for f in schema.fields])), 0)
        reason = (
            F.when(~F.col("_whole"), F.lit(NOT_PARSED)).when(F.col("_surplus").isNotNull(), F.concat(F.lit(SURPLUS), F.col("_surplus")))
            .when(F.col("_got._bad").isNotNull(), F.lit(WRONG_TYPE))
        )
    rows = lines.select(F.col("value").alias("_raw"), got.alias("_got"), whole.alias("_whole"), surplus.alias("_surplus"))
    return rows.select(*[F.col(f"_got.{f.name}").alias(f.name) for f in schema.fields], "_raw", reason.alias("_reason"))


def quarantined(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """The good changes of the files at ``path`` (columns of ``schema``) and the
    lines set aside (raw, reason).  A CSV file starts with a header line of the
    schema's columns, in its order."""
    lines = spark.read.text(path)
    if fmt == "csv":
        lines = lines.where(F.col("value") != ",".join(f.name for f in schema.fields))
    rows = parsed_changes(lines, schema, fmt)
    # Parsed once for both results; the lines themselves are kept where they are set aside.
    rows = materialize(rows.withColumn("_raw", F.when(F.col("_reason").isNotNull(), F.col("_raw"))))
    good = rows.where("_reason IS NULL").select(*[f.name for f in schema.fields])
    return good, rows.where("_reason IS NOT NULL").select(F.col("_raw").alias("raw"), F.col("_reason").alias("reason"))


def read_changes(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """S5 (re-aimed): a change set is JSON lines (or CSV with a header) with a typed schema.

    Malformed lines are kept in ``_corrupt_record`` so the job can reject them
    instead of failing.
    """
    s = StructType(schema.fields + [StructField("_corrupt_record", StringType(), True)])
    reader = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if fmt == "csv":
        return reader.option("header", "true").csv(path)
    return reader.json(path)


def rows_as_json(df: DataFrame) -> Column:
    """One JSON object per row; SQL NULL is kept as JSON null."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    """S7 sink: JSON lines, NULL fields written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
