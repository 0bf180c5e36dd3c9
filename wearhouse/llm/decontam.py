"""Benchmark decontamination by winnowing (operator 5), in SQL functions only.

A text's fingerprints are the hashes of its ``GRAM``-word grams that are the
smallest in some run of ``SPAN`` - ``GRAM`` + 1 neighbouring grams.  Two texts
that share ``SPAN`` words share such a run and so its smallest hash: every
shared span of that length is found.  Document and benchmark fingerprints are
joined; around the hits of a document every ``SPAN``-word window that holds a
hit is compared with the benchmark's windows as text, and the windows that
occur are united into the words that are hit.

Items with fewer than ``SPAN`` words are one window each.  They are found by
the hash of all their words, one gram length for each length that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import documents, materialize, table

SPAN = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _gram(w: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from position ``at`` (0-based)."""
    return F.xxhash64(F.lit(size), *(F.get(w, at + k) for k in range(size)))


def _grams(w: Column, size: int) -> Column:
    n = F.size(w)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: _gram(w, i, size))).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column, run: int) -> Column:
    """The distinct smallest hashes of all runs of ``run`` neighbours."""
    n = F.size(grams)
    least = F.transform(F.sequence(F.lit(0), n - run), lambda i: F.least(*(F.get(grams, i + k) for k in range(run))))
    return F.array_distinct(F.when(n >= run, least).otherwise(F.array().cast("array<bigint>")))


def _fingerprints(rows: DataFrame, short: list[int], span: int, gram: int) -> DataFrame:
    """``rows`` (with words w) plus fps: winnowed fingerprints, and all grams of
    the lengths in ``short``."""
    rows = rows.withColumn("g", _grams(F.col("w"), gram))
    fps = F.concat(_winnow(F.col("g"), span - gram + 1), *(_grams(F.col("w"), m) for m in short))
    return rows.withColumn("fps", fps).drop("g")


def _item_words(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", words(F.col("text")).alias("w"))
    return materialize(items.where(F.size("w") > 0))


def _windows(items: DataFrame, span: int) -> DataFrame:
    """(window, item_id): the windows of every item as text."""
    n = F.size("w")
    long = F.transform(F.sequence(F.lit(1), F.greatest(n - span + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, span), " "))
    return items.select("item_id", F.explode(long).alias("window")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated)
    for every document of ``docs``.

    A NULL text has no words.  A document without hits has the SHA-256 of the
    empty text.  Rows equal in doc_id and text are one document; rows that
    share only the doc_id are told apart by their text hash.  Items without
    words are left out; those without an id count for n_hit and contaminated, but
    not for n_items and items_sha256; repeated items count once.  An empty
    benchmark finds nothing.  Other columns are not read.
    """
    items = _item_words(benchmark)
    short = sorted(r[0] for r in items.where(F.size("w") < span).select(F.size("w")).distinct().collect())  # below span numbers
    windows = materialize(_windows(items, span))
    # an item shorter than a window has its whole gram as its only fingerprint
    long_fps = _fingerprints(items.where(F.size("w") >= span), [], span, gram).select(F.explode("fps").alias("fp"))
    fps = long_fps
    for m in short:
        fps = fps.unionByName(items.where(F.size("w") == m).select(_gram(F.col("w"), F.lit(0), m).alias("fp")))
    fps = materialize(fps.distinct().withColumn("hit", F.lit(True)))

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    split = rows.select("doc_id", "th", words(F.col("text")).alias("w"))
    marked = _fingerprints(split, short, span, gram).select("doc_id", "th", F.size("w").cast("long").alias("n_words"), "fps")
    # position 0 stands for the document itself, so that one without hits stays
    spread = marked.select("doc_id", "th", "n_words", F.posexplode(F.concat(F.array("th"), "fps")).alias("pos", "fp"))
    found = materialize(spread.join(fps, "fp", "left").where("pos = 0 OR hit").select("doc_id", "th", "n_words", "pos", "fp"))

    every = found.where("pos = 0").select("doc_id", "th", "n_words").distinct()
    seeds = found.where("pos > 0").groupBy("doc_id", "th").agg(F.collect_set("fp").alias("seeds"))
    hits = _hits(rows, seeds, windows, short, span, gram)

    # united length of the windows of a document
    step = lambda acc, x: F.struct(
        (acc["total"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(x["at"], acc["until"]))).alias("total"),
        F.greatest(acc["until"], x["at"] + x["size"]).alias("until"),
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("until"))
    places = F.sort_array(F.collect_set(F.struct("at", "size")))
    n_hit = hits.groupBy("doc_id", "th").agg(F.aggregate(places, start, step)["total"].cast("long").alias("n_hit"))
    pairs = hits.select("doc_id", "th", "window").distinct().join(windows, "window").select("doc_id", "th", F.col("item_id").cast("string").alias("item"))
    pairs = pairs.where("item IS NOT NULL").distinct()
    by_doc = pairs.groupBy("doc_id", "th").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))

    e, h, i = every.alias("e"), n_hit.alias("h"), by_doc.alias("i")
    same = "{0}.doc_id <=> e.doc_id AND {0}.th = e.th"
    joined = e.join(h, F.expr(same.format("h")), "left").join(i, F.expr(same.format("i")), "left")
    return joined.select(
        "e.doc_id",
        F.col("e.th").alias("text_hash"),
        "e.n_words",
        F.coalesce("h.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("i.n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("i.items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("h.n_hit").isNotNull().alias("contaminated"),
    )


def _is_seed(size: int):
    """Does the gram of ``size`` words from a position count among the seeds?"""
    return lambda at: F.array_contains("seeds", _gram(F.col("w"), at, size))


def _hits(rows: DataFrame, seeds: DataFrame, windows: DataFrame, short: list[int], span: int, gram: int) -> DataFrame:
    """(doc_id, th, at, size, window): windows of the benchmark that occur in
    documents with seeds.  A window is looked at if one of its grams is a seed."""
    r, s = rows.alias("r"), seeds.alias("s")
    cand = r.join(s, F.expr("r.doc_id <=> s.doc_id AND r.th = s.th")).select("r.doc_id", "r.th", words(F.col("r.text")).alias("w"), "s.seeds")
    cand = cand.withColumn("g", _grams(F.col("w"), gram))
    n = F.size("w")
    # gram positions that are seeds, and the window starts from which they can be reached
    lit = F.filter(F.sequence(F.lit(0), F.greatest(F.size("g") - 1, F.lit(0))), lambda p: F.array_contains("seeds", F.get("g", p)))
    cand = cand.withColumn("lit", F.when(n >= span, lit).otherwise(F.array().cast("array<int>")))
    reach = F.transform("lit", lambda p: F.sequence(F.greatest(p - (span - gram), F.lit(0)), F.least(p, n - span)))
    tries = [cand.select("doc_id", "th", "w", F.explode(F.array_distinct(F.flatten(reach))).alias("at"), F.lit(span).alias("size"))]
    for m in short:
        places = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), _is_seed(m))
        tries.append(cand.where(n >= m).select("doc_id", "th", "w", F.explode(places).alias("at"), F.lit(m).alias("size")))
    out = tries[0]
    for t in tries[1:]:
        out = out.unionByName(t)
    out = out.select("doc_id", "th", "at", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("window"))
    return materialize(out.join(windows.select("window").distinct(), "window").select("doc_id", "th", "at", "size", "window"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without any benchmark window."""
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) p, (SELECT DISTINCT size FROM win) s
  WHERE i + s.size - 1 <= len(w)
), hits AS (
  SELECT DISTINCT doc_id, i, size, item_id FROM places JOIN win USING (size, words)
), hit_words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
