"""Adapter: derive the thirteen wardrobe tables from the TPC-H-style test tables.

One rule per table (FIXTURES.md section 2).  The same rules are written as SQL
CTEs in :mod:`wearhouse.oracle_sql` so the DuckDB oracle sees identical rows.
Every rule is a scan + projection or one aggregate keyed by the table's own
key, so the derivation scales with the input and shuffles at most once per
table (``w_item``: one aggregate of lineitem by part; ``w_rec``: one by
(order, shipdate); ``w_tag``/``w_inc``: one distinct each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.sources.tables import Tables, path_bytes

#: Bytes of a Parquet file that make one partition of a large table.
PARTITION_BYTES = 4 << 20


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ymd(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def ymd_hms(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _dealt(df: DataFrame, size: int, key: str) -> DataFrame:
    """``df`` (files of ``size`` bytes) dealt by ``key``.  Left to itself, Spark makes
    about one partition per core, however large these get; beyond
    ``PARTITION_BYTES`` for each core their number follows the size instead."""
    parts = -(-size // PARTITION_BYTES)
    return df.repartition(parts, key) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(key)


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    region = _read(spark, sf_dir, "region")
    nation = _read(spark, sf_dir, "nation")
    customer = _read(spark, sf_dir, "customer")
    part = _read(spark, sf_dir, "part")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")

    # The extra user with no closet.
    nobody = spark.createDataFrame([(99, "NOBODY", "", "admin")], "u_id bigint, username string, gender string, role string")
    w_user = region.select(
        F.col("r_regionkey").cast("bigint").alias("u_id"),
        F.col("r_name").alias("username"),
        F.lit(None).cast("string").alias("gender"),
        F.when(F.col("r_regionkey") == 0, "manager").otherwise("user").alias("role"),
    ).unionByName(nobody)

    w_closet = nation.select(
        F.col("n_nationkey").cast("bigint").alias("c_id"),
        F.col("n_name").alias("c_name"),
        F.col("n_regionkey").cast("bigint").alias("u_id"),
    )

    first_ship = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").alias("first_ship"))
    pk = F.col("p_partkey")
    w_item = part.join(first_ship, "p_partkey", "left").select(
        pk.alias("item_id"),
        (F.regexp_extract("p_brand", r"Brand#(\d+)", 1).cast("bigint") - 1).alias("c_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_size").cast("string").alias("size"),
        F.when(pk % 10 == 0, F.lit(None).cast("string"))
        .when(pk % 10 == 1, F.lit(""))
        .otherwise(ymd(F.col("first_ship")))
        .alias("last_worn"),
    )

    w_tag = part.select(pk.alias("item_id"), F.explode(F.split("p_name", " ")).alias("tag")).distinct()

    w_cat = part.where(F.col("p_type") != "PROMO").select(pk.alias("item_id"), F.col("p_type").alias("category")).unionByName(
        part.where(F.col("p_size") >= 45).select(pk.alias("item_id"), F.lit("OVERSIZE").alias("category"))
    )

    name = F.col("p_name")
    # Name prefix -> color.
    color = (
        F.when(name.startswith("red"), "Red").when(name.startswith("blue"), "Blue").when(name.startswith("green"), "Green")
    )
    w_color = part.select(pk.alias("item_id"), color.alias("color")).where(F.col("color").isNotNull())

    w_img = part.where(pk % 3 == 0).select(pk.alias("item_id"), F.concat(F.lit("/img/p"), pk.cast("string"), F.lit(".png")).alias("image_url"))

    ok = F.col("o_orderkey")
    cust_region = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.col("c_custkey"), F.col("n_regionkey").cast("bigint").alias("u_id")
    )
    w_outfit = orders.join(cust_region, orders["o_custkey"] == cust_region["c_custkey"]).select(
        ok.alias("outfit_id"),
        F.col("u_id"),
        F.concat(F.lit("Outfit "), ok.cast("string")).alias("outfit_name"),
        F.col("o_orderpriority").alias("note"),
        ymd(F.col("o_orderdate")).alias("created_date"),
    )

    w_oimg = orders.where(ok % 4 <= 1).select(
        ok.alias("outfit_id"),
        F.when(ok % 4 == 0, F.concat(F.lit("/img/o"), ok.cast("string"), F.lit(".png"))).otherwise(F.lit("")).alias("image_url"),
    )

    month = F.month("o_orderdate")
    season = (
        F.when(month.between(3, 5), "Spring").when(month.between(6, 8), "Summer").when(month.between(9, 11), "Autumn").otherwise("Winter")
    )
    w_season = (
        orders.select(ok.alias("outfit_id"), season.alias("season"))
        .unionByName(orders.where(ok % 5 == 0).select(ok.alias("outfit_id"), F.lit("Summer").alias("season")))
        .unionByName(orders.where(ok % 101 == 0).select(ok.alias("outfit_id"), F.lit("Monsoon").alias("season")))
        .distinct()
    )

    w_occ = (
        orders.select(ok.alias("outfit_id"), F.col("o_orderstatus").alias("occasion"))
        .unionByName(orders.where(ok % 3 == 0).select(ok.alias("outfit_id"), F.col("o_orderpriority").alias("occasion")))
        .distinct()
    )

    # Dealt by the order once: the pairs are nearly distinct, so tasks that read
    # lineitem would aggregate in vain, and joins on outfit_id need no other shuffle.
    lines = _dealt(lineitem, path_bytes(spark, f"{sf_dir}/lineitem.parquet"), "l_orderkey")
    w_inc = lines.select(F.col("l_orderkey").alias("outfit_id"), F.col("l_partkey").alias("item_id")).distinct()

    # One record per (order, shipdate): the line with the lowest (linenumber, partkey).
    # min(struct) is a plain hash aggregate, no sort-based window.
    first_line = lines.groupBy("l_orderkey", "l_shipdate").agg(
        F.min(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")).alias("m")
    )
    w_rec = first_line.select(
        F.col("l_orderkey").alias("outfit_id"),
        ymd_hms(F.col("l_shipdate")).alias("datetime"),
        F.when(F.col("m.l_linenumber") <= 5, F.col("m.l_linenumber")).cast("int").alias("rating"),
        F.col("m.l_returnflag").alias("weather"),
        F.lit(None).cast("string").alias("note"),
        F.col("m.l_linestatus").alias("mood"),
    )

    return Tables(
        w_user=w_user, w_closet=w_closet, w_item=w_item, w_tag=w_tag, w_cat=w_cat, w_color=w_color,
        w_img=w_img, w_outfit=w_outfit, w_oimg=w_oimg, w_season=w_season, w_occ=w_occ, w_inc=w_inc,
        w_rec=w_rec,
    ).conform()
