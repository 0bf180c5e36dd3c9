"""Constraint audits (D1-D7): the DDL's keys, NOT NULL, CHECK and FOREIGN KEY
rules, the stated functional dependencies and the application's ownership and
season rules, checked over whole tables.

Parquet enforces none of them, so instead of rejecting a write these report
what is violated.  Each audit is one aggregate per table (or one anti join per
foreign key) and returns a small summary, with zero rows never hidden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearhouse.functions.columns import image_allowed
from wearhouse.plans.factorised import items_with_owner
from wearhouse.sources.schemas import CHECKS, FOREIGN_KEYS, FUNCTIONAL_DEPENDENCIES, NOT_NULL, PRIMARY_KEYS, SEASONS, UNIQUE_KEYS
from wearhouse.sources.tables import Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def primary_keys(t: Tables) -> DataFrame:
    """Per key (primary or unique): rows, distinct key values and key values
    held by more than one row.  ``dup_keys = 0`` means the key holds."""
    frames = []
    keys = [(n, k) for n, k in PRIMARY_KEYS.items()] + [(n, k) for n, ks in UNIQUE_KEYS.items() for k in ks]
    for name, key in keys:
        per_key = t.get(name).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        frames.append(
            per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
                F.count(F.lit(1)).alias("distinct_keys"),
                F.count(F.when(F.col("n") > 1, 1)).alias("dup_keys"),
            ).select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), "n_rows", "distinct_keys", "dup_keys")
        )
    return _union(frames)


def duplicate_keys(t: Tables, name: str) -> DataFrame:
    """D1 detail: the key values of ``name`` held by more than one row."""
    key = PRIMARY_KEYS[name]
    return t.get(name).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def not_null(t: Tables) -> DataFrame:
    """NULL count of every NOT NULL column, one pass per table."""
    frames = []
    for name, cols in NOT_NULL.items():
        counts = t.get(name).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("null_count")) for c in cols])
        frames.append(counts.select(F.lit(name).alias("table_name"), F.inline(pairs)))
    return _union(frames)


def checks(t: Tables) -> DataFrame:
    """D3: rows failing each CHECK constraint (a CHECK passes when it is NULL)."""
    frames = []
    for name, rules in CHECKS.items():
        for rule, predicate in rules:
            frames.append(
                t.get(name).agg(F.count_if(~F.coalesce(F.expr(predicate), F.lit(True))).cast("bigint").alias("violations"))
                .select(F.lit(name).alias("table_name"), F.lit(rule).alias("check_name"), "violations")
            )
    return _union(frames)


def foreign_keys(t: Tables) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    frames = []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        c = t.get(child).select(F.col(ccol).alias("k")).where(F.col("k").isNotNull())
        p = t.get(parent).select(F.col(pcol).alias("k"))
        frames.append(
            c.join(p, "k", "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows")).select(
                F.lit(child).alias("child_table"), F.lit(ccol).alias("child_column"),
                F.lit(parent).alias("parent_table"), "orphan_rows",
            )
        )
    return _union(frames)


def functional_dependencies(t: Tables) -> DataFrame:
    """For X -> Y, the number of X values seen with more than one distinct Y."""
    frames = []
    for name, lhs, rhs in FUNCTIONAL_DEPENDENCIES:
        # one partially aggregated shuffle: some X has two Y if its least and greatest Y differ
        y = F.struct(*rhs)
        per_x = t.get(name).groupBy(*lhs).agg((~F.min(y).eqNullSafe(F.max(y))).alias("differs"))
        frames.append(
            per_x.agg(F.count(F.when(F.col("differs"), 1)).alias("violations")).select(
                F.lit(name).alias("table_name"), F.lit(",".join(lhs)).alias("determinant"),
                F.lit(",".join(rhs)).alias("dependent"), "violations",
            )
        )
    return _union(frames)


def images(t: Tables) -> DataFrame:
    """stored images whose file name has no allowed extension ('' is no image)."""
    frames = [
        t.get(name).where((F.col("image_url") != "") & ~image_allowed("image_url")).select(F.lit(name).alias("table_name"), F.col(key).alias("id"), "image_url")
        for name, key in (("w_img", "item_id"), ("w_oimg", "outfit_id"))
    ]
    return _union(frames)


def ownership(t: Tables) -> DataFrame:
    """Outfit-item links whose item is not owned by the outfit's owner
    (``item_owner`` NULL when the item does not exist)."""
    owners = items_with_owner(t).select("item_id", F.col("u_id").alias("item_owner"))
    links = t.w_inc.join(t.w_outfit.select("outfit_id", F.col("u_id").alias("outfit_owner")), "outfit_id")
    return links.join(owners, "item_id", "left").where(
        F.col("item_owner").isNull() | (F.col("item_owner") != F.col("outfit_owner"))
    ).select("outfit_id", "item_id", "outfit_owner", "item_owner")


def unknown_seasons(t: Tables) -> DataFrame:
    """Stored outfit seasons outside the four canonical ones."""
    return t.w_season.where(~F.col("season").isin(*SEASONS)).select("outfit_id", "season")
