"""Positions by ranges equal those of one window, and no task holds a group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wearhouse.plans.ranking import dealt, ranked_by_ranges
from wearhouse.plans.topk import ranked


def frame(spark, n=3000):
    rng = random.Random(4)
    groups = [1] * 5 + [2, 3, None, 4, 5, 6, 7, 8, 9, 10]  # a third of all rows is of user 1
    rows = [(rng.choice(groups), rng.randrange(20), None if i % 50 == 0 else f"v{rng.randrange(300)}", i) for i in range(n)]
    return spark.createDataFrame(rows, "u_id long, n long, value string, id long").repartition(5)


def order():
    return [F.col("n").desc(), F.col("value").asc(), F.col("id").asc()]


@pytest.mark.parametrize("ranges", [None, 1, 13])
def test_equals_one_window(spark, ranges):
    df = frame(spark)
    got = ranked_by_ranges(df, ["u_id"], order(), "place", ranges)
    assert got.columns == [*df.columns, "place"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, ranked(df, ["u_id"], order(), "place").collect()), key=repr)


def test_a_large_group_is_spread(spark):
    rows = dealt(frame(spark), ["u_id"], order(), 12)
    cells = [r["count"] for r in rows.where("u_id = 1").groupBy("_range").count().collect()]
    assert len(cells) >= 4 and max(cells) <= 2 * 3000 / 12
    plan = ranked_by_ranges(frame(spark), ["u_id"], order(), "place", 12)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number" in x]
    assert windows and all("_range" in x for x in windows)


def test_empty_and_two_columns(spark):
    df = frame(spark, 400)
    assert ranked_by_ranges(df.limit(0), ["u_id"], order(), "place").count() == 0
    got = ranked_by_ranges(df, ["u_id", "n"], order()[1:], "place", 7)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, ranked(df, ["u_id", "n"], order()[1:], "place").collect()), key=repr)
