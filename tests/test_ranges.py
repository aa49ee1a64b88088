"""Ranges of hot keys: the same rows as one window over each key."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import analytics as A
from tallyspark.operators import events as E
from tallyspark.operators import ranges


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(*cols).collect()), key=str) == sorted(map(tuple, b.select(*cols).collect()), key=str)


@pytest.mark.parametrize("size", [3, 40, 10_000])
def test_previous_best(spark, size):
    draw = random.Random(size)
    data = [(i, draw.choice(["hot"] * 8 + ["a", "b", None]), f"2024-01-01 00:{draw.randint(0, 59):02d}:00" if draw.random() < 0.95 else "junk", draw.choice([None, *range(40)]), draw.randint(0, 9)) for i in range(400)]
    df = A.with_order(spark.createDataFrame(data, "id int, e string, at string, score int, extra int"), "at", "id")
    same(ranges.previous_best(df, ["e"], ["score", "extra"], size), A.previous_best(df, ["e"], ["score", "extra"]))
    assert ranges.previous_best(df.limit(0), ["e"], ["score"], size).count() == 0


@pytest.mark.parametrize("timed", [True, False])
@pytest.mark.parametrize("size", [1, 5, 60])
def test_confirm_events(spark, timed, size):
    """Runs that span several ranges, end at their borders, and marks many ranges back."""
    for seed, steady in ((1, 0.97), (2, 0.7), (3, 1.0)):
        draw, at, data = random.Random(seed), 0, []
        for i in range(250):
            at += draw.choice([0, 100, 400])
            data.append((draw.choice(["hot"] * 9 + ["b"]), i, at, draw.random() < steady, draw.random() < 0.03 * (steady < 1), draw.choice("xyz")))
        df = spark.createDataFrame(data, "s string, i int, t long, c boolean, m boolean, d string")
        args = ("s", "t" if timed else None, "i", F.col("c"), F.col("m"), F.col("d"), 900, 3, 2500, 12)
        same(ranges.confirm_events(df, *args, rows=size), E.confirm_events(df, *args))


def test_no_task_above_its_range(spark):
    df = A.with_order(spark.range(5000).select(F.lit("hot").alias("e"), "id", F.timestamp_seconds("id").alias("at")), "at", "id")
    held = ranges.in_ranges(df, ["e"], list(A.ORDER), 500).groupBy("_range").count().collect()
    assert len(held) >= 9 and max(r["count"] for r in held) < 1500


def test_tasks_are_as_many_as_ranges(spark):
    """Rows are moved once to be dealt and once to their range, to a task for each range; none is moved for a join."""
    df = A.with_order(spark.range(5000).select(F.lit("hot").alias("e"), "id", F.timestamp_seconds("id").alias("at"), (F.col("id") % 7).alias("score")), "at", "id")
    out = ranges.previous_best(df, ["e"], ["score"], 250)
    assert out.rdd.getNumPartitions() == 20
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    same(out, A.previous_best(df, ["e"], ["score"]))
