"""Exact quantiles of groups of any size: counts in ever smaller ranges instead of all values in one task.

Distinct values and their counts are written once.  Each round counts the values of the
open ranges in PARTS equal parts; a part that holds a wanted rank becomes the next range,
narrowed to the values in it, until one value is left.  A task holds the sums of parts, and
a group's state is its few ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.scratch import work_table

PARTS, ROUNDS = 4096, 400


def _same(a: DataFrame, b: DataFrame, names: list[str], prefix: str):
    """Null-safe equality of columns with those of ``b`` that carry a prefix."""
    found = F.lit(True)
    for c in names:
        found = found & a[c].eqNullSafe(b[prefix + c])
    return found


def quantiles(df: DataFrame, col: str, by: list[str], shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """``by``, and for each name of ``shares`` the value at that share, linear between neighbours.

    Nulls and NaN don't count; a group without values has no row; groups of a null key are
    one; infinite values are refused.
    """
    values = df.select(*by, F.col(col).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    values = work_table(values.withColumn("v", F.when(F.abs("v") == float("inf"), F.raise_error(F.lit("infinite value")).cast("double")).otherwise(F.col("v"))).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")), "quantile-values")
    total = values.groupBy(*by).agg((F.sum("n") - 1).alias("last"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("last") * F.lit(float(q))).alias("rank"), (F.col("last") * F.lit(float(q))).alias("at")) for name, q in shares.items()])
    targets = total.select(*by, "last", "lo", "hi", F.explode(wanted).alias("w")).select(*by, "last", "lo", "hi", "w.*")
    ranks = targets.select(*by, "lo", "hi", F.explode(F.array(F.col("rank"), F.least(F.col("rank") + 1, F.col("last")))).alias("rank"), F.lit(0).cast("long").alias("before")).distinct()
    open_, done = work_table(ranks, "quantile-ranges"), None
    for _ in range(ROUNDS):
        closed = open_.filter("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
        done = closed if done is None else done.unionByName(closed)
        open_ = open_.filter("lo < hi")
        if not open_.limit(1).count():
            break
        ranges = open_.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
        inside = values.join(ranges, _same(values, ranges, by, "_") & values["v"].between(ranges["_lo"], ranges["_hi"]))
        # Halves, so that no difference overflows.
        part = F.least(F.floor((F.col("v") / 2 - F.col("_lo") / 2) / F.greatest(F.col("_hi") / 2 - F.col("_lo") / 2, F.lit(5e-324)) * parts), F.lit(parts - 1))
        sums = inside.groupBy(*ranges.columns, part.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*ranges.columns).orderBy("part")))  # PARTS rows
        met = open_.join(upto, _same(open_, upto, [*by, "lo", "hi"], "_"))
        hit = met.filter((F.col("before") + F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("upto")))
        open_ = work_table(hit.select(*by, F.col("low").alias("lo"), F.col("high").alias("hi"), "rank", (F.col("before") + F.col("upto") - F.col("n")).alias("before")), "quantile-ranges")
    else:
        raise RuntimeError(f"quantiles did not settle in {ROUNDS} rounds")
    found = done.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("rank").alias("_rank"), "value")
    lower, upper = found, found.withColumnRenamed("value", "next").withColumn("_rank", F.col("_rank") - 1)
    out = targets.join(lower, _same(targets, lower, [*by, "rank"], "_")).drop(*found.columns[:-1])
    out = out.join(upper, _same(out, upper, [*by, "rank"], "_"), "left")
    share = F.col("at") - F.col("rank")
    out = out.withColumn("q", F.col("value") * (1 - share) + F.coalesce("next", "value") * share)
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares])
