"""Ordered events of hot keys: a key is cut into ranges, what a range needs of those before it is carried, and each range is a task of its own.

A window over a key is one task however large the key.  Here rows are first dealt by range
of (key, order), so that a key with many rows lies in many ranges.  A pass over the ranges
gives a few numbers for each (best so far, start of the run at its end, last marks), a
window over these numbers carries them on, and a window inside each range does the rest.
The forms without ranges (``analytics.previous_best``, ``events.confirm_events``) give the
same rows and move less where no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.analytics import ORDER
from tallyspark.operators.events import MIN_FRAMES, MIN_MS, WINDOW_FRAMES, WINDOW_MS
from tallyspark.sources.scratch import work_table

#: Rows of a range, about.
ROWS = 1_000_000


def in_ranges(df: DataFrame, part: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """``df``, written out in ranges of (part, order), with ``_range``: a key's ranges are numbered in its order.

    Rows that are equal in part and order stay in one range, so ``order`` should tell rows apart.
    """
    return _in_ranges(df, part, order, rows)[0]


def _in_ranges(df: DataFrame, part: list[str], order: list[str], rows: int) -> tuple[DataFrame, int]:
    """``in_ranges`` and the number of tasks for what is done inside the ranges: with as many as ranges a task holds a few ranges at most, whatever the input."""
    n = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*part, *order]])
    return work_table(dealt.withColumn("_range", F.spark_partition_id()), "ranges"), n


def _carried(ranges: DataFrame, part: list[str], carry: dict[str, Column]) -> DataFrame:
    """Columns over all ranges of a key before each; joined back by (part, _range)."""
    return ranges.select(*part, "_range", *[c.alias(name) for name, c in carry.items()])


def _join(rows: DataFrame, carried: DataFrame, part: list[str]) -> DataFrame:
    """A row of ``carried`` for each (part, _range); null keys are keys."""
    side = carried.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], F.col("_range").alias("_r"), *[c for c in carried.columns if c not in (*part, "_range")])
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(side, same, "left").drop("_r", *[f"_k{i}" for i in range(len(part))])


def previous_best(df: DataFrame, part: list[str], measures: list[str], rows: int = ROWS) -> DataFrame:
    """``analytics.previous_best`` for entities of any size: adds previous_<measure>, the best of strictly earlier events."""
    timed = F.col("instant_ms").isNotNull()
    ranged, n = _in_ranges(df, part, list(ORDER), rows)
    best = ranged.groupBy(*part, "_range").agg(*[F.max(F.when(timed, F.col(m))).alias(f"_b_{m}") for m in measures])
    earlier = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(best, part, {f"_b_{m}": F.max(f"_b_{m}").over(earlier) for m in measures})
    # What is carried is the first row of its range, so rows needn't be moved for a join and moved again.
    marked = ranged.withColumns({f"_b_{m}": F.when(timed, F.col(m)) for m in measures}).withColumn("_first", F.lit(False))
    both = marked.unionByName(carried.withColumn("_first", F.lit(True)), allowMissingColumns=True).repartition(n, *part, "_range")
    here = Window.partitionBy(*part, "_range").orderBy(F.desc("_first"), *ORDER).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumns({f"previous_{m}": F.when(timed, F.max(f"_b_{m}").over(here)) for m in measures}).filter("NOT _first")
    return out.drop("_range", "_first", *[f"_b_{m}" for m in measures])


def confirm_events(
    df: DataFrame, key: str, ts: str | None, order: str, candidate: Column, transition: Column, dup: Column, min_ms: int = MIN_MS, min_frames: int = MIN_FRAMES, window_ms: int = WINDOW_MS, window_frames: int = WINDOW_FRAMES, rows: int = ROWS,
) -> DataFrame:
    """``events.confirm_events`` for streams of any size: the same columns and rows.

    Carried from range to range: rows so far, start and length of the run of candidates
    that reaches the range's end, and the last confirmed place of each duplicate key.
    """
    by = [ts, order] if ts else [order]
    marked = df.withColumns({"_transition": F.coalesce(transition, F.lit(False)), "_dup": dup})
    marked = marked.withColumn("_run", F.coalesce(candidate, F.lit(False)) & ~F.col("_transition"))
    ranged, n = _in_ranges(marked, [key], by, rows)
    ranged = ranged.repartition(n, key, "_range")
    local = Window.partitionBy(key, "_range").orderBy(*by)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"_i": F.row_number().over(local), "_island": F.sum((~F.col("_run")).cast("long")).over(upto)})

    # The run at the end of a range: all of it where nothing breaks it, else what follows the last break.
    breaks = F.max("_island").over(Window.partitionBy(key, "_range"))
    at = F.col(ts) if ts else F.col("_i").cast("long")
    tail = placed.withColumn("_tail", F.col("_run") & (F.col("_island") == breaks))
    sums = tail.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.max("_island").alias("_breaks"), F.min(F.when(F.col("_tail"), at)).alias("_from"), F.count_if("_tail").alias("_length"))
    ordered = Window.partitionBy(key).orderBy("_range")
    sums = sums.withColumn("_segment", F.sum((F.col("_breaks") > 0).cast("long")).over(ordered))
    segment = Window.partitionBy(key, "_segment").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumns({"_start": F.first("_from", ignorenulls=True).over(segment), "_streak": F.sum("_length").over(segment)})
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(ends, [key], {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_open": F.lag("_start").over(ordered), "_held": F.coalesce(F.lag("_streak").over(ordered), F.lit(0))})
    out = _join(placed, carried, [key]).withColumn("frame_index", F.col("_before") + F.col("_i") - 1)

    first = F.col("_run") & (F.col("_island") == 0)  # still in the run that was open when the range began
    island = Window.partitionBy(key, "_range", "_island", "_run")
    if ts:
        start = F.least(F.min(ts).over(island), F.when(first, F.col("_open")))
        out = out.withColumn("candidate_duration_ms", F.when(F.col("_run"), F.greatest(F.lit(0), F.col(ts) - start)))
        out = out.withColumn("confirmed_result", F.coalesce(F.col("candidate_duration_ms") >= min_ms, F.lit(False)))
    else:
        streak = F.row_number().over(island.orderBy(*by)) + F.when(first, F.col("_held")).otherwise(0)
        out = out.withColumn("candidate_duration_ms", F.lit(None).cast("long")).withColumn("confirmed_result", F.col("_run") & (streak >= min_frames))

    place, limit = (ts, window_ms) if ts else ("frame_index", window_frames)
    sure = out.filter("confirmed_result").groupBy(key, "_dup", "_range").agg(F.max(place).alias("_last"))
    before = _carried(sure, [key, "_dup"], {"_mark": F.lag("_last").over(Window.partitionBy(key, "_dup").orderBy("_range"))})
    out = _join(out, before, [key, "_dup"])
    near = F.lag(place).over(Window.partitionBy(key, "_dup", "confirmed_result", "_range").orderBy(*by))
    gap = F.col(place) - F.coalesce(near, F.col("_mark"))
    out = out.withColumn("duplicate", F.col("confirmed_result") & F.coalesce(gap <= limit, F.lit(False)))
    kind = F.when(F.col("_transition"), "rejected_transition").when(F.col("duplicate"), "duplicate").when(F.col("confirmed_result"), "confirmed").otherwise("none")
    out = out.withColumns({"event_type": kind, "confirmation_mode": F.lit("time" if ts else "frames"), "duplicate_key": F.col("_dup")})
    return out.drop("_transition", "_dup", "_run", "_island", "_range", "_i", "_before", "_open", "_held", "_mark")
