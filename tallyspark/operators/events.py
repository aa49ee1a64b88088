"""Ordered observations -> confirmed, rejected and repeated events (batch forms).

A stream is a key column; order is time, then a tie-breaking column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.vectors import l1

MIN_MS, MIN_FRAMES = 1000, 2
WINDOW_MS, WINDOW_FRAMES = 90_000, 90


def dup_key(name: Column) -> Column:
    """score:<digits> where the file stem has a score token, else file:<name>."""
    file = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    token = F.regexp_extract(stem, r"(?i)score(\d+)", 1)
    return F.when(token != "", F.concat(F.lit("score:"), token)).otherwise(F.concat(F.lit("file:"), file))


def check_sequence(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Rows with ts_error: empty, not_integer, negative, not_increasing, or null where the row is in order.

    A time is compared with the last good form of the row before it, whatever that row's error.
    """
    text = F.trim(F.coalesce(F.col(ts).cast("string"), F.lit("")))
    value = F.when(text.rlike(r"^-?\d+$"), text.try_cast("long"))
    out = df.withColumn("_ts", value)
    before = F.lag("_ts").over(Window.partitionBy(key).orderBy(order))
    error = F.when(text == "", "empty").when(F.col("_ts").isNull(), "not_integer").when(F.col("_ts") < 0, "negative").when(F.col("_ts") <= before, "not_increasing")
    return out.withColumn("ts_error", error).drop("_ts")


def assign_timestamps(df: DataFrame, key: str, order: str, fps: float) -> DataFrame:
    """round(i * 1000 / fps) for row i of a stream, and at least one more than the row before.

    Closed form of "at least one more": i + the running maximum of (time - i).
    """
    w = Window.partitionBy(key).orderBy(order)
    i = F.row_number().over(w) - 1
    out = df.withColumn("_i", i.cast("long")).withColumn("_t", F.bround(F.col("_i") * F.lit(1000.0) / F.lit(float(fps))).cast("long") - F.col("_i"))
    return out.withColumn("timestamp_ms", F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_i")).drop("_i", "_t")


def assign_interval(df: DataFrame, key: str, order: str, start: int, step: int) -> DataFrame:
    return df.withColumn("timestamp_ms", F.lit(start) + (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) * step)


def confirm_events(df: DataFrame, key: str, ts: str | None, order: str, candidate: Column, transition: Column, dup: Column, min_ms: int = MIN_MS, min_frames: int = MIN_FRAMES, window_ms: int = WINDOW_MS, window_frames: int = WINDOW_FRAMES) -> DataFrame:
    """Adds frame_index, event_type (none, confirmed, duplicate, rejected_transition), duplicate, candidate_duration_ms, confirmation_mode.

    An unbroken run of candidates is confirmed once it lasts ``min_ms`` (or has
    ``min_frames`` rows without times); every later row of the run is confirmed too.  A
    transition or a non-candidate ends the run.  A confirmed row within the window of the
    last confirmed row of its duplicate key is a duplicate, and moves the mark.
    """
    w = Window.partitionBy(key).orderBy(*([ts] if ts else []), order)
    out = df.withColumns({"frame_index": F.row_number().over(w) - 1, "_transition": F.coalesce(transition, F.lit(False)), "_dup": dup})
    out = out.withColumn("_run", F.coalesce(candidate, F.lit(False)) & ~F.col("_transition"))
    out = out.withColumn("_island", F.sum((~F.col("_run")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    island = Window.partitionBy(key, "_island", "_run")
    streak = F.row_number().over(island.orderBy(*([ts] if ts else []), order))
    if ts:
        duration = F.when(F.col("_run"), F.greatest(F.lit(0), F.col(ts) - F.min(ts).over(island)))
        out = out.withColumn("candidate_duration_ms", duration).withColumn("confirmed_result", F.coalesce(F.col("candidate_duration_ms") >= min_ms, F.lit(False)))
    else:
        out = out.withColumn("candidate_duration_ms", F.lit(None).cast("long")).withColumn("confirmed_result", F.col("_run") & (streak >= min_frames))
    mark = Window.partitionBy(key, "_dup", "confirmed_result").orderBy(*([ts] if ts else []), order)
    place, limit = (ts, window_ms) if ts else ("frame_index", window_frames)
    gap = F.col(place) - F.lag(place).over(mark)
    out = out.withColumn("duplicate", F.col("confirmed_result") & F.coalesce(gap <= limit, F.lit(False)))
    kind = F.when(F.col("_transition"), "rejected_transition").when(F.col("duplicate"), "duplicate").when(F.col("confirmed_result"), "confirmed").otherwise("none")
    return out.withColumns({"event_type": kind, "confirmation_mode": F.lit("time" if ts else "frames"), "duplicate_key": F.col("_dup")}).drop("_transition", "_dup", "_run", "_island")


def save_candidates(events: DataFrame) -> DataFrame:
    return events.filter("confirmed_result AND NOT duplicate")


def event_summary(events: DataFrame, key: list[str], ts: str | None) -> DataFrame:
    """Counts by type, first confirmed row, and rows by mode."""
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    first = [F.min(F.when(F.col("event_type") == "confirmed", F.col("frame_index"))).alias("first_confirmed_index")]
    if ts:
        first.append(F.min(F.when(F.col("event_type") == "confirmed", F.col(ts))).alias("first_confirmed_ms"))
    modes = [F.count_if(F.col("confirmation_mode") == m).alias(f"{m}_rows") for m in ("time", "frames")]
    return (events.groupBy(*key) if key else events).agg(F.count(F.lit(1)).alias("frames"), is_("confirmed").alias("confirmed"), is_("duplicate").alias("duplicates"), is_("rejected_transition").alias("rejected"), *first, *modes)


def sample_min_gap(df: DataFrame, key: str, ts: str, order: str, gap_ms: int = 1000) -> DataFrame:
    """Adds ``accepted``: at least ``gap_ms`` since the last *accepted* row of the stream.

    That depends on earlier decisions, which no window can say, so rows of a stream are
    walked in order, batch by batch: state is one number, and no stream is held whole.
    """
    schema = df.schema.add("accepted", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, last = None, None
        for batch in batches:
            taken = []
            for k, t in zip(batch[key], batch[ts]):
                if k != stream:
                    stream, last = k, None
                ok = last is None or t - last >= gap_ms
                last = t if ok else last
                taken.append(ok)
            yield batch.assign(accepted=taken)

    return df.repartition(key).sortWithinPartitions(key, ts, order).mapInPandas(run, schema)


def order_guard(df: DataFrame, key: str, ts: str, arrival: str) -> DataFrame:
    """Adds ``late``: the row's time is before the latest time that had arrived in its stream."""
    before = F.max(ts).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("late", F.coalesce(F.col(ts) < before, F.lit(False)))


def classify(df: DataFrame, signals: list[str], needed: list[str], shaping: list[str], transition: Column, expected: Column) -> DataFrame:
    """Adds result_candidate, result_shape_candidate, transition_kind, expected_result_candidate, correct and reason.

    ``signals`` are boolean columns.  A row is a result where all ``needed`` ones hold and it
    is in no transition; it has the shape of one where those and one of ``shaping`` hold, or
    where it is a result.  The reason lists what holds.  Null signals and a null transition don't hold.
    """
    on = {s: F.coalesce(F.col(s), F.lit(False)) for s in signals}
    kind = F.coalesce(transition, F.lit(""))
    every = F.forall(F.array(*[on[s] for s in needed]), lambda x: x)
    some = F.exists(F.array(*[on[s] for s in shaping]), lambda x: x)
    result = every & (kind == "")
    held = [F.when(on[s], s) for s in signals] + [F.when(kind != "", F.concat(F.lit("transition_"), kind)), F.when(result, "finished_result_frame")]
    wanted = F.coalesce(expected, F.lit(False))
    return df.withColumns({
        "result_candidate": result, "result_shape_candidate": every & (some | result), "transition_kind": kind, "expected_result_candidate": wanted,
        "correct": result == wanted, "reason": F.coalesce(F.nullif(F.concat_ws(",", *held), F.lit("")), F.lit("no_signals")),
    })


def stable_values(df: DataFrame, key: str, ts: str, order: str, vector: str, vector_hash: str, change: float = 0.08, frames: int = 3, ms: int = 100) -> DataFrame:
    """Adds state (invalid, change, settling, stable, repeat) and difference: vectors that stay put, in order of arrival.

    A row behind the latest time so far is invalid.  A mean absolute difference above
    ``change`` from the row before, or an invalid row before, starts anew; ``frames`` rows
    and ``ms`` after that the vector is stable, or a repeat if its hash was stable before
    in the stream.  The batch form of ``streaming.stateful.Stability``.
    """
    w = Window.partitionBy(key).orderBy(order)
    latest = F.max(ts).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_bad", F.coalesce(F.col(ts) < latest, F.lit(False)))
    out = out.withColumns({"_before": F.when(~F.lag("_bad").over(w), F.lag(vector).over(w))})
    gap = F.coalesce(l1(F.col("_before"), F.col(vector)), F.lit(1.0))
    out = out.withColumn("difference", F.when(~F.col("_bad"), gap))
    anew = F.col("_bad") | F.col("_before").isNull() | (F.col("difference") > change)
    out = out.withColumn("_run", F.sum(anew.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_anew", anew)
    run = Window.partitionBy(key, "_run").orderBy(order)
    settled = ~F.col("_anew") & (F.row_number().over(run) >= frames) & (F.col(ts) - F.first(ts).over(run) >= ms)
    out = out.withColumn("_settled", settled)
    again = F.row_number().over(Window.partitionBy(key, vector_hash, "_settled").orderBy(order)) > 1
    state = F.when(F.col("_bad"), "invalid").when(F.col("_anew"), "change").when(~F.col("_settled"), "settling").when(again, "repeat").otherwise("stable")
    return out.withColumn("state", state).drop("_bad", "_before", "_run", "_anew", "_settled")
