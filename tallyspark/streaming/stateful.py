"""Stateful streams: the event operators on readStream inputs, with state per key.

Each processor sorts the rows of a trigger by time; a row behind the last time seen is
late and comes out flagged.  State is a few fields per key (the stability detector also
keeps the hashes it has seen).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators.events import MIN_MS, WINDOW_MS
from tallyspark.operators.guarded import insert_once, validate
from tallyspark.sources.scratch import work_table
from tallyspark.sources.versions import FAN, VersionedTable


class _Ordered(StatefulProcessor):
    """Rows of a key in time order; ``step`` sees one at a time."""

    state_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", self.state_schema)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def start(self) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch.sort_values(["timestamp_ms", "order_id"], kind="stable")
        state = tuple(self.value.get()) if self.value.exists() else self.start()
        out = []
        for row in batch.itertuples(index=False):
            state, found = self.step(state, row)
            out += found
        self.value.update(state)
        self.forget(state)
        yield self.frame(key, out)

    def forget(self, state: tuple) -> None:
        """Drop what can't matter any more; called once a trigger and key."""

    def close(self) -> None:
        pass


def _drop_before(marks, least: int) -> None:
    """Remove entries of a map state whose time lies before ``least``."""
    for key in [key for key, (at,) in marks.iterator() if at < least]:
        marks.removeKey(key)


EVENTS = "stream string, order_id long, timestamp_ms long, event_type string, candidate_duration_ms long, late boolean"


class Confirm(_Ordered):
    """Confirm, reject and mark duplicates; columns stream, order_id, timestamp_ms, candidate, transition, dup_key."""

    state_schema = "last long, started long"

    def __init__(self, min_ms: int = MIN_MS, window_ms: int = WINDOW_MS):
        self.min_ms, self.window_ms = min_ms, window_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getMapState("marks", "dup string", "at long")

    def start(self) -> tuple:
        return (None, None)

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        last, started = state
        if last is not None and row.timestamp_ms < last:
            return state, [(row.order_id, row.timestamp_ms, "none", None, True)]
        kind, duration = "none", None
        if row.transition:
            started, kind = None, "rejected_transition"
        elif row.candidate:
            started = row.timestamp_ms if started is None else started
            duration = row.timestamp_ms - started
            if duration >= self.min_ms:
                mark = (row.dup_key,)
                at = self.marks.getValue(mark)[0] if self.marks.containsKey(mark) else None
                kind = "duplicate" if at is not None and row.timestamp_ms - at <= self.window_ms else "confirmed"
                self.marks.updateValue(mark, (row.timestamp_ms,))
        else:
            started = None
        return (row.timestamp_ms, started), [(row.order_id, row.timestamp_ms, kind, duration, False)]

    def forget(self, state: tuple) -> None:
        if state[0] is not None:  # no row that counts is before the last one
            _drop_before(self.marks, state[0] - self.window_ms)

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(out, columns=["order_id", "timestamp_ms", "event_type", "candidate_duration_ms", "late"])
        table.insert(0, "stream", key[0])
        return table.astype({"candidate_duration_ms": "Int64"})


SAMPLED = "stream string, order_id long, timestamp_ms long, accepted boolean"


class Sample(_Ordered):
    """Accept a row if ``gap_ms`` have passed since the last accepted one."""

    state_schema = "last long"

    def __init__(self, gap_ms: int = 1000):
        self.gap_ms = gap_ms

    def start(self) -> tuple:
        return (None,)

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        ok = state[0] is None or row.timestamp_ms - state[0] >= self.gap_ms
        return ((row.timestamp_ms,) if ok else state), [(row.order_id, row.timestamp_ms, ok)]

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(out, columns=["order_id", "timestamp_ms", "accepted"])
        table.insert(0, "stream", key[0])
        return table


LIVE = "stream string, order_id long, timestamp_ms long, result_key string, attempt int, outcome string"
MAX_ATTEMPTS = 8


class LiveResults(_Ordered):
    """Group observations into results; columns is_result, score, result_key and disposition (done or retry).

    Two equal scores in a row confirm a result, which is then active: the same key is
    dropped.  Two non-results in a row end it.  A result whose disposition is retry comes
    again with the next observation of its key, up to eight attempts; the last one, or
    one that has gone from view, is final and unresolved.
    """

    state_schema = "active string, pending string, attempt int, score long, streak int, missing int"

    def start(self) -> tuple:
        return (None, None, 0, None, 0, 0)

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        active, pending, attempt, score, streak, missing = state
        out: list[tuple] = []

        def offer(key: str, n: int) -> None:
            nonlocal active, pending, attempt
            final = n >= MAX_ATTEMPTS
            if row.disposition == "retry" and not final:
                pending, attempt = key, n
                out.append((row.order_id, row.timestamp_ms, key, n, "retry"))
            else:
                active, pending, attempt = key, None, 0
                out.append((row.order_id, row.timestamp_ms, key, n, "unresolved" if row.disposition == "retry" else "resolved"))

        if not row.is_result:
            score, streak, missing = None, 0, missing + 1
            if missing >= 2:
                active = None
                if pending is not None:
                    out.append((row.order_id, row.timestamp_ms, pending, attempt + 1, "unresolved"))
                    pending, attempt = None, 0
        else:
            missing = 0
            if row.result_key == active:
                score, streak = None, 0
                out.append((row.order_id, row.timestamp_ms, row.result_key, 0, "same_result"))
            elif row.result_key == pending:
                offer(row.result_key, attempt + 1)
            else:
                streak = streak + 1 if row.score == score else 1
                score = row.score
                if streak >= 2:
                    score, streak = None, 0
                    offer(row.result_key, 1)
        return (active, pending, attempt, score, streak, missing), out

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(out, columns=["order_id", "timestamp_ms", "result_key", "attempt", "outcome"])
        table.insert(0, "stream", key[0])
        return table


STABLE = "stream string, order_id long, timestamp_ms long, state string, difference double"


class Stability(_Ordered):
    """Vectors that stay put; columns vector (array of 0..1) and vector_hash.

    A mean absolute change above ``change`` starts anew; after ``frames`` rows and ``ms``
    the vector is stable, or a repeat if its hash was stable before.  Time that moves
    backwards is invalid and starts anew.  With ``forget_ms`` a hash is forgotten so long
    after it was last stable; without it repeats are known for ever, which grows by hash.
    """

    state_schema = "last long, started long, count int, vector array<double>"

    def __init__(self, change: float = 0.08, frames: int = 3, ms: int = 100, forget_ms: int | None = None):
        self.change, self.frames, self.ms, self.forget_ms = change, frames, ms, forget_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash string", "at long")

    def start(self) -> tuple:
        return (None, None, 0, None)

    def step(self, state: tuple, row) -> tuple[tuple, list[tuple]]:
        last, started, count, before = state
        if last is not None and row.timestamp_ms < last:
            return (last, None, 0, None), [(row.order_id, row.timestamp_ms, "invalid", None)]
        now = [float(v) for v in row.vector]
        gap = sum(abs(a - b) for a, b in zip(before, now)) / max(1, len(now)) if before is not None and len(before) == len(now) else 1.0
        if before is None or gap > self.change:
            return (row.timestamp_ms, row.timestamp_ms, 1, now), [(row.order_id, row.timestamp_ms, "change", gap)]
        count += 1
        kind = "settling"
        if count >= self.frames and row.timestamp_ms - started >= self.ms:
            mark = (row.vector_hash,)
            kind = "repeat" if self.seen.containsKey(mark) else "stable"
            self.seen.updateValue(mark, (row.timestamp_ms,))
        return (row.timestamp_ms, started, count, now), [(row.order_id, row.timestamp_ms, kind, gap)]

    def forget(self, state: tuple) -> None:
        if state[0] is not None and self.forget_ms is not None:
            _drop_before(self.seen, state[0] - self.forget_ms)

    def frame(self, key, out: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(out, columns=["order_id", "timestamp_ms", "state", "difference"])
        table.insert(0, "stream", key[0])
        return table


SCHEMAS = {Confirm: EVENTS, Sample: SAMPLED, LiveResults: LIVE, Stability: STABLE}


def stateful(stream: DataFrame, processor: StatefulProcessor, watermark: str | None = None) -> DataFrame:
    """Run a processor over a stream with columns stream, order_id, timestamp_ms and what it needs.

    With a watermark, rows later than it are dropped by Spark; earlier ones are flagged or
    handled as the processor says.  Needs the RocksDB state store provider.
    """
    if watermark:
        stream = stream.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", watermark)
    return stream.groupBy("stream").transformWithStateInPandas(processor, outputStructType=SCHEMAS[type(processor)], outputMode="append", timeMode="None")


def stream_to_table(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Each trigger's rows go to ``handle`` (resolve, validate, write once); it may see a batch again after a failure."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_batch(events: DataFrame, table: VersionedTable, enrich: Callable[[DataFrame], DataFrame], errors: Column, key: str, order: list[Column], fan: int = FAN) -> DataFrame:
    """Confirmed events -> enriched -> validated -> saved once as the table's next version; one outcome row per event.

    ``enrich`` adds an event's identity and record columns.  Outcomes are rejected (with the
    codes of ``errors``), duplicate (its key was saved before or comes earlier in the batch)
    and inserted.  Events of a batch that is seen again are duplicates, so it may be repeated.
    Only new rows are written.  Where the table is dealt by ``key``, only the buckets of the
    batch are read; folders of many small batches are joined ``fan`` at a time.
    """
    good, bad = validate(enrich(events), errors)
    latest = table.latest()
    saved = table.read(latest, table.touched(good) if table.key == key else None) if latest else good.limit(0)
    new, outcome = insert_once(saved, good, key, order)
    # What is told is fixed before the table changes.
    outcome = outcome.select(key, "outcome", F.array().cast("array<string>").alias("errors")).unionByName(bad.select(key, F.lit("rejected").alias("outcome"), "errors"))
    outcome = work_table(outcome, "outcomes")
    if new.limit(1).count():
        table.append(new, latest)
        table.compact(fan)
    return outcome


def stream_to_plays(events: DataFrame, table: VersionedTable, enrich: Callable[[DataFrame], DataFrame], errors: Column, key: str, order: list[Column], checkpoint: str, report: Callable[[DataFrame, int], None] = lambda outcome, batch: None):
    """``save_batch`` for every trigger of a stream of confirmed events; ``report`` gets each batch's outcomes."""

    def handle(batch: DataFrame, number: int) -> None:
        report(save_batch(batch.persist(), table, enrich, errors, key, order), number)
        batch.unpersist()

    return stream_to_table(events, handle, checkpoint)
