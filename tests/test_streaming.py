"""Streams give what the batch forms give."""

import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import events as E
from tallyspark.functions.ids import reasons
from tallyspark.operators.guarded import VersionedTable
from tallyspark.streaming.stateful import Confirm, LiveResults, Sample, Stability, stateful, stream_to_plays, stream_to_table


def run(spark, rows, schema, processor, files=3):
    """Feed the rows as a few files, one trigger each, and collect what comes out."""
    folder = tempfile.mkdtemp()
    df = spark.createDataFrame(rows, schema)
    part = -(-len(rows) // files)
    for k in range(files):
        df.filter((F.col("order_id") >= k * part) & (F.col("order_id") < (k + 1) * part)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = []
    stream_to_table(stateful(stream, processor), lambda batch, _: out.append(batch.toPandas()), f"{folder}/check").awaitTermination(120)
    return pd.concat(out).sort_values("order_id").reset_index(drop=True)


def test_confirm_stream_equals_batch(spark):
    rnd, rows, ts = random.Random(3), [], 0
    for i in range(300):
        ts += rnd.choice([200, 600, 4000])
        rows.append((rnd.choice("ab"), i, ts, rnd.random() < 0.8, rnd.random() < 0.05, rnd.choice("xy")))
    schema = "stream string, order_id long, timestamp_ms long, candidate boolean, transition boolean, dup_key string"
    got = run(spark, rows, schema, Confirm(1000, 5000))
    want = E.confirm_events(spark.createDataFrame(rows, schema), "stream", "timestamp_ms", "order_id", F.col("candidate"), F.col("transition"), F.col("dup_key"), 1000, 2, 5000, 9).orderBy("order_id").toPandas()
    assert got["event_type"].tolist() == want["event_type"].tolist()
    assert not got["late"].any()


def test_sample_stream_equals_batch(spark):
    rnd, rows, ts = random.Random(5), [], 0
    for i in range(100):
        ts += rnd.choice([100, 700])
        rows.append(("s", i, ts))
    schema = "stream string, order_id long, timestamp_ms long"
    got = run(spark, rows, schema, Sample(1000))
    want = E.sample_min_gap(spark.createDataFrame(rows, schema), "stream", "timestamp_ms", "order_id", 1000).orderBy("order_id").toPandas()
    assert got["accepted"].tolist() == want["accepted"].tolist()


def test_live_results(spark):
    seen = [(True, 10, "A", "retry"), (True, 10, "A", "retry"), (True, 10, "A", "done"), (True, 10, "A", "done"), (False, None, None, "done"), (False, None, None, "done"), (True, 10, "A", "done"), (True, 10, "A", "done")]
    rows = [("s", i, i * 1000, *s) for i, s in enumerate(seen)]
    got = run(spark, rows, "stream string, order_id long, timestamp_ms long, is_result boolean, score int, result_key string, disposition string", LiveResults(), files=2)
    assert list(zip(got["order_id"], got["attempt"], got["outcome"])) == [(1, 1, "retry"), (2, 2, "resolved"), (3, 0, "same_result"), (7, 1, "resolved")]


def test_stability(spark):
    a, b = [0.0, 0.0], [1.0, 1.0]
    seen = [(0, a), (60, a), (120, a), (180, a), (240, b), (200, b), (300, b)]
    rows = [("s", i, t, v, str(v)) for i, (t, v) in enumerate(seen)]
    got = run(spark, rows, "stream string, order_id long, timestamp_ms long, vector array<double>, vector_hash string", Stability(), files=7)
    assert got["state"].tolist() == ["change", "settling", "stable", "repeat", "change", "invalid", "change"]


def test_confirmed_events_are_saved_once(spark):
    """Events of three triggers, identified and validated; repeated keys are duplicates, broken ones rejected, and a replay saves nothing."""
    folder = tempfile.mkdtemp()
    rows = [(0, "a", 10), (1, "b", 20), (2, "a", 30), (3, "c", -1), (4, "b", 5), (5, "d", 7)]
    df = spark.createDataFrame(rows, "order_id long, seen string, score int")
    for k in range(3):
        df.filter(F.expr(f"order_id div 2 = {k}")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    songs = spark.createDataFrame([("a", "song a"), ("b", "song b"), ("c", "song c"), ("d", "song d")], "seen string, song string")
    table, told = VersionedTable(spark, f"{folder}/plays", "song", 4), []

    def go(check: str) -> None:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        errors = reasons((F.col("score") < 0, "score_negative"))
        tell = lambda out, _: told.extend((r["song"], r["outcome"]) for r in out.collect())
        stream_to_plays(stream, table, lambda batch: batch.join(songs, "seen"), errors, "song", [F.col("order_id")], f"{folder}/{check}", tell).awaitTermination(120)

    go("first")
    assert sorted(r["score"] for r in table.read().collect()) == [7, 10, 20] and table.versions() == [1, 2]
    assert sorted(told) == sorted([("song a", "inserted"), ("song b", "inserted"), ("song a", "duplicate"), ("song c", "rejected"), ("song b", "duplicate"), ("song d", "inserted")])
    go("again")
    assert table.versions() == [1, 2] and table.read().count() == 3


def test_old_marks_are_forgotten(spark):
    """A mark older than the window can't make a duplicate, and is dropped from the state."""
    processor = Confirm(0, 1000)

    class Marks(dict):
        containsKey, updateValue, removeKey = dict.__contains__, dict.__setitem__, dict.__delitem__
        getValue = dict.__getitem__

        def iterator(self):
            return iter(list(self.items()))

    processor.marks, state = Marks(), processor.start()
    row = pd.DataFrame({"order_id": range(5), "timestamp_ms": [0, 500, 5000, 5100, 9000], "candidate": True, "transition": False, "dup_key": list("xyxzx")})
    for r in row.itertuples(index=False):
        state, _ = processor.step(state, r)
        processor.forget(state)
    assert dict(processor.marks) == {("x",): (9000,)}
