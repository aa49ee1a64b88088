"""Manifests and declared sources by hand; the batch form of the stability detector against its stream form."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import events as E
from tallyspark.operators import guarded as G
from tallyspark.streaming.stateful import Stability


def manifest(*rows):
    return json.dumps(list(rows))


def supplement(**changes):
    return {"acquired_on": "d", "chart_id": "c1", "level": 9, "play_style": "S", "song_id": "s1", "source_url": "u", "title": "t"} | changes


def test_manifests(spark):
    more = {k: v for k, v in supplement(chart_id="c2").items() if k != "title"}
    texts = {1: manifest(supplement()), 2: manifest(), 3: None, 4: "{", 5: manifest(supplement(), supplement(), more, supplement(chart_id="c3"), supplement(chart_id="c4"), supplement(chart_id="c5", level=8), {"x": 1}, supplement(chart_id=None)), 6: '{"chart_id": "c1"}'}
    rows = [(m, t, "bad" if m == 2 else None, {1: 1, 2: 1, 5: 8}.get(m)) for m, t in texts.items()]
    table = spark.createDataFrame(rows, "master int, json string, hash string, declared int").withColumn("hash", F.coalesce("hash", F.sha2("json", 256)))
    note = "x confirmed CHALLENGE supplement; source_url=u; acquired_on=d"
    charts = [(m, c, "s1", "t", "S", kind, 9, n) for m, c, kind, n in ((1, "c1", "CHALLENGE", note), (5, "c3", "EXPERT", note), (5, "c4", "CHALLENGE", note + " more"), (5, "c5", "CHALLENGE", note))]
    got = G.check_manifests(table, spark.createDataFrame(charts, "master int, chart_id string, song_id string, title string, play_style string, difficulty string, level int, notes string"))
    found = {tuple(r) for r in got.collect()}
    assert {r for r in found if r[0] != 6} == {
        (2, "supplement_hash_mismatch", ""), (2, "supplement_count_mismatch", ""), (3, "supplement_hash_mismatch", ""), (3, "supplement_invalid_json", ""), (4, "supplement_invalid_json", ""),
        (5, "supplement_repeated", "c1"), (5, "supplement_row_keys", "2"), (5, "supplement_row_keys", "6"), (5, "supplement_not_in_charts", "c3"), (5, "supplement_note_mismatch", "c4"), (5, "supplement_not_in_charts", "c5"), (5, "supplement_not_in_charts", None),
    }
    assert any(r[0] == 6 for r in found)  # an object is no list
    assert G.check_manifests(table.limit(0), spark.createDataFrame(charts, "master int, chart_id string, song_id string, title string, play_style string, difficulty string, level int, notes string")).count() == 0


def test_sources(spark):
    masters = [(1, "a", "h", None, None), (2, None, "", "b", "h"), (3, "a", "x", "b", None), (4, "q", "h", "", "")]
    snapshots = [(1, "a", "h"), (2, "b", "h"), (3, "a", "h"), (3, "b", "h"), (4, "a", "h"), (4, "b", "h")]
    got = G.check_sources(spark.createDataFrame(masters, "master int, s_url string, s_hash string, o_url string, o_hash string"), spark.createDataFrame(snapshots, "master int, url string, content_hash string"), "s", ["o"])
    assert {tuple(r) for r in got.collect()} == {(2, "s_incomplete", ""), (2, "snapshot_count_mismatch", "1/2"), (3, "s_hash_mismatch", "a"), (3, "o_incomplete", "b"), (4, "s_url_unknown", "q"), (4, "snapshot_count_mismatch", "2/1")}


class Marks(dict):
    """What a stream's map state does."""

    containsKey, updateValue, removeKey = dict.__contains__, dict.__setitem__, dict.__delitem__


@pytest.mark.parametrize("frames, ms", [(1, 0), (2, 100), (3, 250)])
def test_stable_values_as_the_stream_sees_them(spark, frames, ms):
    draw, rows = random.Random(frames), []
    for stream in ("a", "b"):
        at, v = 0, [0.5, 0.5]
        for i in range(150):
            at += draw.choice([0, 60, 120]) - (400 if draw.random() < 0.05 else 0)
            if draw.random() < 0.3:
                v = [draw.choice([0.1, 0.14, 0.9]), draw.choice([0.1, 0.5])]
            rows.append((stream, i, at, list(v), ",".join(map(str, v))))
    df = spark.createDataFrame(rows, "s string, i int, t long, v array<double>, h string").repartition(3)
    got = {(r["s"], r["i"]): (r["state"], r["difference"]) for r in E.stable_values(df, "s", "t", "i", "v", "h", 0.08, frames, ms).collect()}
    for stream in ("a", "b"):
        processor = Stability(0.08, frames, ms)
        processor.seen, state = Marks(), processor.start()
        own = pd.DataFrame([r for r in rows if r[0] == stream], columns=["stream", "order_id", "timestamp_ms", "vector", "vector_hash"])
        for row in own.itertuples(index=False):
            state, out = processor.step(state, row)
            (_, _, kind, gap), = out
            assert got[stream, row.order_id][0] == kind
            assert gap is None or got[stream, row.order_id][1] == pytest.approx(gap)
    assert len({s for s, _ in got.values()}) == 5 or frames == 1
