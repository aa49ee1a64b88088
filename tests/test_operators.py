"""Operators on hand-made tables: edge cases of order, ties, nulls and stale state."""

import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators import analytics as A
from tallyspark.operators import events as E
from tallyspark.operators import evaluate as V
from tallyspark.operators import guarded as G
from tallyspark.operators import nearest as N
from tallyspark.sources import html as H
from tallyspark.sources import tables as S


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_mixed_offsets_and_unparseable_times(spark):
    data = [("p1", "2024-01-01T10:00:00+09:00", 10), ("p2", "2024-01-01 02:00:00", 20), ("p3", "2024-01-01T00:30:00Z", 5), ("p4", "junk", 99)]
    df = A.with_order(spark.createDataFrame(data, "id string, at string, score int").withColumn("e", F.lit(1)), "at", "id")
    got = {r["id"]: r["previous_score"] for r in A.previous_best(df, ["e"], ["score"]).collect()}
    assert got == {"p3": None, "p1": 5, "p2": 10, "p4": None}
    assert {r["id"] for r in A.best_updates(A.previous_best(df, ["e"], ["score"]), ["score"]).collect()} == {"p1", "p2"}


def test_best_outside_the_newest_still_counts(spark):
    data = [(k, f"2024-01-01 00:{k:02d}:00", s) for k, s in enumerate([100, 50, 60, 70])]
    df = A.with_order(spark.createDataFrame(data, "id int, at string, score int").withColumn("e", F.lit(1)), "at", "id")
    assert rows(A.best_points(df, ["e"], "score", 3).select("id")) == []
    assert sorted(rows(A.best_points(df, ["e"], "score", 4).select("id"))) == [(0,)]


def test_day_starts_at_seven(spark):
    df = spark.createDataFrame([("2024-01-02 06:59:59",), ("2024-01-02 07:00:00",)], "t string")
    assert [str(r[0]) for r in df.select(A.play_day(F.to_timestamp("t"))).collect()] == ["2024-01-01", "2024-01-02"]
    tokyo = df.select(A.play_day(F.to_timestamp("t"), "Asia/Tokyo"))
    assert [str(r[0]) for r in tokyo.collect()] == ["2024-01-02", "2024-01-02"]


def test_empty_table_sums(spark):
    df = spark.createDataFrame([], "a int, b int, ok int, kcal double")
    assert rows(A.day_summary(df, ["a", "b"], "ok", "kcal")) == [(0, None, None)]


def test_page_refuses_bad_bounds(spark):
    df = spark.range(5)
    for bounds in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            A.page(df, [F.col("id")], *bounds)
    assert rows(A.page(df, [F.col("id")], 3, 50)) == [(3,), (4,)]


def sequential(frames, min_ms, window):
    start, marks, out = None, {}, []
    for i, (ts, candidate, moving, key) in enumerate(frames):
        kind = "none"
        if moving:
            start, kind = None, "rejected_transition"
        elif candidate:
            start = ts if start is None else start
            if ts - start >= min_ms:
                kind = "duplicate" if key in marks and ts - marks[key] <= window else "confirmed"
                marks[key] = ts
        else:
            start = None
        out.append((i, kind))
    return out


def test_confirm_agrees_with_a_loop(spark):
    import random

    rnd = random.Random(7)
    frames, ts = [], 0
    for _ in range(1500):
        ts += rnd.choice([100, 300, 700, 5000])
        frames.append((ts, rnd.random() < 0.8, rnd.random() < 0.05, rnd.choice("ab")))
    df = spark.createDataFrame([(i, "s", *f) for i, f in enumerate(frames)], "i long, k string, ts long, cand boolean, mov boolean, dup string")
    got = E.confirm_events(df, "k", "ts", "i", F.col("cand"), F.col("mov"), F.col("dup"), 1000, 2, 4000, 9)
    assert sorted(rows(got.select("i", "event_type"))) == sequential(frames, 1000, 4000)


def test_sampler_depends_on_accepted_rows(spark):
    df = spark.createDataFrame([("s", t, t) for t in (0, 600, 1000, 1900, 2000, 2100)], "k string, ts long, i long")
    got = E.sample_min_gap(df, "k", "ts", "i", 1000)
    assert [r["ts"] for r in got.orderBy("ts").collect() if r["accepted"]] == [0, 1000, 2000]


def test_dup_key(spark):
    df = spark.createDataFrame([("a/b/Score123.png",), ("x.png",), (None,)], "n string")
    assert [r[0] for r in df.select(E.dup_key(F.col("n"))).collect()] == ["score:123", "file:x.png", "file:"]


def test_entity_distances_in_blocks(spark):
    obs = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, v array<double>")
    refs = spark.createDataFrame([(i, i % 3, [float(i) + 0.25, 0.0]) for i in range(20)] + [(99, 9, None)], "id long, e int, v array<double>")
    whole = N.entity_distances(obs, refs, "id", "id", "e", "v")
    small = N.entity_distances(obs, refs, "id", "id", "e", "v", block=3, small=0)
    assert sorted(rows(whole)) == sorted(rows(small))
    assert whole.count() == 60


def test_reviews_are_all_or_nothing(spark):
    refs = spark.createDataFrame([(1, 0, "needs_review", None), (2, 3, "rejected", 5)], "ref_id int, revision int, status string, entity int")
    ask = "action_id string, ref_id int, action string, expected_revision int, expected_status string, entity int"
    good = spark.createDataFrame([("a", 1, "manual_confirm", 0, "needs_review", 7)], ask)
    new, log = G.apply_reviews(refs, good)
    assert sorted(rows(new)) == [(1, 1, "manual_confirmed", 7), (2, 3, "rejected", 5)]
    assert rows(log.select("action_id", "revision")) == [("a", 1)]
    assert rows(G.review_violations(refs, good, log).select("violations")) == [(["receipt"],)]
    stale = spark.createDataFrame([("b", 2, "reopen", 1, "rejected", None), ("c", 9, "reject", 0, "x", None)], ask)
    got = dict(rows(G.review_violations(refs, stale).select("action_id", "violations")))
    assert got == {"b": ["stale_revision"], "c": ["unknown_reference"]}
    with pytest.raises(Exception, match="refused"):
        G.apply_reviews(refs, good.unionByName(stale))[0].collect()
    # The same id for something else isn't a receipt, nor is one id twice.
    other = spark.createDataFrame([("a", 1, "reject", 1, "manual_confirmed", None)], ask)
    assert rows(G.review_violations(new, other, log).select("violations")) == [(["action_reused"],)]
    assert {tuple(v) for (v,) in rows(G.review_violations(refs, good.unionByName(good), log).select("violations"))} == {("repeated_action", "conflicting_requests")}
    # A batch with a receipt and a good request is applied; one with a bad request isn't, and no request of it is.
    third = spark.createDataFrame([(1, 1, "manual_confirmed", 7), (2, 3, "rejected", 5), (3, 0, "unresolved", None), (4, 0, "unresolved", None)], "ref_id int, revision int, status string, entity int")
    more = spark.createDataFrame([("a", 1, "manual_confirm", 0, "needs_review", 7, 1), ("d", 2, "reopen", 3, "rejected", None, 1), ("e", 3, "reject", 0, "unresolved", None, 2), ("f", 4, "reopen", 0, "unresolved", None, 2)], ask + ", batch int")
    done, log = G.apply_reviews(third, more, log, "batch")
    assert sorted(rows(done)) == [(1, 1, "manual_confirmed", 7), (2, 4, "needs_review", None), (3, 0, "unresolved", None), (4, 0, "unresolved", None)]
    assert rows(log.select("action_id", "before_status", "after_status", "after_entity")) == [("d", "rejected", "needs_review", None)]
    told = dict(rows(G.review_outcomes(third, more, spark.createDataFrame([("a", "x")], "action_id string, payload string"), "batch").select("action_id", "outcome")))
    assert told == {"a": "refused", "d": "refused_with_batch", "e": "refused_with_batch", "f": "refused"}


def test_a_drifted_feature_takes_no_place(spark):
    features = spark.createDataFrame([(1, "x", True, "old", "new"), (2, "x", True, "new", "new"), (3, "x", True, "new", "new"), (4, "y", True, "n", "n"), (5, "z", None, "n", "n"), (6, "w", True, None, "n")], "feature_id int, ident string, accepted boolean, canonical string, expected_canonical string")
    store = spark.createDataFrame([("y",), ("y",)], "ident string")
    put, told = G.store_features(store, features, ["ident"])
    assert dict(rows(told.select("feature_id", "outcome"))) == {1: "canonical_drift", 2: "inserted", 3: "duplicate", 4: "duplicate", 5: "not_accepted", 6: "canonical_drift"}
    assert rows(put.select("feature_id")) == [(2,)] and told.count() == 6


def test_plan_refuses_false_decisions(spark):
    df = spark.createDataFrame([(1, "auto_x", 5, 6)], "ref_id int, route string, matched int, truth int")
    refs = spark.createDataFrame([], "ref_id int, status string, entity int")
    with pytest.raises(Exception, match="false automatic"):
        G.build_plan(df, refs, "truth").collect()


def test_versioned_table(spark):
    table = G.VersionedTable(spark, tempfile.mkdtemp() + "/t")
    assert table.publish(spark.range(3), expected=0) == 1
    assert table.publish(spark.range(4), expected=1) == 2
    with pytest.raises(ValueError, match="stale"):
        table.publish(spark.range(5), expected=1)
    assert table.read().count() == 4 and table.read(1).count() == 3


def test_fingerprint_ignores_order(spark):
    a, b = spark.range(100), spark.range(100).orderBy(F.desc("id"))
    assert V.table_fingerprint(a).first() == V.table_fingerprint(b).first() != V.table_fingerprint(spark.range(101)).first()


def test_csv_and_schema_contract(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/a.csv", "w") as f:
        f.write("image,ts,more\nx,5,y\nz,bad,w\n")
    schema = T.StructType([T.StructField("ts", T.LongType())])
    got = S.read_csv_required(spark, f"{folder}/a.csv", ["image", "ts"], schema)
    assert rows(got) == [("x", 5, "y"), ("z", None, "w")]
    with pytest.raises(ValueError, match="lacks"):
        S.read_csv_required(spark, f"{folder}/a.csv", ["nope"])
    contract = {1: T.StructType([T.StructField("image", T.StringType()), T.StructField("ts", T.LongType())])}
    assert S.schema_errors(got, contract, 1) == ["unknown more"]


def test_publish_export_restore(spark):
    folder = tempfile.mkdtemp()
    S.publish(spark.range(10), f"{folder}/out")
    with pytest.raises(FileExistsError):
        S.publish(spark.range(10), f"{folder}/out")
    S.write_report(spark.range(3), f"{folder}/report", ["id"])
    plays = spark.createDataFrame([("p1", "k1", 5, 1, 2.5), ("p2", "k2", 6, None, None)], "play_id string, duplicate_key string, score int, ok int, calories double")
    logs = spark.createDataFrame([("l", "p1")], "log string, play_id string")
    S.export_plays(plays, f"{folder}/v1", 1)
    back, unlinked = S.restore_plays(spark, f"{folder}/v1", plays.schema, logs, 2)
    assert sorted(rows(back)) == [("p1", "k1", 5, None, None), ("p2", "k2", 6, None, None)]
    assert rows(unlinked.select("play_id")) == [(None,)]
    with pytest.raises(ValueError):
        S.restore_plays(spark, f"{folder}/v1", plays.schema, logs, 3)


PAGE = """<table><tr><th>title<th>easy<th>hard</tr>
<tr><td colspan=3>First part</td></tr><tr><td>One <a href=#>*1</a></td><td rowspan=2>3</td><td>9</td></tr><tr><td>Two</td><td>-</td></tr></table>
<p>see <a href="/x?a=1">X &amp; Y</a><a href="http://other/">Z</a><a>no link</a>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://site/p/", PAGE), (2, None, None)], "page_id int, url string, html string")
    cells = H.expand_tables(pages, "page_id", "html")
    assert [list(r["cells"]) for r in cells.orderBy("row_no").collect()] == [["title", "easy", "hard"], ["First part"] * 3, ["One", "3", "9"], ["Two", "3", "-"]]
    charts = H.parse_sectioned_table(cells, ["title", "easy", "hard"], ["title", "easy", "hard"], {"easy": ("s", "easy"), "hard": ("s", "hard")})
    assert sorted(rows(charts.select("section", "title", "difficulty", "level"))) == [("First part", "One", "easy", 3), ("First part", "One", "hard", 9), ("First part", "Two", "easy", 3)]
    links = H.extract_html_rows(pages, "page_id", "url", "html", "a", "href")
    got = {r["text"]: (r["link"], r["same_origin"], r["error"]) for r in links.collect()}
    assert got["X & Y"] == ("http://site/x?a=1", True, None)
    assert got["Z"] == ("http://other/", False, None)
    assert got["no link"] == (None, None, "missing_link")


def test_lost_race_leaves_the_published_version(spark):
    """Two publishers write the same version; who comes second is refused, and the first one's rows stay."""
    table = G.VersionedTable(spark, tempfile.mkdtemp() + "/t")
    table.publish(spark.range(1), 0)
    other = G.VersionedTable(spark, table.path)
    first, second = G.VersionedTable._mark, []

    def late(self, *args):
        if not second:
            second.append(other.publish(spark.range(10), 1))
        return first(self, *args)

    table._mark = lambda *args: late(table, *args)
    with pytest.raises(ValueError, match="stale"):
        table.publish(spark.range(99), 1)
    assert second == [2] and table.versions() == [1, 2]
    assert table.read().count() == 10 and table.read(1).count() == 1


def test_fingerprint_sees_moved_values(spark):
    schema = "a string, b string"
    shapes = [[(None, "1")], [("1", None)], [("", "1")], [("11", "")], [("1", "1")], [("1", "1")] * 2, [("1;1:1", None)], []]
    found = [V.table_fingerprint(spark.createDataFrame(rows, schema)).first() for rows in shapes]
    assert len(set(found)) == len(shapes)
    assert V.table_fingerprint(spark.createDataFrame([("x", 1)], "b string, a int")).first() == V.table_fingerprint(spark.createDataFrame([(1, "x")], "a int, b string")).first()


def test_stale_plan_is_refused(spark):
    refs = spark.createDataFrame([(1, "needs_review", None, 0), (2, "auto_confirmed", 5, 1), (3, "needs_review", None, 4)], "ref_id int, status string, entity int, revision int")
    planned = spark.createDataFrame([(1, "auto_x", 7, 7), (2, "auto_x", 5, 5), (3, "manual_y", None, 9), (4, "auto_x", 8, 8)], "ref_id int, route string, matched int, truth int")
    plan = G.build_plan(planned, refs, "truth")
    new, outcome = G.apply_plan(refs, plan)
    assert sorted(rows(new)) == [(1, "auto_confirmed", 7, 1), (2, "auto_confirmed", 5, 1), (3, "needs_review", None, 4)]
    assert dict(rows(outcome.select("ref_id", "outcome"))) == {1: "applied", 2: "no_op", 3: "manual", 4: "unknown"}
    for result in G.apply_plan(new, plan):
        with pytest.raises(Exception, match="stale"):
            result.collect()


def test_save_records_rewrites_the_log(spark):
    schema = "n int, has_play boolean, duplicate_key string, play_id string, analysis_status string, save_boundary_status string, skip_reason string, duplicate boolean"
    records = [(k, play, key, f"p{k}" if play else None, "saved" if play else "error", "ready", "", False) for k, (play, key) in enumerate([(True, "a"), (True, "b"), (True, "b"), (False, "b"), (False, None), (True, "c")])]
    saved = spark.createDataFrame([("a",), ("a",)], "duplicate_key string")
    log = ["n", "play_id", "analysis_status", "save_boundary_status", "skip_reason", "duplicate"]
    plays, captures, logged = G.save_records(saved, spark.createDataFrame(records, schema), [F.col("n")], "why", ["n"], ["n"], log)
    assert sorted(rows(plays)) == [(1,), (5,)] and captures.count() == 6
    again = (None, "skipped", "duplicate", "why", True)
    assert sorted(rows(logged)) == [(0, *again), (1, "p1", "saved", "ready", "", False), (2, *again), (3, None, "error", "ready", "", False), (4, None, "error", "ready", "", False), (5, "p5", "saved", "ready", "", False)]


def test_first_rule_that_holds(spark):
    df = spark.createDataFrame([(1, True, None), (2, None, True), (3, None, False)], "id int, a boolean, b boolean")
    out = V.route(df, [(F.col("a"), "auto_a", F.col("id"), "is_a"), (F.col("b"), "manual_b", None, "is_b")], ("none", "nothing"), "int")
    assert sorted(rows(out.select("id", "route", "matched", "route_reason"))) == [(1, "auto_a", 1, "is_a"), (2, "manual_b", None, "is_b"), (3, "none", None, "nothing")]
