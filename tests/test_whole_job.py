"""Queries that once left rows out, against plain Python over whole tables."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark import plans
from tallyspark.operators import analytics as A
from tallyspark.functions import text as X
from tallyspark.operators import evaluate as V
from tallyspark.operators import resolve as R
from tallyspark.plans import resolve_queries
from tallyspark.plans.registry import Tables
from tests.conftest import SF


def test_sort_modes_place_every_row(spark):
    queries = plans.queries()
    rows = queries["a1_j2_entity_bests"](spark, SF).collect()
    found = {}
    for r in queries["l3_sort_modes"](spark, SF).collect():
        found.setdefault(r["mode"], []).append((r["place"], r["l_partkey"]))
    tie = lambda r: (r["title"].lower(), r["l_partkey"])
    orders = {
        "title": lambda r: (r["title"].lower(), r["level"] is None, r["level"] or 0, r["l_partkey"]), "score_asc": lambda r: (r["best_score"], *tie(r)), "score_desc": lambda r: (-r["best_score"], *tie(r)), "plays_desc": lambda r: (-r["plays"], *tie(r)), "goal": lambda r: (990_000 - r["best_score"], *tie(r)),
        "level_asc": lambda r: (r["level"] is None, r["level"] or 0, *tie(r)), "level_desc": lambda r: (r["level"] is None, -(r["level"] or 0), *tie(r)),
    }
    assert len(rows) > 100 and set(orders) | {"recent"} == set(found)
    for mode, order in orders.items():
        wanted = [r for r in rows if mode != "goal" or r["best_score"] < 990_000]
        assert sorted(found[mode]) == list(enumerate((r["l_partkey"] for r in sorted(wanted, key=order)), 1))
    assert [p for p, _ in sorted(found["recent"])] == list(range(1, len(rows) + 1))


def test_goal_order_leaves_out_what_is_above(spark):
    rows = spark.createDataFrame([(1, "a", 995_000, 1), (2, "b", 980_000, 1), (3, "c", 900_000, 2), (4, "d", 990_000, 1)], "k int, title string, best_score int, plays int")
    placed = A.places(A.sort_bests(rows.repartition(4), "goal", "k", 990_000)).select("k", "place")
    assert sorted(tuple(r) for r in placed.collect()) == [(2, 1), (3, 2)]


def test_title_ties_go_by_level(spark):
    rows = spark.createDataFrame([(1, "a", 9, 30), (2, "A", None, 20), (3, "a", 4, 10)], "k int, title string, level int, best_score int")
    assert [r["k"] for r in A.sort_bests(rows, "title", "k").collect()] == [3, 1, 2]
    assert [r["k"] for r in A.sort_bests(rows, "score_asc", "k").collect()] == [3, 2, 1]


def test_references_are_all_lines(spark):
    queries = plans.queries()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    status = {0: "auto_confirmed", 1: "manual_confirmed", 2: "needs_review", 3: "unresolved"}
    seen = Counter(status[r["l_suppkey"] % 4] for r in lines)
    total = queries["a24_coverage_summary"](spark, SF).first()
    assert (total["rows"], total["auto"], total["confirmed"]) == (len(lines), seen["auto_confirmed"], seen["auto_confirmed"] + seen["manual_confirmed"])
    counts = {(r["field"], r["value"]): r["n"] for r in queries["a26_unresolved_summary"](spark, SF).collect()}
    assert {k: counts["status", k] for k in seen} == seen
    assert {v: n for (f, v), n in counts.items() if f == "reason"} == Counter(r["l_returnflag"] for r in lines)
    states = queries["j23_f7_reference_state"](spark, SF).select("ref", "sk").collect()
    assert Counter(map(tuple, states)) == Counter((r["l_orderkey"] * 10 + r["l_linenumber"], r["l_suppkey"]) for r in lines)
    played = {r["l_partkey"] for r in lines}
    covered = queries["j24_coverage"](spark, SF).collect()
    assert {r["song"]: r["rows"] for r in covered if r["rows"]} == Counter(r["l_partkey"] for r in lines)
    assert {r["song"] for r in queries["j26_presence"](spark, SF).filter("presence = 'present'").collect()} == played


def test_songs_without_references(spark):
    songs = spark.createDataFrame([(1, "x", True), (2, "x", True), (3, "y", False)], "song int, style string, available boolean")
    refs = spark.createDataFrame([(1, "auto_confirmed", "R", 1)], "song int, status string, reason string, ref int")
    found = V.coverage(songs.select("song"), refs, refs.filter("false"), "song", "ref").collect()
    assert {r["song"]: (r["coverage"], r["rows"]) for r in found} == {1: ("referenced", 1), 2: ("uncollected", 0), 3: ("uncollected", 0)}
    assert {r["song"]: r["presence"] for r in V.presence(songs, refs, "song", "available").collect()} == {1: "present", 2: "available_only", 3: "absent"}
    seen = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "obs int, style string")
    status = {r["obs"]: r["row_status"] for r in V.candidate_coverage(seen, songs, refs, "obs", "song", ["style"]).collect()}
    assert status == {1: "partial", 2: "none", 3: "no_candidates"}


def _points(plays, newest):
    """Keys of first plays and new bests among the newest, of one part's (order..., score) in order of time."""
    out, best = [], None
    for k, play in enumerate(plays):
        if k >= len(plays) - newest and (best is None or play[-1] > best):
            out.append(play[:-1])
        best = play[-1] if best is None else max(best, play[-1])
    return out


def test_best_points_look_at_the_newest_hundred(spark):
    parts = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        parts.setdefault(r["l_partkey"], []).append((r["l_shipdate"], r["l_orderkey"], r["l_linenumber"], r["l_suppkey"], int(r["l_extendedprice"]) * 10))
    wanted = Counter((p[1], p[2], part, p[3]) for part, plays in parts.items() for p in _points(sorted(plays), 100))
    assert wanted != Counter((p[1], p[2], part, p[3]) for part, plays in parts.items() for p in _points(sorted(plays), 20))
    found = plans.queries()["w3_best_points"](spark, SF).collect()
    assert Counter((r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"]) for r in found) == wanted


def test_best_points_window_bites(spark):
    data = [(k, f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", k) for k in range(120)]
    df = A.with_order(spark.createDataFrame(data, "id int, at string, score int").withColumn("e", F.lit(1)), "at", "id")
    assert sorted(r["id"] for r in A.best_points(df, ["e"], "score").collect()) == list(range(20, 120))


def test_progress_counts_every_played_part(spark):
    queries = plans.queries()
    played = {r["l_partkey"] for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()}
    parts = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").collect() if r["p_partkey"] % 10}
    assert {r["l_partkey"] for r in queries["j4_overlay"](spark, SF).filter("plays > 0").collect()} == played
    total = queries["a5_progress"](spark, SF).agg(F.sum("recorded"), F.sum("unrecorded")).first()
    assert tuple(total) == (len(played), len(parts - played))


def test_keys_of_whole_table(spark):
    """Keys of all documents, by the rules written out for one text."""
    found = {r["doc_id"]: r for r in plans.queries()["p2_p4_keys"](spark, SF).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()

    def strict(t):
        t = "".join(X.QUOTES_AND_DASHES.get(c, c) for c in unicodedata.normalize("NFKC", t)).casefold()
        return "".join(re.sub(X.ELLIPSIS, "...", t).split())

    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        bare = "".join(X.LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKD", r["text"]).casefold() if unicodedata.category(c) != "Mn")
        title = "".join(c for c in unicodedata.normalize("NFKC", r["text"]).casefold() if not c.isspace() and c not in X.TITLE_PUNCTUATION)
        assert (found[r["doc_id"]]["strict"], found[r["doc_id"]]["loose"], found[r["doc_id"]]["title"]) == (md5(strict(r["text"])), md5(strict(bare)), md5(title))


def test_fuzzy_match_against_difflib(spark):
    """Statuses, ties and the five best of every observation, by loops over its block."""
    rnd = random.Random(4)
    titles = ["abcdefgh", "abcdefgi", "abcdefgh", "xyz", "hello world", "hello word", "", "q"]
    charts = [(k, titles[k % 8], f"artist{k}", k % 3) for k in range(24) if titles[k % 8]]
    seen = [(k, "".join(c for c in rnd.choice(titles) if rnd.random() < 0.9), k % 4, k % 7 != 0) for k in range(60)]
    c = spark.createDataFrame(charts, "id int, title string, artist string, block int").withColumn("known", F.col("title"))
    o = spark.createDataFrame(seen, "obs int, seen string, block int, ok boolean")
    found = {r["obs"]: r for r in R.fuzzy_match(o, "obs", "seen", F.col("ok"), c, ["block"], "known", "id", 0.8).collect()}
    statuses = Counter()
    for k, text, block, ok in seen:
        scored = sorted(((-X.similarity(text, t), t, a, i) for i, t, a, b in charts if b == block), key=lambda s: s)
        scored = scored if ok and text else []
        ties = sum(round(s[0], 6) == round(scored[0][0], 6) for s in scored)
        if not (ok and text):
            want = "insufficient_input"
        elif not scored or -scored[0][0] < 0.8:
            want = "not_found"
        else:
            want = "ambiguous" if ties > 1 else "matched"
        statuses[want] += 1
        assert found[k]["match_status"] == want
        assert (found[k]["top_chart"] is None) == (not scored)
        if scored:
            assert found[k]["top_chart"] == scored[0][3] and found[k]["top_candidates"] == " | ".join(f"{-s:.4f}:{t} / {a} [{i}]" for s, t, a, i in scored[:5])
    assert len(statuses) == 4


def test_fuzzy_query_against_difflib(spark):
    """The whole registered query: every pair of every block, scored without any bound."""
    t = Tables(spark, SF)
    charts, obs = resolve_queries.songs(t).collect(), resolve_queries.observations(t).collect()
    blocks = defaultdict(list)
    for c in charts:
        blocks[c["style"], c["level"]].append((X.fold("title", c["title"]), c["title"], c["artist"], c["song_id"]))
    found = {r["obs_id"]: r for r in resolve_queries.j6_p20_fuzzy_match(t).collect()}
    assert len(found) == len(obs)
    for o in obs:
        seen, got = X.fold("title", o["title"]), found[o["obs_id"]]
        scored = sorted((-X.similarity(seen, k), title, artist, i) for k, title, artist, i in blocks[o["style"], o["level"]]) if seen else []
        if not seen:
            assert (got["match_status"], got["top_chart"]) == ("insufficient_input", None)
            continue
        best = -scored[0][0]
        ties = sum(round(-s[0], 6) == round(best, 6) for s in scored)
        assert got["match_status"] == ("not_found" if best < 0.92 else "ambiguous" if ties > 1 else "matched")
        assert got["top_chart"] == scored[0][3] and abs(got["top_score"] - best) < 1e-6
        assert got["top_candidates"] == " | ".join(f"{-s:.4f}:{title} / {artist} [{i}]" for s, title, artist, i in scored[:5])


def test_coverage_comes_from_sums_by_block(spark):
    """No pair of observation and candidate is moved or sorted, and the totals make none; the same as by pairs, also of observations of several rows."""
    obs = spark.createDataFrame([(i % 70, f"s{i % 5}") for i in range(80)], "obs long, style string")
    charts = spark.createDataFrame([(f"s{i % 4}", i) for i in range(40)], "style string, song long")
    refs = spark.createDataFrame([(i,) for i in range(40) if i % 4 == 0 or i % 8 == 1], "song long")
    rows = V.candidate_coverage(obs, charts, refs, "obs", "song", ["style"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") > plan.index("Join")  # the window is below the join that makes the pairs
    by_pairs = {tuple(r) for r in V.coverage_totals(rows, "obs").collect()}
    assert by_pairs == {tuple(r) for r in V.block_coverage_totals(obs, charts, refs, "obs", "song", ["style"]).collect()}
    asked = obs.selectExpr("obs", "style", "obs % 45 AS expected", "'' AS failure", "'ready' AS block_status").distinct()
    pairs = asked.join(charts, "style").select("obs", "song")
    one, other = (V.expected_status(asked, c, refs, "obs", "song", b).select("obs", "style", "expected_status", "expected_reason") for c, b in ((pairs, None), (charts, ["style"])))
    assert sorted(map(tuple, other.filter("obs >= 10").collect())) == sorted(map(tuple, one.filter("obs >= 10").collect()))


def test_a_catalog_of_a_small_file_is_not_broadcast(spark, tmp_path):
    """Its keys are many times its compressed file, by which the planner judges."""
    spark.range(3000).selectExpr("id AS song", "concat('t', id % 7) AS title").write.parquet(str(tmp_path / "songs"))
    songs = spark.read.parquet(str(tmp_path / "songs"))
    found = R.cascade(songs, "song", {1: F.col("title"), 2: F.col("title")}, R.keyed(songs, "song", {1: F.col("title"), 2: F.col("title")}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {(r["step"], r["hits"]) for r in found.collect()} == {(1, 428), (1, 429)}


def test_lists_of_a_key_come_last(spark):
    """No list is moved with an observation: above the join that adds the lists there is no exchange."""
    songs = spark.range(400).selectExpr("id AS song", "concat('t', id % 7) AS title")
    out = R.strict_lookup(songs, "song", F.lit(True), F.col("title"), F.col("title"), R.keyed(songs, "song", {1: F.col("title"), 2: F.col("title")}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    lists = {r["song"]: r["entities"] for r in out.collect()}
    assert all(lists[i] == [k for k in range(400) if k % 7 == i % 7] for i in range(400))


def test_fuzzy_pairs_are_never_rows(spark, monkeypatch):
    """Bins of texts meet, equal texts are one: the same best rows and ties as by loops, whatever the bins."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7)))
    charts = [(k, f"{word()}", f"artist{k % 3}", k % 2) for k in range(120)] + [(200 + k, "abcdab", "same", 0) for k in range(9)] + [(300, "x" * 300, "long", 1)]
    seen = [(k, word() if k % 9 else "abcdab", k % 3) for k in range(90)] + [(400, "x" * 290 + "y", 1)]
    c = spark.createDataFrame(charts, "id int, title string, artist string, block int").withColumn("known", F.col("title"))
    o = spark.createDataFrame(seen, "obs int, seen string, block int")
    for known, asked in ((2048, 512), (7, 4)):
        monkeypatch.setattr(R, "KNOWN", known)
        monkeypatch.setattr(R, "SEEN", asked)
        found = {r["_text"] + str(r["block"]): r for r in R.best_in_block(o.withColumn("_text", F.col("seen")), c, ["block"], "known", "id").collect()}
        assert len(found) == len({(s, b) for _, s, b in seen if b < 2})
        for _, text, block in seen:
            scored = sorted((-X.similarity(text, t), t, a, i) for i, t, a, b in charts if b == block)
            if scored:
                got = found[text + str(block)]
                assert [tuple(r) for r in got["_top"]] == scored[:5] and got["top_score"] == -scored[0][0]
                assert got["_ties"] == sum(round(s[0], 6) == round(scored[0][0], 6) for s in scored)


def test_reviews_are_judged_once(spark, monkeypatch):
    """What upsert and delete read again and again is a written table, not the judging of all requests."""
    from tallyspark.sources.versions import VersionedTable

    given, upsert, delete = [], VersionedTable.upsert, VersionedTable.delete
    monkeypatch.setattr(VersionedTable, "upsert", lambda self, df, *a: given.append(df) or upsert(self, df, *a))
    monkeypatch.setattr(VersionedTable, "delete", lambda self, df, *a: given.append(df) or delete(self, df, *a))
    plans.queries()["g4_g9_reviewed_versions"](spark, SF)
    assert len(given) == 2
    for df in given:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
