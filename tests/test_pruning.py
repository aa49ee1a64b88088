"""Exact pruning: nearest entities by rings, fuzzy titles by bounds, cascades by key summaries."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import metric as M
from tallyspark.operators import nearest as N
from tallyspark.operators import resolve as R


def vectors(spark, n, seed, clusters=30, size=8, entities=3, spread=0.05):
    """Clustered vectors; each cluster has entities of its own."""
    centres = np.random.default_rng(99).standard_normal((clusters, size)) * 3
    draw = np.random.default_rng(seed)
    c = draw.integers(0, clusters, n)
    v = centres[c] + draw.standard_normal((n, size)) * spread
    return [(int(i), int(c[i] * entities + i % entities), [float(x) for x in v[i]]) for i in range(n)]


def brute(kind, obs, refs, leave_out=False):
    """{obs: [(distance, entity, ref)] in order}, by the least reference of each entity."""
    out = {}
    for i, _, v in obs:
        best = {}
        for j, e, w in refs:
            if v is None or w is None or e is None or len(v) != len(w) or (leave_out and i == j):
                continue
            d = float(M.distances(kind, np.array([v], float), np.array([w], float))[0, 0])
            if d == d:
                best[e] = min(best.get(e, (d, j)), (d, j))
        if best:
            out[i] = sorted((d, e, j) for e, (d, j) in best.items())
    return out


SCHEMA = "id long, e long, v array<double>"


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["id"]].append((r["distance"], r["e"] if "e" in r else r["entity"], r["ref_id"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("kind", ["l1", "l2", "rmse"])
@pytest.mark.parametrize("small", [M.SMALL, 0])
def test_nearest_is_exact_and_compares_few(spark, kind, small):
    obs, refs = vectors(spark, 150, 1), vectors(spark, 1500, 2)
    want = brute(kind, obs, refs)
    count = spark.sparkContext.accumulator(0)
    got = M.nearest_entities(spark.createDataFrame(obs, SCHEMA), spark.createDataFrame(refs, SCHEMA), "id", "id", "e", "v", 2, kind=kind, small=small, block=16, compared=count)
    assert found(got) == {i: rows[:2] for i, rows in want.items()}
    assert 0 < count.value < 0.1 * len(obs) * len(refs)


@pytest.mark.parametrize("small", [M.SMALL, 0])
def test_nearest_within_reach_and_without_own(spark, small):
    rows = vectors(spark, 120, 3, clusters=6)
    table = spark.createDataFrame(rows, SCHEMA)
    want = brute("l1", rows, rows, True)
    got = M.nearest_entities(table, table, "id", "id", "e", "v", 1, within=0.02, leave_out=True, small=small, block=8)
    assert found(got) == {i: [r for k, r in enumerate(rows) if k < 1 or r[0] - rows[0][0] <= 0.02] for i, rows in want.items()}
    far = table.withColumn("far", F.when(F.col("id") % 3 == 0, 2.5).when(F.col("id") % 3 == 1, 0.0))
    got = M.nearest_entities(far, table, "id", "id", "e", "v", 2, reach="far", leave_out=True, small=small, block=8)
    assert found(got) == {i: [r for k, r in enumerate(rows) if k < 2 or (i % 3 == 0 and r[0] <= 2.5)] for i, rows in want.items()}
    # The true entity's rank is among what its reach gives.
    near = N.truth_reach(table, table, "id", "id", "e", "v", "e", leave_out=True)
    ranked = N.ranked(M.nearest_entities(near, table, "id", "id", "e", "v", 1, reach="reach", leave_out=True, small=small, block=8), "id")
    got = {r["id"]: r["rank"] for r in ranked.join(table.select("id", F.col("e").alias("entity")), ["id", "entity"]).collect()}
    assert got == {i: 1 + [e for _, e, _ in want[i]].index(e) for i, e, _ in rows if e in [x for _, x, _ in want[i]]}


@pytest.mark.parametrize("small", [M.SMALL, 0])
def test_nearest_of_odd_rows(spark, small):
    nan = float("nan")
    same = [(i, 100 + i % 7, [1.0, 1.0]) for i in range(90)]  # a vector that many entities share
    refs = [*same, (200, 5, [2.0, 2.0]), (201, 5, [2.0, 2.0]), (202, None, [0.0, 0.0]), (203, 6, None), (204, 7, [nan, 1.0]), (205, 8, [1.0]), (206, 9, []), (207, 10, [5.0, 1.0, 2.0])]
    obs = [(1, 0, [1.0, 1.0]), (1, 0, [1.0, 1.0]), (2, 0, [2.0, 2.1]), (3, 0, None), (4, 0, [nan, 0.0]), (5, 0, [4.0]), (6, 0, [9.0, 9.0, 9.0, 9.0]), (7, 0, []), (200, 0, [2.0, 2.0])]
    a, b = spark.createDataFrame(obs, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    for leave_out in (False, True):
        got = M.nearest_entities(a, b, "id", "id", "e", "v", 3, leave_out=leave_out, small=small, block=4)
        want = brute("l1", [o for o in obs if o[2]], [r for r in refs if r[2]], leave_out)
        assert found(got) == {i: rows[:3] for i, rows in want.items()}
    assert M.nearest_entities(a.limit(0), b, "id", "id", "e", "v", small=small).count() == 0
    assert M.nearest_entities(a, b.limit(0), "id", "id", "e", "v", small=small).count() == 0
    with pytest.raises(ValueError):
        M.nearest_entities(a, b, "id", "id", "e", "v", 0)


def test_names_instead_of_numbers(spark):
    """Ids and entities that are texts, in every form."""
    rows = [(f"id{i}", f"e{e}", v) for i, e, v in vectors(spark, 60, 5, clusters=4)]
    table = spark.createDataFrame(rows, "id string, e string, v array<double>")
    want = {i: r[:2] for i, r in brute("l1", rows, rows, True).items()}
    for small in (M.SMALL, 0):
        assert found(M.nearest_entities(table, table, "id", "id", "e", "v", 2, leave_out=True, small=small, block=8)) == want
    every = brute("l1", rows, rows)
    for small in (32 << 20, 0):
        assert found(N.entity_distances(table, table, "id", "id", "e", "v", block=16, small=small)) == every


def test_a_block_that_many_visit_is_split(spark, monkeypatch):
    monkeypatch.setattr(M, "VISITORS", 10)
    obs, refs = [(i, 0, [0.001 * i, 0.0]) for i in range(100)], [(i, i % 5, [0.01 * i, 1.0]) for i in range(40)]
    got = M.nearest_entities(spark.createDataFrame(obs, SCHEMA), spark.createDataFrame(refs, SCHEMA), "id", "id", "e", "v", 2, small=0, block=8)
    assert found(got) == {i: rows[:2] for i, rows in brute("l1", obs, refs).items()}


def test_bounds_of_similarity():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdeé漢 ") for _ in range(draw.randint(0, 70)))
    pairs = [(word(), word()) for _ in range(400)] + [("", "abc"), ("abc", ""), ("xabcdex", "abcde"), ("a" * 64, "a" * 64), ("ab" * 40, "ba" * 40)]
    bounds = X.similarity_bounds(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert all(b >= X.similarity(x, y) for b, (x, y) in zip(bounds, pairs))
    assert sum(b < 1 for b in bounds) > 350


def test_common_letters_in_parts(monkeypatch):
    whole = X.common_letters(["abc", "abd", ""] * 20, ["abe", "bd", "x"] * 20)
    monkeypatch.setattr(X, "MASK_CELLS", 3)
    assert X.common_letters(["abc", "abd", ""] * 20, ["abe", "bd", "x"] * 20).tolist() == whole.tolist() == [2, 2, 0] * 20


def test_few_pairs_are_scored(spark):
    draw = random.Random(7)
    titles = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(200)]
    seen = [(k, "".join(draw.choice("xyz") if draw.random() < 0.15 else c for c in draw.choice(titles))) for k in range(40)]
    cands = spark.createDataFrame([(k, s, t) for k, s in seen for t in titles], "obs int, seen string, known string")
    got = defaultdict(list)
    for r in R.best_scored(cands, "obs", "seen", "known").collect():
        got[r["obs"]].append(r["score"])
    for k, s in seen:
        scores = sorted((X.similarity(s, t) for t in titles), reverse=True)
        assert sorted(got[k], reverse=True)[:5] == scores[:5]
        assert sum(round(x, 6) == round(scores[0], 6) for x in got[k]) == sum(round(x, 6) == round(scores[0], 6) for x in scores)
    assert sum(map(len, got.values())) < 0.4 * len(seen) * len(titles)


def test_cascade_joins_a_row_for_each_key(spark):
    catalog = [(1, "t", k % 9, f"artist{k % 9 % 4}") for k in range(300)] + [(1, "sole", 50, "a"), (2, "alias", 51, "a"), (2, "alias", 51, "b"), (1, "", 52, "a"), (2, None, 53, "a")]
    c = spark.createDataFrame(catalog, "step int, key string, entity long, artist string")
    obs = [(k, t, a) for k, (t, a) in enumerate([("t", "artist3"), ("t", "artist0"), ("sole", "x"), ("alias", "a"), ("none", "a"), ("", "a"), (None, "a"), ("t", None)])]
    o = spark.createDataFrame(obs, "obs int, t string, a string")
    summary = R.key_summary(c.filter("key != ''"))
    assert summary.count() == 3
    found = {r["obs"]: r for r in R.cascade(o, "obs", {1: F.col("t"), 2: F.col("t")}, c, lists=True).collect()}
    assert {k: (r["step"], r["hits"], r["entity"], r["entities"]) for k, r in found.items()} == {0: (1, 9, 0, list(range(9))), 1: (1, 9, 0, list(range(9))), 7: (1, 9, 0, list(range(9))), 2: (1, 1, 50, [50]), 3: (2, 1, 51, [51])}
    artists = c.select("entity", "artist").distinct()
    got = {r["obs"]: (r["status"], r["entity"]) for r in R.resolve_title(o, "obs", F.col("t"), F.col("a"), c.filter("key != ''"), artists).collect()}
    assert got == {0: ("resolved_artist", 3) if sum(e % 4 == 3 for e in range(9)) == 1 else ("ambiguous_title", None), 1: ("ambiguous_title", None), 2: ("resolved_title", 50), 3: ("resolved_alias", 51), 4: ("title_not_found", None), 5: ("missing_label", None), 6: ("missing_label", None), 7: ("ambiguous_title", None)}
    unique = spark.createDataFrame([(1, "t", k, f"artist{k}") for k in range(9)], "step int, key string, entity long, artist string")
    got = {r["obs"]: (r["status"], r["entity"]) for r in R.resolve_title(o.limit(2), "obs", F.col("t"), F.col("a"), unique, unique.select("entity", "artist")).collect()}
    assert got == {0: ("resolved_artist", 3), 1: ("resolved_artist", 0)}


def brute_pairs(rows, threshold):
    """{(a, b): (distance, common signatures)} by loops; all references of an entity count."""
    refs, signs = defaultdict(list), defaultdict(set)
    for e, s, v in rows:
        if e is not None and v is not None:
            refs[e].append(v)
        if e is not None and s is not None:
            signs[e].add(s)
    out = {}
    for a in refs:
        for b in refs:
            if a < b and (common := signs[a] & signs[b]):
                near = [float(np.abs(np.array(v) - np.array(w)).mean()) for v in refs[a] for w in refs[b] if len(v) == len(w)]
                if near and min(near) <= threshold:
                    out[a, b] = (round(min(near), 6), " | ".join(sorted(common)))
    return out


def test_near_pairs_of_a_signature_that_all_share(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i % 150), "all", [float(x) for x in draw.random(3) * 4]) for i in range(200)] + [(int(i), f"s{i % 9}", [0.0, float(i), 1.0]) for i in range(40)]
    rows += [(1, None, [0.0, 0.0, 0.0]), (None, "all", [0.0, 0.0, 0.0]), (2, "all", None), (3, "all", [1.0]), (4, "all", [1.0])]
    table = spark.createDataFrame(rows, "e int, s string, v array<double>")
    want = brute_pairs(rows, 0.3)
    assert len(want) > 50
    for few, block in ((64, 1024), (0, 16), (8, 7)):
        got = {(r["a"], r["b"]): (r["distance"], r["common_signatures"]) for r in N.near_pairs(table, "e", "s", "v", 0.3, few, block).collect()}
        assert got == want
    assert N.near_pairs(table.limit(0), "e", "s", "v").count() == 0


def test_a_hot_signature_runs_in_many_tasks(spark):
    rows = [(i, "all", [0.001 * i, 0.0]) for i in range(400)]
    each = spark.createDataFrame(rows, "e int, sig string, v array<double>").withColumn("size", F.lit(2))
    groups = N._close_in_rings(each, 0.01, 20)
    assert groups.count() == len(brute_pairs([(e, s, v) for e, s, v in rows], 0.01))


def test_work_arrays_are_bounded(monkeypatch):
    """Unstructured vectors, of which each observation must meet nearly every block: no array holds more than CELLS distances, and results are those of brute force."""
    rng = np.random.default_rng(5)
    w, v = rng.random((6000, 32)), rng.random((3000, 32))
    refs = pd.DataFrame({"ref": np.arange(6000), "entity": np.arange(6000) % 7, "w": list(w)}).sort_values(["entity", "ref"])
    largest, plain = [], M.distances
    monkeypatch.setattr(M, "CELLS", 1 << 14)
    known = M.Local("l1", refs, 16)
    monkeypatch.setattr(M, "distances", lambda kind, a, b: largest.append(len(a) * max(len(b), len(known.parts))) or plain(kind, a, b))
    found, _, low, _ = M.search("l1", known.rings, known.parts, pd.DataFrame({"obs": np.arange(3000), "v": list(v), "reach": -1.0}), 1, 0.0, False)
    assert max(largest) <= M.CELLS
    assert np.allclose(low, plain("l1", v, w).min(1)) and set(found["obs"]) == set(range(3000))


def test_dealt_references_lie_in_bins(spark, monkeypatch):
    """Several bins, two lengths of vectors, several tasks for a bin: the same as when all is broadcast."""
    monkeypatch.setattr(M, "GROUP", 8 * 4 * 100)
    monkeypatch.setattr(M, "VISITORS", 60)
    rng = np.random.default_rng(6)
    rows = lambda n, at: [(at + i, int(rng.integers(6)), rng.random(4 if i % 5 else 3).tolist()) for i in range(n)]
    obs, refs = (spark.createDataFrame(r, "id long, e int, v array<double>") for r in (rows(90, 0), rows(400, 50)))
    ask = lambda small: M.nearest_entities(obs, refs, "id", "id", "e", "v", 2, within=0.02, leave_out=True, small=small, block=8).toPandas()
    far, near = (t.sort_values(["id", "distance", "entity"]).reset_index(drop=True) for t in (ask(0), ask(1 << 20)))
    pd.testing.assert_frame_equal(far, near)


@pytest.mark.parametrize("kind", ["l1", "l2", "rmse"])
def test_bounds_hold_for_odd_numbers(kind, monkeypatch):
    """Bounds of sums enclose the distances, whatever the numbers, and what they leave open holds the nearest."""
    monkeypatch.setattr(M, "FEW", 8)
    rng = np.random.default_rng(8)
    plain = rng.standard_normal((80, 5))
    tables = [plain, plain * 1e-20, plain + 1e9, plain * 1e16, np.ones((80, 5)), rng.standard_normal((80, 1)), np.where(rng.random((80, 5)) < 0.05, 1e6, plain)]
    for w in tables:
        v = np.concatenate([w[:20] + 0.01 * rng.standard_normal((20, w.shape[1])), 3 * w[:20], w[:5]])
        part = M.Part(kind, np.arange(80), np.arange(80) // 9, w)
        got, d, row = part.asked(v), M.distances(kind, v, w), np.arange(len(v))[:, None]
        assert (got.low(got.sums, row) <= d).all() and (d <= got.high(got.sums, row)).all()
        row, group = (x.ravel() for x in np.indices((len(v), len(part.first))))
        place, least = part.least(got, v, row, group, None)
        for r, g, p, x in zip(row, group, place, least):
            own = d[r, part.first[g] : part.first[g] + 9]
            assert x == own.min() and p == part.first[g] + own.argmin()


def test_true_entities_are_ranked_with_few_rows(spark):
    """Unstructured vectors, of which every block holds every entity: an observation's reach shrinks to its true entity's distance."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(5)), rng.random(24 if i % 40 else 23).tolist()) for i in range(900)]
    obs, refs = [r for r in rows if r[0] % 5 == 0], [r for r in rows if r[0] % 5]
    want = brute("l1", obs, refs)
    seen, table = (spark.createDataFrame(x, SCHEMA) for x in (obs, refs))
    known = N.truth_reach(seen, table, "id", "id", "e", "v", "e")
    for small in (M.SMALL, 0):
        got = found(M.nearest_entities(known, table, "id", "id", "e", "v", 2, reach="reach", truth="e", small=small, block=64))
        assert got == {i: want[i][: max(2, 1 + [x for _, x, _ in want[i]].index(e))] if e in [x for _, x, _ in want[i]] else want[i][:2] for i, e, _ in obs if i in want}
    whole = pd.DataFrame([r for r in refs if len(r[2]) == 24], columns=["ref", "entity", "w"]).sort_values(["entity", "ref"])
    asked = pd.DataFrame([(i, v, 9.0, e) for i, e, v in obs if len(v) == 24], columns=["obs", "v", "reach", "truth"])
    local = M.Local("l1", whole, 16)
    out = M.search("l1", local.rings, local.parts, asked, 2, 0.0, False)[0]
    assert len(out) <= sum(max(2, 1 + [x for _, x, _ in want[i]].index(e)) for i, e in zip(asked["obs"], asked["truth"])) + len(asked)


def test_vectors_are_searched_once(spark):
    """A rerank asks several times for the nearest entities, which are found once."""
    rows = vectors(spark, 60, 10, clusters=4)
    table, count = spark.createDataFrame(rows, SCHEMA), spark.sparkContext.accumulator(0)
    near = M.nearest_entities(table, table, "id", "id", "e", "v", 2, within=0.5, leave_out=True, compared=count)
    near.count()
    once = count.value
    again = N.rerank(near, N.entity_distances(table, table, "id", "id", "e", "v", "l2", True), "id", 0.02, 0.5)
    assert again.count() == near.groupBy("id").count().filter("count > 1").count()
    assert count.value == once > 0
