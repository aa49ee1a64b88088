"""Second looks at ambiguous sets, against loops over each set."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark.functions.vectors import row_words
from tallyspark.operators import nearest as N
from tallyspark.operators import rerank as K


def bits(rows):
    return [int(b) for r in rows for c in r for b in f"{int(c, 16):04b}"]


def measure(seen, known, others):
    """Share of weight of the bits that differ; those that vary among ``others`` weigh five times."""
    if len(seen) != len(known) or sum(map(len, seen)) != sum(map(len, known)):
        return 1.0
    weight = [5 if len(set(column)) > 1 else 1 for column in zip(*map(bits, others))]
    return sum(w for w, a, b in zip(weight, bits(seen), bits(known)) if a != b) / sum(weight)


def sets(seed, n=60):
    """(observation, seen), and (observation, entity, chart, known) with ties, equal keys and sets that don't vary."""
    draw = random.Random(seed)
    row = lambda: draw.choice(["00000000000000000000", "0f0f0f0f0f0f0f0f0f0f", "0f0f0f0f0f0f0f0f0f0e", "ffff0000ffff0000ffff"])
    obs, pairs = [], []
    for i in range(n):
        known = [[row(), row()] for _ in range(draw.choice([1, 2, 5]))]
        if i % 7 == 0:
            known = known[:1] * 3
        seen = None if i % 11 == 0 else list(draw.choice(known)) if i % 3 == 0 else [row(), row()]
        obs.append((i, seen))
        if i % 13 != 5:
            pairs += [(i, k % 3, 10 * i + k, v) for k, v in enumerate(known)]
    return obs, pairs


def frames(spark, obs, pairs):
    return spark.createDataFrame(obs, "obs int, seen array<string>"), spark.createDataFrame(pairs, "obs int, entity int, chart int, known array<string>")


def by_set(pairs):
    out = defaultdict(list)
    for i, *rest in pairs:
        out[i].append(tuple(rest))
    return out


def test_words_of_rows(spark):
    df = spark.createDataFrame([(["0f", "a1"] * 9,), ([],), (["ff"],)], "r array<string>")
    assert [sum(bin(w).count("1") for w in r[0]) for r in df.select(row_words(F.col("r"))).collect()] == [63, 0, 8]


def test_near_tie_chain(spark):
    obs, pairs = sets(1)
    o, p = frames(spark, obs, pairs)
    got = {r["obs"]: (r["entity"], round(r["distance"], 9), r["margin"] and round(r["margin"], 9), r["chain"]) for r in K.near_tie_chain(p.join(o.filter("seen IS NOT NULL"), "obs"), "obs", "entity", "seen", "known").collect()}
    seen, want = dict(obs), {}
    for i, rows in by_set(pairs).items():
        if seen[i] is None:
            continue
        exact = {e for e, _, k in rows if k == seen[i]}
        if len(exact) == 1:
            want[i] = (exact.pop(), 0.0, None, "row_keys")
        elif not exact and len({tuple(k) for *_, k in rows}) > 1:
            best = sorted((min(measure(seen[i], k, [x for *_, x in rows]) for e2, _, k in rows if e2 == e), e) for e in {e for e, *_ in rows})
            if len(best) > 1 and best[0][0] <= 0.35 and best[1][0] - best[0][0] > 0.01:
                want[i] = (best[0][1], round(best[0][0], 9), round(best[1][0] - best[0][0], 9), "masked")
    assert got == want and {"row_keys", "masked"} == {v[3] for v in want.values()}
    assert len(want) < len(by_set(pairs))


def test_row_key_rerank(spark):
    obs, pairs = sets(2, 90)
    o, p = frames(spark, obs, pairs)
    got = {r["obs"]: r for r in K.row_key_rerank(o, p, "obs", "entity", "chart", "seen", "known", []).collect()}
    assert len(got) == len(obs)
    groups, statuses = by_set(pairs), Counter()
    for i, seen in obs:
        r, rows = got[i], groups.get(i)
        if seen is None or not rows:
            assert (r["exact_status"], r["dict_status"], r["distance_status"]) == ("missing_feature",) * 3
            assert r["reason"] == ("row_keys_unavailable" if seen is None else "no_candidate_row_keys")
            continue
        exact = {e for e, _, k in rows if k == seen}
        agree = lambda k: sum(a == b and int(a, 16) != 0 for a, b in zip(seen, k))
        alike = min((-agree(k), c, e) for e, c, k in rows)
        near = min((measure(seen, k, [x for *_, x in rows]), c, e) for e, c, k in rows)
        tied = any(e != alike[2] and agree(k) == -alike[0] for e, _, k in rows)
        close = any(e != near[2] and measure(seen, k, [x for *_, x in rows]) - near[0] <= 0.01 for e, _, k in rows)
        assert r["exact_status"] == ("no_exact_match" if not exact else "resolved_candidate" if len(exact) == 1 else "ambiguous_candidate")
        assert r["dict_status"] == ("no_dict_match" if not alike[0] else "ambiguous_candidate" if tied else "resolved_candidate")
        assert r["distance_status"] == ("ambiguous_candidate" if close else "resolved_candidate")
        assert (r["dict_chart"], r["dict_rows"], r["top_chart"], round(r["top_distance"], 9)) == (alike[1], -alike[0], near[1], round(near[0], 9))
        assert r["reason"] == ("no_matching_rows" if not alike[0] else "tied_row_matches" if tied else "near_top_distance" if close else "") and r["reference_count"] == len(rows)
        statuses.update([r["exact_status"], r["dict_status"], r["distance_status"], r["reason"]])
    assert len(statuses) == 8


def test_gated_stages_with_a_chain_and_the_last_check(spark):
    ambiguous = spark.createDataFrame([(i, e) for i in range(7) for e in (1, 2)], "obs int, entity int")
    title = [(0, 1, 0.10), (0, 2, 0.30), (1, 1, 0.10), (1, 2, 0.105), (2, 1, 0.10), (2, 2, 0.105), (3, 1, 0.5), (3, 2, 0.6), (4, 1, 0.1), (5, 1, 0.5), (5, 2, 0.5), (6, 1, 0.1), (6, 2, 0.2)]
    artist = [(i, 1, 0.2) for i in range(5)] + [(i, 2, 0.1) for i in range(5)] + [(5, 1, 0.1), (5, 2, 0.1)]
    chain = spark.createDataFrame([(1, 2, 0.0, None, "row_keys"), (0, 2, 0.0, None, "row_keys")], "obs int, entity int, distance double, margin double, chain string")
    stages = [(n, spark.createDataFrame(d, "obs int, entity int, distance double")) for n, d in (("title", title), ("artist", artist))]
    out = N.gated_rerank(ambiguous, stages, "obs", chains={"title": chain})
    charts = spark.createDataFrame([(0, 1, 10), (1, 2, 11), (1, 2, 12), (2, 2, 13), (2, 2, 13), (4, 2, 14)], "obs int, entity int, chart int")
    got = {r["obs"]: (r["title_state"], r["entity"], r["decided_by"], r["chart_status"], r["chart"]) for r in K.one_chart(out, charts, "obs", "entity", "chart").collect()}
    assert got == {
        0: ("resolved", 1, "title", "resolved", 10), 1: ("resolved_row_keys", 2, "title", "chart_ambiguous", None), 2: ("ambiguous", 2, "artist", "resolved", 13), 3: ("insufficient", 2, "artist", "chart_not_found", None),
        4: ("incomplete", 2, "artist", "resolved", 14), 5: ("insufficient", None, None, "unresolved", None), 6: ("resolved", 1, "title", "chart_not_found", None),
    }
    assert {r["obs"]: (r["distance"], r["margin"]) for r in out.collect()}[1] == (0.0, None)


def test_suffix_rerank(spark):
    obs = [(1, "Song ＴＹＰＥ 1", "ok"), (2, "song type2", "ok"), (3, "song", "ok"), (4, "", "ok"), (5, None, "ok"), (6, "type1", "blurred"), (7, "type1", None), (8, "Type 3 type1", "ok"), (9, "type3", "ok")]
    titles = [(1, 10, 100, "A Type1", "songtype1"), (1, 11, 101, "B Type2", "songtype2"), (2, 10, 100, "Z type2", "ztype2"), (2, 11, 101, "A type2", "atype2"), (3, 10, 100, "x", "x"), (8, 10, 100, "t1", "xtype1"), (8, 10, 102, "t1", "xtype1"), (8, 11, 101, "t3", "xtype3"), (9, 10, 100, "t1", "xtype1")]
    o = spark.createDataFrame(obs, "obs int, text string, status string")
    c = spark.createDataFrame(titles, "obs int, entity int, chart int, title string, key string")
    got = {r["obs"]: (r["suffix"], r["chart"], r["top_candidates"], r["rerank_status"], r["rerank_reason"]) for r in K.suffix_rerank(o, c, "obs", "entity", "chart", "text", "status", "key", ["title"], F.concat_ws("/", "title", "chart")).collect()}
    missing = lambda why: ("", None, "", "missing_ocr", why)
    assert got == {
        1: ("TYPE1", 100, "A Type1/100", "resolved_candidate", ""), 2: ("TYPE2", 101, "A type2/101 | Z type2/100", "ambiguous_candidate", "suffix_matches_multiple_ambiguous_songs"), 3: ("", None, "", "no_suffix", "type_suffix_not_detected"),
        4: missing("empty_ocr"), 5: missing("empty_ocr"), 6: missing("blurred"), 7: missing("title_ocr_not_run"), 8: ("TYPE1", 100, "t1/100 | t1/102", "resolved_candidate", ""), 9: ("TYPE3", None, "", "no_candidate_suffix_match", "suffix_not_in_ambiguous_candidates"),
    }
