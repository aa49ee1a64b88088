"""op11 to op13 against brute force: edge cases by hand, then the smallest tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import divergence, line_dedup, queries, whitening
from tests.compare import oracle, same
from tests.conftest import SF

U = np.uint64


# op11


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_eigen_against_numpy(size):
    a = np.random.default_rng(size).standard_normal((size, size))
    a = a @ a.T
    k = min(8, size)
    values, vectors = whitening.eigen(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-12, atol=1e-12 * values[0])
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0] * size
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


@pytest.mark.parametrize("a", [np.zeros((6, 6)), 3 * np.eye(6), np.diag([5.0, 5, 5, 1, 1, 1]), np.ones((9, 9)), np.array([[2, 1e-9], [1e-9, 2]]), np.diag([1e-200, 2e-200])])
def test_eigen_of_clusters_and_split_matrices(a):
    values, vectors = whitening.eigen(a, min(5, len(a)))
    scale = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values / scale, np.linalg.eigvalsh(a)[::-1][: len(values)] / scale, atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_sturm_counts():
    d, e = np.array([2.0, 1.0, 3.0, 0.0]), np.array([1.0, 0.5, 0.0])
    truth = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-2, 5, 41) + 1e-3
    assert whitening.below(d, e, at).tolist() == [int((truth < x).sum()) for x in at]


def whitened(rows, k=8):
    """Brute force: Python integers, numpy's eigenvectors, any sign."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in good], dtype=object)
    n, s = len(good), x.sum(0)
    dev = ((n * x - s) ** 2).sum(1)
    y = np.array(n * x - s, dtype=float) / n
    e, p = np.linalg.eigh(y.T @ y / n)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    trace = np.trace(y.T @ y / n)
    return {(i, c + 1): (n, int(dev[r]), (y[r] @ p[:, c]) / math.sqrt(e[c]), e[c] / trace) for r, (i, _) in enumerate(good) for c in range(len(e))}


def test_whitening_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    wanted, got = whitened(rows), queries.op11_whitening(spark, SF).collect()
    assert len(got) == len(wanted)
    sign = {}
    for r in got:
        n, dev, w, share = wanted[r["vec_id"], r["component"]]
        sign.setdefault(r["component"], np.sign(w * r["whitened"]))
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(sign[r["component"]] * r["whitened"] - w) < 1e-7 and abs(r["explained"] / share - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5], 1), (1, [1.0, 2.0, 0.5], 2), (None, [0.0, -1.0, 0.25], 3), (4, [3.0, 1.0, 0.75], 4), (5, [2.0, -2.5, 9.0], 5), (6, None, 6), (7, [nan, 1.0, 1.0], 7), (8, [inf, 1.0, 1.0], 8), (9, [None, 1.0, 1.0], 9), (10, [], 10), (11, [1.0, 2.0], 11), (12, [1e300, 0.0, 0.0], 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    got = whitening.whiten(table.repartition(3)).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 6, None: 3, 4: 3, 5: 3}
    wanted = whitened([r[:2] for r in rows[:5]])
    assert all(r["deviation"] == wanted[r["vec_id"], r["component"]][1] and abs(abs(r["whitened"]) - abs(wanted[r["vec_id"], r["component"]][2])) < 1e-9 for r in got)
    # All alike: no variance, so nothing to whiten by.
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, "vec_id long, embedding array<float>, n int")).collect()
    assert len(flat) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in flat)
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.filter("vec_id = 10")).count() == 0


def test_whitening_far_from_nought(spark):
    """Entries so large that products leave a double's and a long's exact range."""
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1e11, 1e11), draw.uniform(-1, 1), 5e11 + draw.uniform(-1, 1)]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    wanted = whitened(rows)
    assert all(r["deviation"] is None or r["deviation"] == wanted[r["vec_id"], r["component"]][1] for r in got.collect())
    assert {r["deviation"] is None for r in got.collect()} == {v[1] > 2**63 - 1 for v in wanted.values()}
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4


# op12


def brute_lines(rows, least):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    found = collections.Counter(k for _, t in rows for k in {key(line) for line in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if not key(line) or found[key(line)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINE_ROWS = [
    (1, "Same line\nown 1\n\n  SAME LINE \t\n"), (2, "same line\r\nown 2"), (2, "same line\r\nown 2"), (3, None), (4, ""), (5, "\n\n"), (None, "\x0bsame line\x0c"), (6, "É accents\né accents\nÉ accents"),
    (7, "É accents"), (8, " É ACCENTS"), (9, "x" * 70_000 + "\n" + "y" * 300), (10, "x" * 70_000), (11, "x" * 70_000 + " "), (12, "\n".join(f"l{i}" for i in range(3000))), (13, "same line"), (14, "a\nb\na\nb\n"), (15, "same  line\nsameline"),
]


@pytest.mark.parametrize("small", [line_dedup.SMALL, 0])
@pytest.mark.parametrize("least", [1, 2, 3, 300])
def test_line_dedup_odd_rows(spark, small, least):
    table = spark.createDataFrame([(i, t, "k", 1) for i, t in LINE_ROWS], "doc_id long, text string, kept string, n_lines int").repartition(4)
    got = line_dedup.drop_frequent_lines(table, min_docs=least, small=small, hot_docs=4)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(LINE_ROWS, least)
    assert line_dedup.drop_frequent_lines(table.limit(0), small=small).count() == 0


@pytest.mark.parametrize("small", [line_dedup.SMALL, 0])
def test_line_dedup_whole_table(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.drop_frequent_lines(docs, small=small, hot_docs=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows, 10)
    if small:
        same(queries.op12_line_dedup(spark, SF).toPandas(), oracle(SF, queries.ORACLES["op12_line_dedup"]))


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 63, 64, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n * 2, dtype=np.uint64))[:n]
        sizes, words, at = line_dedup.perfect_hash(keys)
        assert sorted(at.tolist()) == list(range(n)) and sizes.sum() == 64 * len(words)
        assert not n or sizes.sum() < 5 * n + 64 * len(sizes)


def test_shards_know_their_keys_only():
    draw, log2 = np.random.default_rng(1), 6
    keys = np.unique(draw.integers(0, 1 << 63, 4000, dtype=np.uint64) * U(2))
    count = {int(k): int(c) for k, c in zip(keys, draw.integers(1, 12, len(keys)))}
    rows = []
    for shard in range(5, 64):  # five shards are unknown
        own = keys[(keys >> U(64 - log2)) == shard]
        sizes, words, at = line_dedup.perfect_hash(own)
        prints, counts = np.zeros(len(own), "<u2"), np.zeros(len(own), "<u1")
        prints[at], counts[at] = line_dedup.fingerprint(own), [count[int(k)] for k in own]
        rows.append((shard, sizes.tobytes(), words.tobytes(), prints.tobytes(), counts.tobytes()))
    random.Random(0).shuffle(rows)
    shards = line_dedup.Shards(rows, 10)
    found = shards.count(keys, (keys >> U(64 - log2)).astype(np.int64))
    assert found.tolist() == [count[int(k)] if k >> U(58) >= 5 else 0 for k in keys]
    other = draw.integers(0, 1 << 63, 100_000, dtype=np.uint64) * U(2) + U(1)
    assert (shards.count(other, (other >> U(64 - log2)).astype(np.int64)) > 0).sum() < 20
    assert line_dedup.Shards([], 10).count(other[:3], np.zeros(3, np.int64)).tolist() == [0, 0, 0]


def test_line_index_of_other_documents(spark):
    corpus = spark.createDataFrame([(i, f"footer\nown {i}") for i in range(12)], "doc_id long, text string")
    index = line_dedup.build_index(corpus)
    assert index.bytes > 0 and index.shards.count() <= 1 << index.log2
    got = line_dedup.drop_frequent_lines(spark.createDataFrame([(1, "new\nFooter")], "doc_id long, text string"), index=index)
    assert got.first()["kept"] == "new"


# op13


def brute_audit(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held, count, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), {}
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups.setdefault(lang, set()).add(source)
        held[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        everywhere = {t: sum(count[lang, s][t] for s in sources) for t in kept}

        def p(n, all_n):
            return 1 + 1_000_000_000 * (n + 1) // (all_n + len(kept))

        for s in sources:
            pairs = [(-sum((p(count[lang, s][t], total[s]) - q) ** 2 // q for t in kept for q in (p(count[lang, o][t], total[o]),)), o.encode(), o) for o in sources - {s}]
            own = [(t, p(count[lang, s][t], total[s]), p(everywhere[t], sum(everywhere.values()))) for t in kept if count[lang, s][t]]
            typical = [(-((a - q) ** 2 // q), t.encode(), t) for t, a, q in own if a > q]
            out += [(lang, s, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(typical)[:top], 1)]
    return sorted(out)


def test_divergence_odd_rows(spark):
    draw = random.Random(5)
    words = ["the", "The", "foo-bar", "foo", "foo,", "BAR", "Éa", "éa", "漢字", "a1b", "--", " x", "ſ", "K", "x.y.x"]
    rows = [(" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))), draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "S1", None, "é"])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", "only", "one"), ("some words here", "lone", "one"), ("a b", "few", "s1"), ("a c", "few", "s2"), ("z " * 40_000, "en", "s1")] + [rows[0]] * 3
    table = spark.createDataFrame([(t, la, s, "x", 1, 2) for t, la, s in rows], "text string, lang string, source string, term string, n int, docs int").repartition(5)
    got = divergence.audit(table, limit=500)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows)
    assert sorted(tuple(r) for r in divergence.audit(table, min_docs=1, top_terms=4).collect()) == brute_audit(rows, 1, 4)
    assert divergence.audit(table.limit(0)).count() == 0
    bare = divergence.audit(table.withColumn("text", F.lit(None).cast("string")))
    assert {(r["part"], r["value"]) for r in bare.collect()} == {("pair", 0)}


def test_divergence_whole_table(spark):
    got = queries.op13_source_divergence(spark, SF).toPandas()
    same(got, oracle(SF, queries.ORACLES["op13_source_divergence"]))
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(got.itertuples(index=False, name=None)) == brute_audit(rows)


def test_exact_parts(spark):
    """Counts whose products leave a long's range."""
    row = spark.range(1).select(divergence._p(F.lit(9 * 10**15), F.lit(10**16), F.lit(7).cast("long")).alias("p"), divergence._f(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert row["p"] == 1 + 10**9 * (9 * 10**15 + 1) // (10**16 + 7) and row["f"] == 10**18


def test_chunks_of_a_slice():
    import pyarrow as pa

    texts = ["a b a", None, "", "b\tc\n", "é  a"]
    kinds, bucket, first, many, chunk, n = divergence._chunks(pa.array(texts), 3)
    kinds, doc = kinds.cast(pa.string()).to_pylist(), np.repeat(np.arange(5), many)
    assert sorted((int(d), kinds[c], int(m)) for d, c, m in zip(doc, chunk, n)) == [(0, "a", 2), (0, "b", 1), (3, "b", 1), (3, "c", 1), (4, "a", 1), (4, "é", 1)]
    assert first[-1] == 4 and len(bucket) == len(first) - 1 and sorted(set(bucket)) == bucket.tolist()
    for numbers in ([0, 70000, 3], [1, 2], [1 << 40, 5], []):
        assert divergence._unpack(divergence._pack(np.array(numbers, np.int64)), len(numbers)).tolist() == numbers


def test_sums_of_many_slices(spark):
    """Slices of a document or two, added up three at a time."""
    rows = [("the end " + "abcdefg"[k % 7], "en", f"s{k % 3}") for k in range(60)]
    table = spark.createDataFrame(rows, "text string, lang string, source string")
    got = {(r["source"], r["term"]): (r["n"], r["all"]) for r in divergence.count_terms(table, limit=12, fan=3).collect()}
    assert got[("s0", "the")] == (20, 60) and len(got) == 3 * 9
    first = divergence.count_terms(table, limit=12, fan=3).agg(F.sum("first")).first()[0]
    assert first == 9
