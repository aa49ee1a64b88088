"""The pipeline against a chain of plain loops, and every stage on odd rows."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import bpe, mixing, quality, queries
from tests.conftest import SF

STAGES = dict(corpus_pipeline.STAGES)


def plain_statistics(text):
    """The statistics of one text, by loops over its bytes and words."""
    raw = (text or "").encode()
    kinds = collections.Counter()

    def kind(b):
        if 97 <= b <= 122:
            return "lower"
        if 65 <= b <= 90:
            return "upper"
        if 48 <= b <= 57:
            return "digit"
        if b in b"!,.:;?":
            return "stop"
        if b == 10:
            return "newline"
        if b in b"\t\x0b\x0c\r ":
            return "blank"
        if b >= 128:
            return "high"
        return "control" if b < 32 or b == 127 else "mark"

    for b in raw:
        kinds[kind(b)] += 1
    words = raw.split()
    n, many = len(words), max(1, len(words))
    mean, square = sum(map(len, words)) / many, sum(len(w) ** 2 for w in words) / many
    pairs = set(zip(words[:-1], words[1:]))
    ends = collections.Counter(kind(w[-1]) for w in words)
    return [
        *(kinds[k] / max(1, len(raw)) for k in quality.KINDS), np.log1p(len(raw)), np.log1p(n), mean, np.sqrt(max(square - mean**2, 0)), len(set(words)) / many,
        max(collections.Counter(words).values(), default=0) / many, ends["mark"] / many, ends["stop"] / many, n / (1 + kinds["newline"]),
        len(pairs) / (n - 1) if n > 1 else 0, raw.count(b"!") / many,
    ]


def plain_score(trees, x):
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_statistics_and_scores_against_loops(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = [r["text"] for r in rows] + ["", " \t\n", "!", "a", "a b", "é! \x00\x7f zz\r\n!?", "x " * 500]
    raw = [t.encode() for t in texts]
    found = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(found, [plain_statistics(t) for t in texts], rtol=1e-12, atol=1e-12)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert len(trees.feature) and np.allclose(trees.score(found), [plain_score(trees, x) for x in found])
    got = {r["doc_id"]: r["score"] for r in queries.op10_quality_gbdt(spark, SF).collect()}
    assert np.allclose([got[r["doc_id"]] for r in rows], trees.score(found[: len(rows)]))


def plain_copies(docs):
    """Of equal texts, white space apart, the longest and then the smallest id."""
    best = {}
    for d in docs:
        key = "".join(c for c in d["text"] or "" if c not in " \t\n\x0b\x0c\r")
        rank = (-len(d["text"] or ""), d["doc_id"])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, d)
    return [d for _, d in best.values()]


def plain_near(docs, width=5, low=80):
    """One document, that of the smallest id, of each component of links."""
    sets = []
    for d in docs:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (d["text"] or "").encode())
        w = raw.split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    name = list(range(len(docs)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= low * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                name[max(a, b, key=lambda k: docs[k]["doc_id"])] = min(a, b, key=lambda k: docs[k]["doc_id"])
    return [d for i, d in enumerate(docs) if root(i) == i]


def plain_fill(budget, children):
    """{name: tokens} of (name, capacity, weight): full children first, then shares by weight of what is left."""
    got, left = {}, list(children)
    while full := [c for c in left if c[1] * sum(w for *_, w in left) <= c[2] * budget]:
        name, capacity, _ = min(full, key=lambda c: c[1] / c[2])
        got[name] = capacity
        budget -= capacity
        left = [c for c in left if c[0] != name]
    weight = sum(w for *_, w in left)
    return got | {name: budget * w // weight for name, _, w in left}


def plain_mix(docs):
    leaves = collections.defaultdict(list)
    for d in docs:
        source = d["source"] or ""
        domain = f"domain{int(hashlib.md5(source.encode()).hexdigest()[:2], 16) % 3}"
        leaves[domain, d["lang"] or "", source].append((d, len((d["text"] or "").encode().split())))
    tokens = {leaf: sum(n for _, n in rows) for leaf, rows in leaves.items()}
    budgets = {(): sum(tokens.values()) * 9 // 10}
    for depth, weigh in enumerate((lambda n: mixing.DOMAINS.get(n, 1), lambda n: mixing.LANGUAGES.get(n, 1), lambda n: 1)):
        for path in [p for p in budgets if len(p) == depth]:
            names = {leaf[depth] for leaf in leaves if leaf[:depth] == path}
            children = [(path + (n,), sum(t for leaf, t in tokens.items() if leaf[: depth + 1] == path + (n,)), weigh(n)) for n in names]
            budgets |= plain_fill(budgets[path], children)
    kept = []
    for leaf, rows in leaves.items():
        epochs, rest = divmod(budgets[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        if epochs:
            kept += [d for d, _ in rows]
            continue
        used = 0
        for d, n in sorted(rows, key=lambda r: hashlib.md5(f"1:{epochs}:{r[0]['doc_id']}".encode()).hexdigest()[:15]):
            used += n
            if used > rest:
                break
            kept += [d] if n else []
    return kept


def test_pipeline_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    good = [d for d in rows if plain_score(trees, plain_statistics(d["text"])) >= 0.5]
    kept = plain_mix(plain_near(plain_copies(good)))
    assert 0 < len(kept) < len(good) < len(rows)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path(queries.RANKS))), special_tokens={})
    want = []
    for d in kept:
        ids = library.encode_ordinary(d["text"])
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


LONG = " ".join(f"w{i}" for i in range(700_000))
WORDS = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
#: Nulls in every column, empty texts, ties, rows that repeat, one id with two texts, a text longer than a slice.
ODD = [
    (1, WORDS[0], "en", "s1", 60), (1, WORDS[0], "en", "s1", 60), (1, WORDS[1], "en", "s1", 60), (2, WORDS[0] + " ", "en", "s1", 61), (3, WORDS[1] + " tail", None, None, None),
    (4, None, "en", "s1", 0), (5, "", "en", "s2", 0), (6, " \n", "en", "s2", 2), (None, WORDS[2], "fr", "s2", 60), (None, WORDS[2], "fr", "s2", 60), (None, WORDS[3], "fr", "s3", 60),
    (7, LONG, "de", "s3", len(LONG)), (7, LONG, "de", "s3", len(LONG)), (8, "x y", "es", "s3", 3), (9, "X Y", "es", "s3", 3), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "clash", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tally_sha string, _key int").repartition(5)


def texts(df):
    return collections.Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()[:8]) for r in df.select("doc_id", "text").collect())


def test_stages_on_odd_rows(spark, odd):
    key = lambda k, t: (k, hashlib.sha256((t or "").encode()).hexdigest()[:8])
    scored = STAGES["quality_classifier"](spark, odd, SF)
    assert scored.columns == odd.columns and not texts(scored) - texts(odd)
    single = STAGES["exact_dedup"](spark, odd, SF)
    assert single.columns == odd.columns
    assert texts(single) == collections.Counter([key(2, WORDS[0] + " "), key(1, WORDS[1]), key(3, WORDS[1] + " tail"), key(6, " \n"), key(None, WORDS[2]), key(None, WORDS[3]), key(7, LONG), key(8, "x y"), key(9, "X Y")])
    near = STAGES["ngram_jaccard"](spark, odd, SF)
    wordless = [key(4, None), key(5, ""), key(6, " \n"), key(None, None)]
    assert near.columns == odd.columns
    assert texts(near) == collections.Counter([key(1, WORDS[0]), key(1, WORDS[1]), key(None, WORDS[2]), key(None, WORDS[3]), key(7, LONG), key(8, "x y"), *wordless])
    mixed = STAGES["source_mixing"](spark, near, SF)
    for stage in (scored, single, near, mixed):
        assert {(r["tally_sha"], r["_key"]) for r in stage.collect()} <= {("clash", 1)}
    assert mixed.columns == odd.columns and 0 < mixed.count() <= near.count() and not texts(mixed) - texts(near)
    coded = STAGES["bpe_encode"](spark, odd, SF)
    want = collections.Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ODD)
    assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in coded.collect()) == want


def test_repeated_rows_end_as_one(spark):
    """Equal rows spread over partitions leave one row after the two stages that remove copies."""
    docs = spark.createDataFrame([(1, WORDS[4], "en", "s", 60)] * 3 + [(1, WORDS[5], "en", "s", 60)] * 2, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for name in ("exact_dedup", "ngram_jaccard"):
        assert sorted(texts(STAGES[name](spark, docs, SF)).values()) == [1, 1]
    once = STAGES["ngram_jaccard"](spark, STAGES["exact_dedup"](spark, docs, SF), SF)
    assert sorted(texts(once).values()) == [1, 1]


def test_ids_are_distinct_before_labels_reach_the_driver(spark):
    """A labelled id on very many rows gives one row to learn from."""
    docs = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2).alias("text"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit, quality.fit = quality.fit, lambda x, y: seen.append(len(x)) or fit(x, y)
    try:
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert seen == [1]
