"""Source divergence audit: how the terms of each source differ from its language's and from other sources'.

White-space chunks are counted per document and packed a slice of documents at a time.  The
slices' distinct chunks travel in packed rows to buckets by their text, where each globally
distinct chunk is cut into terms once; the terms return to the packed counts of their
slices, where documents and occurrences of a term are counted, every document in one slice.
Packed rows of these counts go to buckets of terms and are added up, a bounded number of
slices at a time, so that a term that all slices hold is no burden.

A pair of sources sums over all kept terms, most of which neither has.  f is constant there,
and where one source alone has the term it depends on that source's count alone: these sums
come from how often each count occurs.  Only terms that both have are looked at one by one,
in blocks of terms, and give sums by pair, never rows by pair and term.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import IS_WORD, U, Words, bucket_count, buffer_of, hash_runs, lean, slices, spans, spill, text_bytes, wide_rows

#: Documents in which a language's term must be; what is added to each count; ranks of terms that are reported.
MIN_DOCS, ADD, TOP_TERMS = 3, 1, 200
#: Probabilities are parts of so many.
SCALE = 1_000_000_000
#: Bytes of text in a slice and behind a bucket; slices that are added up at once.
SLICE, BUCKET, FAN = 16 << 20, 4 << 20, 128
#: Terms times sources that are compared at once.
BLOCK = 1 << 16
#: Fixed value: bytes of which terms are made, once A-Z are lower-cased.
IS_TERM = np.array([c >= 0x80 or 0x61 <= c <= 0x7A for c in range(256)])


def _pack(a: np.ndarray) -> bytes:
    """Numbers in planes of 16 bits, lowest first, as many as the largest needs: high planes are small when compressed."""
    largest = int(a.max(initial=0))
    return b"".join((a >> 16 * k).astype("<u2").tobytes() for k in range(1 if largest < 1 << 16 else 2 if largest < 1 << 32 else 4))


def _unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(b, "<u2").astype(np.int64).reshape(-1, n) if n else np.zeros((1, 0), np.int64)
    return sum(plane << 16 * k for k, plane in enumerate(planes))


def _column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts of these sizes, one after the other in ``data``."""
    cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cut), pa.py_buffer(data)])


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct texts and the place of each text among them."""
    coded = texts.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64)


def _hashes(texts: pa.Array) -> np.ndarray:
    buf, off = buffer_of(texts)
    data = np.concatenate([buf[off[0] : off[-1]], np.zeros(16, np.uint8)])
    return hash_runs(data, off[:-1] - off[0], off[1:] - off[0])


def _dealt(texts: pa.Array, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct texts in order of bucket, the new place of each, the buckets that occur and where they begin (and the end)."""
    bucket = (_hashes(texts) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return texts.take(pa.array(order)), place, bucket[first], np.append(first, len(bucket))


def _between(texts: pa.Array, lo: int, hi: int) -> tuple[bytes, bytes]:
    """Bytes and packed sizes of texts[lo:hi]."""
    buf, off = buffer_of(texts)
    return buf[off[lo] : off[hi]].tobytes(), _pack(np.diff(off[lo : hi + 1]))


def _joined(rows: list[dict], count: str, texts: str = "texts", sizes: str = "sizes") -> pa.Array:
    """Packed texts of several rows, one after the other."""
    size = [_unpack(r[sizes], r[count]) for r in rows]
    return _column(np.frombuffer(b"".join(r[texts] for r in rows), np.uint8), np.concatenate(size) if size else np.zeros(0, np.int64))


def _texts(words: Words, kind: np.ndarray) -> pa.Array:
    """The words one after the other, as an Arrow column."""
    data = words.data[: words.size]
    return _column(data[kind[data]], words.end - words.start)


def _chunks(texts: pa.Array, buckets: int):
    """Distinct chunks of a slice in order of bucket, the buckets and where they begin, how many chunks each document has, and then by document and chunk the chunk and its count."""
    words = Words(*buffer_of(texts))
    kinds, index = _coded(_texts(words, IS_WORD))
    kinds, place, bucket, first = _dealt(kinds, buckets)
    size = max(1, len(kinds))
    pair = np.repeat(np.arange(len(texts)), np.diff(words.doc)) * size
    del words
    pair, n = np.unique(pair + place[index], return_counts=True)
    return kinds, bucket, first, np.bincount(pair // size, minlength=len(texts)), pair % size, n


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to about ``limit`` bytes of their first column."""
    waiting, size = [], 0
    for batch in batches:
        for part in slices(batch, batch.schema.names[0], limit):
            waiting.append(part)
            size += part.column(0).nbytes
            if size >= limit:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


GROUPS = "groups array<struct<lang string, source string>>"
PACKED = f"slice long, {GROUPS}, docs long, pairs long, grp binary, many binary, step binary, n binary, parts array<struct<bucket: long, lo: long, chunks: long, texts: binary, sizes: binary>>"
CELLS = f"bucket long, part long, {GROUPS}, terms long, texts binary, sizes binary, many binary, cells long, grp binary, docs binary, n binary"


def count_chunks(docs: DataFrame, text_col: str, lang_col: str, source_col: str, buckets: int, limit: int = SLICE) -> DataFrame:
    """A row per slice of documents: its groups (lang, source), for each document its group and chunks with their counts, and the distinct chunks by bucket."""
    kind = pa.schema([
        ("slice", pa.int64()), ("groups", pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))), ("docs", pa.int64()), ("pairs", pa.int64()), ("grp", pa.binary()), ("many", pa.binary()), ("step", pa.binary()), ("n", pa.binary()),
        ("parts", pa.list_(pa.struct([("bucket", pa.int64()), ("lo", pa.int64()), ("chunks", pa.int64()), ("texts", pa.binary()), ("sizes", pa.binary())]))),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, limit):
            kinds, bucket, first, many, chunk, n = _chunks(part.column(0), buckets)
            lang, source = (part.column(i).fill_null("") for i in (1, 2))
            groups: dict[tuple, int] = {}
            code = np.array([groups.setdefault(g, len(groups)) for g in zip(lang.to_pylist(), source.to_pylist())], np.int64)
            start = (np.cumsum(many) - many)[many > 0]
            step = np.diff(chunk, prepend=0)  # small numbers, as a document's chunks are in order
            step[start] = chunk[start]
            parts = [{"bucket": b, "lo": lo, "chunks": hi - lo} | dict(zip(("texts", "sizes"), _between(kinds, lo, hi))) for b, lo, hi in zip(bucket.tolist(), first[:-1].tolist(), first[1:].tolist())]
            row = {"slice": random.getrandbits(63), "groups": [{"lang": a, "source": b} for a, b in groups], "docs": len(many), "pairs": len(chunk), "parts": parts}
            yield pa.RecordBatch.from_pylist([row | {"grp": _pack(code), "many": _pack(many), "step": _pack(step), "n": _pack(n)}], kind)

    only = docs.select(F.col(f"`{text_col}`").alias("_tally_text"), F.col(f"`{lang_col}`").cast("string"), F.col(f"`{source_col}`").cast("string"))
    return wide_rows(only).mapInArrow(lean(pack), PACKED)


def cut_terms(rows: pa.Table) -> pa.Table:
    """Terms of the chunks of a bucket, each distinct chunk cut once: a packed row goes back to each slice."""
    asked = rows.to_pylist()
    kinds, index = _coded(_joined(asked, "chunks"))
    words = Words(*buffer_of(kinds), lower=True, kind=IS_TERM)
    many = np.diff(words.doc)[index]
    terms = _texts(words, IS_TERM).take(pa.array(spans(words.doc[:-1][index], many)))
    chunk, end, out, at = np.cumsum([0, *(r["chunks"] for r in asked)]), np.concatenate([[0], np.cumsum(many)]), [], 0
    for r, a, b in zip(asked, chunk[:-1], chunk[1:]):
        texts, sizes = _between(terms, end[a], end[b])
        out.append({"s": r["s"], "lo": r["lo"], "chunks": r["chunks"], "many": _pack(many[a:b]), "terms": int(end[b] - end[a]), "texts": texts, "sizes": sizes})
    return pa.Table.from_pylist(out, pa.schema([("s", pa.int64()), ("lo", pa.int64()), ("chunks", pa.int64()), ("many", pa.binary()), ("terms", pa.int64()), ("texts", pa.binary()), ("sizes", pa.binary())]))


CELL_TYPE = pa.schema([
    ("bucket", pa.int64()), ("part", pa.int64()), ("groups", pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))), ("terms", pa.int64()), ("texts", pa.binary()), ("sizes", pa.binary()), ("many", pa.binary()),
    ("cells", pa.int64()), ("grp", pa.binary()), ("docs", pa.binary()), ("n", pa.binary()),
])


def _cell_row(bucket: int, part: int, groups: list, terms: pa.Array, lo: int, hi: int, term: np.ndarray, grp: np.ndarray, docs: np.ndarray, n: np.ndarray) -> dict:
    """Cells of terms[lo:hi], in order of term, as one packed row with the groups that occur in it."""
    texts, sizes = _between(terms, lo, hi)
    used, grp = np.unique(grp, return_inverse=True)
    many = np.bincount(term - lo, minlength=hi - lo)
    return {"bucket": bucket, "part": part, "groups": [groups[g] for g in used], "terms": hi - lo, "texts": texts, "sizes": sizes, "many": _pack(many), "cells": len(grp), "grp": _pack(grp), "docs": _pack(docs), "n": _pack(n)}


def _in_slice(named: pa.Table, packed: pa.Table, buckets: int) -> pa.Table:
    """Documents and occurrences by group and term in one slice, a packed row for each bucket of terms."""
    if not named.num_rows or not packed.num_rows:
        return CELL_TYPE.empty_table()
    row, parts = packed.to_pylist()[0], sorted(named.to_pylist(), key=lambda r: r["lo"])
    group, many = _unpack(row["grp"], row["docs"]), _unpack(row["many"], row["docs"])
    step, n = _unpack(row["step"], row["pairs"]), _unpack(row["n"], row["pairs"])
    doc, first = np.repeat(np.arange(row["docs"]), many), np.cumsum(many) - many
    chunk = np.cumsum(step)
    chunk -= (chunk - step)[first[doc]]
    size = np.concatenate([_unpack(r["many"], r["chunks"]) for r in parts])
    terms, codes = _coded(_joined(parts, "terms"))
    terms, place, bucket, begin = _dealt(terms, buckets)
    kinds, many_groups = max(1, len(terms)), len(row["groups"])
    # One entry for each (document, chunk, term of the chunk).
    entry = np.repeat(np.arange(len(chunk)), size[chunk])
    term = place[codes][spans((np.cumsum(size) - size)[chunk], size[chunk])]
    pair, back = np.unique(doc[entry] * kinds + term, return_inverse=True)
    times = np.bincount(back, n[entry], len(pair))
    cell, back = np.unique(pair % kinds * many_groups + group[pair // kinds], return_inverse=True)
    docs, total = np.bincount(back, minlength=len(cell)), np.bincount(back, times, len(cell)).astype(np.int64)
    term, grp = cell // many_groups, cell % many_groups
    cut = np.searchsorted(term, begin)
    return pa.Table.from_pylist([_cell_row(b, row["slice"], row["groups"], terms, lo, hi, term[x:y], grp[x:y], docs[x:y], total[x:y]) for b, lo, hi, x, y in zip(bucket.tolist(), begin[:-1].tolist(), begin[1:].tolist(), cut[:-1], cut[1:])], CELL_TYPE)


def _added(rows: list[dict]) -> tuple[list, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(groups, terms, term and group of each cell, its documents, its occurrences) of packed rows of one bucket, added up and in order of term."""
    terms, code = _coded(_joined(rows, "terms"))
    cells = [_unpack(r["many"], r["terms"]) for r in rows]
    known: dict[tuple, int] = {}
    own = [np.array([known.setdefault((g["lang"], g["source"]), len(known)) for g in r["groups"]], np.int64)[_unpack(r["grp"], r["cells"])] for r in rows]
    term, grp = np.repeat(code, np.concatenate(cells)), np.concatenate(own)
    docs, n = (np.concatenate([_unpack(r[c], r["cells"]) for r in rows]) for c in ("docs", "n"))
    cell, back = np.unique(term * len(known) + grp, return_inverse=True)
    docs, n = (np.bincount(back, x, len(cell)).astype(np.int64) for x in (docs, n))
    return [{"lang": a, "source": b} for a, b in known], terms, cell // len(known), cell % len(known), docs, n


def _add_up(rows: pa.Table) -> pa.Table:
    """Packed rows of some slices as one."""
    listed = rows.to_pylist()
    groups, terms, term, grp, docs, n = _added(listed)
    return pa.Table.from_pylist([_cell_row(listed[0]["bucket"], listed[0]["part"], groups, terms, 0, len(terms), term, grp, docs, n)], CELL_TYPE)


KEPT = "lang string, source string, bucket long, code long, term string, n long, all long, first long"


def _kept(rows: pa.Table, min_docs: int) -> pa.Table:
    """Cells of the terms that a language keeps: (lang, source, term, n), ``all`` over its sources, and ``first`` for one cell of each (lang, term)."""
    listed = rows.to_pylist()
    groups, terms, term, grp, docs, n = _added(listed)
    langs: dict[str, int] = {}
    lang = np.array([langs.setdefault(g["lang"], len(langs)) for g in groups], np.int64)[grp]
    _, one, back = np.unique(term * len(langs) + lang, return_index=True, return_inverse=True)
    held, total = (np.bincount(back, x, len(one)).astype(np.int64) for x in (docs, n))
    first = np.zeros(len(term), np.int64)
    first[one] = 1
    keep = np.flatnonzero(held[back] >= min_docs)
    name = {k: pa.array([g[k] for g in groups], pa.string()).take(pa.array(grp[keep])) for k in ("lang", "source")}
    bucket = pa.array(np.full(len(keep), listed[0]["bucket"]), pa.int64())
    return pa.table([name["lang"], name["source"], bucket, pa.array(term[keep]), terms.take(pa.array(term[keep])).cast(pa.string()), pa.array(n[keep]), pa.array(total[back][keep]), pa.array(first[keep])], names=["lang", "source", "bucket", "code", "term", "n", "all", "first"])


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, limit: int = SLICE, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """(lang, source, bucket, code, term, n, all, first): occurrences in each group of the terms that ``min_docs`` documents of its language hold, and in the language.

    ``code`` tells the terms of a bucket apart; ``first`` is 1 for one row of each (lang, term).
    """
    buckets = bucket_count(text_bytes(docs, text_col), bucket, 64)
    packed = spill(count_chunks(docs, text_col, lang_col, source_col, buckets, limit), "chunk-counts")
    slices_ = packed.count()
    asked = packed.select(F.col("slice").alias("s"), F.inline("parts"))
    named = asked.groupBy("bucket").applyInArrow(cut_terms, "s long, lo long, chunks long, many binary, terms long, texts binary, sizes binary")
    cells = named.groupBy("s").cogroup(packed.drop("parts").groupBy("slice")).applyInArrow(lambda a, b: _in_slice(a, b, buckets), CELLS)
    while slices_ > fan:
        slices_ = -(-slices_ // fan)
        cells = cells.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(slices_)))
        cells = cells.groupBy("bucket", "part").applyInArrow(_add_up, CELLS)
    return cells.groupBy("bucket").applyInArrow(lambda rows: _kept(rows, min_docs), KEPT)


def _p(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + ADD) / (total + ADD * kinds)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADD).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", top, (total + ADD * kinds).cast("decimal(19,0)")).cast("long")


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _joint(cells: pa.Table) -> pa.Table:
    """Over the terms of a bucket, the sum by pair of sources that both have a term of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)."""
    sources = cells["source"].combine_chunks().dictionary_encode()
    sources = sources.combine_chunks() if isinstance(sources, pa.ChunkedArray) else sources
    s, (kinds, t) = np.asarray(sources.indices), np.unique(cells["code"].to_numpy(), return_inverse=True)
    many = len(sources.dictionary)
    zero = np.zeros(many, np.int64)
    zero[s] = cells["p0"].to_numpy()
    lang, out, total = cells["lang"][0].as_py(), [], np.zeros((many, many), np.int64)
    met = np.zeros((many, many), bool)

    def f(a, b):
        return (a - b) ** 2 // b

    order = np.argsort(t, kind="stable")
    step = max(1, BLOCK // many)  # terms at a time
    for lo in range(0, len(kinds), step):
        at = order[slice(*np.searchsorted(t[order], [lo, lo + step]))]
        p = np.zeros((step, many), np.int64)
        p[t[at] - lo, s[at]] = cells["p"].to_numpy()[at]
        has = p > 0
        for g in np.flatnonzero(has.any(0)):
            rows = np.flatnonzero(has[:, g])
            q, mine = np.where(has[rows], p[rows], 1), p[rows, g][:, None]
            total[g] += np.where(has[rows], f(mine, q) - f(mine, zero) - f(zero[g], q) + f(zero[g], zero), 0).sum(0)
            met[g] |= has[rows].any(0)
    np.fill_diagonal(met, False)
    for g in range(many):
        other = np.flatnonzero(met[g])
        out.append(pa.table([pa.array([lang] * len(other), pa.string()), sources.dictionary.take(pa.array(np.full(len(other), g))), sources.dictionary.take(pa.array(other)), pa.array(total[g, other])], names=["lang", "source", "item", "s"]))
    return pa.concat_tables(out)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, limit: int = SLICE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: other sources of its language and its most typical terms.

    A null text, language or source is an empty one; a group without terms still compares;
    a language's only source has no pairs; without kept terms all pairs have value 0 and
    there are no terms; every row is a document of its own, repeated ones too; ties rank by
    item; a text is read whole however long; an empty table gives no rows; other columns are
    ignored whatever their names.
    """
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col))
    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct()
    cells = spill(count_terms(docs, text_col, lang_col, source_col, min_docs, limit), "kept-cells")
    langs = cells.groupBy(F.col("lang").alias("l")).agg(F.sum("first").alias("v"), F.sum(F.col("first") * F.col("all")).alias("lang_n"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("own_v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    facts = groups.join(own, ["lang", "source"], "left").join(langs, F.col("lang") == F.col("l"), "left")
    facts = facts.select("lang", "source", zero("own_n").alias("own_n"), zero("own_v").alias("own_v"), zero("v").alias("v"), zero("lang_n").alias("lang_n"))
    facts = spill(facts.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("own_n"), F.col("v")))), "group-facts", narrow=True)
    measured = cells.join(facts, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("own_n"), F.col("v")))
    return _pairs(facts, measured).unionByName(_terms(measured, top_terms))


def _terms(measured: DataFrame, top: int) -> DataFrame:
    rated = measured.withColumn("q", _p(F.col("all"), F.col("lang_n"), F.col("v"))).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rated.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pairs(facts: DataFrame, measured: DataFrame) -> DataFrame:
    left = facts.select("lang", "source", F.col("own_v").alias("v1"), F.col("p0").alias("z1"), "v")
    right = facts.select("lang", F.col("source").alias("item"), F.col("own_v").alias("v2"), F.col("p0").alias("z2"))
    pairs = left.join(right, "lang").filter("source != item")  # the result's own rows
    both = F.coalesce((F.col("v") - F.col("v1") - F.col("v2")) * _f(F.col("z1"), F.col("z2")), F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", "item", both.alias("s"))
    # Terms that one side has: its counts, and how many terms have each, against the other side's p of no occurrence.
    often = spill(measured.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")), "count-histogram", narrow=True)
    other = facts.select("lang", F.col("source").alias("item"), F.col("p0").alias("z"))
    met = often.join(other, "lang").filter("source != item")
    mine = met.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _f(F.col("p"), F.col("z"))).alias("s"))
    theirs = met.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("k") * _f(F.col("z"), F.col("p"))).alias("s"))
    # Terms that both have, a bucket at a time.
    joint = measured.select("lang", "source", "bucket", "code", "p", "p0").groupBy("lang", "bucket").applyInArrow(_joint, "lang string, source string, item string, s long")
    joint = joint.groupBy("lang", "source", "item").agg(F.sum("s").alias("s"))
    value = pairs.unionByName(mine).unionByName(theirs).unionByName(joint).groupBy("lang", "source", "item").agg(F.sum("s").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))


ORACLE = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
    k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
    l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
    g AS (
        SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS total
        FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (c JOIN k USING (lang, term)) c ON c.lang = x.lang AND c.source = x.source
        GROUP BY ALL),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
               1 + 1000000000 * (k.n + 1) // (l.total + l.v) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pair AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
