"""Frequent lines: documents probe a sharded minimal perfect hash instead of joining lines.

Lines are hashed and counted once per document.  The distinct hashes are dealt to shards by
their top bits; each shard becomes a minimal perfect hash (levels of bits in which keys that
meet no other key rest; a key's index is the rank of its bit) over two compact arrays:
fingerprints of 16 bits, and counts that stop at the threshold.  About 3.7 bits, a
fingerprint and a byte stand for a line of any length.

Shards of up to ``small`` bytes in all are broadcast, and every document is judged where it
lies.  Beyond that no worker could hold them: then (row, hash) pairs visit the shard that
can answer them, after the hottest lines, a list of proven size, are judged from a broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import GAMMA, U, Words, bucket_count, buffer_of, hash_runs, lean, mix, slices, spill, text_bytes, wide_rows

#: Documents in which a line is frequent; bytes of text behind a shard; bytes of shards that are broadcast.
MIN_DOCS, SHARD_BYTES, SMALL = 10, 4 << 20, 32 << 20
#: Bits a key in each level of the perfect hash.
LOAD = 2
#: Lines in so many documents are hot, and at most so many are (8 bytes each).
HOT_DOCS, HOT_LINES = 1_000_000, 4_000_000
SHARD = "shard long, sizes binary, bits binary, prints binary, counts binary"


class Lines:
    """Lines of a slice of texts: bounds, the document of each, and the keys' hashes; an empty key has none."""

    def __init__(self, texts: pa.Array):
        buf, off = buffer_of(texts)
        words = Words(buf, off, lower=True)
        cut = (off - off[0]).astype(np.int64)
        ends = np.flatnonzero(words.data[: words.size] == 10)
        self.start, self.end = np.sort(np.concatenate([cut[:-1], ends + 1])), np.sort(np.concatenate([ends, cut[1:]]))
        self.count = np.searchsorted(ends, cut[1:]) - np.searchsorted(ends, cut[:-1]) + 1
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        # A line's first word starts its key and the last one ends it.
        first, last = np.searchsorted(words.start, self.start), np.searchsorted(words.start, self.end)
        self.filled = np.flatnonzero(first < last)
        self.hash = hash_runs(words.data, words.start[first[self.filled]], words.end[last[self.filled] - 1])
        self.raw = memoryview(buf)[off[0] : off[-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (hash, document) pairs, ordered."""
        doc = self.doc[self.filled]
        order = np.lexsort((doc, self.hash))
        h, d = self.hash[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return h[new], d[new]

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each text without the lines that ``gone`` marks."""
        first = np.cumsum(self.count) - self.count
        lost = np.add.reduceat(gone, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        out = []
        for at, n, some in zip(first.tolist(), self.count.tolist(), lost.tolist()):
            if some:
                out.append(b"\n".join(self.raw[self.start[i] : self.end[i]] for i in range(at, at + n) if not gone[i]))
            else:
                out.append(bytes(self.raw[self.start[at] : self.end[at + n - 1]]))
        return out


def _place(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return mix(keys ^ (U(level + 1) * GAMMA)) % np.asarray(size).astype(U)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each level, the levels' words one after the other, index of each key) for distinct 64-bit keys.

    In a level a key that shares its place with another goes on to the next.  Different keys
    part sooner or later, as every level places them anew.
    """
    sizes, words, level, base = [], [], np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live, at = np.arange(len(keys)), 0
    with np.errstate(over="ignore"):
        for number in itertools.count():
            if not len(live):
                break
            size = -(-LOAD * len(live) // 64) * 64
            place = _place(keys[live], number, size).astype(np.int64)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, np.uint8)
            bits[place[alone]] = 1
            level[live[alone]], base[live[alone]] = number, at + place[alone]
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            live, at = live[~alone], at + size
    words = np.concatenate(words) if words else np.zeros(0, "<u8")
    return np.array(sizes, np.int64), words, _rank(words, _before(words), base)


def _before(words: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(words).astype(np.int64)
    return np.cumsum(ones) - ones


def _rank(words: np.ndarray, before: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Set bits before each bit."""
    under = (U(1) << (bit & 63).astype(U)) - U(1)
    return before[bit >> 6] + np.bitwise_count(words[bit >> 6] & under)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys * GAMMA) >> U(48)).astype("<u2")


def count_type(min_docs: int) -> str:
    """Counts stop at the threshold, so they need no more bytes than that."""
    return "<u1" if min_docs < 1 << 8 else "<u2" if min_docs < 1 << 16 else "<u8"


class Shards:
    """Perfect hashes and arrays of some shards, one after the other: rows (shard, sizes, bits, prints, counts)."""

    def __init__(self, rows: list[tuple], min_docs: int):
        rows = sorted(rows, key=lambda r: r[0])
        sizes = [np.frombuffer(r[1], "<i8") for r in rows]
        self.known = np.array([r[0] for r in rows], np.int64)
        self.size = np.ones((len(rows), max(map(len, sizes), default=0)), np.int64)
        self.levels = np.array(list(map(len, sizes)), np.int64)
        for row, s in zip(self.size, sizes):
            row[: len(s)] = s
        starts = np.cumsum([0, *(s.sum() for s in sizes)])[:-1].astype(np.int64)
        self.base = starts[:, None] + np.cumsum(self.size, 1) - self.size
        self.words = np.frombuffer(b"".join(r[2] for r in rows), "<u8")
        self.before = _before(self.words).astype(np.int64)
        self.prints = np.frombuffer(b"".join(r[3] for r in rows), "<u2")
        self.counts = np.frombuffer(b"".join(r[4] for r in rows), count_type(min_docs))

    def count(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Documents of each key, up to the threshold; 0 for a key that the shards don't know (but for 1 of 65,536)."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.known):
            return out
        row = np.minimum(np.searchsorted(self.known, shard), len(self.known) - 1)
        live = np.flatnonzero(self.known[row] == shard)
        for number in range(self.size.shape[1]):
            live = live[self.levels[row[live]] > number]
            if not len(live):
                break
            r = row[live]
            with np.errstate(over="ignore"):
                bit = self.base[r, number] + _place(keys[live], number, self.size[r, number]).astype(np.int64)
            hit = (self.words[bit >> 6] >> (bit & 63).astype(U)) & U(1) > 0
            at = _rank(self.words, self.before, bit[hit])
            found = live[hit]
            out[found] = np.where(self.prints[at] == fingerprint(keys[found]), self.counts[at], 0)
            live = live[~hit]
        return out


class LineIndex(NamedTuple):
    """Shards and counts in the shared folder, and what is known of them."""

    shards: DataFrame
    counts: DataFrame
    log2: int
    min_docs: int
    bytes: int


def _shard_of(h: Column, log2: int) -> Column:
    return F.shiftrightunsigned(h, 64 - log2)


def build_index(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, shard_bytes: int = SHARD_BYTES) -> LineIndex:
    """Count each line key once a document and index all of them.  Shards grow in number with the bytes of text, not in size."""
    log2 = max(6, (bucket_count(text_bytes(docs, text_col), shard_bytes, 1) - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_tally_text"):
                h, _ = Lines(part.column(0)).pairs()
                keys, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    def build(rows: pa.Table) -> pa.Table:
        keys, n = rows["h"].to_numpy().view(U), rows["n"].to_numpy()
        sizes, words, at = perfect_hash(keys)
        prints, counts = np.zeros(len(keys), "<u2"), np.zeros(len(keys), count_type(min_docs))
        prints[at], counts[at] = fingerprint(keys), np.minimum(n, min_docs)
        values = (int(keys[0] >> U(64 - log2)), sizes.tobytes(), words.tobytes(), prints.tobytes(), counts.tobytes())
        return pa.table([pa.array([values[0]], pa.int64()), *(pa.array([v], pa.binary()) for v in values[1:])], names=["shard", "sizes", "bits", "prints", "counts"])

    seen = wide_rows(docs.select(F.col(f"`{text_col}`").alias("_tally_text"))).mapInArrow(lean(count), "h long, n long")
    counts = spill(seen.groupBy("h").agg(F.sum("n").alias("n")), "line-counts")
    shards = spill(counts.withColumn("shard", _shard_of(F.col("h"), log2)).groupBy("shard").applyInArrow(build, SHARD), "line-shards")
    size = shards.agg(F.sum(sum(F.octet_length(c) for c in ("sizes", "bits", "prints", "counts")))).first()[0] or 0
    return LineIndex(shards, counts, log2, min_docs, size)


def _judged(part: pa.RecordBatch, lines: Lines, frequent: np.ndarray) -> pa.RecordBatch:
    """(id, n_lines, n_dropped, kept) of a slice; ``frequent`` by filled line."""
    gone = np.zeros(len(lines.doc), bool)
    gone[lines.filled] = frequent
    dropped = np.bincount(lines.doc[gone], minlength=part.num_rows)
    kept = pa.array(lines.kept(gone), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(lines.count.astype(np.int64)), pa.array(dropped.astype(np.int64)), kept], [part.schema.names[0], "n_lines", "n_dropped", "kept"])


def _near(docs: DataFrame, index: LineIndex, schema: str) -> DataFrame:
    """Shards are broadcast; documents stay where they are."""
    rows = [(r["shard"], bytes(r["sizes"]), bytes(r["bits"]), bytes(r["prints"]), bytes(r["counts"])) for r in index.shards.collect()]  # of a checked size
    known, log2, min_docs = docs.sparkSession.sparkContext.broadcast(Shards(rows, index.min_docs)), index.log2, index.min_docs

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = known.value
        for batch in batches:
            for part in slices(batch, "_tally_text"):
                lines = Lines(part.column(1))
                yield _judged(part, lines, shards.count(lines.hash, (lines.hash >> U(64 - log2)).astype(np.int64)) >= min_docs)

    return docs.mapInArrow(lean(judge), schema)


def _far(docs: DataFrame, index: LineIndex, schema: str, id_col: str, hot_docs: int) -> DataFrame:
    """Pairs (row, hash) visit the shards; texts are written once with a number of their own, and meet the hashes that were found frequent."""
    spark = docs.sparkSession
    rows = spill(docs.withColumn("_tally_row", F.monotonically_increasing_id()), "line-rows")
    total = index.counts.agg(F.sum("n")).first()[0] or 0
    least = max(hot_docs, index.min_docs, -(-total // HOT_LINES))  # so that at most HOT_LINES are hot
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in index.counts.filter(F.col("n") >= least).select("h").collect()], np.int64).view(U)))
    log2, min_docs = index.log2, index.min_docs

    def is_hot(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hot.value, h)
        return hot.value[np.minimum(at, len(hot.value) - 1)] == h if len(hot.value) else np.zeros(len(h), bool)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_tally_text"):
                h, doc = Lines(part.column(0)).pairs()
                cold = ~is_hot(h)
                yield pa.RecordBatch.from_arrays([pa.array((h[cold] >> U(64 - log2)).astype(np.int64)), pa.array(h[cold].view(np.int64)), part.column(1).take(pa.array(doc[cold]))], ["shard", "h", "row"])

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        h = asked["h"].to_numpy()
        held = Shards([tuple(r[c] for c in ("shard", "sizes", "bits", "prints", "counts")) for r in shard.to_pylist()], min_docs)
        often = held.count(h.view(U), asked["shard"].to_numpy()) >= min_docs
        return pa.table([asked["row"].filter(pa.array(often)), asked["h"].filter(pa.array(often))], names=["row", "h"])

    asked = rows.select("_tally_text", "_tally_row").mapInArrow(lean(ask), "shard long, h long, row long")
    found = asked.groupBy("shard").cogroup(index.shards.groupBy("shard")).applyInArrow(answer, "row long, h long")
    often = found.groupBy("row").agg(F.collect_list("h").alias("_tally_often"))  # lines of one text
    both = rows.join(often, F.col("_tally_row") == F.col("row"), "left").select(F.col(f"`{id_col}`"), "_tally_text", "_tally_often")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_tally_text"):
                lines, listed = Lines(part.column(1)), part.column(2)
                keys = np.asarray(listed.flatten()).view(U)
                doc = np.repeat(np.arange(part.num_rows), np.asarray(listed.value_lengths().fill_null(0)))
                order = np.lexsort((keys, doc))
                frequent = is_hot(lines.hash)
                mine = lines.doc[lines.filled]
                lo, hi = np.searchsorted(doc[order], np.arange(part.num_rows)), np.searchsorted(doc[order], np.arange(part.num_rows), "right")
                for d in np.flatnonzero(lo < hi):
                    at = slice(*np.searchsorted(mine, [d, d + 1]))
                    frequent[at] |= np.isin(lines.hash[at], keys[order[lo[d] : hi[d]]])
                yield _judged(part, lines, frequent)

    return both.mapInArrow(lean(judge), schema)


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, small: int = SMALL, index: LineIndex | None = None, hot_docs: int = HOT_DOCS) -> DataFrame:
    """A row per document: id, n_lines, n_dropped, kept (the text without its frequent lines).

    A text splits at ``\\n``; a line's key is stripped of white space and lower-cased in A-Z.
    A key with any code point that ``min_docs`` documents hold goes everywhere.  Null and
    empty texts are one empty line; empty keys always stay; every row is a document of its
    own, also where ids repeat or are null; a text is read whole however long; an empty
    table gives no rows; other columns are ignored whatever their names.  ``index`` may come
    from other documents: a line that they don't hold then counts as frequent by chance once
    in 65,536.  Lines are told apart by 64-bit hashes.
    """
    index = index or build_index(docs, text_col, min_docs)
    kind = dict(docs.dtypes)[id_col]
    only = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_tally_text"))
    schema = f"`{id_col}` {kind}, n_lines long, n_dropped long, kept string"
    return _near(wide_rows(only), index, schema) if index.bytes <= small else _far(wide_rows(only), index, schema, id_col, hot_docs)


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_lines, n_dropped and the SHA-256 of what is kept."""
    return judged.select(F.col(f"`{id_col}`"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
    WITH split AS (
        SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    line AS (
        SELECT r, i, lines[i] AS line,
               translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM split, unnest(range(1, len(lines) + 1)) AS u(i)),
    often AS (SELECT k FROM line WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
    kept AS (
        SELECT r, count(*) FILTER (WHERE k IN (SELECT k FROM often)) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM often)), '') AS kept
        FROM line GROUP BY r)
    SELECT doc_id, len(lines)::BIGINT AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM split JOIN kept USING (r)"""
