"""Substring de-duplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash among its runs
of ``SEED`` words; consecutive windows that share one form a super-k-mer, a piece of text
that is packed as one string and travels to the bucket of its minimiser.  Equal windows
have equal minimisers, so each bucket sorts its windows and counts them exactly.

Hot passages: seeds that make up more than 1 of ``HOT_SHARE`` super-k-mers are found in a
first pass (a bounded list) and come last in the order of minimisers, so that windows which only touch
such a passage are dealt out by their own text.  Equal super-k-mers of a slice travel
once; their windows are known to repeat and need no answer.  What needs no bucket passes
through evenly dealt ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import KeyFilter, U, Words, bucket_count, buffer_of, dealt, lean, mix, powers, row_key, slices, spill, text_bytes, wide_rows

WINDOW, SEED, HOT_SHARE = 35, 4, 2000
CODEC = "zstd"


class SuperKmers:
    """Super-k-mers of a slice: first and one-past-last window (word index), minimiser, and a hash of the text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, hot: np.ndarray, window: int = WINDOW):
        self.words = w = Words(buf, off)
        n = len(w)
        count = n - window + 1
        empty = np.zeros(0, np.int64)
        self.first, self.last, self.minimiser, self.hash, self.doc = empty, empty, empty.view(U), empty.view(U), empty
        if count <= 0:
            return
        h, seed = w.hash, min(SEED, window)
        rolled = np.zeros(n - seed + 1, U)
        for k in range(seed):
            rolled += h[k : n - seed + 1 + k] * mix(np.array([k + 1], U))[0]
        rolled = mix(rolled) >> U(1)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, rolled), len(hot) - 1)
            rolled |= (hot[at] == rolled).astype(U) << U(63)
        least, have, want = rolled, 1, window - seed + 1
        while have < want:  # sliding minimum by doubling
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        doc = np.repeat(np.arange(len(off) - 1), np.diff(w.doc))
        valid = np.arange(count) + window <= w.doc[1:][doc[:count]]
        change = np.ones(count + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        self.first = np.flatnonzero(change[:-1] & valid)
        self.last = np.flatnonzero(change[1:] & valid) + 1
        self.minimiser, self.doc = least[self.first], doc[self.first]
        up, down = powers(n)
        total = np.concatenate((np.zeros(1, U), np.cumsum(h * up)))
        end = self.last + window - 1
        self.hash = mix((total[end] - total[self.first]) * down[self.first] + (end - self.first).astype(U))


def hot_seeds(docs: DataFrame, text_col: str, window: int = WINDOW) -> np.ndarray:
    """Seeds of more than 1 of HOT_SHARE super-k-mers: at most 2 * HOT_SHARE of them, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = SuperKmers(*buffer_of(part.column("text")), np.zeros(0, U), window)
                value, count = np.unique(s.minimiser, return_counts=True)
                often = count > max(2, len(s.first) // HOT_SHARE)
                value, count = np.append(value[often].view(np.int64), -1), np.append(count[often], len(s.first))
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], names=["seed", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    found = spill(found, "hot-seeds")  # a seed of -1 counts all
    total = found.filter("seed = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = found.filter((F.col("seed") != -1) & (F.col("n") * 2 * HOT_SHARE > int(total))).select("seed").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64)).view(U)


BLOCK = "bucket long, size long, texts binary, lengths binary, weights binary, keys binary, firsts binary"
SPAN = "key long, span long"


def _pack(hot: np.ndarray, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC)
        for batch in batches:
            for part in slices(batch, "text"):
                s = SuperKmers(*buffer_of(part.column("text")), hot, window)
                w, key = s.words, np.asarray(part.column("key"))
                rows: list[tuple] = []
                if len(s.first):
                    inner = s.first - w.doc[s.doc]  # word index within the document
                    end = s.last + window - 1
                    _, index, group, count = np.unique(s.hash, return_index=True, return_inverse=True, return_counts=True)
                    known = count[group] > 1
                    if known.any():
                        side = -1 - int(mix(s.hash[:1])[0] % U(buckets))
                        span = inner[known] << 32 | (inner + end - s.first)[known]
                        rows.append((side, 0, b"", b"", b"", key[s.doc[known]].tobytes(), span.tobytes()))
                    to = (mix(s.minimiser[index]) % U(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    index, to, weight = index[order], to[order], np.minimum(count[order], 2).astype(np.uint8)
                    a, b = w.start[s.first[index]], w.end[end[index] - 1]
                    view = memoryview(w.data)
                    cut = np.append(np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))), len(to)).tolist()
                    lows, highs = a.tolist(), b.tolist()
                    for x, y in zip(cut[:-1], cut[1:]):
                        raw = b"".join([view[i:j] for i, j in zip(lows[x:y], highs[x:y])])
                        own = index[x:y]
                        rows.append((int(to[x]), len(raw), codec.compress(raw, asbytes=True), (b - a)[x:y].astype(np.int32).tobytes(), weight[x:y].tobytes(), key[s.doc[own]].tobytes(), inner[own].astype(np.int32).tobytes()))
                cols = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "size", "texts", "lengths", "weights", "keys", "firsts"])

    return run


def _count(table: pa.Table, window: int) -> pa.Table:
    """One bucket: all its windows, sorted and counted; spans (word range as first << 32 | end) of those that repeat."""
    keys = [np.frombuffer(b.as_buffer(), np.int64) for b in table.column("keys")]
    if table.column("bucket")[0].as_py() < 0:
        spans = [np.frombuffer(b.as_buffer(), np.int64) for b in table.column("firsts")]
        return pa.table({"key": np.concatenate(keys), "span": np.concatenate(spans)})
    codec = pa.Codec(CODEC)
    raw = b"".join(codec.decompress(t.as_buffer(), n.as_py(), asbytes=True) for t, n in zip(table.column("texts"), table.column("size")))
    length, weight, first = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(c)]) for c, kind in (("lengths", np.int32), ("weights", np.uint8), ("firsts", np.int32)))
    key = np.concatenate(keys)
    w = Words(np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(length.astype(np.int64)))))
    n = len(w)
    text = np.repeat(np.arange(len(length)), np.diff(w.doc))
    at = np.flatnonzero(np.arange(n) + window <= w.doc[1:][text])  # first words of windows
    marks = []
    for base in (0x5851F42D4C957F2D, 0xD1342543DE82EF95):
        up, down = powers(n, base)
        total = np.concatenate((np.zeros(1, U), np.cumsum(w.hash * up)))
        marks.append((total[at + window] - total[at]) * down[at])
    order = np.argsort(marks[0])
    one, two = marks[0][order], marks[1][order]
    if len(one) and ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
        order = np.lexsort((marks[1], marks[0]))
        one, two = marks[0][order], marks[1][order]
    new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    weights = np.add.reduceat(weight[text[at[order]]].astype(np.int64), np.flatnonzero(new))
    again = np.zeros(len(at), bool)
    again[order] = (weights > 1)[np.cumsum(new) - 1]
    again &= weight[text[at]] == 1  # the others were answered where they came from
    hit = at[again]
    start = np.concatenate(([True], (np.diff(hit) != 1) | (text[hit[1:]] != text[hit[:-1]]))) if len(hit) else np.zeros(0, bool)
    a = hit[start]
    b = hit[np.append(np.flatnonzero(start)[1:] - 1, len(hit) - 1)] if len(hit) else a
    of = text[a]
    begin = first[of].astype(np.int64) + a - w.doc[of]
    return pa.table({"key": key[of], "span": begin << 32 | (begin + (b - a) + window)})


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, spans) for each row (``row_key``) with windows that occur elsewhere; spans are first word << 32 | end."""
    hot = hot_seeds(docs, text_col, window)
    buckets = bucket_count(text_bytes(docs, text_col), least=512)
    blocks = docs.select("key", F.col(text_col).alias("text")).mapInArrow(lean(_pack(hot, window, buckets)), BLOCK)
    spans = spill(dealt(blocks, buckets).groupBy("bucket").applyInArrow(lambda t: _count(t, window), SPAN), "spans")
    return spans.groupBy("key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words left, joined by one space, as bytes).

    Null texts have no words; texts shorter than a window keep all; equal rows lose what
    they share; very long texts travel in pieces; an empty table gives no rows; other
    columns are ignored whatever their names.  At the end only texts that a filter of the
    keys with spans flags are moved to their spans; the others stay where they are read.
    """
    texts = wide_rows(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", row_key("id", "text"))
    spans = spill(repeated_spans(texts, "text", window), "row-spans").withColumnRenamed("key", "of")
    probed = KeyFilter(spans, "of").probe(texts, "key")
    whole = probed.filter("NOT _maybe").select("id", "text", F.lit(None).cast("array<bigint>").alias("spans"))
    cut = probed.filter("_maybe").join(spans.hint("shuffle_hash"), F.col("key") == F.col("of"), "left").select("id", "text", "spans")
    joined = whole.unionByName(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                total, removed, kept = [], [], []
                for text, spans in zip(part.column("text").cast(pa.binary()), part.column("spans")):
                    words, gone, at = text.as_py().split(), 0, 0
                    left: list[bytes] = words
                    if spans.is_valid and len(spans):
                        left = []
                        for span in np.sort(spans.values.to_numpy()).tolist():
                            a, b = span >> 32, span & 0xFFFFFFFF
                            if a > at:
                                left += words[at:a]
                            gone += max(0, b - max(a, at))
                            at = max(at, b)
                        left += words[at:]
                    total.append(len(words))
                    removed.append(gone)
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("id", id_col)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
