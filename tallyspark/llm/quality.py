"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics and scores every document; only the statistics of at most
``train_rows`` labelled rows (a documented bound) reach the driver, where the trees are
grown on quantile bins.  The fitted trees are complete binary trees flattened into three
arrays, so that scoring is ``depth`` numpy gathers per tree for a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Words, buffer_of, lean, slices, unused, wide_rows

#: At most so many labelled rows are used to fit.
TRAIN_ROWS = 20_000
KINDS = ("lower", "upper", "digit", "stop", "mark", "newline", "blank", "high", "control")
KIND = np.full(256, KINDS.index("mark"), np.uint8)
KIND[97:123] = KINDS.index("lower")
KIND[65:91] = KINDS.index("upper")
KIND[48:58] = KINDS.index("digit")
KIND[[33, 44, 46, 58, 59, 63]] = KINDS.index("stop")
KIND[10] = KINDS.index("newline")
KIND[[9, 11, 12, 13, 32]] = KINDS.index("blank")
KIND[128:] = KINDS.index("high")
KIND[:9] = KIND[14:32] = KIND[127] = KINDS.index("control")
NAMES = [*(f"share_{k}" for k in KINDS), "log_bytes", "log_words", "word_bytes", "word_spread", "distinct", "top_word", "marked_end", "stopped_end", "line_words", "distinct_pairs", "exclaim"]


def _per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` between offsets; empty ranges give 0."""
    total = np.zeros(len(off) - 1)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        total[full] = np.add.reduceat(mask, off[full], dtype=np.int64)
    return total


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each document of a slice; an empty text gives zeros."""
    w = Words(buf, off)
    cut = off - off[0]
    size = np.diff(cut).astype(float)
    kind = KIND[w.data[: w.size]]
    out = np.zeros((len(size), len(NAMES)))
    some = np.maximum(size, 1)
    for k in range(len(KINDS)):
        out[:, k] = _per_doc(kind == k, cut) / some
    length = (w.end - w.start).astype(float)
    n = np.diff(w.doc).astype(float)
    many = np.maximum(n, 1)
    mean = _per_doc((w.end - w.start), w.doc) / many
    square = _per_doc((w.end - w.start).astype(np.int64) ** 2, w.doc) / many
    ends = kind[w.end - 1] if len(length) else np.zeros(0, np.uint8)
    at = len(KINDS)
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.log1p(n)
    out[:, at + 2] = mean
    out[:, at + 3] = np.sqrt(np.maximum(square - mean**2, 0))
    hashed = w.hash
    for i in np.flatnonzero(n):
        a, b = w.doc[i], w.doc[i + 1]
        own = np.sort(hashed[a:b])
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[i, at + 4] = len(new) / n[i]
        out[i, at + 5] = np.diff(np.append(new, b - a)).max() / n[i]
        if b - a > 1:
            pairs = np.sort(hashed[a : b - 1] * np.uint64(3) + hashed[a + 1 : b])
            out[i, at + 8 + 1] = (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) / (n[i] - 1)
    out[:, at + 6] = _per_doc(ends == KINDS.index("mark"), w.doc) / many
    out[:, at + 7] = _per_doc(ends == KINDS.index("stop"), w.doc) / many
    out[:, at + 8] = n / (1 + _per_doc(kind == KINDS.index("newline"), cut))
    out[:, at + 10] = _per_doc(w.data[: w.size] == 33, cut) / many
    return out


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes (feature, threshold) and leaf values, one row per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting on quantile bins.  Without rows or with one class: a constant score."""
    inner, features = 2**depth - 1, x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), base)
    shape = ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, g_all, h_all = np.full(width, 1e-9), np.bincount(local, grad, width), np.bincount(local, hess, width)
            split = np.full(width, -1)
            for j in range(features):
                cell = local * bins + binned[:, j]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                h = np.bincount(cell, hess, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + ridge) + gr**2 / (hr + ridge) - (g_all**2 / (h_all + ridge))[:, None]
                gain[(h < least) | (hr < least)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                feature[first : first + width][better] = j
                split[better] = at[better]
            for k in np.flatnonzero(split >= 0):
                threshold[first + k] = edges[feature[first + k]][split[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        local = node - inner
        leaf = -rate * np.bincount(local, grad, inner + 1) / (np.bincount(local, hess, inner + 1) + ridge)
        margin += leaf[local]
        for rows, row in zip(shape, (feature, threshold, leaf)):
            rows.append(row)
    return Trees(*map(np.array, shape), base)


def held_out(id_col: str) -> F.Column:
    """Rows never learned from: crc32 of the id as text has remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = statistics(*buffer_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``train_rows`` labelled rows, chosen by the hash of their id, none of them held out.

    Rows with a null id or label are passed over.  The same rows give the same trees.  Of
    document rows with one id the one with the least statistics counts, so that the driver
    gets no more rows than labels.  Without usable labels the score is one constant.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    texts = wide_rows(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    x = texts.mapInArrow(lean(_featurise), f"id {dict(docs.dtypes)[id_col]}, x array<double>").groupBy("id").agg(F.min("x").alias("x")).toPandas()
    y = chosen.toPandas()
    both = x.merge(y, on="id") if len(x) else x.assign(y=[])
    both = both.assign(_key=both["x"].map(tuple)).sort_values(["id", "y", "_key"]) if len(both) else both
    return fit(np.array(both["x"].tolist(), float).reshape(-1, len(NAMES)), both["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score (0 to 1) appended as ``into``, which must be a new name.

    Null and empty texts score too; repeated rows score alike; a very long text is read whole.
    """
    at = docs.columns.index(text_col)
    if unused(docs, into) != into:
        raise ValueError(f"there is a column {into} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                s = trees.score(statistics(*buffer_of(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, into])

    rest = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return wide_rows(docs).mapInArrow(lean(run), f"{rest}, `{into}` double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: id, held_out, score, predicted.

    Only the id and the text are read, whatever other columns are called; the score depends
    on the text alone, so repeated rows score alike and null counts as empty.  A null id is
    not held out.  An empty table gives no rows, and without labels all score one half.
    """
    trees = train(docs, labels, id_col, text_col, train_rows=train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(trees.score(statistics(*buffer_of(part.column("text")))))], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score below ``least``; columns as given.  What ``classify`` states holds here too."""
    into = unused(docs, "tally_quality")
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col, into)
    return scored.filter(F.col(into) >= least).drop(into)
