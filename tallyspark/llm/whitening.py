"""Embedding whitening: exact sums, a distributed centred covariance, and its leading eigenvectors.

Pass 1 adds up the integer vectors x = floor(SCALE * c) + SHIFT.  Pass 2 centres every x by
the rounded mean before it is multiplied; these products are integers and are added up
exactly, whatever the order of tasks, and the part of the mean that was rounded off is taken
out exactly as well.  The covariance, as wide as a vector, goes to the driver, where
Householder reflections make it tridiagonal, Sturm counts bisect its leading eigenvalues and
inverse iteration, orthogonalised inside clusters, finds their vectors.  The components, a
few vectors, are broadcast and every row is projected where it lies.  Pass 3 measures the
covariance of what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import spill

#: Fixed values of the contract.
SCALE, SHIFT, COMPONENTS = 1024, 100000, 8
#: Entries beyond it have no integer vector in a double's exact range and count as non-finite.
LARGEST = 2.0**40
#: Integers up to it are exact in a double; up to the next in a long.
EXACT, LONG = 1 << 53, (1 << 63) - 1
#: Eigenvalues within this part of the matrix' norm are one cluster, whose vectors are orthogonalised.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)


class Basis(NamedTuple):
    """What a projection needs: rows, the rounded mean and the rest of each sum, components (columns), eigenvalues, trace."""

    n: int
    centre: np.ndarray
    rest: list[int]  # sum of x minus n times the centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that remain, their lengths, and their entries x one after the other; other rows are null or hold null or non-finite entries."""
    size = np.diff(np.asarray(col.offsets)) if len(col) else np.zeros(0, np.int64)
    valid = np.asarray(col.is_valid())
    size = np.where(valid, size, 0)
    c = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
    row = np.repeat(np.arange(len(col)), size)
    bad = np.bincount(row[~(np.abs(c) < LARGEST)], minlength=len(col)) > 0
    good = valid & ~bad
    return np.flatnonzero(good), size[good], np.floor(c[good[row]] * SCALE).astype(np.int64) + SHIFT


def of_length(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector remains and has ``width`` entries, and these as a matrix."""
    rows, size, x = integers(col)
    fits = size == width
    return rows[fits], x[np.repeat(fits, size)].reshape(int(fits.sum()), width)


def _column_sums(x: np.ndarray) -> list[int]:
    largest = int(np.abs(x).max(initial=0))
    return [int(s) for s in (x if largest * len(x) < LONG else x.astype(object)).sum(0)]


def _products(y: np.ndarray) -> np.ndarray:
    """y'y in integers: by doubles where every sum is exact in them."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * max(1, len(y)) < EXACT:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64)
    z = y.astype(object)
    return z.T @ z


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(width, n, sums): of the length that most vectors have (the greatest of equally common ones), exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            rows, size, _ = integers(batch.column(0))
            for width in np.unique(size).tolist():
                _, x = of_length(batch.column(0), width)
                n, s = total.get(width, (0, [0] * width))
                total[width] = n + len(x), [a + b for a, b in zip(s, _column_sums(x))]
        for width, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"width": pa.array([width] * (width + 1), pa.int32()), "at": pa.array(range(-1, width), pa.int32()), "s": pa.array([n, *s], pa.decimal128(38, 0))})

    parts = spill(vectors.mapInArrow(add, "width int, at int, s decimal(38,0)"), "vector-sums")
    first = parts.filter("at = -1").groupBy("width").agg(F.sum("s").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if first is None:
        return 0, 0, []
    sums = parts.filter(F.col("width") == first["width"]).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()  # as many as entries
    return first["width"], int(first["n"]), [int(r["s"]) for r in sums[1:]]


def _covariance(vectors: DataFrame, width: int, n: int, centre: np.ndarray, rest: list[int]) -> np.ndarray:
    """The covariance of x, divisor n: products of centred integers, added up exactly; each entry is rounded once."""
    i, j = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            _, x = of_length(batch.column(0), width)
            if len(x):
                part = _products(x - centre)[i, j].tolist()
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["i", "j", "s"])

    out = np.zeros((width, width))
    for r in vectors.mapInArrow(add, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # as many as a vector's entries squared
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = (n * int(r["s"]) - rest[r["i"]] * rest[r["j"]]) / (n * n)
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors of a symmetric matrix: column k is reflected by the k-th vector."""
    a = a.astype(float).copy()
    size, mirrors = len(a), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v[1:]).max(initial=0.0)
        if scale == 0.0:
            mirrors.append(np.zeros(len(v)))
            continue
        scale = max(scale, abs(v[0]))
        v /= scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each x."""
    least = max(float(np.abs(e).max(initial=0.0)), float(np.abs(d).max(initial=0.0)), 1e-300) * EPS**2
    count, q = np.zeros(len(x), np.int64), np.ones(len(x))
    for k in range(len(d)):
        q = d[k] - x - (e[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until no double lies between its bounds."""
    size = len(d)
    reach = np.zeros(size)
    reach[:-1] += np.abs(e)
    reach[1:] += np.abs(e)
    margin = 2 * EPS * max(np.abs(d).max(initial=0.0), reach.max(initial=0.0)) * size
    lo, hi = np.full(k, (d - reach).min() - margin), np.full(k, (d + reach).max() + margin)
    wanted = size - np.arange(k)  # so many eigenvalues are at most the j-th largest
    while True:
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            return mid
        under = below(d, e, mid) >= wanted
        hi, lo = np.where(under, mid, hi), np.where(under, lo, mid)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """x with (T - shift) x = b, by elimination with row exchanges; a pivot that vanishes is ``tiny``."""
    size = len(d)
    u0, u1, u2, x = d - shift, np.append(e, 0.0), np.zeros(size), b.copy()
    for k in range(size - 1):
        low0, low1, low2 = e[k], u0[k + 1], u1[k + 1]
        if abs(low0) > abs(u0[k]):
            (u0[k], u1[k], u2[k]), (low0, low1, low2) = (low0, low1, low2), (u0[k], u1[k], u2[k])
            x[k], x[k + 1] = x[k + 1], x[k]
        if abs(u0[k]) < tiny:
            u0[k] = tiny
        f = low0 / u0[k]
        u0[k + 1], u1[k + 1] = low1 - f * u1[k], low2 - f * u2[k]
        x[k + 1] -= f * x[k]
    if abs(u0[-1]) < tiny:
        u0[-1] = tiny
    for k in range(size - 1, -1, -1):
        x[k] -= u1[k] * x[k + 1] if k + 1 < size else 0.0
        x[k] -= u2[k] * x[k + 2] if k + 2 < size else 0.0
        x[k] /= u0[k]
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues; those of a cluster are orthogonalised against each other in every step."""
    size = len(d)
    norm = float(np.abs(d).max(initial=0.0) + 2 * np.abs(e).max(initial=0.0)) or 1.0
    draw, out, first, shift = np.random.default_rng(0), np.zeros((size, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = min(value, shift - 10 * EPS * norm)  # equal eigenvalues get shifts of their own
        x = draw.standard_normal(size)
        for _ in range(steps):
            x = _solve(d, e, shift, x / np.abs(x).max(), EPS * norm)
            x /= np.abs(x).max()
            for _ in range(2):  # twice is enough
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    d, e, mirrors = tridiagonal(a)
    values = leading_values(d, e, k)
    vectors = inverse_iteration(d, e, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    return values, vectors


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS) -> Basis | None:
    """The basis of all remaining vectors of ``vectors``, or None where none remains.

    What reaches the driver is a vector of sums and the covariance: their size is that of
    the dimension, squared, and doesn't grow with the rows.
    """
    only = vectors.select(F.col(f"`{vector_col}`").alias("v"))
    width, n, sums = _sums(only)
    if not n or not width:
        return None
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    v = _covariance(only, width, n, centre, rest)
    values, columns = eigen(v, min(k, width))
    return Basis(n, centre, rest, columns, values, float(np.trace(v)))


def _project(basis: Basis, x: np.ndarray) -> np.ndarray:
    """(x - S/n) on the components, over the roots of their eigenvalues; NaN where an eigenvalue is nought but for rounding."""
    off = np.array([float(Fraction(r, basis.n)) for r in basis.rest])
    alive = basis.values > len(basis.centre) * EPS * max(basis.trace, 0.0)
    root = np.sqrt(np.where(alive, basis.values, np.nan))
    return ((x - basis.centre) - off) @ basis.vectors / root


def _deviation(basis: Basis, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2 in integers; null where a long can't hold it."""
    y, most = x - basis.centre, max(map(abs, basis.rest))
    largest = basis.n * int(np.abs(y).max(initial=0)) + most
    if largest * largest * x.shape[1] <= LONG:
        return ((basis.n * y - np.array(basis.rest, np.int64)) ** 2).sum(1).tolist()
    exact = ((basis.n * y.astype(object) - np.array(basis.rest, object)) ** 2).sum(1)
    return [v if v <= LONG else None for v in exact]


def _identity_error(only: DataFrame, basis: Basis) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    width, k = len(basis.centre), len(basis.values)
    i, j = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(i))
        for batch in batches:
            z = _project(basis, of_length(batch.column(0), width)[1])
            total += np.concatenate([z.sum(0), (z.T @ z)[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "s"])

    s = np.zeros(k + len(i))
    for r in only.mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():  # a few numbers
        s[r["at"]] = r["s"] / basis.n
    off = np.abs(s[k:] - s[i] * s[j] - (i == j))
    return float(np.nanmax(off, initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those with null or non-finite entries (or beyond LARGEST) are left out;
    so are vectors of another length than most have.  Repeated rows and a null id are rows
    like others.  Vectors of fewer than ``k`` entries have as many components as entries; an
    eigenvalue that is nought but for rounding gives null for ``whitened``, and a trace of
    nought for ``explained``.  A deviation beyond a long is null.  An empty table gives no
    rows; other columns are ignored whatever their names.
    """
    kind = dict(vectors.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    basis = fit(vectors, vector_col, k)
    if basis is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = _identity_error(vectors.select(F.col(f"`{vector_col}`").alias("v")), basis)
    known = vectors.sparkSession.sparkContext.broadcast(basis)  # k vectors

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = known.value
        width, count = len(basis.centre), len(basis.values)
        share = basis.values / basis.trace if basis.trace > 0 else np.full(count, np.nan)
        for batch in batches:
            rows, x = of_length(batch.column(1), width)
            if not len(rows):
                continue
            z = _project(basis, x).ravel()
            each = np.repeat(np.arange(len(rows)), count)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, count + 1), len(rows)), pa.int32()), pa.array(np.full(len(z), basis.n), pa.int64()),
                pa.array(_deviation(basis, x), pa.int64()).take(pa.array(each)), pa.array(z, mask=np.isnan(z)), pa.array(np.tile(share, len(rows)), mask=np.isnan(np.tile(share, len(rows)))), pa.array(np.full(len(z), error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").alias("_tally_v")).mapInArrow(give, schema)
