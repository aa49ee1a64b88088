"""The nearest entities of each observation, exactly, without comparing all with all.

References are dealt to cells by their nearest pivot and a cell is cut into blocks by the
distance to it, so that a block is a ring around a pivot.  By the triangle inequality an
observation whose distance to the pivot is p has nothing nearer than max(p - high, low - p)
in a ring from low to high.  Distances to the pivots, which are references themselves, and
one block that is looked at first bound the k-th nearest entity; only blocks that can hold
something within that bound are compared.

References of up to ``small`` bytes are broadcast and observations stay where they are.
Beyond that blocks lie together in bins of GROUP bytes, each reference in one, and
observations go once to each bin with a block that they need, where they meet these blocks
only: a bin that many visit is copied for them, other references aren't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.scratch import work_table

#: Bytes of references that may be broadcast; references of a block there, and of one that is dealt.
SMALL, LOCAL_BLOCK, BLOCK = 32 << 20, 128, 2048
#: Candidates that are drawn for a pivot.
SPREAD = 4
#: References that one task deals to pivots.
PLACED = 1 << 14
#: Observations for which a bin isn't copied once more, however many cores there are.
ALONE = 1 << 10
#: Most pivots, blocks, observations that meet a bin in one task, bounds that are held at once, and visits that leave a worker in one batch.
PIVOTS, BLOCKS, VISITORS, CELLS, BATCH = 1024, 500_000, 1 << 15, 1 << 20, 1 << 13
#: Bytes of the vectors, as doubles, of references that lie in one bin and of observations that meet them in one task.
GROUP = 32 << 20
#: Cells that one step of ``Steps`` works on; references of which the distances themselves are found as fast as bounds; largest number and longest vector for bounds.
TILE, FEW, LARGE, LONG = 1 << 18, 256, 1e15, 4096
#: Entities of a part up to which each one's sums are taken by themselves.
NAMES = 32
#: References of a run of parts, and the share of a run's pairs from which it is met as one.
RUN, MOST = 2048, 0.7
#: Bounds are widened by this part, more than rounding can make of them.
SLACK = 1e-9


def _row(kind: str, many: np.ndarray, one: np.ndarray) -> np.ndarray:
    if kind == "l1":
        return np.abs(many - one).mean(1)
    square = ((many - one) ** 2).sum(1)
    return np.sqrt(square / many.shape[1]) if kind == "rmse" else np.sqrt(square)


def distances(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances: l1 (mean of absolute differences), l2 or rmse, all of them metrics.  A pair's value doesn't depend on what is beside it."""
    out = np.empty((len(a), len(b)))
    if len(a) <= len(b):
        for i, row in enumerate(a):
            out[i] = _row(kind, b, row)
    else:
        for j, row in enumerate(b):
            out[:, j] = _row(kind, a, row)
    return out


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def nothing(*columns: str) -> pd.DataFrame:
    """No rows, of columns that may be of any type."""
    return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})


class Steps:
    """Bounds of mean absolute differences to the vectors ``w``, by sums of whole steps in 16 bits.

    The sum of |a - b| is twice that of max(a, b) less both sums, and each difference is a step off
    at most.  What of an observation lies outside the references' range is added as it is.
    """

    #: A sum that no pair has: it stands for none.
    NONE = 65535

    def __init__(self, w: np.ndarray):
        self.low, self.high, top = w.min(), w.max(), (self.NONE - 1) // w.shape[1]
        self.step = (self.high - self.low) / top or 1.0
        self.w = np.ascontiguousarray(self._whole(w).T)
        self.half = (self.w.sum(0, dtype=np.int64) // 2).astype(np.uint16)

    def _whole(self, v: np.ndarray) -> np.ndarray:
        return np.rint((v - self.low) / self.step).astype(np.uint16)

    def __call__(self, v: np.ndarray) -> "Bounds":
        inside = np.clip(v, self.low, self.high)
        whole = np.ascontiguousarray(self._whole(inside).T)
        sums = np.zeros((v.shape[0], self.w.shape[1]), np.uint16)
        step = max(1, TILE // max(1, sums.shape[1]))
        larger = np.empty((min(step, len(sums)), sums.shape[1]), np.uint16)
        for at in range(0, len(sums), step):
            some = sums[at : at + step]
            for mine, theirs in zip(whole, self.w):
                np.maximum(mine[at : at + step, None], theirs, out=larger[: len(some)])
                some += larger[: len(some)]
        sums -= self.half
        size, beyond = v.shape[1], np.abs(v - inside).sum(1)
        own, slack = whole.sum(0, dtype=np.int64) + 0.0, size * (1 + 1e-6) + 1
        room = SLACK * (np.abs(v).max(1) + max(abs(self.low), abs(self.high)))
        low = lambda least, row: np.where(least == self.NONE, np.inf, (self.step * (2.0 * least - own[row] - slack) + beyond[row]) / size - room[row])
        high = lambda least, row: np.where(least == self.NONE, np.inf, (self.step * (2.0 * least - own[row] + slack) + beyond[row]) / size + room[row])
        # Distances that differ by less than their rounding tie.
        return Bounds(sums, low, high, np.minimum(self.NONE, np.ceil(slack + 2 + room * size / self.step)), self.NONE)


class Squares:
    """Bounds of l2 or rmse distances to the vectors ``w``, by one product of matrices in single precision with room for its rounding."""

    NONE = np.inf

    def __init__(self, w: np.ndarray, kind: str):
        self.scale, self.centre, self.far = w.shape[1] ** 0.5 if kind == "rmse" else 1.0, w.mean(0), np.abs(w).max()
        c = w - self.centre
        square = (c * c).sum(1)
        self.norm = square.max() ** 0.5
        self.w = np.concatenate([-2 * c, square[:, None], np.ones((len(c), 1))], 1).astype(np.float32).T

    def __call__(self, v: np.ndarray) -> "Bounds":
        c = v - self.centre
        square = (c * c).sum(1)
        found = np.concatenate([c, np.ones((len(c), 1)), square[:, None]], 1).astype(np.float32) @ self.w
        most = square**0.5 + self.norm
        off = 2 * (v.shape[1] + 8) * 2.0**-24 * most**2 + 1e-30
        room = SLACK * (np.abs(v).max(1) + self.far)
        tie = self.scale * room + SLACK * most
        low = lambda least, row: np.sqrt(np.maximum(least - off[row], 0)) / self.scale * (1 - SLACK) - room[row]
        high = lambda least, row: np.sqrt(np.maximum(least + off[row], 0)) / self.scale * (1 + SLACK) + room[row]
        return Bounds(found, low, high, 2.1 * off + 4 * tie * (most + tie), self.NONE)


class Exact:
    """The distances themselves, for few vectors, and where numbers are too large, or vectors too long, for bounds that tell anything."""

    NONE = np.inf

    def __init__(self, w: np.ndarray, kind: str):
        self.w, self.kind = w, kind

    def __call__(self, v: np.ndarray) -> "Bounds":
        as_is = lambda least, row: least
        d = distances(self.kind, v, self.w)
        return Bounds(np.where(np.isnan(d), self.NONE, d), as_is, as_is, np.zeros(len(v)), self.NONE)


class Bounds(NamedTuple):
    """``sums`` of (observation, reference), rising with their distance, and what bounds it: low and high of (sums, rows).

    Of an observation's references only those whose sum is at most ``apart`` above the least can be the nearest.
    """

    sums: np.ndarray
    low: Callable
    high: Callable
    apart: np.ndarray
    none: float


def bounds_to(kind: str, w: np.ndarray) -> Steps | Squares | Exact:
    """Bounds that suit the numbers of ``w``."""
    if len(w) < FEW or w.shape[1] > LONG or not w.shape[1] or not np.abs(w).max() < LARGE:
        return Exact(w, kind)
    return Steps(w) if kind == "l1" else Squares(w, kind)


class Part:
    """References of one ring, in order of entity and reference, with their vectors."""

    def __init__(self, kind: str, ref: np.ndarray, entity: np.ndarray, w: np.ndarray):
        self.kind, self.ref, self.entity, self.w = kind, ref, entity, w
        self.first = np.flatnonzero(np.append(True, self.entity[1:] != self.entity[:-1]))
        self.names = self.entity[self.first]

    @cached_property
    def bounds(self) -> Steps | Squares | Exact:
        return bounds_to(self.kind, self.w)

    def asked(self, v: np.ndarray) -> Bounds:
        return (self.bounds if np.abs(v).max(initial=0.0) < LARGE else Exact(self.w, self.kind))(v)

    def place(self, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose true entity is here, and its place among the names."""
        rows = np.flatnonzero(~pd.isna(truth))
        at = np.minimum(np.searchsorted(self.names, truth[rows].astype(self.names.dtype)), len(self.names) - 1)
        here = self.names[at] == truth[rows]
        return rows[here], at[here]

    def without(self, got: Bounds, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes references with an observation's own id out of the sums of ``rows``."""
        got.sums[rows] = np.where(ids[rows, None] == self.ref[None, :], got.none, got.sums[rows])

    def nearer(self, v: np.ndarray, ids: np.ndarray | None, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, entity, place, distance) of entities that have something nearer than ``known``, a distance for each observation and entity; with ``ids`` other than their own."""
        got = self.asked(v)
        if ids is not None:
            self.without(got, ids, np.flatnonzero(pd.Series(ids).isin(self.ref)))
        sums = np.minimum.reduceat(got.sums, self.first, axis=1)
        row, group = np.nonzero((got.low(sums, np.arange(len(v))[:, None]) < known) & (sums != got.none))
        place, d = self.least(got, v, row, group, ids)
        use = d < known[row, group]
        return row[use], group[use], place[use], d[use]

    def least(self, got: Bounds, v: np.ndarray, row: np.ndarray, group: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Place and exact distance of the nearest reference of each (row, entity), ties by reference.

        Only references that their sums leave in question are compared in full, a bounded number at a time.
        """
        place, least = np.empty(len(row), np.int64), np.full(len(row), np.inf)
        step = max(1, CELLS // max(1, self.w.shape[1]))
        for of, col in self._open(got, row, group):
            use = got.sums[row[of], col] != got.none
            of, col = of[use], col[use]
            d = np.empty(len(of))
            for cut in range(0, len(of), step):
                d[cut : cut + step] = _row(self.kind, self.w[col[cut : cut + step]], v[row[of[cut : cut + step]]])
            if ids is not None:
                d[ids[row[of]] == self.ref[col]] = np.inf
            order = np.lexsort((col, d, of))
            top = order[np.flatnonzero(np.append(True, np.diff(of[order]) > 0))] if len(of) else order
            place[of[top]], least[of[top]] = col[top], d[top]
        return place, least

    def _open(self, got: Bounds, row: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``row``, column) of references that may be the nearest of their (row, entity), from CELLS sums at a time."""
        ends = np.append(self.first[1:], len(self.ref))
        size = (ends - self.first)[group]
        if len(self.first) <= NAMES:
            for g in np.unique(group).tolist():
                own, to = np.flatnonzero(group == g), slice(self.first[g], ends[g])
                step = max(1, CELLS // (to.stop - to.start))
                for at in range(0, len(own), step):
                    some = row[own[at : at + step]]
                    sums = got.sums[some, to]
                    one, col = np.nonzero(sums <= (sums.min(1) + got.apart[some])[:, None])
                    yield own[at + one], col + to.start
            return
        begin, at = np.append(0, np.cumsum(size)), 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + CELLS, "right")) - 1)
            start = begin[at:to] - begin[at]
            of = np.repeat(np.arange(at, to), size[at:to])
            col = np.arange(len(of)) - start[of - at] + self.first[group[of]]
            sums = got.sums[row[of], col]
            use = np.flatnonzero(sums <= (np.minimum.reduceat(sums, start) + got.apart[row[at:to]])[of - at])
            yield of[use], col[use]
            at = to


class Parts(list[Part]):
    """Parts of all rings, and runs of them that are met as one where most of their pairs are wanted anyway."""

    @cached_property
    def runs(self) -> list[tuple[int, int, np.ndarray]]:
        """(first, behind the last, sizes) of runs of about RUN references."""
        sizes = np.array([len(x.ref) for x in self], int)
        cut = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // RUN, prepend=-1))
        return [(a, b, sizes[a:b]) for a, b in zip(cut.tolist(), np.append(cut[1:], len(self)).tolist())]

    @cached_property
    def _joined(self) -> dict[int, Part]:
        return {}

    def joined(self, a: int, b: int) -> Part:
        if a not in self._joined:
            rows = pd.DataFrame({c: np.concatenate([getattr(x, c) for x in self[a:b]]) for c in ("entity", "ref")}).sort_values(["entity", "ref"])
            self._joined[a] = Part(self[a].kind, rows["ref"].to_numpy(), rows["entity"].to_numpy(), np.concatenate([x.w for x in self[a:b]])[rows.index])
        return self._joined[a]


class Rings(NamedTuple):
    """Pivots of one vector length (with their reference and entity, by entity) and the rings around them."""

    pivots: Part
    block: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def near(self, v: np.ndarray, ids: np.ndarray, k: int, leave_out: bool, truth: np.ndarray | None, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each observation: least distance that each block can hold, the block to look at first, bounds of the nearest and of the k-th nearest entity, and its reach.

        First comes what may hold the nearest, of several the ring around the nearest pivot.
        """
        got = self.pivots.asked(v)
        row = np.arange(len(v))[:, None]
        d, far = np.maximum(got.low(got.sums, row), 0), got.high(got.sums, row)
        at, most = d[:, self.pivot], far[:, self.pivot]
        # A reference is no farther from its own pivot than from the observation's.
        least = np.maximum(np.maximum(at - self.high, self.low - most), (at - far.min(1)[:, None]) / 2) - SLACK * (most + self.high)
        known = np.where(ids[:, None] == self.pivots.ref[None, :], np.inf, far) if leave_out else far
        each = np.minimum.reduceat(known, self.pivots.first, axis=1)
        return least, np.argmin(np.maximum(least, 0) + 1e-3 * at, axis=1), each.min(1), kth(each, k), _nearer(self.pivots, each, truth, reach)


def nearest_place(kind: str, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``w`` and distance of what is nearest to each vector, the first of several."""
    one = Part(kind, np.arange(len(w)), np.zeros(len(w), int), w)
    place, least, step = [], [], max(1, CELLS // len(w))
    for at in range(0, len(v), step):
        some = v[at : at + step]
        to, d = one.least(one.asked(some), some, np.arange(len(some)), np.zeros(len(some), int), None)
        place.append(to)
        least.append(d)
    return np.concatenate(place), np.concatenate(least)


def _nearer(part: Part, each: np.ndarray, truth: np.ndarray | None, reach: np.ndarray) -> np.ndarray:
    """The reach of observations that look for their true entity: no more than a bound of its distance."""
    if truth is None:
        return reach
    rows, at = part.place(truth)
    reach = reach.copy()
    reach[rows] = np.minimum(reach[rows], each[rows, at])
    return reach


def kth(each: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of each row, infinite where there are fewer."""
    return np.partition(each, k - 1, axis=1)[:, k - 1] if each.shape[1] >= k else np.full(len(each), np.inf)


class Asked:
    """Observations of one vector length, with the bounds of what can belong to their answers and the rows found: (place, entity, ref, distance).

    Rows are brought together, the least of each (observation, entity), when CELLS of them lie there.
    """

    def __init__(self, obs: pd.DataFrame, v: np.ndarray, k: int, within: float, leave_out: bool):
        self.v, self.ids, self.k, self.within, self.leave_out = v, obs["obs"].to_numpy(), k, within, leave_out
        self.truth = obs["truth"].to_numpy() if "truth" in obs else None
        self.reach = obs["reach"].to_numpy(float)
        self.low, self.bound = (obs[c].to_numpy(float) if c in obs else np.full(len(obs), np.inf) for c in ("low", "bound"))
        self.found, self.rows, self.most, self.pairs = [], 0, CELLS, 0

    def narrow(self, low: np.ndarray, bound: np.ndarray, reach: np.ndarray, rows=slice(None)) -> None:
        self.low[rows], self.bound[rows], self.reach[rows] = np.minimum(self.low[rows], low), np.minimum(self.bound[rows], bound), reach

    def cut(self, rows=slice(None)) -> np.ndarray:
        """Nothing beyond it can belong to the answer."""
        near = np.maximum(self.bound[rows], self.reach[rows])
        return np.maximum(near, self.low[rows] + self.within) if self.within > 0 else near

    def meet(self, part: Part, rows: np.ndarray) -> None:
        """Observations of ``rows`` meet all references of ``part``, CELLS pairs at a time.

        An entity of the answer is among the k nearest of the block that holds its nearest
        reference, or within its observation's reach.
        """
        step = max(1, CELLS // len(part.ref))
        own = pd.Series(self.ids[rows]).isin(part.ref).to_numpy() if self.leave_out else None
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            v, ids = self.v[some], self.ids[some]
            got = part.asked(v)
            if self.leave_out:
                part.without(got, ids, np.flatnonzero(own[at : at + step]))
            sums = np.minimum.reduceat(got.sums, part.first, axis=1)
            row = np.arange(len(some))[:, None]
            high = got.high(sums, row)
            self.narrow(high.min(1), kth(high, self.k), _nearer(part, high, None if self.truth is None else self.truth[some], self.reach[some]), some)
            row, group = np.nonzero((got.low(sums, row) <= self.cut(some)[:, None]) & (sums != got.none))
            self.pairs += got.sums.size
            if len(row):
                place, least = part.least(got, v, row, group, ids if self.leave_out else None)
                np.minimum.at(self.low, some[row], least)
                if self.k == 1:
                    self.bound[some] = np.minimum(self.bound[some], self.low[some])
                use = np.flatnonzero((least <= self.cut(some)[row]) & np.isfinite(least))
                self.found.append((some[row[use]], part.entity[place[use]], part.ref[place[use]], least[use]))
                self.rows += len(use)
                if self.rows > self.most:
                    self.gather()
                    self.most = max(CELLS, 2 * self.rows)

    def gather(self) -> tuple[np.ndarray, ...]:
        """The rows that may still belong to an answer, one for each (observation, entity)."""
        if not self.found:
            return tuple(np.zeros(0, int) for _ in range(4))
        of, entity, ref, d = (np.concatenate(c) for c in zip(*self.found))
        use = np.flatnonzero(d <= self.cut(of))
        names = pd.factorize(entity[use])[0]
        order = use[np.lexsort((pd.factorize(ref[use], sort=True)[0], d[use], names, of[use]))]
        here = (of[order], pd.factorize(entity[order])[0])
        first = order[np.flatnonzero(np.append(True, (np.diff(here[0]) != 0) | (np.diff(here[1]) != 0)))] if len(order) else order
        self.found, self.rows = [(of[first], entity[first], ref[first], d[first])], len(first)
        return self.found[0]


class Local:
    """All references of one vector length in rings, for a worker that holds them."""

    def __init__(self, kind: str, refs: pd.DataFrame, block: int):
        w = stacked(refs["w"])
        drawn = np.random.default_rng(0).permutation(len(refs))[: SPREAD * pivot_count(len(refs))]
        chosen = np.sort(drawn[spread(kind, w[drawn], pivot_count(len(refs)))])
        cell, r = nearest_place(kind, w, w[chosen])
        ref, entity = refs["ref"].to_numpy(), refs["entity"].to_numpy()
        order = np.lexsort((r, cell))
        start = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0))
        place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
        cut = np.flatnonzero(place % block == 0)
        self.parts = Parts()
        for a, b in zip(cut, np.append(cut[1:], len(w))):
            rows = np.sort(order[a:b])  # refs are in order of entity and reference
            self.parts.append(Part(kind, ref[rows], entity[rows], w[rows]))
        self.rings = Rings(Part(kind, ref[chosen], entity[chosen], w[chosen]), np.arange(len(cut)), cell[order][cut], np.minimum.reduceat(r[order], cut), np.maximum.reduceat(r[order], cut))


def search(kind: str, rings: Rings, parts: Parts, obs: pd.DataFrame, k: int, within: float, leave_out: bool) -> tuple[pd.DataFrame, int, np.ndarray, np.ndarray]:
    """Rows of all ``parts`` (the references of each ring) that may belong to the answer, pairs compared, and bounds of the nearest and the k-th.

    ``obs`` may bring bounds (bound, low) that were found elsewhere.  Observations are taken a bounded number at a time.
    A row has its observation's place, and bounds (near, far, within) of the nearest, the k-th and its reach.
    """
    found, pairs, lows, bounds = [], 0, [], []
    held = np.array([len(x.ref) for x in parts], float)
    step = max(1, CELLS // max(1, len(parts), len(rings.pivots.ref)))
    for at in range(0, len(obs), step):
        some = obs.iloc[at : at + step].reset_index(drop=True)
        ask = Asked(some, stacked(some["v"]), k, within, leave_out)
        least, home, low, bound, reach = rings.near(ask.v, ask.ids, k, leave_out, ask.truth, ask.reach)
        ask.narrow(low, bound, reach)
        # Who must meet most references anyway doesn't look at one block first.
        few = np.flatnonzero((least <= ask.cut()[:, None]) @ held < MOST * held.sum())
        order = few[np.argsort(home[few], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
            ask.meet(parts[home[rows[0]]], rows)
        least[few, home[few]] = np.inf
        for a, b, sizes in parts.runs:
            asked = least[:, a:b] <= ask.cut()[:, None]
            rows = np.flatnonzero(asked.any(1))
            if b - a > 1 and len(rows) and len(rows) * sizes.sum() * MOST <= (asked.sum(0) * sizes).sum():
                ask.meet(parts.joined(a, b), rows)
                continue
            for at in np.flatnonzero(asked.any(0)):
                rows = np.flatnonzero(least[:, a + at] <= ask.cut())
                if len(rows):
                    ask.meet(parts[a + at], rows)
        of, entity, ref, d = ask.gather()
        if len(of):
            found.append(pd.DataFrame({"obs": ask.ids[of], "entity": entity, "ref": ref, "distance": d, "near": ask.low[of], "far": ask.bound[of], "within": ask.reach[of]}))
        pairs += ask.pairs
        lows.append(ask.low)
        bounds.append(ask.bound)
    return pd.concat(found, ignore_index=True) if found else nothing("obs", "entity", "ref", "distance", "near", "far", "within"), pairs, np.concatenate(lows), np.concatenate(bounds)


def pivot_count(rows: int) -> int:
    return max(1, min(PIVOTS, int(2 * rows**0.5)))


def spread(kind: str, w: np.ndarray, n: int) -> np.ndarray:
    """Places of up to ``n`` vectors, each as far as can be from those before it: every cluster gets one before any gets two."""
    chosen, far = [0], distances(kind, w, w[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(kind, w, w[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _distinct(refs: DataFrame, k: int, every: bool, leave_out: bool) -> DataFrame:
    """References that can matter: the least of each (entity, vector), two where one may be left out.

    Equal vectors are equally far from everything and ties go by entity, so of a vector that
    many entities share k entities are enough (one more where one may be left out), unless
    ``every`` entity within a distance is wanted.
    """
    if leave_out:
        refs = refs.withColumn("_n", F.row_number().over(Window.partitionBy("entity", "w").orderBy("ref"))).filter("_n <= 2").drop("_n")
    else:
        refs = refs.groupBy("entity", "w").agg(F.min("ref").alias("ref"))
    if every:
        return refs
    return refs.withColumn("_n", F.dense_rank().over(Window.partitionBy("w").orderBy("entity"))).filter(F.col("_n") <= k + leave_out).drop("_n")


def nearest_entities(
    obs: DataFrame, refs: DataFrame, obs_id: str, ref_id: str, entity: str, vector: str, k: int = 2, within: float = 0.0, reach: str | None = None, kind: str = "l1", leave_out: bool = False, truth: str | None = None,
    small: int = SMALL, block: int | None = None, compared: Accumulator | None = None,
) -> DataFrame:
    """(obs_id, entity, distance, ref_id): the ``k`` nearest entities of each observation, ties by entity.

    With ``within`` also every entity that far from the nearest, and with ``reach``, a column
    of ``obs``, every one up to that distance.  With ``truth``, a column of ``obs`` too, these
    are the entities as near as the true one, and ``reach`` bounds its distance, so that an
    observation's reach shrinks as nearer references of it are met.  ``leave_out`` skips a reference with the
    observation's own id.  Null vectors, null or NaN entries and other lengths match nothing; rows of one
    observation id are one observation.  ``compared`` counts pairs.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c))
    a = obs.filter(whole).select(F.col(obs_id).alias("obs"), F.col(vector).alias("v"), (F.coalesce(F.col(reach).cast("double"), F.lit(-1.0)) if reach else F.lit(-1.0)).alias("reach"), *([F.col(truth).alias("truth")] if truth else []))
    b = refs.filter(whole & F.col(entity).isNotNull() & (F.size(vector) > 0)).select(F.col(ref_id).alias("ref"), F.col(entity).alias("entity"), F.col(vector).alias("w"))
    if truth and not reach:
        raise ValueError("truth needs a reach")
    if reach:
        each = a
        # Rows of one id share their answer: of several each looks as far as any of them.
        shared = a.groupBy("obs").agg(F.max("reach").alias("_most"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").drop("_rows")
        alone = F.col("_most").isNull()
        a = a.join(shared, "obs", "left").withColumns({"reach": F.coalesce("_most", "reach"), **({"truth": F.when(alone, F.col("truth"))} if truth else {})}).drop("_most")
    kinds = {**dict(a.dtypes), **dict(b.dtypes)}
    schema = f"obs {kinds['obs']}, entity {kinds['entity']}, ref {kinds['ref']}, distance double"
    count, numbers = b.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    b = _distinct(b, k, within > 0 or reach is not None, leave_out)
    if 8 * numbers + 64 * count <= small:
        found = _local(a, b, schema, k, within, kind, leave_out, block or LOCAL_BLOCK, compared)
    else:
        found = _dealt(a, b, schema, count, -(-numbers // count), k, within, kind, leave_out, block or BLOCK, compared)
    best = found.groupBy("obs", "entity").agg(F.min(F.struct("distance", "ref")).alias("m")).select("obs", "entity", "m.distance", "m.ref")
    order = Window.partitionBy("obs").orderBy("distance", "entity")
    keep = F.col("_n") <= k
    if within > 0:
        keep |= F.col("distance") - F.col("_low") <= within
    if truth:
        best = best.join(each.groupBy("obs").agg(F.collect_set("truth").alias("_truths")), "obs")
        best = best.withColumn("_reach", F.max(F.when(F.array_contains("_truths", F.col("entity")), F.col("distance"))).over(Window.partitionBy("obs")))
    elif reach:
        best = best.join(each.groupBy("obs").agg(F.max("reach").alias("_reach")), "obs")
    if reach:
        keep |= F.col("distance") <= F.col("_reach")
    best = best.withColumn("_n", F.row_number().over(order))
    if within > 0:
        best = best.withColumn("_low", F.min("distance").over(Window.partitionBy("obs")))
    # Written, as those who ask twice, or for some columns only, would search again.
    return work_table(best.filter(keep).select(F.col("obs").alias(obs_id), "entity", "distance", F.col("ref").alias("ref_id")), "nearest")


def _local(a: DataFrame, b: DataFrame, schema: str, k: int, within: float, kind: str, leave_out: bool, block: int, compared: Accumulator | None) -> DataFrame:
    rows = b.toPandas().sort_values(["entity", "ref"])  # of a checked size
    index = {int(n): Local(kind, part, block) for n, part in rows.groupby(rows["w"].map(len))} if len(rows) else {}
    known = a.sparkSession.sparkContext.broadcast(index)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len)
            for n in set(lengths) & set(known.value):
                found, pairs, _, _ = search(kind, known.value[n].rings, known.value[n].parts, batch[lengths == n], k, within, leave_out)
                if compared is not None:
                    compared.add(pairs)
                yield found[["obs", "entity", "ref", "distance"]]

    return a.mapInPandas(near, schema)


def _dealt(a: DataFrame, b: DataFrame, schema: str, count: int, width: int, k: int, within: float, kind: str, leave_out: bool, block: int, compared: Accumulator | None) -> DataFrame:
    spark = a.sparkSession
    block = max(block, -(-count // BLOCKS))
    held = max(block, GROUP // (8 * width))  # references that lie together
    visitors = max(1, min(VISITORS, held))
    b = work_table(b, "nearest-references")
    drawn = b.withColumn("size", F.size("w")).withColumn("_n", F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("w"), "entity", "ref"))).filter(F.col("_n") <= SPREAD * pivot_count(count)).drop("_n")
    drawn = drawn.toPandas().sort_values(["size", "entity", "ref"])  # a few times PIVOTS of each length
    pivots = pd.concat([part.iloc[spread(kind, stacked(part["w"]), pivot_count(count))] for _, part in drawn.groupby("size")] or [drawn])
    pivots = pivots.sort_values(["size", "entity", "ref"]).reset_index(drop=True)
    by_size = spark.sparkContext.broadcast({int(n): (part.index[0], stacked(part["w"])) for n, part in pivots.groupby("size")})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["w"].map(len)
            for n in set(sizes):
                own = batch[sizes == n].reset_index(drop=True)
                first, p = by_size.value[n]
                cell, r = nearest_place(kind, stacked(own["w"]), p)
                yield own.assign(cell=cell + first, r=r)

    kinds = dict(b.dtypes)
    placed = b.repartition(max(1, -(-count // PLACED))).mapInPandas(place, ", ".join(f"{c} {kinds[c]}" for c in b.columns) + ", cell long, r double")
    # Ranges of (pivot, distance) split a cell however full it is; a task numbers its rows, and a block is a run of them in one cell.
    tasks = max(1, -(-count // (4 * held)))
    ordered = placed.repartitionByRange(tasks, "cell", "r", "ref").sortWithinPartitions("cell", "r", "ref").withColumn("_row", F.monotonically_increasing_id())
    ordered = ordered.withColumns({"block": F.expr(f"_row div {block}"), "bin": F.expr(f"_row div {held}"), "size": F.size("w")}).drop("_row")
    rings = work_table(ordered, "nearest-rings")
    ring = rings.groupBy("bin", "block", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high")).toPandas().sort_values(["bin", "cell", "low", "block"])  # BLOCKS and a few more
    index = {}
    for n, part in pivots.groupby("size"):
        own = ring[ring["cell"].isin(part.index)].reset_index(drop=True)
        index[int(n)] = Rings(Part(kind, part["ref"].to_numpy(), part["entity"].to_numpy(), stacked(part["w"])), own[["bin", "block"]].to_numpy(np.int64), own["cell"].to_numpy() - part.index[0], own["low"].to_numpy(), own["high"].to_numpy())
    known = spark.sparkContext.broadcast(index)
    own_columns = a.columns
    wide = f"{', '.join(f'{c} {t}' for c, t in a.dtypes)}, bound double, low double, bin long, size int, salt long"

    def visits(first: bool, salts):
        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                lengths = batch["v"].map(len)
                for n in set(lengths) & set(known.value):
                    rings, same = known.value[n], batch[lengths == n].reset_index(drop=True)
                    bins, start = np.unique(rings.block[:, 0], return_index=True)
                    step = max(1, CELLS // max(1, len(rings.block), len(rings.pivots.ref)))
                    for at in range(0, len(same), step):
                        part = same.iloc[at : at + step].reset_index(drop=True)
                        ask = Asked(part, stacked(part["v"]), k, within, leave_out)
                        least, home, low, bound, reach = rings.near(ask.v, ask.ids, k, leave_out, ask.truth, ask.reach)
                        own = np.searchsorted(bins, rings.block[home, 0])
                        if first:
                            row, to = np.arange(len(part)), own
                        else:
                            low, bound, reach = (np.minimum(x, part[c].fillna(np.inf).to_numpy()) for x, c in ((low, "_low"), (bound, "_bound"), (reach, "_within")))
                            ask.narrow(low, bound, reach)
                            ok = np.logical_or.reduceat(least <= ask.cut()[:, None], start, axis=1)
                            ok[np.arange(len(part)), own] = False
                            row, to = np.nonzero(ok)
                        # An observation may visit every bin: its vector is copied for a bounded number of visits at a time.
                        for cut in range(0, len(row), BATCH):
                            of, at_bin = row[cut : cut + BATCH], bins[to[cut : cut + BATCH]]
                            out = part.iloc[of][own_columns].assign(reach=reach[of], bound=bound[of], low=low[of], bin=at_bin, size=np.int32(n))
                            many = np.array([salts.value.get((b, n), 1) for b in at_bin.tolist()], np.int64) if salts else 1
                            yield out.assign(salt=pd.util.hash_array(out["obs"].to_numpy()).astype(np.int64) % many)

        return visit

    def meet(rows: DataFrame, first: bool) -> DataFrame:
        asked = rows.mapInPandas(visits(first, None), wide).groupBy("bin", "size").agg(F.count(F.lit(1)).alias("n")).collect()  # fewer than BLOCKS
        cores = spark.sparkContext.defaultParallelism
        together = min(visitors, max(ALONE, -(-sum(r["n"] for r in asked) // (4 * cores))))
        many = {(r["bin"], r["size"]): -(-r["n"] // together) for r in asked if r["n"] > together}  # bins that many visit
        tasks = max(1, min(4 * sum(many.get((r["bin"], r["size"]), 1) for r in asked), 16 * cores))
        salts = spark.sparkContext.broadcast(many)
        copies = spark.createDataFrame([(int(b), int(n), int(m)) for (b, n), m in many.items()], "bin long, size int, n long")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)) - 1))
        met = rings.join(F.broadcast(copies), ["bin", "size"], "left").withColumn("salt", each)

        def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return nothing("obs", "entity", "ref", "distance", "near", "far", "within")
            every = known.value[len(y["w"].iloc[0])]
            pivots = every.pivots
            here = np.flatnonzero(every.block[:, 0] == y["bin"].iloc[0])
            cells = np.unique(every.pivot[here])  # pivots stay in order of entity
            own = Rings(Part(kind, pivots.ref[cells], pivots.entity[cells], pivots.w[cells]), every.block[here], np.searchsorted(cells, every.pivot[here]), every.low[here], every.high[here])
            offset = y["cell"].min() - cells[0]
            y = y.sort_values(["entity", "ref"])
            of = {key: rows for key, rows in y.groupby(["block", "cell"])}
            parts = [of[b, int(c)] for b, c in zip(every.block[here, 1].tolist(), every.pivot[here] + offset)]
            found, pairs, _, _ = search(kind, own, Parts(Part(kind, rows["ref"].to_numpy(), rows["entity"].to_numpy(), stacked(rows["w"])) for rows in parts), x, k, within, leave_out)
            if compared is not None:
                compared.add(pairs)
            return found

        asked = rows.mapInPandas(visits(first, salts), wide)
        # By number, so that small tables with much to compare aren't brought together in few tasks.
        asked, met = (x.repartition(tasks, "bin", "size", "salt") for x in (asked, met))
        return asked.groupBy("bin", "size", "salt").cogroup(met.groupBy("bin", "size", "salt")).applyInPandas(compare, schema + ", near double, far double, within double")

    home = work_table(meet(a, True), "nearest-home")
    bounds = home.groupBy("obs").agg(F.min("near").alias("_low"), F.min("far").alias("_bound"), F.min("within").alias("_within"))
    rest = meet(work_table(a.join(bounds, "obs", "left"), "nearest-bounds"), False)
    return home.select("obs", "entity", "ref", "distance").unionByName(rest.select("obs", "entity", "ref", "distance"))
