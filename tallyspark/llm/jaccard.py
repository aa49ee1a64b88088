"""N-gram Jaccard self-join with parity sketches.

A document's tokens are its distinct word shingles (64-bit hashes).  In a parity sketch
each token flips one bit, so the Hamming distance of two sketches is at most the size
of the symmetric difference.  Where two sets link, with sizes n <= m, that difference is
at most 3 (n + m) / 37 (for 85 of 100).  Sizes fall in bands, and a set also enters the next
band if a partner may be there.  The sketch of a band is cut into parts, a third more than
the largest difference in it, so most sets have tokens in more parts than can differ.  Such
a set's keys are (band, part, tokens in it, parity bits) of one part more than can differ
for its own size, the first ones in an order that all sets share: two linked sets agree in
one key at least (pigeonhole).  The order goes by falling number of tokens, as texts that
share a passage only agree in a part of one token often and in one of three seldom.  The
few sets with tokens in too few parts have all parts as keys.

Keys travel in packed blocks to buckets, whose number grows with the input.  A key of up
to ``FEW`` sets gives all its pairs; a longer one links its members to one hub, and what
such a key may still hide is settled afterwards: of the keys whose members aren't in one
component, first neighbours in a salted order are tried.  Members of keys that stay open are
joined by their rarest tokens: sets that link share one at the front of both, so a template
that many texts share gives no pairs, and work grows with the members.  Pairs are dropped
where a sketch of 512 bits proves them too far apart, and verified on the exact sets.
Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import BitFilter, GAMMA, KeyFilter, U, Words, bucket_count, buffer_of, dealt, lean, mix, row_key, slices, spans, spent, spill, text_bytes, unused, wide_rows
from tallyspark.llm.components import components

GROWTH = 1.4
#: Sets of a key that are paired: the pairs grow with the square, what longer keys take grows with their members.
FEW, FEW_HERE = 8, 4
#: Members that a rare token has at most.
RARE = 8
#: Bytes of text that are shingled together.
SLICE = 2 << 20
POSITIONS = U((1 << 20) - 1)
SKETCH_BITS, SKETCH_WORDS = 512, 8
KEYS, HUBS, PAIRS, REST, FACTS = range(5)


def bands(limit: int) -> np.ndarray:
    """Lower ends of the size bands: the same series whatever ``limit``, with two ends beyond it."""
    ends = [1]
    while len(ends) < 3 or ends[-2] <= limit:
        ends.append(max(ends[-1] + 1, int(ends[-1] * GROWTH)))
    return np.array(ends, np.int64)


class Shingles:
    """Sorted distinct shingle hashes of each document of a slice."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, width: int):
        w = Words(buf, off, lower=True)
        h, n = w.hash, len(w)
        rolled = np.zeros(n, U)
        for k in range(width):
            rolled[: max(0, n - width + 1)] += h[k : max(k, n - width + 1 + k)] * mix(np.array([k + 1], U))[0]
        rolled = mix(rolled)
        self.sets: list[np.ndarray] = []
        for a, b in zip(w.doc[:-1], w.doc[1:]):
            if b - a >= width:
                self.sets.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:  # the whole sequence as one, apart from all longer shingles
                one = np.array([b - a], U)
                for x in h[a:b]:
                    one = mix(one * GAMMA + x)
                self.sets.append(one)
            else:
                self.sets.append(rolled[:0])
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.sketches = np.zeros((len(self.sets), SKETCH_WORDS), np.int64)
        for i, tokens in enumerate(self.sets):
            place = ((tokens >> U(44)) & U(SKETCH_BITS - 1)).astype(np.int64)
            odd = (np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)
            self.sketches[i] = np.packbits(odd, bitorder="little").view(np.int64)
        self.ids = np.array([(mix(s + U(len(s))).sum(dtype=U) if len(s) else 0) for s in self.sets], U).view(np.int64)


def sketch_keys(sets: list[np.ndarray], ids: np.ndarray, low: int = 85) -> tuple[np.ndarray, np.ndarray]:
    """All (key, set id) entries of non-empty sets for a similarity of ``low`` of 100."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes):
        return np.zeros(0, U), np.zeros(0, np.int64)
    tokens = np.concatenate(sets)
    flips = mix((tokens & POSITIONS) + GAMMA)
    ends = bands(int(sizes.max()))
    own = np.searchsorted(ends, sizes, "right") - 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    found = []
    for step in (0, 1):
        band = own + step
        use = np.flatnonzero((sizes > 0) & ((step == 0) | (100 * sizes >= low * ends[band])))
        if not len(use):
            continue
        n, top = sizes[use], ends[band[use] + 1] - 1
        most = (100 - low) * 2 * top // (100 + low)  # of the symmetric difference in the band
        own_most = (100 - low) * (n + np.minimum(top, 100 * n // low)) // (100 + low)  # of this set with any partner there
        parts = most + most // 3 + 3
        first = np.concatenate(([0], np.cumsum(parts)))
        at = spans(starts[use], n)
        cell = np.repeat(first[:-1], n) + ((tokens[at] >> U(24)) % np.repeat(parts, n).astype(U)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        bits = np.zeros(first[-1], U)
        bits[cell[new]] = np.bitwise_xor.reduceat(flips[at][order], new)
        held = np.bincount(cell, minlength=first[-1])
        owner = np.repeat(np.arange(len(use)), parts)
        enough = np.add.reduceat((held > 0).astype(np.int64), first[:-1]) > own_most
        part = np.arange(first[-1]) - first[:-1][owner]
        key = mix(bits + mix(part.astype(U) * GAMMA + band[use][owner].astype(U) + (held.astype(U) << U(32))))
        rows = np.flatnonzero((held > 0) | ~enough[owner])
        rows = rows[np.lexsort((key[rows], -held[rows], owner[rows]))]  # by what the key holds alone, so all sets share the order
        place = np.arange(len(rows)) - np.searchsorted(owner[rows], owner[rows])
        rows = rows[(place <= own_most[owner[rows]]) | ~enough[owner[rows]]]
        found.append((key[rows], ids[use][owner[rows]]))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _runs(keys: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct entries, with the index of the first entry of the key and the key's count."""
    order = np.lexsort((ids, keys))
    keys, ids, more = keys[order], ids[order], [m[order] for m in more]
    if len(keys):
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        more = [np.maximum.reduceat(m, np.flatnonzero(fresh)) for m in more]
        keys, ids = keys[fresh], ids[fresh]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(keys)))
    return (keys, ids, np.repeat(start, count), np.repeat(count, count), *more)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


BLOCK = "bucket long, kind int, x binary, y binary, z binary, s binary"
FOUND = "kind int, a long, b long, c long, s array<bigint>"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*[(*r, b"") if len(r) == 5 else r for r in rows])) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "kind", "x", "y", "z", "s"])


def _blocks(width: int, low: int, buckets: int):
    """Documents -> packed blocks; what needs no partner goes to pass-through buckets below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Shingles(*buffer_of(part.column("text")), width)
                id_col = part.column("id")
                null = np.asarray(id_col.is_null())
                docs = np.asarray(id_col.fill_null(0)).astype(np.int64)
                side = -1 - int(mix(np.array([s.ids.view(U).sum(dtype=U) + U(len(docs))], U))[0] % U(buckets))
                rows = [(side, FACTS, _blob(docs), _blob(s.ids), _blob(s.sizes * 2 + null), _blob(s.sketches))]
                _, once = np.unique(s.ids, return_index=True)
                once = once[s.sizes[once] > 0]
                keys, ids, start, count = _runs(*sketch_keys([s.sets[i] for i in once], s.ids[once], low))
                many = count > FEW_HERE
                if many.any():  # collapsed here: only the hub of such a key travels
                    inner = many & (start != np.arange(len(keys)))
                    pair = np.unique(np.stack([ids[start[inner]], ids[inner]], 1), axis=0)
                    rows.append((side, PAIRS, _blob(pair[:, 0]), _blob(pair[:, 1]), b""))
                    rows.append((side, REST, _blob(keys[inner]), _blob(ids[inner]), b""))
                for kind, chosen in ((KEYS, ~many), (HUBS, many & (start == np.arange(len(keys))))):
                    k, i = keys[chosen], ids[chosen]
                    to = (k % U(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    to, k, i = to[order], k[order], i[order]
                    at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else []
                    rows += [(int(to[a]), kind, _blob(k[a:b]), _blob(i[a:b]), b"") for a, b in zip(at, np.append(at[1:], len(to)))] if len(to) else []
                yield _emit(rows)

    return run


def _found(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None, sketches: np.ndarray | None = None) -> pa.Table:
    n = len(a)
    none = pa.nulls(n, pa.list_(pa.int64()))
    lists = none if sketches is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(sketches))
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), "a": pa.array(a), "b": pa.array(b), "c": pa.array(np.zeros(n, np.int64) if c is None else c), "s": lists})


def _match(table: pa.Table) -> pa.Table:
    """One bucket: entries by key -> candidate pairs and the members of long keys; other rows pass."""
    kinds = np.asarray(table.column("kind"))
    x, y, z, s = (table.column(c).combine_chunks() for c in "xyzs")
    long_of = lambda col, i: np.frombuffer(col[i].as_buffer(), np.int64)
    out, entries = [_found(PAIRS, *[np.zeros(0, np.int64)] * 2)], []
    for i, kind in enumerate(kinds):
        a, b = long_of(x, i), long_of(y, i)
        if kind in (KEYS, HUBS):
            entries.append((a.view(U), b, np.full(len(a), kind == HUBS)))
        elif kind == FACTS:
            out.append(_found(kind, a, b, long_of(z, i), long_of(s, i)))
        else:
            out.append(_found(kind, a, b))
    if entries:
        keys, ids, start, count, hub = _runs(*(np.concatenate(e) for e in zip(*entries)))
        long = count > FEW
        if hub.any():
            first = np.flatnonzero(start == np.arange(len(keys)))
            long |= np.repeat(np.logical_or.reduceat(hub, first), count[first])
        here = np.arange(len(keys))
        star = np.flatnonzero(long & (start != here))
        pairs = [(ids[start[star]], ids[star])]
        for k in range(1, FEW):
            i = np.flatnonzero(~long & (here - start >= k))
            pairs.append((ids[i - k], ids[i]))
        a, b = (np.concatenate(p) for p in zip(*pairs))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        out.append(_found(PAIRS, pair[:, 0].copy(), pair[:, 1].copy()))
        i = np.flatnonzero(long)
        out.append(_found(REST, keys[i].view(np.int64), ids[i]))
    return pa.concat_tables(out)


def wide_sketch(tokens: np.ndarray) -> bytes:
    bits = max(SKETCH_BITS, 1 << (4 * len(tokens) - 1).bit_length())
    place = ((tokens >> U(20)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches; the longer is folded, which never adds to it."""
    u, v = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(u) != len(v):
        if len(u) < len(v):
            u, v = v, u
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _sets_of(docs: DataFrame, wanted: BitFilter, width: int) -> DataFrame:
    """(set_id, n, wide, tokens) of the documents that stand for a wanted set; the filter is bounded in size.

    ``wide`` is a parity sketch of four bits or more a token: a sixteenth of the set's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Shingles(*buffer_of(part.column("text")), width)
                docs = np.asarray(part.column("id").fill_null(0)).astype(np.int64)
                use = np.flatnonzero(shared.value.test(s.ids, docs) & (s.sizes > 0))
                use = use[np.unique(np.stack([s.ids[use], docs[use]], 1), axis=0, return_index=True)[1]] if len(use) else use
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[use]), pa.array(s.sizes[use]), pa.array([wide_sketch(s.sets[i]) for i in use], pa.binary()), pa.array([_blob(s.sets[i]) for i in use], pa.binary())], names=["set_id", "n", "wide", "tokens"])

    return docs.mapInArrow(lean(run), "set_id long, n long, wide binary, tokens binary")


SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]


def _near(low: int) -> F.Column:
    """Sizes and sketches of x and y allow a link."""
    apart = sum(F.bit_count(F.col(f"{s}_x").bitwiseXOR(F.col(f"{s}_y"))) for s in SKETCH)
    sizes = 100 * F.least("n_x", "n_y") >= low * F.greatest("n_x", "n_y")
    return sizes & ((100 + low) * apart <= (100 - low) * (F.col("n_x") + F.col("n_y")))


def _side(nodes: DataFrame, x: str, key: str) -> DataFrame:
    return nodes.select(F.col("set_id").alias(key), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *SKETCH)])


class Sets:
    """Exact sets (set_id, n, wide, tokens), written out once for those that are asked for."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, width: int):
        self.texts, self.nodes, self.width, self.table = texts, nodes, width, None
        self.tables: list[DataFrame] = []  # written ones that ``table`` is made of

    def of(self, ends: DataFrame) -> DataFrame:
        """A table that holds the sets of ``ends`` (set_id); texts are read again only where some are new."""
        ends = ends.select("set_id").distinct()
        if self.table is not None:
            ends = ends.join(self.table.select("set_id"), "set_id", "left_anti")
        stands = spill(self.nodes.join(ends, "set_id", "left_semi").select("set_id", "id"), "stands", narrow=True)
        if self.table is None or stands.limit(1).count():
            more = spill(_sets_of(self.texts, BitFilter.build(stands, "set_id", "id"), self.width), "tokens")
            rows, distinct = more.agg(F.count(F.lit(1)), F.count_distinct("set_id")).first()
            if self.table is not None:  # the filter lets a few others through
                more = more.join(stands.select("set_id"), "set_id", "left_semi")
            if rows != distinct:  # rows that repeat id and text, in different slices
                more = more.dropDuplicates(["set_id"])
            if rows != distinct or self.table is not None:
                more = spill(more, "tokens")
            self.tables.append(more)
            self.table = more if self.table is None else self.table.unionByName(more)
        return self.table


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set_id"))


def _those(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that are ends of pairs, and a few more: a filter of their ids spares the others the shuffle."""
    ends = spill(_ends(pairs).distinct(), "ends", narrow=True)
    return KeyFilter(ends, "set_id").probe(sets, "set_id").filter("_maybe").drop("_maybe")


def _verify(pairs: DataFrame, nodes: DataFrame, exact: Sets, low: int) -> DataFrame:
    """Those of (a, b) whose exact sets link."""
    with spent(pairs.sparkSession) as keep:
        found = keep(_verified(pairs, nodes, exact, low))
        for table in exact.tables:
            keep(table)
    return found


def _verified(pairs: DataFrame, nodes: DataFrame, exact: Sets, low: int) -> DataFrame:
    pairs = pairs.join(_side(nodes, "x", "a"), "a").join(_side(nodes, "y", "b"), "b").filter(_near(low)).select("a", "b")
    pairs = spill(pairs, "near", narrow=True)
    sets = _those(exact.of(_ends(pairs)), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for s, t in zip(batch.column("s"), batch.column("t")):
                u, v = np.frombuffer(s.as_buffer(), U), np.frombuffer(t.as_buffer(), U)
                both = np.sort(np.concatenate((u, v)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= low * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [(100 + low) * sketch_distance(u, v) <= (100 - low) * n for u, v, n in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "n")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("set_id").alias("a"), F.col("n").alias("p"), F.col("wide").alias("u"))
    y = sets.select(F.col("set_id").alias("b"), F.col("n").alias("q"), F.col("wide").alias("v"))
    thin = pairs.join(x, "a").join(y, "b").select("a", "b", "u", "v", (F.col("p") + F.col("q")).alias("n"))
    pairs = spill(thin.mapInArrow(lean(close), "a long, b long"), "close", batch=2000)
    sets = _those(sets, pairs)
    left = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("s")), "a")
    full = left.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("t")), "b")
    return spill(full.select("a", "b", "s", "t").mapInArrow(lean(run), "a long, b long"), "verified", batch=200)


#: Members of an unsettled key that are ordered together, about, and how many neighbours each tries.
GROUP, NEIGHBOURS = 1000, 3


def _unsettled(rest: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Members (key, main, members, set_id, component, n, sketch) of keys whose members are in different components."""
    placed = rest.join(named, rest["set_id"] == named["node"], "left").select("key", "set_id", F.coalesce("component", "set_id").alias("component"))
    placed = spill(placed, "rest", narrow=True)
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_keys = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_keys = spill(open_keys.select(F.col("key").alias("open"), "main", "members"), "open", narrow=True)
    if not open_keys.limit(1).count():
        return None
    joined = placed.join(open_keys, F.col("key") == F.col("open")).drop("open")
    return spill(joined.join(nodes.select("set_id", "n", *SKETCH), "set_id"), "unsettled", narrow=True)


def _neighbours(rest: DataFrame) -> DataFrame:
    """Pairs of members that stand next to each other by size, in groups that don't grow with the key."""
    salt = F.pmod(F.xxhash64("set_id"), F.expr(f"members div {GROUP} + 1"))
    order = Window.partitionBy("key", "_salt").orderBy("n", "set_id")
    out = rest.withColumn("_salt", salt)  # a window can't stand inside a generator
    after = F.array(*[F.struct(*[F.lead(c, k).over(order).alias(c) for c in ("set_id", "component", "n", *SKETCH)]) for k in range(1, NEIGHBOURS + 1)])
    both = ("set_id", "component", "n", *SKETCH)
    out = out.withColumn("after", after).select(*[F.col(c).alias(f"{c}_x") for c in both], F.explode("after").alias("y"))
    return out.select("*", *[F.col(f"y.{c}").alias(f"{c}_y") for c in both]).drop("y").filter("set_id_y IS NOT NULL AND component_x != component_y")


def _rarest(members: DataFrame, exact: Sets, low: int) -> DataFrame:
    """Pairs of members in different components that share one of the rarest tokens of both.

    All sets share one order of tokens: those of one member, then those of up to RARE, then
    the others, each by value.  Two filters, bounded in size, tell them apart where the set
    is read, so only tokens of the front travel; a token that a filter takes for another kind
    has the same place in every set.  Of two sets that link, with sizes n <= m, the first
    token that both have is among the first n - ceil(2 low n / (100 + low)) + 1 of the smaller
    and the first m - ceil(low m / 100) + 1 of the larger one.
    """
    sides = spill(members.select("set_id", "component", "n", *SKETCH).dropDuplicates(["set_id"]), "members", narrow=True)
    sets = exact.of(sides).select("set_id", "tokens")
    context = sets.sparkSession.sparkContext
    inside = context.broadcast(BitFilter.build(sides, "set_id", "set_id"))

    def chosen(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Set ids, sizes and all tokens of the members in a batch."""
        ids = np.asarray(batch.column("set_id"))
        use = np.flatnonzero(inside.value.test(ids, ids))
        found = [np.frombuffer(batch.column("tokens")[int(i)].as_buffer(), np.int64) for i in use]
        return ids[use], np.array([len(t) for t in found], np.int64), np.concatenate(found) if found else np.zeros(0, np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, count = np.unique(chosen(batch)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count)], names=["token", "held"])

    held = sets.mapInArrow(lean(counted), "token long, held long").groupBy("token").agg(F.sum("held").alias("held")).filter("held > 1")
    held = spill(held, "member-tokens", batch=500)
    shared = context.broadcast(BitFilter.build(held, "token", "token"))
    often = context.broadcast(BitFilter.build(held.filter(F.col("held") > RARE), "token", "token"))

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, token = chosen(batch)
            of = np.repeat(np.arange(len(ids)), size)
            kind = np.where(often.value.test(token, token), 2, shared.value.test(token, token).astype(np.int64))
            order = np.lexsort((token, kind, of))
            token, kind = token[order], kind[order]
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            probe, index = size + (-low * size) // 100 + 1, size + (-2 * low * size) // (100 + low) + 1
            use = np.flatnonzero((place < probe[of]) & (kind > 0))
            yield pa.RecordBatch.from_arrays([pa.array(ids[of[use]]), pa.array(token[use]), pa.array(place[use] < index[of[use]])], names=["set_id", "token", "index"])

    first = spill(sets.mapInArrow(lean(front), "set_id long, token long, index boolean"), "member-rarest", batch=500)
    both = spill(first.join(sides, "set_id"), "member-sides")
    x, y = (both.select("token", "index", *[F.col(c).alias(f"{c}_{side}") for c in ("set_id", "component", "n", *SKETCH)]) for side in "xy")
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("set_id_x") < F.col("set_id_y")))
    return x.filter("index").drop("index").join(y.drop("index"), "token").filter(smaller & (F.col("component_x") != F.col("component_y")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, low: int = 85) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links).

    Ids are integers.  Null and wordless texts have an empty set and only themselves;
    texts shorter than a shingle are one token; repeated rows are linked copies; a null
    id is never a component's name unless alone; an empty table gives no rows.
    """
    with spent(docs.sparkSession) as keep:
        placed, lowest = map(keep, _placed(docs, id_col, text_col, width, low))
    joined = placed.join(lowest, F.col("component") == F.col("name"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, low: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, component) of every row, and the smallest id of each component of more than one."""
    texts = wide_rows(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = bucket_count(text_bytes(docs, text_col))
    blocks = dealt(texts.mapInArrow(lean(_blocks(width, low, buckets)), BLOCK), buckets)
    found = spill(blocks.groupBy("bucket").applyInArrow(lambda t: _match(t), FOUND), "matched")
    facts = found.filter(F.col("kind") == FACTS).select(F.expr("if(c % 2 = 1, null, a)").alias("id"), F.col("b").alias("set_id"), F.expr("c div 2").alias("n"), "s")
    # A node stands for all documents with its set; what stands for it is the smallest id (0 for null).
    nodes = spill(facts.groupBy("set_id").agg(F.coalesce(F.min("id"), F.lit(0)).alias("id"), F.min("n").alias("n"), *[F.min(F.get("s", k)).alias(s) for k, s in enumerate(SKETCH)]), "nodes", narrow=True)
    tried = spill(found.filter(F.col("kind") == PAIRS).select("a", "b").distinct(), "pairs", narrow=True)
    exact = Sets(texts, nodes, width)
    links = _verify(tried, nodes, exact, low)
    named = spill(components(links), "components", narrow=True)
    rest = found.filter(F.col("kind") == REST).select(F.col("a").alias("key"), F.col("b").alias("set_id")).distinct()
    for candidates in (_neighbours, lambda members: _rarest(members, exact, low)):
        if (members := _unsettled(rest, named, nodes)) is None:
            break
        more = candidates(members).filter(_near(low)).select(F.least("set_id_x", "set_id_y").alias("a"), F.greatest("set_id_x", "set_id_y").alias("b")).distinct()
        more = spill(more.join(tried, ["a", "b"], "left_anti"), "pairs", narrow=True)
        tried = tried.unionByName(more)
        links = links.unionByName(_verify(more, nodes, exact, low))
        named = spill(components(links), "components", narrow=True)

    placed = facts.join(named, facts["set_id"] == named["node"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "set_id")).alias("component"))
    placed = spill(placed, "placed", narrow=True)
    lowest = spill(placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("component").alias("name"), "first"), "lowest", narrow=True)
    return placed, lowest


def _losers(keyed: DataFrame, key: str, id_col: str, text_col: str, width: int, low: int) -> tuple[DataFrame, DataFrame]:
    """Keys of rows that go (_gone), and keys that several rows have (_again)."""
    found = jaccard_components(keyed, key, text_col, width, low).filter("n_shingles > 0")
    found = found.groupBy(F.col(key).alias("_of"), "component_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = keyed.groupBy(F.col(key).alias("_row")).agg(F.min(id_col).alias("_id"))
    placed = spill(found.join(ids, F.col("_of") == F.col("_row")).drop("_row"), "near-placed", narrow=True)
    order = F.struct(F.col("_id").isNull(), "_id", "_of")
    stays = placed.groupBy(F.col("component_id").alias("_name")).agg(F.min_by("_of", order).alias("_stays"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    stays = spill(stays.select("_name", "_stays"), "near-stays", narrow=True)
    gone = placed.join(stays, F.col("component_id") == F.col("_name")).filter("_of != _stays").select(F.col("_of").alias("_gone"))
    return spill(gone, "near", narrow=True), spill(placed.filter("_n > 1").select(F.col("_of").alias("_again")), "near-again", narrow=True)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, low: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns as given.

    Rows are told apart by id and text, so an id with two texts is two documents.  A null
    id loses every tie; of rows that repeat id and text one stays; texts without words all
    stay; a very long text is shingled whole; an empty table stays empty.
    """
    key = unused(docs, "tally_key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    with spent(docs.sparkSession) as keep:
        gone, again = map(keep, _losers(keyed, key, id_col, text_col, width, low))
    left = keyed.join(gone, keyed[key] == gone["_gone"], "left_anti")
    if again.limit(1).count():
        same = left[key] == again["_again"]
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([key]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
