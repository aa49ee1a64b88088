"""Byte-level BPE encoding and decoding with overlapping chunks.

Every text is cut into chunks that overlap.  Chunks are pre-tokenised apart from each
other and stitched where their boundaries resynchronise: a match depends only on what
follows its start, so from a boundary that both sides share they agree.  Where no boundary
is shared (one run longer than the overlap), the chunks are matched again as one text, and
their number doubles until a boundary is.  Boundaries within ``GUARD`` characters of a
chunk's end aren't trusted: public_tokenizers.PATTERN looks ahead two characters at most
besides runs of one class, and a run that reaches the end has no boundary there.

All texts take these steps.  Chunks of most texts are worked on where the text is read; a
text of more than ``DEALT`` chunks deals them out over the cluster to be pre-tokenised.

The pieces of a slice of texts are encoded together: its distinct pieces, by a 64-bit hash
of their bytes, are merged once, those of one length as rows of a matrix, and their ids
gathered.  Each slice is then decoded and compared with its bytes, so that two pieces of
one hash can't go wrong.  Nothing is remembered from slice to slice.  Decoding
concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import GAMMA, U, buffer_of, hash_runs, lean, slices, spans, wide_rows

CHUNK, OVERLAP, GUARD = 4096, 128, 4
#: Texts of more chunks than this are dealt out.
DEALT = 8
#: Bytes of text encoded together.
SLICE = 1 << 20
#: Pieces of up to so many bytes are merged together as rows of a matrix, longer ones one by one.
ROW_BYTES = 32
NO_PAIR = np.int32(np.iinfo(np.int32).max)
#: Texts or id lists decoded together hold about so many ids.
IDS_AT_ONCE = 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file as it is (fixed size, under 1 MB): it travels with the job, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: again and again the pair of lowest rank, the leftmost of equals, becomes one."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue
        alive[j] = False
        end[i], after[i] = to, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return tuple(out)


class PairRanks:
    """Rank of the token that two tokens make, in an open table of hashed slots."""

    def __init__(self, ranks: dict[bytes, int], size: int):
        pairs = [(ranks[t[:i]] * size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T
        self.size, self.bits = size, max(10, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = keys[free]  # of those that want one slot the last has it
            held = self.slots[at[left]] == keys[left]
            self.values[at[left[held]]] = values[left[held]]
            left = left[~held]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * GAMMA) >> U(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = self._place(keys)
        slots, out = self.slots[at], self.values[at]
        other = np.flatnonzero((slots != keys) & (slots >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.slots) - 1)
            slots[other], out[other] = self.slots[at[other]], self.values[at[other]]
            other = other[(slots[other] != keys[other]) & (slots[other] >= 0)]
        out[slots != keys] = NO_PAIR
        return out


class Coder:
    """Ranks, the bytes of every id and the ranks of pairs."""

    def __init__(self, raw: bytes):
        self.ranks = parse_ranks(raw)
        size = 1 + max(self.ranks.values(), default=0)
        spelled = [b""] * size
        for token, rank in self.ranks.items():
            spelled[rank] = token
        self.length = np.fromiter(map(len, spelled), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.pairs = PairRanks(self.ranks, size)
        self.byte_id = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int32)
        if self.byte_id.min() < 0:
            raise ValueError("the ranks must hold every single byte")
        used = np.flatnonzero(self.length > 1)
        hashed = hash_runs(np.concatenate((self.bytes, np.zeros(8, np.uint8))), self.start[used], self.start[used] + self.length[used])
        order = np.argsort(hashed)
        self.whole_hash, self.whole_id = hashed[order], used[order].astype(np.int32)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Concatenated bytes of ids; an id outside the ranks is an error."""
        return self.bytes[spans(self.start[ids], self.length[ids])]

    def encode(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of ``data``, which lie side by side from ``start`` on, and how many each piece has."""
        end = np.append(start[1:], len(data))
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        keys, first, which = np.unique(hash_runs(padded, start, end), return_index=True, return_inverse=True)
        ids, count = self._distinct(data, keys, start[first], end[first])
        ids, count = ids[spans((np.cumsum(count) - count)[which], count[which])], count[which]
        spelled = self.spell(ids)
        if len(spelled) != len(data) or not np.array_equal(spelled, data):  # two pieces of one hash
            found = [merge(data[a:b].tobytes(), self.ranks) for a, b in zip(start, end)]
            ids, count = np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found], np.int64)
        return ids, count

    def _distinct(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one piece after the other, and how many each has."""
        length = end - start
        at = np.minimum(np.searchsorted(self.whole_hash, keys), len(self.whole_hash) - 1)
        token = np.where(self.whole_hash[at] == keys, self.whole_id[at], -1) if len(self.whole_hash) else np.full(len(keys), -1)
        parts = [(np.flatnonzero(token >= 0), token[token >= 0][:, None])]
        for size in np.unique(length[token < 0]).tolist():
            rows = np.flatnonzero((token < 0) & (length == size))
            if size <= ROW_BYTES:
                parts += [(rows[r], t) for r, t in self._merge_rows(self.byte_id[data[start[rows][:, None] + np.arange(size)]])]
            else:
                parts += [(rows[k : k + 1], np.array([merge(data[start[r] : end[r]].tobytes(), self.ranks)], np.int32)) for k, r in enumerate(rows)]
        count = np.zeros(len(keys), np.int64)
        for rows, ids in parts:
            count[rows] = ids.shape[1]
        first = np.cumsum(count) - count
        out = np.zeros(count.sum(), np.int32)
        for rows, ids in parts:
            out[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, count

    def _merge_rows(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) as they end; in each round every row left merges its pair of lowest rank, the leftmost of equals."""
        rows, out = np.arange(len(ids)), []
        rank = self.pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            width, all_rows = ids.shape[1], np.arange(len(rows))
            at = rank.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            least = rank[all_rows, at] if width > 1 else np.full(len(rows), NO_PAIR)
            go = least != NO_PAIR
            if not go.all():
                out.append((rows[~go], ids[~go]))
                rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
                all_rows = all_rows[: len(rows)]
            if not len(rows):
                break
            stay = np.ones(ids.shape, bool)
            stay[all_rows, at + 1] = False
            ids = ids[stay].reshape(len(rows), width - 1)
            ids[all_rows, at] = least
            stay = np.ones(rank.shape, bool)
            stay[all_rows, at] = False
            rank = rank[stay].reshape(len(rows), width - 2)
            for side in (0, -1):  # the pairs that begin and end with the new token
                use = np.flatnonzero((at + side >= 0) & (at + side < width - 2))
                left = at[use] + side
                rank[use, left] = self.pairs.of(ids[use, left], ids[use, left + 1])
        return out


_made: dict[int, Coder] = {}


def coder_of(raw: bytes) -> Coder:
    """One for each worker process and rank file; the last one only is held."""
    key = hash(raw)
    if key not in _made:
        _made.clear()
        _made[key] = Coder(raw)
    return _made[key]


def splitter(pattern: str) -> regex.Pattern:
    split = regex.compile(pattern)
    if split.groups:
        raise ValueError("the pattern of pieces must have no capturing groups")
    return split


def chunk_starts(size: int, chunk: int, overlap: int) -> range:
    """Where the chunks of a text start; what is no longer than a chunk and its overlap is one chunk."""
    return range(0, max(1, size - overlap), chunk)


def cuts(text: str, split: regex.Pattern) -> np.ndarray:
    """Starts of all matches, which must cover the text."""
    found = split.findall(text)
    length = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(length)
    if (end[-1] if len(end) else 0) != len(text):
        raise ValueError("the pattern of pieces must match every character")
    return end - length


def stitch(chunks: list[tuple[int, str, np.ndarray]], split: regex.Pattern) -> np.ndarray:
    """Starts of the matches of a whole text from its chunks (start, text, cuts), which overlap, in order."""
    at, text, own = chunks[0]
    own = own + at
    done, out, k = at, [], 1
    while k < len(chunks):
        start, more, theirs = chunks[k]
        trusted = own[(own >= max(done, start)) & (own <= at + len(text) - GUARD)]
        shared = np.intersect1d(trusted, theirs + start, assume_unique=True)[:1]
        if len(shared):
            out.append(own[(own >= done) & (own < shared[0])])
            done, at, text, own = int(shared[0]), start, more, theirs + start
            k += 1
            continue
        parts, end = [text[done - at :]], at + len(text)
        enough = end + (end - done)  # doubles, so that a long run is matched a few times only
        while k < len(chunks) and end < enough:
            start, more, _ = chunks[k]
            parts.append(more[end - start :])
            end = start + len(more)
            k += 1
        at, text = done, "".join(parts)
        own = cuts(text, split) + at
    out.append(own[own >= done])
    return np.concatenate(out)


def pieces_of(text: str, split: regex.Pattern, chunk: int, overlap: int) -> np.ndarray:
    """Starts of the pieces of one text, by its chunks."""
    parts = [(s, part, cuts(part, split)) for s in chunk_starts(len(text), chunk, overlap) for part in (text[s : s + chunk + overlap],)]
    return stitch(parts, split)


def _lists(ids: np.ndarray, count: np.ndarray, starts: list[np.ndarray]) -> pa.Array:
    """Lists of ids of each text, from the ids of each piece and the pieces of each text."""
    pieces = np.cumsum([0, *map(len, starts)])
    total = np.concatenate(([0], np.cumsum(count)))
    return pa.ListArray.from_arrays(pa.array(total[pieces].astype(np.int32)), pa.array(ids))


def encode_texts(texts: pa.Array, starts: list[np.ndarray], coder: Coder) -> pa.Array:
    """Ids of texts whose pieces start at the given characters."""
    buf, off = buffer_of(texts)
    data, cut = buf[off[0] : off[-1]], off - off[0]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    base = np.searchsorted(lead, cut[:-1])
    at = lead[np.concatenate([s + b for s, b in zip(starts, base)] or [np.zeros(0, np.int64)]).astype(np.int64)]
    return _lists(*coder.encode(data, at), starts)


def spell_lists(lists: pa.Array, coder: Coder) -> pa.Array:
    """Concatenated bytes of each list of ids; null lists give none."""
    total = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    end = np.concatenate(([0], np.cumsum(coder.length[ids])))[total].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(end), pa.py_buffer(coder.spell(ids))])


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) for every row, in no set order; ``decoded`` adds what the ids decode to, in the same pass.

    Null and empty texts give no ids; repeated rows stay repeated (of a long text the copies
    are counted first and encoded once); rows of one id with different texts are encoded
    apart; very long texts travel as chunks; other columns are ignored whatever their names;
    an empty table gives no rows.  ``pattern`` must match every character, without groups,
    and look ahead ``GUARD`` characters at most.
    """
    if overlap < 2 * GUARD or chunk < 1:
        raise ValueError(f"chunks must overlap by {2 * GUARD} characters at least")
    splitter(pattern)
    kind = dict(docs.dtypes)[id_col]
    made = ["ids", "decoded"] if decoded else ["ids"]

    def results(ids: pa.Array, coder: Coder) -> list[pa.Array]:
        return [ids, spell_lists(ids, coder)] if decoded else [ids]

    texts = wide_rows(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, coder = splitter(pattern), coder_of(ranks)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                starts = [pieces_of(t, split, chunk, overlap) for t in part.column("text").to_pylist()]
                ids = encode_texts(part.column("text"), starts, coder)
                yield pa.RecordBatch.from_arrays([part.column("id"), *results(ids, coder)], names=["id", *made])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "text", 1):
                text = one.column("text")[0].as_py()
                begin = chunk_starts(len(text), chunk, overlap)
                same = [pa.repeat(one.column(c)[0], len(begin)) for c in ("id", "key", "size", "copies")]
                parts = pa.array([text[s : s + chunk + overlap] for s in begin])
                yield pa.RecordBatch.from_arrays([*same, pa.array(begin, pa.int64()), parts], names=["id", "key", "size", "copies", "start", "text"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                marks = [cuts(t, split).astype(np.int32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.binary())], names=[*part.schema.names, "cuts"])

    def join(table: pa.Table) -> pa.Table:
        split, coder = splitter(pattern), coder_of(ranks)
        rows = sorted(table.select(["start", "text", "cuts"]).to_pylist(), key=lambda r: r["start"])
        starts = stitch([(r["start"], r["text"], np.frombuffer(r["cuts"], np.int32).astype(np.int64)) for r in rows], split)
        text = "".join(r["text"][:chunk] if k + 1 < len(rows) else r["text"] for k, r in enumerate(rows))
        ids = encode_texts(pa.array([text], pa.large_string()), [starts], coder)
        return pa.table([table.column("id")[:1], table.column("copies")[:1], *results(ids, coder)], names=["id", "copies", *made])

    out = f"id {kind}, ids array<int>" + ", decoded binary" * decoded
    long = F.char_length("text") > chunk * DEALT + overlap
    most = texts.filter(~long).mapInArrow(lean(here), out)
    apart = texts.filter(long).groupBy("id", F.xxhash64("text").alias("key"), F.char_length("text").alias("size"))
    apart = apart.agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    head = f"id {kind}, key long, size int, copies long, start long, text string"
    chunks = apart.select("id", "key", "size", "copies", "text").mapInArrow(lean(cut), head)
    marked = chunks.repartition("id", "key", "start").mapInArrow(lean(pretokenise), f"{head}, cuts binary")
    stitched = marked.groupBy("id", "key", "size").applyInArrow(lambda t: join(t), out.replace("ids", "copies long, ids", 1))
    stitched = stitched.select("id", *made, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    return most.unionByName(stitched).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``into``: the concatenated bytes of the ids.

    Null and empty lists give no bytes; a column that is already called ``into`` is
    replaced; ids outside the ranks are an error; repeated rows stay; an empty table gives
    no rows.
    """
    kept = [c for c in encoded.columns if c != into]
    if ids_col not in kept:
        raise ValueError(f"the decoded bytes can't take the place of {ids_col}")
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks)
        for batch in batches:
            total = np.concatenate(([0], np.cumsum(batch.column(kept.index(ids_col)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, total[at] + IDS_AT_ONCE, "right")) - 1)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, spell_lists(part.column(kept.index(ids_col)), coder)], names=[*kept, into])
                at = to

    return wide_rows(encoded).select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(lean(run), f"{schema}, `{into}` binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 of the comma-joined ids, decoded_sha256 of the decoded bytes.

    Encoding and decoding share a worker, so a task holds one set of tables.
    """
    both = encode(docs, ranks, pattern, id_col, text_col, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
