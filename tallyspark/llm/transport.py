"""Media columns as MPEG transport streams.

A payload travels as the elementary stream of one programme: a programme association
table, a programme map table, then packetised elementary packets (PES), each cut into
188-byte transport packets.  Reading parses the tables, checks sync bytes and continuity
counters, reassembles the PES packets and lists timestamps and random-access points.
Packets are laid out and taken apart as numpy rows, whole streams at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import lean, slices, wide_rows

#: Fixed values of ISO/IEC 13818-1.
PACKET, BODY, SYNC, PAT_PID = 188, 184, 0x47, 0
PMT_PID, ES_PID, PRIVATE_DATA, PRIVATE_STREAM = 0x1000, 0x100, 0x06, 0xBD
CLOCK = 90_000
#: Payload bytes of one PES packet: every PES is a random-access point, one tick of 40 ms after the last.
UNIT, TICK = 61_440, CLOCK // 25

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else _c << 1
    _CRC[_i] = _c


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ int(_CRC[(crc >> 24) ^ b])
    return crc


def _section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


HEADER = _table_packet(PAT_PID, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def _read_stamp(b: np.ndarray) -> int:
    b = [int(x) for x in b[:5]]
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``; an empty one gives the tables alone."""
    out, counter = [HEADER], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = k * TICK
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # The first packet has an adaptation field: random access and the programme clock.
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        room = BODY - 8
        first = pes[:room]
        pad = room - len(first)
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter & 15, 7 + pad, 0x50]) + clock + b"\xff" * pad + first)
        counter += 1
        rest = np.frombuffer(pes, np.uint8)[room:]
        whole = len(rest) // BODY
        if whole:
            rows = np.empty((whole, PACKET), np.uint8)
            rows[:, :3] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            rows[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            rows[:, 4:] = rest[: whole * BODY].reshape(whole, BODY)
            out.append(rows.tobytes())
            counter += whole
        tail = rest[whole * BODY :].tobytes()
        if tail:
            pad = BODY - len(tail) - 1  # the adaptation field's own length
            field = bytes([pad]) + (b"\x00" + b"\xff" * (pad - 1) if pad else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter & 15]) + field + tail)
            counter += 1
    return b"".join(out)


def _tables(rows: np.ndarray, pids: np.ndarray) -> int | None:
    """PID of the elementary stream by way of both tables; None where they are missing or damaged."""

    def section(pid: int) -> bytes | None:
        at = np.flatnonzero((pids == pid) & (rows[:, 1] & 0x40 > 0))
        if not len(at):
            return None
        body = rows[at[0], 4:].tobytes()
        body = body[1 + body[0] :]
        size = 3 + ((body[1] & 0x0F) << 8 | body[2])
        return body[: size - 4] if crc32_mpeg(body[:size]) == 0 else None

    pat = section(PAT_PID)
    pmt = section((pat[10] & 0x1F) << 8 | pat[11]) if pat and len(pat) >= 12 else None
    if not pmt:
        return None
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    return (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2] if len(pmt) >= at + 5 else None


def _repeats(rows: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Packets that repeat the one before, which is allowed once: all bytes are the same but for the programme clock."""
    same = rows[1:] == rows[:-1]
    clock = flags & 0x10 > 0
    same[:, 6:12] |= (clock[1:] & clock[:-1])[:, None]
    again = np.concatenate(([False], same.all(1)))
    for k in np.flatnonzero(again):
        again[k] = not again[k - 1]
    return again


def demux(stream: bytes) -> dict:
    """payload, stamps, random_access (packet numbers), packets, repeats, gaps (continuity errors) and intact.

    ``stamps`` has (packet, pts, random_access) for every PES packet with a timestamp: the
    number of the transport packet that it begins in, and whether that packet is a
    random-access point.  A packet that repeats the one before is dropped and counted; a
    jump of the counter is no error where the packet flags a discontinuity.
    """
    whole = len(stream) // PACKET
    rows = np.frombuffer(stream, np.uint8, whole * PACKET).reshape(whole, PACKET)
    found = {"payload": b"", "stamps": [], "random_access": [], "packets": whole, "repeats": 0, "gaps": 0, "intact": False}
    if not whole or len(stream) % PACKET or (rows[:, 0] != SYNC).any():
        return found
    pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    pid = _tables(rows, pids)
    if pid is None:
        return found
    own = np.flatnonzero((pids == pid) & (rows[:, 3] & 0x10 > 0))
    flags = np.where((rows[own, 3] & 0x20 > 0) & (rows[own, 4] > 0), rows[own, 5], 0)
    once = ~_repeats(rows[own], flags) if len(own) else np.zeros(0, bool)
    found["repeats"] = int(len(own) - once.sum())
    own, flags = own[once], flags[once]
    mine = rows[own]
    jumps = np.diff(mine[:, 3].astype(np.int64) & 15) % 16 != 1
    found["gaps"] = int(np.count_nonzero(jumps & (flags[1:] & 0x80 == 0)))
    begin = np.where(mine[:, 3] & 0x20 > 0, 5 + mine[:, 4].astype(np.int64), 4)
    random = flags & 0x40 > 0
    found["random_access"] = own[random].tolist()
    # All payload bytes in order, with packets that have no adaptation field copied as one block.
    keep = np.arange(PACKET) >= begin[:, None]
    data = mine[keep]
    heads = np.flatnonzero(mine[:, 1] & 0x40 > 0)
    starts = np.concatenate(([0], np.cumsum(keep.sum(1))))[heads]
    parts, whole_units = [], found["gaps"] == 0
    for head, a, b in zip(heads, starts, np.append(starts[1:], len(data))):
        pes = data[a:b]
        if len(pes) < 9 or pes[:3].tobytes() != b"\x00\x00\x01":
            whole_units = False
            continue
        length = int(pes[4]) << 8 | int(pes[5])
        whole_units &= 6 + length == len(pes)
        if pes[7] & 0x80 and len(pes) >= 14:
            found["stamps"].append({"packet": int(own[head]), "pts": _read_stamp(pes[9:14]), "random_access": bool(random[head])})
        parts.append(pes[9 + int(pes[8]) :].tobytes())
    found["payload"], found["intact"] = b"".join(parts), bool(whole_units)
    return found


def padded(text: bytes, unit: int = 64) -> bytes:
    """``text`` and zero bytes up to a positive multiple of ``unit``."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b"\x00")


def to_media(docs: DataFrame, text_col: str = "text", into: str = "media") -> DataFrame:
    """All columns of ``docs`` and the transport stream of the padded text; a column called ``into`` is replaced.

    Null and empty texts are 64 zero bytes; equal texts give equal streams; a very long text
    is one stream; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c != into or c == text_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(kept.index(text_col)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([mux(padded(t.as_py() or b"")) for t in texts], pa.binary())], names=[*kept, into])

    if into == text_col:
        raise ValueError("the stream can't take the text's place")
    return docs.mapInArrow(lean(run), f"{schema}, `{into}` binary")


PARSED = "payload binary, stamps array<struct<packet: bigint, pts: bigint, random_access: boolean>>, random_access array<bigint>, packets bigint, repeats bigint, gaps bigint, intact boolean"
NAMES = ("payload", "stamps", "random_access", "packets", "repeats", "gaps", "intact")


def from_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of ``media`` and what demux() finds, as columns; columns of those names are replaced.

    A null, empty or damaged stream is not intact; repeated rows repeat; an empty table gives no rows.
    """
    if media_col in NAMES:
        raise ValueError(f"{media_col} would be replaced")
    kept = [c for c in media.columns if c not in NAMES]
    media = media.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{c}` {t}" for c, t in media.dtypes)
    stamp = pa.struct([("packet", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_())])
    kinds = [pa.binary(), pa.list_(stamp), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media_col):
                found = [demux(m.as_py() or b"") for m in part.column(kept.index(media_col))]
                new = [pa.array([f[n] for f in found], k) for n, k in zip(NAMES, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*kept, *NAMES])

    return media.mapInArrow(lean(run), f"{schema}, {PARSED}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload is what was read back.  The feature lists packets, PES packets, last
    timestamp, random-access points, continuity gaps and whether the stream is intact.
    Nulls count as empty, repeated rows repeat, other columns are ignored, and an empty
    table gives no rows.
    """
    texts = wide_rows(docs).select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("size"), F.coalesce(text_col, F.lit("")).alias("text"))
    read = from_media(to_media(texts, "text").select("id", "size", "media"))
    last = F.coalesce(F.array_max("stamps.pts"), F.lit(0))
    facts = (("packets", F.col("packets")), ("pes", F.size("stamps")), ("last_pts", last), ("random_access", F.size("random_access")), ("gaps", F.col("gaps")), ("intact", F.col("intact")))
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in facts])
    tail = F.substring("payload", F.lit(-64), F.lit(64))
    return read.select(
        F.col("id").alias(id_col), F.col("size").cast("long").alias("n_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
