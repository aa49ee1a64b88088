"""Shared pieces of the training-data operators.

Word model: a word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the
UTF-8 text.  All per-word work is vectorised with numpy over the buffer of one
Arrow column; a document is a slice ``[off[i], off[i+1])`` of that buffer.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of every contract.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
GAMMA = U(0x9E3779B97F4A7C15)
#: Texts are worked on in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 4 << 20
BATCH_ROWS, WIDE_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Spark's own switch: shuffle files go when the query that wrote them ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of one bucket of dealt rows, about.
BUCKET_BYTES = 8 << 20
#: Runs longer than this are hashed by BLAKE2 as a whole.
LONG_RUN = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Where it is unset a local session, as in tests, gets a folder of this machine; on a
    cluster that would lose rows, so there it is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_OPEN = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


@contextlib.contextmanager
def spent(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are spilled inside are deleted at the end, but for those given to the function that this yields.

    For what stands between two results: once the later one is written nothing reads the
    others again.  After an error all stay, as what fails may be tried again.
    """
    written: list[str] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes().append(written)
    try:
        yield keep
    finally:
        _scopes().pop()  # scopes are nested
    stays = {_folder(f) for df in kept for f in df.inputFiles()}
    for path in written:
        if _folder(path + "/part") not in stays:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _folder(file: str) -> str:
    """Name of a written table's folder, whichever way its path is spelled."""
    return file.rstrip("/").split("/")[-2]


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; what they were is put back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spill(df: DataFrame, tag: str, narrow: bool = False, batch: int = 0) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    What was shuffled for it is deleted once it stands: nothing reads that any more.
    A ``narrow`` table (a few numbers a row) is written by an eighth of the shuffle's tasks.
    With ``batch`` the write's Python functions get so many rows at once, where rows are
    wide; the session's own setting is put back.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for scope in _scopes():
        scope.append(path)
    with _settings(spark, {CLEAN_SHUFFLES: "true"} | ({BATCH_ROWS: str(batch)} if batch else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide_rows(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of WIDE_ROWS rows in its session, unless that has a number of its own.

    Texts are wide: batches of Spark's default number of rows take a hundred MB on both
    sides of a Python worker.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":  # Spark's default
        conf.set(BATCH_ROWS, str(WIDE_ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text; one text is never cut."""
    if not batch.num_rows:
        return
    _, off = buffer_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give freed memory back to the system: idle workers would hold it while other stages run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of all i, one after the other."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; ``data`` has 8 bytes more than the last run."""
    length = end - start
    loads = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = length.astype(U) * GAMMA
    out = mix(out ^ (loads[start] & MASKS[np.minimum(length, 8)]))
    for i in np.flatnonzero(length > LONG_RUN):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    live, at = np.flatnonzero((length > 8) & (length <= LONG_RUN)), 8
    while len(live):
        out[live] = mix((out[live] + GAMMA) ^ (loads[start[live] + at] & MASKS[np.minimum(length[live] - at, 8)]))
        at += 8
        live = live[length[live] > at]
    return out


class Words:
    """Words of a slice of documents: byte bounds, 64-bit hashes, and the first word of each document.

    ``kind`` says of each byte whether it belongs to a word.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, kind: np.ndarray = IS_WORD):
        lo, hi = int(off[0]), int(off[-1])
        size = hi - lo
        data = np.zeros(size + 16, np.uint8)
        data[:size] = LOWER[buf[lo:hi]] if lower else buf[lo:hi]
        cut = (off - lo).astype(np.int64)
        word = kind[data[:size]]
        first = np.zeros(size + 1, bool)
        first[cut] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | first[1:size]
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:size]
        self.data, self.size = data, size
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, cut)  # word offsets, one more than documents
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_runs(self.data, self.start, self.end)
        return self._hash


def powers(n: int, base: int = 0x5851F42D4C957F2D) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in [0, n)."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, U), np.full(n, inverse, U)
    if n:
        up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*cols: str) -> Column:
    """64-bit key of a row's content: equal rows share it, nulls included; others don't but by a chance of 1 in 2**64 a pair.

    A null is told from every value and from a null elsewhere: xxhash64 alone passes nulls over.
    """
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


#: Bits of one bitmap of bitmap_construct_agg, fixed by Spark.
BITMAP_BITS = 32768


def bit_of(hashed: Column, probe: int, log2_bits: int) -> Column:
    """Bit position in a filter of 2**log2_bits bits: 1-based, as bitmap_bucket_number expects."""
    spread = F.xxhash64(hashed, F.lit(probe).cast("long"))
    return (F.shiftrightunsigned(spread, 64 - log2_bits) + 1).cast("long")


def bitmaps(bits: DataFrame, bit: str) -> DataFrame:
    """(bucket, bitmap) of distributed bit positions: at most 2**log2_bits / 8 bytes over all rows."""
    return bits.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(bit))).alias("bitmap"))


#: A filter of up to so many bytes is broadcast.
BROADCAST_BYTES = 32 << 20


class KeyFilter:
    """A blocked Bloom filter over a key column, in DataFrame functions only.

    A key chooses one block of BITMAP_BITS bits by its hash and sets ``PROBES`` bits in it;
    bits that ``times`` rows or more hit stay, so with 2 the filter knows keys that may
    repeat.  It has BITS_PER_ROW bits a row, so its size is known before it is built: up to
    ``broadcast_bytes`` its blocks are broadcast, beyond that they are joined by block.
    What travels to build it are block and bit numbers, added up before they are shuffled.
    """

    PROBES, BITS_PER_ROW = 2, 16

    def __init__(self, rows: DataFrame, key: str, times: int = 1, broadcast_bytes: int = BROADCAST_BYTES):
        self.blocks = max(1, -(-self.BITS_PER_ROW * rows.count() // BITMAP_BITS))
        self.small = self.blocks * BITMAP_BITS // 8 <= broadcast_bytes
        hits = rows.select(self._block(key).alias("block"), F.explode(F.array(*[self._bit(key, k) for k in range(self.PROBES)])).alias("bit"))
        if times > 1:
            hits = hits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)
        self.table = spill(hits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "bloom")

    def _block(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    @staticmethod
    def _bit(key: str, probe: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key, F.lit(probe)), 64 - 15)  # BITMAP_BITS is 2 ** 15

    def probe(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with a boolean ``_maybe``: false only where the key was not among the filter's rows, or not ``times`` times."""
        side = self.table.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))
        found = rows.join(F.broadcast(side) if self.small else side.hint("merge"), self._block(key) == F.col("_block"), "left")
        maybe = F.lit(True)
        for k in range(self.PROBES):
            bit = self._bit(key, k).cast("int")
            byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
            maybe = maybe & F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit % 8)) != 0, F.lit(False))
        return found.select(*[rows[f"`{c}`"] for c in rows.columns], maybe.alias("_maybe"))


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """``blocks`` dealt out by bucket, 32 buckets a task at most, so that a task's share stays the same as buckets grow."""
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(max(least, -(-buckets // 32)), "bucket")


def spark_xxhash64(values: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """What xxhash64() of Spark SQL gives for a bigint column, vectorised; chain seeds for more columns."""
    p1, p2, p3, p4, p5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, k: int) -> np.ndarray:
        return (x << U(k)) | (x >> U(64 - k))

    h = np.asarray(seed).astype(U) + p5 + U(8)
    h = turn(h ^ (turn(values.astype(U) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return h ^ (h >> U(32))


class BitFilter:
    """A Bloom filter of at most 2**28 bits (32 MB), built from bitmaps; tests (x, y) pairs of bigints in numpy."""

    def __init__(self, log2_bits: int, rows: list[tuple[int, bytes]], probes: int = 2):
        self.log2_bits, self.probes = log2_bits, probes
        self.bytes = np.zeros(max(1 << log2_bits, BITMAP_BITS) // 8, np.uint8)
        for bucket, bitmap in rows:
            at = (bucket - 1) * BITMAP_BITS // 8
            self.bytes[at : at + len(bitmap)] = np.frombuffer(bitmap, np.uint8)

    @staticmethod
    def build(pairs: DataFrame, x: str, y: str, max_log2_bits: int = 28, probes: int = 2) -> "BitFilter":
        """The bitmaps that reach the driver are bounded by the filter's size, whatever ``pairs`` holds."""
        bits = max(15, min(max_log2_bits, int(16 * pairs.count()).bit_length()))
        hashed = F.xxhash64(x, y)
        rows = bitmaps(pairs.select(F.explode(F.array(*[bit_of(hashed, k, bits) for k in range(probes)])).alias("bit")), "bit").collect()
        return BitFilter(bits, [(r["bucket"], bytes(r["bitmap"])) for r in rows], probes)

    def test(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        hashed = spark_xxhash64(y, spark_xxhash64(x))
        found = np.ones(len(x), bool)
        for k in range(self.probes):
            bit = probe_hash(hashed, k) >> U(64 - self.log2_bits)
            found &= (self.bytes[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 > 0
        return found


def probe_hash(hashed: np.ndarray, probe: int) -> np.ndarray:
    """xxhash64(hashed, probe) as bit_of computes it: the probe is a bigint."""
    return spark_xxhash64(np.full(len(hashed), probe, np.int64), spark_xxhash64(hashed))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: decides how many buckets a job deals out."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def bucket_count(total_bytes: int, each: int = BUCKET_BYTES, least: int = 1024) -> int:
    """Buckets grow with the input, so that one bucket's share stays the same."""
    return max(least, -(-total_bytes // each))
