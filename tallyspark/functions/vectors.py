"""Vectors as array columns: hashes, distances, packing.  All in SQL functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts and weights of the composite distances.
IMAGE_PARTS = (("thumbnail", 0.70), ("histogram", 0.20), ("dhash_bits", 0.10))
TEXT_PARTS = (("luma", 0.35), ("edge", 0.15), ("suffix_luma", 0.30), ("suffix_edge", 0.10), ("dhash_bits", 0.10))


def _at(arr: Column, i: Column) -> Column:
    return F.get(arr, i)


def dhash_bits(grid: Column, width: int, height: int) -> Column:
    """Row-major bits of a (width+1) x height grid: 1 where a cell is above its left neighbour."""
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: (_at(grid, F.floor(k / width).cast("int") * (width + 1) + k % width + 1) > _at(grid, F.floor(k / width).cast("int") * (width + 1) + k % width)).cast("int"))


def bits_to_hex(bits: Column) -> Column:
    """Hex digits of a bit array, padded with zeros to whole digits."""
    nibbles = F.sequence(F.lit(0), F.ceil(F.size(bits) / 4).cast("int") - 1)
    bit = lambda i: F.coalesce(_at(bits, i), F.lit(0)).cast("int")
    return F.array_join(F.transform(nibbles, lambda n: F.lower(F.hex((bit(n * 4) * 8 + bit(n * 4 + 1) * 4 + bit(n * 4 + 2) * 2 + bit(n * 4 + 3)).cast("long")))), "")


def row_hashes(grid: Column, width: int, threshold: float = 0.5) -> Column:
    """One hex key for each row of a grid, of its cells at or above the threshold."""
    rows = F.sequence(F.lit(0), (F.size(grid) / width).cast("int") - 1)
    return F.transform(rows, lambda r: bits_to_hex(F.transform(F.slice(grid, r * width + 1, F.lit(width)), lambda v: (v >= threshold).cast("int"))))


def histogram(arr: Column, bins: int, low: float, high: float) -> Column:
    """Shares of values in equal bins; the last is closed; values outside count nowhere."""
    size = (high - low) / bins
    inside = F.filter(arr, lambda v: (v >= low) & (v <= high))
    place = F.transform(inside, lambda v: F.least(F.lit(bins - 1), F.floor((v - low) / size).cast("int")))
    total = F.greatest(F.lit(1), F.size(inside))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(place, lambda p: p == b)) / total)


def channel_histograms(arr: Column, channels: int, bins: int, low: float, high: float) -> Column:
    """Histograms of interleaved channels, one after the other: value i is of channel i modulo ``channels``."""

    def of(channel: int) -> Column:
        return histogram(F.filter(arr, lambda v, i: i % channels == channel), bins, low, high)

    return F.concat(*[of(c) for c in range(channels)])


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def l1(a: Column, b: Column) -> Column:
    """Mean absolute difference; null where lengths differ or are 0."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), _sum(gaps) / F.size(a))


def hamming(a: Column, b: Column) -> Column:
    """Share of positions that differ; null where lengths differ or are 0."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a))


def rmse(a: Column, b: Column) -> Column:
    """Root of the mean squared difference; infinite where lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(_sum(squares) / F.size(a))).otherwise(F.lit(float("inf")))


def composite_distance(a: Column, b: Column, parts: tuple[tuple[str, float], ...] = IMAGE_PARTS) -> Column:
    """Weighted sum over struct fields: bits by share that differ, all others by mean difference."""
    total = F.lit(0.0)
    for name, weight in parts:
        total = total + (hamming if name.endswith("bits") else l1)(a[name], b[name]) * weight
    return total


def masked_hamming(a: Column, b: Column, mask: Column, weight: float = 5.0) -> Column:
    """Share of weight of differing positions; positions that vary among the candidates (mask 1) weigh more; 1 where lengths differ."""
    heavy = F.transform(mask, lambda m: F.when(m > 0, F.lit(weight)).otherwise(F.lit(1.0)))
    apart = F.zip_with(F.zip_with(a, b, lambda x, y: (x != y).cast("double")), heavy, lambda d, w: d * w)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) == F.size(mask)), _sum(apart) / _sum(heavy)).otherwise(F.lit(1.0))


def row_match_count(a: Column, b: Column) -> Column:
    """Positions at which both row keys are equal and not zero."""
    same = F.zip_with(a, b, lambda x, y: (x == y) & ~x.rlike("^0*$"))
    return F.size(F.filter(same, lambda s: F.coalesce(s, F.lit(False))))


def row_words(rows: Column) -> Column:
    """The bits of hex row keys, 60 in a number, so that they compare by bit operations."""
    text = F.array_join(rows, "")
    places = F.sequence(F.lit(0), F.ceil(F.length(text) / 15).cast("int") - 1)
    words = F.transform(places, lambda k: F.conv(F.substring(text, k * 15 + 1, F.lit(15)), 16, 10).cast("long"))
    return F.when(F.length(text) > 0, words).otherwise(F.array().cast("array<bigint>"))


def words_apart(a: Column, b: Column, mask: Column | None) -> Column:
    """Bits that differ in two arrays of numbers, of those that ``mask`` has where it is given."""
    apart = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    if mask is not None:
        apart = F.zip_with(apart, mask, lambda x, m: x.bitwiseAND(m))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.bit_count(x), F.lit(0)))


def pack_u8(arr: Column) -> Column:
    """0..1 to 0..255, rounded half to even and clamped."""
    return F.transform(arr, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.bround(v.cast("double") * 255).cast("int"))))


def unpack_u8(arr: Column, size: int) -> Column:
    """Back to 0..1; null unless it has ``size`` values of 0..255."""
    good = (F.size(arr) == size) & F.forall(arr, lambda v: v.between(0, 255))
    return F.when(good, F.transform(arr, lambda v: v / 255.0))


def payload_hash(arr: Column) -> Column:
    return F.sha2(F.to_json(arr), 256)
