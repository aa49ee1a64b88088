"""Exact de-duplication with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 reads each text once and keeps (id, size, digest) as a narrow table.  From it a
Bloom filter of *repeated* bits is built: a digest sets two bits, and only bits that two
or more rows hit stay.  Pass 2 probes it: a row whose bits are all repeated may have a
partner and is shuffled by digest; every other row passes straight through.

The filter (see KeyFilter) has 16 bits a row, however many rows there are.  Up to
``broadcast_bytes`` it is broadcast; beyond that it is joined block by block, which moves
narrow rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import BROADCAST_BYTES, KeyFilter, spill, unused

#: Up to so many dropped rows (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 100_000
#: Fixed value: characters that don't count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"


def digest(text: str) -> F.Column:
    """SHA-256 (hex) of the text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), IGNORED, ""), 256)


def size_of(text: str) -> F.Column:
    """Code points of the text as it is; null counts as empty."""
    return F.char_length(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _judge(docs: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> tuple[DataFrame, KeyFilter]:
    """Facts (id, size, sha) with ``keep`` and ``most`` (id and size of the row that stays) and ``n`` (rows of the group)."""
    facts = spill(docs.select(F.col(f"`{id_col}`").alias("id"), size_of(text_col).alias("size"), digest(text_col).alias("sha")), "facts")
    repeats = KeyFilter(facts, "sha", 2, broadcast_bytes)
    probed = repeats.probe(facts, "sha")
    first = F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("unknown"), "id")  # ids of any ordered type
    groups = probed.filter("_maybe").groupBy("sha").agg(F.min_by("id", first).alias("keep"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written out so that both sides of the join below are plain exchanges, which Spark splits where one digest is hot.
    groups = spill(groups.select(F.col("sha").alias("gsha"), "keep", "most", "n"), "groups")
    shared = probed.filter("_maybe").join(groups, F.col("sha") == F.col("gsha"), "left")
    shared = shared.select("id", "size", "sha", F.when(F.col("n") > 1, F.col("keep")).otherwise(F.col("id")).alias("keep"), F.coalesce("most", "size").alias("most"), F.coalesce("n", F.lit(1)).alias("n"))
    alone = probed.filter("NOT _maybe").select("id", "size", "sha", F.col("id").alias("keep"), F.col("size").alias("most"), F.lit(1).cast("long").alias("n"))
    return alone.unionByName(shared), repeats


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (white space apart) the longest original stays, then the smallest id.
    Ids are of any ordered type.  A null text is empty; a null id loses every tie; rows that repeat id and text all
    count as the one that stays; very long texts are read whole and never moved; an empty
    table gives no rows; other columns are ignored whatever their names.
    """
    judged, _ = _judge(docs, id_col, text_col, broadcast_bytes)
    return judged.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("keep").eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns as given.

    As in ``exact_dedup`` the longest original stays, then the smallest id.  Of rows that
    repeat id, size and normalised text one stays.  Null and empty texts are one group; an
    empty table stays empty.  Where many rows go, only those that the filter flags are moved.
    """
    judged, repeats = _judge(docs, id_col, text_col, broadcast_bytes)
    groups = judged.filter("n > 1").groupBy("id", "size", "sha").agg(F.count(F.lit(1)).alias("copies"), F.first("keep").alias("keep"), F.first("most").alias("most"))
    stays = F.col("keep").eqNullSafe(F.col("id")) & (F.col("size") == F.col("most"))
    groups = spill(groups.select(F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("sha").alias("_sha"), stays.alias("_stays"), "copies"), "copies")
    gone = groups.filter("NOT _stays").drop("_stays", "copies")
    again = groups.filter("_stays AND copies > 1").drop("_stays", "copies")
    sha, size = unused(docs, "tally_sha"), unused(docs, "tally_size")
    marked = docs.withColumns({sha: digest(text_col), size: size_of(text_col)})

    def same(rows: DataFrame, other: DataFrame) -> F.Column:
        return (rows[sha] == other["_sha"]) & (rows[size] == other["_size"]) & rows[f"`{id_col}`"].eqNullSafe(other["_id"])

    def settle(rows: DataFrame, mark) -> DataFrame:
        left = rows.join(mark(gone), same(rows, gone), "left_anti")
        if again.limit(1).count():
            twice = left.join(mark(again), same(left, again), "left_semi").dropDuplicates([sha, size])
            left = left.join(mark(again), same(left, again), "left_anti").unionByName(twice)
        return left.select(*[F.col(f"`{c}`") for c in docs.columns])

    if groups.count() <= broadcast_rows:
        return settle(marked, F.broadcast)
    probed = repeats.probe(marked, sha)
    alone = probed.filter("NOT _maybe").select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.unionByName(settle(probed.filter("_maybe").drop("_maybe"), lambda rows: rows))
