"""Tables in versions: what is written, what stays readable, and who is refused."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyspark.sources.versions import Stale, VersionedTable


def table(spark, **kw):
    return VersionedTable(spark, tempfile.mkdtemp() + "/t", **kw)


def size(t):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(t.path) for f in files if f.endswith(".parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def batch(spark, lo, hi, tag="a"):
    return spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(tag).alias("tag"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def test_an_append_writes_its_rows_only(spark):
    t = table(spark, key="k", buckets=4)
    t.publish(batch(spark, 0, 20_000), 0)
    first = size(t)
    grown = []
    for n in range(4):
        before = size(t)
        assert t.append(batch(spark, 20_000 + 10 * n, 20_010 + 10 * n)) == n + 2
        grown.append(size(t) - before)
    assert max(grown) < first / 50 and max(grown) < 3 * min(grown)
    assert [t.read(v).count() for v in t.versions()] == [20_000, 20_010, 20_020, 20_030, 20_040]


def test_an_upsert_writes_touched_buckets_only(spark):
    t = table(spark, key="k", buckets=64)
    t.publish(batch(spark, 0, 20_000))
    first = size(t)
    t.upsert(batch(spark, 7, 8, "b").unionByName(batch(spark, 50_000, 50_001, "b")))
    assert size(t) - first < first / 10
    assert t.read().count() == 20_001 and t.read().filter("tag = 'b'").count() == 2 and t.read(1).filter("tag = 'b'").count() == 0
    t.delete(spark.range(100).select(F.col("id").alias("k")))
    assert t.read().count() == 19_901 and t.read(2).count() == 20_001
    again = VersionedTable(spark, t.path)
    assert (again.key, again.buckets) == ("k", 64) and sorted({b for b, *_ in again.parts()}) == list(range(64))


def test_null_and_repeated_keys(spark):
    t = table(spark, key="k", buckets=3)
    make = lambda data: spark.createDataFrame(data, "k string, v int")
    t.append(make([(None, 1), ("a", 2), ("a", 3), ("b", 4)]))
    t.upsert(make([(None, 5), ("a", 6)]))
    assert rows(t.read()) == [("a", 6), ("b", 4), (None, 5)]
    t.upsert(make([]))
    t.delete(make([("a", 0), ("zz", 0)]).select("k"))
    assert rows(t.read()) == [("b", 4), (None, 5)]
    t.delete(t.read().select("k"))
    assert rows(t.read()) == [] and t.read().columns == ["k", "v"]
    t.append(make([("c", 7)]))
    assert rows(t.read()) == [("c", 7)]


def test_columns_are_kept_and_others_refused(spark):
    t = table(spark)
    t.append(spark.createDataFrame([(1, "a")], "k int, tag string"))
    t.append(spark.createDataFrame([("b", 2)], "tag string, k int"))
    assert rows(t.read()) == [(1, "a"), (2, "b")]
    for bad in ("k long, tag string", "k int", "k int, tag string, x int"):
        with pytest.raises(ValueError, match="columns"):
            t.append(spark.createDataFrame([], bad))
    with pytest.raises(ValueError, match="key"):
        t.upsert(spark.createDataFrame([(1, "a")], "k int, tag string"))
    with pytest.raises(FileNotFoundError):
        table(spark).read()


def test_compaction_in_tiers(spark):
    t = table(spark, key="k", buckets=2)
    written, tiers = 0, set()
    for n in range(10):
        t.append(batch(spark, 8 * n, 8 * n + 8))
        while t.compact(2):
            pass
        tiers |= {tier for *_, tier in t.parts()}
        assert rows(t.read().select("k")) == sorted([(k,) for k in range(8 * n + 8)], key=str)
        folders = [sum(1 for b, *_ in t.parts() if b == bucket) for bucket in range(2)]
        assert max(folders) <= 4  # a folder a tier, at most
    assert tiers == {0, 1, 2, 3}
    assert t.read(1).count() == 8 and t.compact(2) is None


def test_two_publishers(spark, monkeypatch):
    """The other one publishes between this one's look and its mark: a replacement is refused, an append goes behind."""
    t = table(spark, key="k", buckets=2)
    t.publish(batch(spark, 0, 4))
    other = VersionedTable(spark, t.path)
    mark, late = VersionedTable._mark, []

    def overtaken(self, *args):
        if self is t and not late:
            late.append(True)
            other.append(batch(spark, 100, 101, "other"))
        return mark(self, *args)

    monkeypatch.setattr(VersionedTable, "_mark", overtaken)
    with pytest.raises(Stale):
        t.upsert(batch(spark, 0, 1, "lost"))
    assert t.versions() == [1, 2] and t.read().filter("tag = 'lost'").count() == 0
    late.clear()
    with pytest.raises(Stale):
        t.append(batch(spark, 200, 201, "lost"), expected=2)
    late.clear()
    assert t.append(batch(spark, 300, 301, "mine")) == 5
    assert sorted(r["k"] for r in t.read().collect()) == [0, 1, 2, 3, 100, 100, 100, 300]
    with pytest.raises(Stale):
        t.publish(batch(spark, 0, 1), expected=1)
