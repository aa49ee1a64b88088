"""Tables in versions: a version is a manifest of data folders, so a change writes what changed.

A table is a folder of data folders and manifests v000001.done, v000002.done ...  Rows lie
in buckets by the hash of a key; a manifest lists for each bucket the folders that hold its
rows, oldest first.  ``append`` adds a folder, ``upsert`` and ``delete`` write the touched buckets anew,
``publish`` everything, ``compact`` joins small folders, in tiers, so that a row is written
a few times however often the table is appended to.  Data is never changed in place: older
versions stay readable.

A publisher writes data under names of its own and then moves a complete manifest to the
version's name, where no manifest may be yet: who comes second is refused and touches no
published data, and a crash leaves the table as it was.  That move is atomic where the file
system's is, as on HDFS.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table without a key; folders of one tier in a bucket that are joined.
BUCKETS, FAN = 1, 8
BUCKET = "_bucket"


class Stale(ValueError):
    """Another version was published meanwhile."""


class VersionedTable:
    """Parquet versions under one folder of any file system that Spark reads.

    ``key`` and ``buckets`` say how rows of a new table are dealt; a table that exists keeps
    what it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.key, self.buckets = key, buckets if key else 1
        if known := self.versions():
            made = self._manifest(known[-1])
            self.key, self.buckets = made["key"], made["buckets"]

    # --- versions

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def latest(self) -> int:
        """0 where there is none yet."""
        return (self.versions() or [0])[-1]

    def _marker(self, version: int) -> str:
        return f"{self.path}/v{version:06d}.done"

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"key": self.key, "buckets": self.buckets, "schema": None, "parts": []}
        return json.loads(self.spark.read.option("wholetext", True).text(self._marker(version)).first()[0])

    def parts(self, version: int | None = None) -> list[tuple[int, str, int]]:
        """(bucket, folder, tier) of a version, oldest first."""
        return [tuple(p) for p in self._manifest(version or self.latest())["parts"]]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version, the latest one by default, or of some of its buckets."""
        version = version or self.latest()
        if not version:
            raise FileNotFoundError(f"{self.path} has no version")
        made = self._manifest(version)
        return self._rows(made["schema"], [(b, f) for b, f, _ in made["parts"] if buckets is None or b in buckets])

    def _rows(self, schema: str, parts: list[tuple[int, str]]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        paths = [f"{self.path}/{folder}/{BUCKET}={bucket}" for bucket, folder in parts]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows belong to: as many as the table has at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    # --- changes

    def publish(self, df: DataFrame, expected: int | None = None) -> int:
        """The next version holds ``df``.  Refused if ``expected`` isn't the latest one (0: none yet) or another publisher was first."""
        base = self._base(expected)
        return self._mark(base, df.schema, [(b, f, 0) for b, f in self._write(df)])

    def append(self, df: DataFrame, expected: int | None = None, tries: int = 5) -> int:
        """The next version has these rows too; only they are written.

        With ``expected`` it is refused as in ``publish``; without, an append that another
        publisher overtook is put behind it: its data is not written again.
        """
        base = self._base(expected)
        new = [(b, f, 0) for b, f in self._write(self._like(df, base))]
        for _ in range(tries):
            try:
                made = self._manifest(base)
                return self._mark(base, self._schema(made, df), [*map(tuple, made["parts"]), *new])
            except Stale:
                if expected is not None:
                    raise
                base = self.latest()
                self._like(df, base)
        raise Stale(f"{self.path}: overtaken {tries} times")

    def upsert(self, df: DataFrame, expected: int | None = None) -> int:
        """The next version has these rows in place of those of equal keys; the buckets that they touch are written anew.

        Rows of one key, in the table or in ``df``, stand and go together; a null key is a key.
        """
        return self._replace(df, df, expected)

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """The next version lacks the rows of these keys; the buckets that they touch are written anew."""
        return self._replace(keys, None, expected)

    def _replace(self, keys: DataFrame, df: DataFrame | None, expected: int | None) -> int:
        if not self.key:
            raise ValueError(f"{self.path} has no key")
        base = self._base(expected)
        made = self._manifest(base)
        touched = set(self.touched(keys))
        stays = [tuple(p) for p in made["parts"] if p[0] not in touched]
        rows = self._like(df, base) if df is not None else None
        old = [(b, f) for b, f, _ in made["parts"] if b in touched]
        if old:
            gone = keys.select(F.col(self.key).alias("_gone")).distinct()
            kept = self._rows(made["schema"], old)
            kept = kept.join(gone, kept[self.key].eqNullSafe(gone["_gone"]), "left_anti")
            rows = kept if rows is None else kept.unionByName(rows)
        new = [(b, f, 0) for b, f in self._write(rows)] if rows is not None else []
        return self._mark(base, self._schema(made, df), [*stays, *new])

    def compact(self, fan: int = FAN) -> int | None:
        """Join ``fan`` folders or more of one tier of a bucket into one of the next tier; None where there are none.

        Rows stay as they are.  As a folder of a tier holds ``fan`` times the rows of one
        below, a row is written once a tier: as often as the logarithm of the appends.
        """
        base = self.latest()
        made = self._manifest(base)
        by = defaultdict(list)
        for b, f, tier in made["parts"]:
            by[b, tier].append(f)
        chosen: dict[int, int] = {}
        for (b, tier), folders in sorted(by.items()):
            if len(folders) >= fan and b not in chosen:
                chosen[b] = tier
        if not chosen:
            return None
        old = {(b, f) for b, tier in chosen.items() for f in by[b, tier]}
        new = dict(self._write(self._rows(made["schema"], sorted(old))))
        parts: list[tuple[int, str, int]] = []
        for b, f, tier in made["parts"]:
            if (b, f) not in old:
                parts.append((b, f, tier))
            elif b in new:  # where its first folder was
                parts.append((b, new.pop(b), tier + 1))
        return self._mark(base, T.StructType.fromJson(json.loads(made["schema"])), parts)

    # --- pieces

    def _base(self, expected: int | None) -> int:
        latest = self.latest()
        if expected is not None and expected != latest:
            raise Stale(f"stale: version {latest} is the latest, not {expected}")
        return latest

    def _schema(self, made: dict, df: DataFrame | None) -> T.StructType:
        return T.StructType.fromJson(json.loads(made["schema"])) if made["schema"] else df.schema

    def _like(self, df: DataFrame, version: int) -> DataFrame:
        """``df`` with the columns of a version, in its order; other names or types are refused."""
        made = self._manifest(version)
        if not made["schema"]:
            return df
        want = T.StructType.fromJson(json.loads(made["schema"]))
        have = {f.name: f.dataType for f in df.schema}
        if have != {f.name: f.dataType for f in want}:
            raise ValueError(f"{self.path}: columns {df.schema.simpleString()}, not {want.simpleString()}")
        return df.select(*[f"`{f.name}`" for f in want])

    def _write(self, df: DataFrame) -> list[tuple[int, str]]:
        """(bucket, folder) of the rows, written to one new folder."""
        folder = f"data-{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, self.bucket())
        if self.buckets > 1:
            rows = rows.hint("rebalance", BUCKET)  # few files a bucket; adaptive execution splits a large one
        rows.write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
        return sorted((int(n.split("=")[1]), folder) for n in names if n.startswith(f"{BUCKET}="))

    def _mark(self, base: int, schema: T.StructType, parts: list[tuple[int, str, int]]) -> int:
        version = base + 1
        text = json.dumps({"key": self.key, "buckets": self.buckets, "schema": schema.json(), "parts": parts})
        draft, marker = self._path(f"{self.path}/_{uuid.uuid4().hex}.manifest"), self._path(self._marker(version))
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(marker) or not self._fs.rename(draft, marker):
            self._fs.delete(draft, False)
            raise Stale(f"stale: version {version} was published meanwhile")
        return version
