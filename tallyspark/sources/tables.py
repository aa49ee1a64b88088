"""Scans with a contract, integrity checks, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.evaluate import fingerprint, table_fingerprint
from tallyspark.sources.scratch import scratch, work_table  # noqa: F401  part of this module


def read_csv_required(spark: SparkSession, path: str, required: list[str], schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header; a required column that is missing is an error; extra ones stay, as text; nothing is inferred."""
    head = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in head.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    types = {f.name: f.dataType for f in (schema or T.StructType())}
    return head.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in head.columns])


def schema_errors(df: DataFrame, contract: dict[int, T.StructType], version: int) -> list[str]:
    """What differs from the contract of a version: columns that are missing, unknown, of another type or in another order."""
    want, have = {f.name: f.dataType for f in contract[version]}, {f.name: f.dataType for f in df.schema}
    found = [f"missing {c}" for c in want if c not in have] + [f"unknown {c}" for c in have if c not in want]
    found += [f"{c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]
    return found or ([] if list(want) == list(have) else [f"columns are in the order {', '.join(have)}"])


def as_version(df: DataFrame, contract: dict[int, T.StructType], version: int) -> DataFrame:
    """The columns of an older version, in its order; what later ones added goes."""
    return df.select(*[F.col(f"`{f.name}`") for f in contract[version]])


def validate_schema(df: DataFrame, contract: dict[int, T.StructType], version: int) -> DataFrame:
    if errors := schema_errors(df, contract, version):
        raise ValueError("; ".join(errors))
    return df


def snapshot_violations(songs: DataFrame, images: DataFrame, summary: DataFrame) -> DataFrame:
    """(code, detail): counts that differ, rows without exactly one good image of the same hash and path, images of no row, urls twice."""
    code = lambda df, c, d: df.select(F.lit(c).alias("code"), F.col(d).cast("string").alias("detail"))
    n = songs.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(summary.select(F.col("song_count").alias("said")).limit(1))).filter("n != said")
    good = images.filter("error IS NULL OR error = ''").select("url", F.col("sha256").alias("_sha"), F.col("path").alias("_path"))
    per = songs.join(good, "url", "left").groupBy("song_id").agg(F.count("_sha").alias("n"), F.count_if((F.col("_sha") == F.col("sha256")) & (F.col("_path") == F.col("path"))).alias("same"))
    out = code(n, "count_mismatch", "n").unionByName(code(per.filter("n != 1"), "image_not_unique", "song_id")).unionByName(code(per.filter("n = 1 AND same = 0"), "image_differs", "song_id"))
    out = out.unionByName(code(images.join(songs, "url", "left_anti"), "image_unreferenced", "url"))
    return out.unionByName(code(songs.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "url_repeated", "url"))


def write_report(df: DataFrame, path: str, order: list[str], fmt: str = "csv") -> None:
    """Rows in a fixed order and columns by name; an existing report is an error."""
    rows = df.select(*sorted(df.columns)).orderBy(*order)
    rows.write.mode("errorifexists").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)


def publish(df: DataFrame, path: str, inputs: list[DataFrame] | None = None) -> str:
    """Write beside the target, read back, compare with what was written, then move; refuse to overwrite.  Gives the fingerprint.

    The rows are counted and hashed as they are written.  If one of ``inputs`` isn't the
    same before and after, nothing is published.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    before = [table_fingerprint(i).first() for i in inputs or []]
    written = Observation()
    df.observe(written, *fingerprint(df.columns)).write.mode("errorifexists").parquet(staging.toString())
    want, have = written.get, table_fingerprint(spark.read.parquet(staging.toString())).first().asDict()
    if want != have or before != [table_fingerprint(i).first() for i in inputs or []]:
        fs.delete(staging, True)
        raise ValueError(f"{path}: read back {have}, wrote {want}" if want != have else f"{path}: an input changed meanwhile")
    if not fs.rename(staging, target):
        raise FileExistsError(path)
    return have["content"]


METRICS = {"ok": "int", "calories": "double"}


def export_plays(plays: DataFrame, path: str, version: int = 2) -> None:
    """JSON lines; version 1 has no ok and calories."""
    (plays if version == 2 else plays.drop(*METRICS)).withColumn("export_version", F.lit(version)).write.mode("errorifexists").json(path)


def restore_plays(spark: SparkSession, path: str, schema: T.StructType, logs: DataFrame, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(all plays, logs without links): ids and duplicate keys must be unique and the count as expected; version 1 gets null metrics."""
    names = [f.name for f in schema]
    plays = spark.read.schema(schema).json(path).select(*names)
    n, ids, keys = plays.agg(F.count(F.lit(1)), F.count_distinct("play_id"), F.count_distinct("duplicate_key")).first()
    if ids != n or keys != n or (expected is not None and expected != n):
        raise ValueError(f"{path}: {n} plays, {ids} ids, {keys} keys; expected {expected}")
    return plays, logs.withColumn("play_id", F.lit(None).cast("string"))
