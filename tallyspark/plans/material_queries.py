"""Vectors of several parts, evidence, and round trips through files, over the driver's tables."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import ids as I
from tallyspark.functions import scores as S
from tallyspark.functions import vectors as V
from tallyspark.operators import nearest as N
from tallyspark.plans.registry import Tables, query
from tallyspark.sources import extract
from tallyspark.sources import tables as R

# --- vectors: 64 numbers, cut into parts; each vector meets the next one ----------------


def neighbours(t: Tables) -> DataFrame:
    """(vec_id, label, x, y): each vector and the one with the next id."""
    e = t.embeddings
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.select("vec_id", "label", F.col("embedding").alias("x")).join(after, "vec_id")


def _cut(col: str, parts: dict[str, tuple[int, int]]) -> Column:
    """A struct of slices (start, length); those called bits hold 1 where a number is above zero."""
    bits = lambda arr: F.transform(arr, lambda v: (v > 0).cast("int"))
    cut = {n: F.slice(col, a, size) for n, (a, size) in parts.items()}
    return F.struct(*[(bits(c) if n.endswith("bits") else c).alias(n) for n, c in cut.items()])


def _parts_sql(parts: dict[str, tuple[int, int]], weights: tuple[tuple[str, float], ...]) -> str:
    terms = []
    for name, weight in weights:
        a, size = parts[name]
        gap = "((z[1] > 0) <> (z[2] > 0))::INT" if name.endswith("bits") else "abs(z[1]::DOUBLE - z[2]::DOUBLE)"
        terms.append(f"{weight} * list_sum(list_transform(list_zip(x[{a}:{a + size - 1}], y[{a}:{a + size - 1}]), lambda z: {gap})) / {size}")
    return " + ".join(terms)


PAIR_SQL = "p AS (SELECT a.vec_id, a.label, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
IMAGE = {"thumbnail": (1, 48), "histogram": (49, 8), "dhash_bits": (57, 8)}
TEXT = {"luma": (1, 16), "edge": (17, 16), "suffix_luma": (33, 8), "suffix_edge": (41, 8), "dhash_bits": (49, 16)}


@query(f"WITH {PAIR_SQL} SELECT vec_id, round({_parts_sql(IMAGE, V.IMAGE_PARTS)}, 6) AS image_distance, round({_parts_sql(TEXT, V.TEXT_PARTS)}, 6) AS text_distance FROM p")
def v4_v5_composite_distances(t: Tables) -> DataFrame:
    far = lambda cut, parts: F.round(V.composite_distance(_cut("x", cut), _cut("y", cut), parts), 6)
    return neighbours(t).select("vec_id", far(IMAGE, V.IMAGE_PARTS).alias("image_distance"), far(TEXT, V.TEXT_PARTS).alias("text_distance"))


_HEX = " || ".join("printf('%x', " + " + ".join(f"g[k * 8 + {4 * half + j + 1}] * {8 >> j}" for j in range(4)) + ")" for half in (0, 1))


@query(f"""WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: (v >= 0)::INT) AS g FROM embeddings), r AS (SELECT vec_id, list_transform(range(0, 8), lambda k: {_HEX}) AS keys FROM b)
    SELECT a.vec_id, array_to_string(a.keys, ',') AS row_keys, len(list_filter(list_zip(a.keys, c.keys), lambda z: z[1] = z[2] AND z[1] <> '00'))::INT AS matched FROM r a JOIN r c ON c.vec_id = a.vec_id + 1""")
def v2_v7_row_keys(t: Tables) -> DataFrame:
    d = neighbours(t).select("vec_id", V.row_hashes(F.col("x"), 8, 0.0).alias("p"), V.row_hashes(F.col("y"), 8, 0.0).alias("q"))
    return d.select("vec_id", F.array_join("p", ",").alias("row_keys"), V.row_match_count(F.col("p"), F.col("q")).alias("matched"))


@query(f"""WITH {PAIR_SQL}, u AS (SELECT label, i, max((embedding[i] > 0)::INT) <> min((embedding[i] > 0)::INT) AS varies FROM embeddings, range(1, 65) t(i) GROUP BY ALL), m AS (SELECT label, list(CASE WHEN varies THEN 5.0 ELSE 1.0 END ORDER BY i) AS w FROM u GROUP BY label)
    SELECT vec_id, round(list_sum(list_transform(list_zip(x, y, w), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN z[3] ELSE 0.0 END)) / list_sum(w), 6) AS distance FROM p JOIN m USING (label)""")
def v6_candidate_masks(t: Tables) -> DataFrame:
    """The bits that differ among the vectors of a label weigh more."""
    bits = lambda c: F.transform(c, lambda v: (v > 0).cast("int"))
    masks = N.bit_masks(t.embeddings.select("label", bits("embedding").alias("bits")), "label", "bits")
    pairs = neighbours(t).join(masks, "label")
    return pairs.select("vec_id", F.round(V.masked_hamming(bits("x"), bits("y"), F.col("mask")), 6).alias("distance"))


@query("""WITH c AS (SELECT vec_id, unnest(range(0, 3)) AS ch, embedding AS e FROM embeddings), v AS (SELECT vec_id, ch, list_transform(range(0, (63 - ch) // 3 + 1), lambda k: e[k * 3 + ch + 1]::DOUBLE) AS a FROM c),
    h AS (SELECT vec_id, ch, a, unnest(range(0, 4)) AS b FROM v) SELECT vec_id, (ch * 4 + b)::INT AS bin, round(len(list_filter(a, lambda v: v >= -1 AND v <= 1 AND least(3, floor((v + 1) / 0.5)::INT) = b)) / greatest(1, len(list_filter(a, lambda v: v >= -1 AND v <= 1))), 6) AS share FROM h""")
def v3_channel_histograms(t: Tables) -> DataFrame:
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    return t.embeddings.select("vec_id", F.posexplode(V.channel_histograms(numbers, 3, 4, -1.0, 1.0)).alias("bin", "share")).withColumn("share", F.round("share", 6))


@query("SELECT event_id, round(sqrt(((value - 50) / 18.0) ** 2 + (least(((user_id * 7) - 90.0 + 3600) % 360, 360 - ((user_id * 7) - 90.0 + 3600) % 360) / 18.0) ** 2), 6) AS distance FROM events")
def p23_value_hue_distance(t: Tables) -> DataFrame:
    hue = (F.col("user_id") * 7).cast("double")
    return t.events.select("event_id", F.round(S.value_hue_distance(F.col("value"), hue, F.lit(50.0), F.lit(90.0)), 6).alias("distance"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","candidates":[{"kind":"type","value":"' || p_type || '"},{"kind":"size","value":"' || p_size || '"}],"size":' || p_size || '}' AS evidence FROM part""")
def p24_evidence_json(t: Tables) -> DataFrame:
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    found = F.array(one("type", F.col("p_type")), one("size", F.col("p_size")))
    return t.part.select("p_partkey", I.evidence_json(size=F.col("p_size"), candidates=found, brand=F.col("p_brand")).alias("evidence"))


# --- files: what is written is read back ------------------------------------------------


@query("SELECT * FROM orders")
def s13_publish(t: Tables) -> DataFrame:
    """Orders published once and read back."""
    path = R.scratch(t.orders.sparkSession, "published")
    R.publish(t.orders, path, inputs=[t.orders])
    return t.orders.sparkSession.read.parquet(path)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s1_s12_report(t: Tables) -> DataFrame:
    """A report as CSV, read back by contract."""
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    path = R.scratch(rows.sparkSession, "report")
    R.write_report(rows, path, ["c_custkey"])
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType())])
    return R.validate_schema(R.read_csv_required(rows.sparkSession, path, ["c_custkey", "c_name"], schema).select(*rows.columns), {1: schema}, 1)


@query("SELECT o_orderkey::VARCHAR AS play_id, o_custkey::INT AS score, NULL::INT AS ok, NULL::DOUBLE AS calories FROM orders")
def s14_export_restore(t: Tables) -> DataFrame:
    """Orders exported as plays of version 1, which has no ok and calories, and restored."""
    key = F.col("o_orderkey").cast("string")
    plays = t.orders.select(key.alias("play_id"), key.alias("duplicate_key"), F.col("o_custkey").cast("int").alias("score"), F.lit(1).alias("ok"), F.lit(2.0).alias("calories"))
    path = R.scratch(plays.sparkSession, "export")
    R.export_plays(plays, path, 1)
    schema = T.StructType.fromDDL("play_id string, duplicate_key string, score int, ok int, calories double")
    restored, _ = R.restore_plays(plays.sparkSession, path, schema, plays.select("play_id"))
    return restored.drop("duplicate_key")


@query("""WITH p AS (SELECT page_id AS page, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
    SELECT page, unnest(range(0, len(h))) AS position, unnest(t) AS text, origin || unnest(h) AS link, true AS same_origin, NULL::VARCHAR AS error FROM p""")
def x3_s5_lateral_rows(t: Tables) -> DataFrame:
    """The links of all pages by a table function in SQL."""
    pages = t.pages
    extract.register(pages.sparkSession)
    return pages.sparkSession.sql("SELECT p.page_id AS page, r.* FROM {pages} p, LATERAL html_rows(p.html, p.url, 'a', 'href') r", pages=pages)


@query("""WITH r AS (SELECT page_id AS page, unnest(range(0, 3)) AS row_no FROM pages) SELECT page, 0 AS table_no, row_no, CASE row_no WHEN 0 THEN 'page|n|' WHEN 1 THEN 'p' || page || '|1|x' ELSE 'p' || page || '|2|2' END AS cells FROM r""")
def x3_s6_lateral_cells(t: Tables) -> DataFrame:
    """Tables put behind each page, by a table function in SQL."""
    made = F.concat(F.lit("<table><tr><th>page</th><th>n</th></tr><tr><td rowspan=2>p"), "page_id", F.lit("<a>*1</a></td><td>1</td><td> x </td></tr><tr><td colspan=2>2</td></tr></table>"))
    pages = t.pages.withColumn("html", F.concat("html", made))
    extract.register(pages.sparkSession)
    rows = pages.sparkSession.sql("SELECT p.page_id AS page, r.* FROM {pages} p, LATERAL html_cells(p.html) r", pages=pages)
    return rows.withColumn("cells", F.array_join("cells", "|"))


def _first(pattern: str, group: int, sure: float):
    """An extractor of the first match, whose confidence falls with where it stands."""

    def read(texts: pd.Series) -> pd.DataFrame:
        found = [re.search(pattern, x) for x in texts]
        return pd.DataFrame({"value": [m.group(group) if m else None for m in found], "confidence": [round(sure - 0.5 * min(1.0, m.start(group) / 1000), 6) if m else 0.0 for m in found], "status": ["ok" if m else "not_found" for m in found]})

    return extract.extractor(read)


PROFILES = {"digits": _first(r"([0-9]+)", 1, 1.0), "capital": _first(r"([A-Z][a-z]+)", 1, 0.9), "mail": _first(r"([a-z0-9]+)@", 1, 0.95)}
FOUND = """v AS (SELECT doc_id, unnest(['digits', 'capital', 'mail']) AS profile, unnest([1.0, 0.9, 0.95]) AS sure, text, unnest([regexp_extract(text, '[0-9]+'), regexp_extract(text, '[A-Z][a-z]+'), regexp_extract(text, '([a-z0-9]+)@', 1)]) AS value, unnest(['', '', '@']) AS tail FROM documents),
    x AS (SELECT doc_id, profile, nullif(value, '') AS value, CASE WHEN text IS NULL OR value = '' THEN 0.0 ELSE round(sure - 0.5 * least(1.0, (strpos(text, value || tail) - 1) / 1000), 6) END::DOUBLE AS confidence, CASE WHEN text IS NULL THEN 'missing' WHEN value = '' THEN 'not_found' ELSE 'ok' END AS status FROM v)"""


@query(f"WITH {FOUND} SELECT * FROM x")
def x1_extract(t: Tables) -> DataFrame:
    """Three profiles of a user's extractor over every text."""
    return extract.extract(t.documents, "doc_id", "text", PROFILES)


@query(f"""WITH {FOUND}, b AS (SELECT * FROM x WHERE status = 'ok' AND confidence >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, list_position(['mail', 'digits', 'capital'], profile)) = 1)
    SELECT d.doc_id, b.profile, b.value, coalesce(b.confidence, 0.0) AS confidence, CASE WHEN b.doc_id IS NULL THEN 'none' ELSE 'ok' END AS status FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def x1_best_profile(t: Tables) -> DataFrame:
    return extract.best_profile(extract.extract(t.documents, "doc_id", "text", PROFILES), "doc_id", ["mail", "digits", "capital"], 0.6)


@query("""WITH e AS (SELECT event_id, user_id % 4 + 1 AS attempt, CASE WHEN event_type = 'error' THEN 'retry' WHEN value < 20 THEN 'skip' ELSE 'done' END AS disposition FROM events)
    SELECT event_id, disposition, CASE disposition WHEN 'done' THEN 'resolved' WHEN 'skip' THEN 'skipped' ELSE CASE WHEN attempt >= 3 THEN 'unresolved' ELSE 'retry' END END AS outcome FROM e""")
def x2_process(t: Tables) -> DataFrame:
    """A user's processor over every event, with its dispositions checked and turned into outcomes."""

    def judge(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(np.where(rows["event_type"] == "error", "retry", np.where(rows["value"] < 20, "skip", "done")))

    events = t.events.withColumn("attempt", F.col("user_id") % 4 + 1)
    return extract.process(events, judge, ["event_type", "value"], "attempt", 3).select("event_id", "disposition", "outcome")


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: least(255, greatest(0, round_even(abs(v)::DOUBLE * 255, 0)::INT))) AS u FROM embeddings)
    SELECT vec_id, sha256('[' || array_to_string(u, ',') || ']') AS payload, vec_id % 3 <> 0 AS readable, CASE WHEN vec_id % 3 <> 0 THEN round(list_sum(list_transform(u, lambda x: x / 255.0)), 6) END AS total FROM p""")
def v8_packed_payloads(t: Tables) -> DataFrame:
    """Vectors packed to bytes, hashed, and unpacked again; every third one is said to have another length."""
    packed = t.embeddings.select("vec_id", V.pack_u8(F.transform("embedding", lambda v: F.abs(v.cast("double")))).alias("u"))
    back = V.unpack_u8(F.col("u"), F.when(F.col("vec_id") % 3 == 0, 63).otherwise(64))
    return packed.select("vec_id", V.payload_hash(F.col("u")).alias("payload"), back.isNotNull().alias("readable"), F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
