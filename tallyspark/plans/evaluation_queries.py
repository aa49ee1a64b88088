"""Evaluation over ``documents`` with ``labels``, ``embeddings``, ``events`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scores as S
from tallyspark.functions.ids import json_candidates, sole
from tallyspark.operators import evaluate as V
from tallyspark.plans.registry import Tables, query
from tallyspark.plans.resolve_queries import VEC, nearest_and_truth

#: A recognised value beside its truth: the line's quantity, read wrong or not at all in a fixed pattern.
READ_SQL = """x AS (SELECT l_orderkey AS item, l_returnflag AS field, l_linestatus AS profile, l_orderkey * 10 + l_linenumber AS k, l_quantity::INT AS q FROM lineitem),
    rd AS (SELECT *, CASE WHEN k % 11 = 0 THEN '' WHEN k % 7 = 0 THEN (q + 1)::VARCHAR ELSE '0' || q END AS value, CASE WHEN k % 13 = 0 THEN '' ELSE q::VARCHAR END AS expected, k % 17 <> 0 AS ok FROM x)"""


def read(t: Tables) -> DataFrame:
    x = t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("profile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").cast("int").alias("q"))
    value = F.when(F.col("k") % 11 == 0, "").when(F.col("k") % 7 == 0, (F.col("q") + 1).cast("string")).otherwise(F.concat(F.lit("0"), F.col("q")))
    return x.withColumns({"value": value, "expected": F.when(F.col("k") % 13 == 0, "").otherwise(F.col("q").cast("string")), "ok": F.col("k") % 17 != 0})


BUCKET = """SELECT {by}, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS unavailable,
    count(*) FILTER (ok AND value <> '' AND expected <> '' AND try_cast(value AS INT) = try_cast(expected AS INT)) AS "match", count(*) FILTER (ok AND value <> '' AND expected <> '' AND try_cast(value AS INT) <> try_cast(expected AS INT)) AS mismatch,
    count(*) FILTER (ok AND value = '' AND expected <> '') AS empty, count(*) FILTER (expected = '') AS no_expected FROM rd GROUP BY {by}"""


@query(f"WITH {READ_SQL}, b AS ({BUCKET.format(by='field, profile')}) SELECT *, CASE WHEN no_expected = total THEN 'no_expected' WHEN no_expected > 0 OR unavailable > 0 THEN 'partially_evaluated' ELSE 'evaluated' END AS evaluation_status FROM b")
def a10_a11_p8_match_bucket(t: Tables) -> DataFrame:
    return V.match_bucket(read(t), ["field", "profile"], "value", "expected", F.col("ok"))


@query(f"""WITH {READ_SQL}, b AS ({BUCKET.format(by='field, profile')}) SELECT field, profile, b."match", mismatch, empty, b."match" - (SELECT d."match" FROM b d WHERE d.field = b.field AND d.profile = 'O') AS gain,
    CASE WHEN b."match" = 0 THEN 'no_match' WHEN mismatch > 0 THEN 'has_mismatch' WHEN empty > 0 THEN 'has_empty' ELSE 'ready' END AS readiness FROM b QUALIFY rank() OVER (PARTITION BY field ORDER BY b."match" DESC, mismatch, empty) = 1""")
def a12_recommend_profile(t: Tables) -> DataFrame:
    return V.recommend_profile(V.match_bucket(read(t), ["field", "profile"], "value", "expected", F.col("ok")), "field", "profile", "O")


@query(f"WITH {READ_SQL}, b AS ({BUCKET.format(by='field')}) SELECT field, CASE WHEN total = 0 THEN 'no_target' WHEN no_expected = total THEN 'needs_labels' WHEN mismatch > 0 THEN 'has_mismatch' WHEN empty > 0 THEN 'has_empty' WHEN no_expected > 0 THEN 'partially_labelled' ELSE 'ready' END AS adoption_status FROM b")
def a19_field_readiness(t: Tables) -> DataFrame:
    return V.field_readiness(V.match_bucket(read(t), ["field"], "value", "expected", F.col("ok")).withColumnRenamed("total", "target")).select("field", "adoption_status")


@query(f"WITH {READ_SQL} SELECT profile, ok::VARCHAR AS st, length(value) AS length, count(*) AS n, round(avg(q), 6) AS mean_distance FROM rd GROUP BY ALL")
def a15_recognition_bucket(t: Tables) -> DataFrame:
    return V.recognition_bucket(read(t).withColumn("st", F.col("ok").cast("string")), ["profile"], "st", F.length("value"), "q").withColumn("mean_distance", F.round("mean_distance", 6))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT::VARCHAR AS va, l_linenumber % 5 <> 0 AS oa FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 9 = 0 THEN (l_quantity::INT + 1)::VARCHAR ELSE '00' || l_quantity::INT END AS vb, l_linenumber % 4 <> 0 AS ob FROM lineitem WHERE l_suppkey % 10 <> 0)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT oa THEN 'unavailable_a' WHEN ob IS NULL OR NOT ob THEN 'unavailable_b' WHEN va::INT = vb::INT THEN 'same' ELSE 'different' END AS comparison FROM a LEFT JOIN b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def j21_compare_engines(t: Tables) -> DataFrame:
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    q = F.col("l_quantity").cast("int")
    ok = lambda k: F.when(F.col("l_linenumber") % k != 0, "ok").otherwise("failed").alias("status")
    a = t.lineitem.select(*ids, q.cast("string").alias("value"), ok(5))
    b = t.lineitem.filter("l_suppkey % 10 != 0").select(*ids, F.when(F.col("l_partkey") % 9 == 0, (q + 1).cast("string")).otherwise(F.concat(F.lit("00"), q)).alias("value"), ok(4))
    return V.compare_engines(a, b, ids, "value", "status").select(*ids, "comparison")


@query("""WITH p AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT field, value, count(*) AS n FROM p WHERE value <> '' GROUP BY ALL), v AS (SELECT 'lang' AS field, unnest(['en', 'xx']) AS value)
    SELECT field, value, coalesce(n, 0) AS n FROM c FULL JOIN v USING (field, value)""")
def a7_value_counts(t: Tables) -> DataFrame:
    return V.value_counts(t.documents, ["lang", "source"], {"lang": ["en", "xx"]})


@query("SELECT lang, source, count(*) AS n, array_to_string(list_slice(list(doc_id ORDER BY n_chars DESC, doc_id), 1, 3), ',') AS representatives FROM documents GROUP BY ALL")
def a8_groups_with_reps(t: Tables) -> DataFrame:
    return V.groups_with_reps(t.documents, ["lang", "source"], "doc_id", [F.col("n_chars").desc(), F.col("doc_id")])


@query("""WITH p AS (SELECT 'text' AS field, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 8000 THEN 'long' ELSE 'ready' END AS status, lang AS reason FROM documents UNION ALL SELECT 'source', CASE WHEN source IN ('src1', 'src2') THEN 'blocked' ELSE 'ready' END, source FROM documents),
    g AS (SELECT field, status, reason, count(*) AS n FROM p WHERE status <> 'ready' GROUP BY ALL), a AS (SELECT *, CASE status WHEN 'short' THEN 'drop' WHEN 'long' THEN 'split' ELSE 'review' END AS action, CASE status WHEN 'short' THEN 1 WHEN 'long' THEN 2 ELSE 9 END AS priority FROM g)
    SELECT *, row_number() OVER (ORDER BY priority, n DESC, field, status, reason) AS place FROM a""")
def a9_w9_resolution_order(t: Tables) -> DataFrame:
    size = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 8000, "long").otherwise("ready")
    src = F.when(F.col("source").isin("src1", "src2"), "blocked").otherwise("ready")
    d = t.documents.select(size.alias("text_status"), F.col("lang").alias("text_reason"), src.alias("source_status"), F.col("source").alias("source_reason"))
    return V.resolution_order(d, ["text", "source"], {"short": ("drop", 1), "long": ("split", 2)})


LABELLED = "lb AS (SELECT doc_id, lang, source, n_chars, quality, (n_chars > 400)::INT AS predicted FROM documents JOIN labels USING (doc_id))"


def labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").withColumn("predicted", (F.col("n_chars") > 400).cast("int"))


@query(f"""WITH {LABELLED} SELECT lang, count(*) AS n, count(*) FILTER (predicted = quality) AS correct, round(count(*) FILTER (predicted = quality) / count(*), 6) AS accuracy,
    count(*) FILTER (predicted = 1 AND quality = 0) AS false_positives, count(*) FILTER (predicted = 0 AND quality = 1) AS false_negatives FROM lb GROUP BY lang""")
def a13_classification_summary(t: Tables) -> DataFrame:
    return V.classification_summary(labelled(t), "predicted", "quality", ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {LABELLED} SELECT lang, CASE WHEN predicted = 1 THEN 'false_positive' ELSE 'false_negative' END AS kind, doc_id FROM lb WHERE predicted <> quality""")
def a13_misclassified(t: Tables) -> DataFrame:
    return V.misclassified(labelled(t), "predicted", "quality", "doc_id", ["lang"])


@query(f"""WITH {LABELLED}, g AS (SELECT source AS method, count(*) AS artifacts, count(*) FILTER (n_chars > 100) AS evaluated, count(*) FILTER (n_chars > 100 AND quality = 1) AS exact, count(*) FILTER (n_chars > 100 AND predicted = 1) AS auto,
    count(*) FILTER (n_chars > 100 AND predicted = 1 AND quality = 1) AS correct_auto FROM lb GROUP BY source), h AS (SELECT *, auto - correct_auto AS known_false, CASE WHEN evaluated > 0 THEN exact / evaluated END AS exact_rate, CASE WHEN auto > 0 THEN correct_auto / auto END AS precision FROM g),
    f AS (SELECT *, concat_ws(',', CASE WHEN evaluated < 15 THEN 'insufficient_evaluated' END, CASE WHEN coalesce(exact_rate < 0.8, true) THEN 'exact_rate_below_gate' END, CASE WHEN known_false > 0 THEN 'known_false_detected' END, CASE WHEN auto = 0 THEN 'no_auto_candidates' END, CASE WHEN coalesce(precision <> 1, true) THEN 'precision_below_gate' END) AS failed_gates FROM h)
    SELECT method, artifacts, evaluated, exact, auto, correct_auto, known_false, round(exact_rate, 6) AS exact_rate, round(precision, 6) AS precision, failed_gates = '' AS adopted, failed_gates FROM f""")
def a18_adoption(t: Tables) -> DataFrame:
    out = V.adoption(labelled(t).withColumnRenamed("source", "method"), "method", F.col("n_chars") > 100, F.col("quality") == 1, F.col("predicted") == 1, F.col("quality") == 1, 15, 0.8)
    return out.withColumns({"exact_rate": F.round("exact_rate", 6), "precision": F.round("precision", 6)})


@query("SELECT lang, count(n_chars) AS n, min(n_chars) AS low, round(quantile_cont(n_chars, 0.25), 4) AS p25, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.75), 4) AS p75, max(n_chars) AS high FROM documents GROUP BY lang")
def a20_distribution(t: Tables) -> DataFrame:
    return V.distribution(t.documents, "n_chars", ["lang"]).withColumns({c: F.round(c, 4) for c in ("p25", "median", "p75")})


@query("""WITH r AS (SELECT p_partkey, unnest(['base', 'low', 'high']) AS config, unnest([CASE WHEN p_size > 25 THEN 'ok' ELSE 'empty' END, CASE WHEN p_size > 15 THEN 'ok' ELSE 'empty' END, CASE WHEN p_size > 40 THEN 'ok' ELSE 'empty' END]) AS status FROM part)
    SELECT o.config, b.status AS baseline_status, o.status AS other_status, count(*) AS n FROM r b JOIN r o USING (p_partkey) WHERE b.config = 'base' AND o.config <> 'base' GROUP BY ALL""")
def a21_config_matrix(t: Tables) -> DataFrame:
    state = lambda n, k: F.struct(F.lit(n).alias("config"), F.when(F.col("p_size") > k, "ok").otherwise("empty").alias("status"))
    rows = t.part.select("p_partkey", F.inline(F.array(state("base", 25), state("low", 15), state("high", 40))))
    return V.config_matrix(rows, "p_partkey", "config", "status", "base")


@query("""WITH d AS (SELECT DISTINCT sha256(text) AS sha256, doc_id::VARCHAR AS name FROM documents), n AS (SELECT sha256, count(*) AS names FROM d GROUP BY 1 HAVING count(*) > 1) SELECT sha256, names, name FROM d JOIN n USING (sha256)""")
def a22_duplicate_hashes(t: Tables) -> DataFrame:
    return V.duplicate_hashes(t.documents.withColumn("name", F.col("doc_id").cast("string")), "text", "name")


TOPK = f"""{VEC}, e AS (SELECT k.*, o.label FROM k JOIN o USING (vec_id)), w AS (SELECT vec_id, label, label % 5 <> 4 AS in_snapshot, max(CASE WHEN rank = 1 THEN entity END) AS top_entity, max(CASE WHEN rank = 1 THEN distance END) AS top_distance,
    max(CASE WHEN rank = 1 THEN margin END) AS margin, max(CASE WHEN entity = label THEN rank END) AS expected_rank FROM e GROUP BY vec_id, label),
    z AS (SELECT *, coalesce(expected_rank <= 1, false) AS top1, coalesce(expected_rank <= 3, false) AS top3, coalesce(expected_rank <= 5, false) AS top5, coalesce(expected_rank <= 10, false) AS top10,
    CASE WHEN NOT in_snapshot THEN 'hold_truth_not_in_snapshot' WHEN top_distance > 0.115 THEN 'hold_distance' WHEN margin < 0.002 THEN 'hold_ambiguous' WHEN top_entity = label THEN 'matched_correct' ELSE 'matched_false' END AS decision FROM w)"""


def topk(t: Tables) -> DataFrame:
    truth = t.embeddings.filter("vec_id % 5 = 0").select("vec_id", "label", (F.col("label") % 5 != 4).alias("in_snapshot"))
    return V.topk_rows(nearest_and_truth(t), truth, "vec_id", "label", 0.115, 0.002)


@query(f"WITH {TOPK} SELECT vec_id, top_entity, expected_rank, top1, top3, top5, top10, decision FROM z")
def a16_topk_rows(t: Tables) -> DataFrame:
    return topk(t).select("vec_id", "top_entity", "expected_rank", "top1", "top3", "top5", "top10", "decision")


@query(f"""WITH {TOPK}, c AS (SELECT count(*) AS confirmed, count(*) FILTER (in_snapshot) AS s, count(*) FILTER (in_snapshot AND top1) AS t1, count(*) FILTER (in_snapshot AND top3) AS t3, count(*) FILTER (in_snapshot AND top5) AS t5, count(*) FILTER (in_snapshot AND top10) AS t10,
    count(*) FILTER (decision = 'matched_correct') AS correct, count(*) FILTER (decision = 'matched_false') AS wrong FROM z)
    SELECT confirmed, s AS in_snapshot, round(t1 / s, 6) AS top1_accuracy, round(t3 / s, 6) AS top3_accuracy, round(t5 / s, 6) AS top5_accuracy, round(t10 / s, 6) AS top10_accuracy, correct + wrong AS emitted, correct, wrong AS "false",
    round(CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) END, 6) AS precision, round((correct + wrong) / confirmed, 6) AS coverage_confirmed, round((correct + wrong) / s, 6) AS coverage_snapshot FROM c""")
def a16_topk_metrics(t: Tables) -> DataFrame:
    out = V.topk_metrics(topk(t))
    return out.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


ROUTE_SQL = """i AS (SELECT p_partkey AS k, p_partkey % 31 = 0 AS rejected, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS gate, p_partkey % 29 = 0 AS mismatch, p_partkey % 23 = 0 AS conflict, p_partkey % 3 = 0 AS one_title, p_partkey % 5 = 0 AS one_pair,
    p_partkey % 6 <> 1 AS in_top, p_partkey % 7 = 0 AS title_ambiguous, p_partkey % 11 = 0 AS pair_ambiguous, p_partkey % 2 = 0 AS pair_complete, p_partkey % 13 > 5 AS snapshot_title, p_partkey % 17 > 8 AS snapshot_pair FROM part),
    r AS (SELECT k, CASE WHEN rejected THEN 'rejected_capture_mismatch' WHEN gate IS NOT NULL THEN 'auto_jacket_gate' WHEN mismatch THEN 'manual_other' WHEN conflict THEN 'manual_jacket_ocr_conflict' WHEN one_title AND NOT title_ambiguous AND in_top THEN 'auto_jacket_top3_title_ocr'
    WHEN one_pair AND NOT pair_ambiguous AND NOT snapshot_pair THEN 'auto_ocr_title_artist_pair' WHEN pair_ambiguous THEN 'manual_ocr_pair_ambiguous' WHEN one_title AND NOT in_top AND NOT snapshot_title AND NOT pair_complete THEN 'manual_ocr_pair_incomplete' WHEN one_title AND NOT in_top THEN 'manual_jacket_top3_miss'
    WHEN title_ambiguous THEN 'manual_jacket_ocr_unresolved' ELSE 'manual_jacket_ocr_unresolved' END AS route, one_title, in_top FROM i),
    m AS (SELECT k, route, CASE route WHEN 'auto_jacket_gate' THEN k WHEN 'auto_jacket_top3_title_ocr' THEN k WHEN 'auto_ocr_title_artist_pair' THEN k + 1 END AS matched FROM r)"""
ROUTES = ["auto_jacket_gate", "auto_jacket_top3_title_ocr", "auto_ocr_title_artist_pair", "manual_jacket_ocr_conflict", "manual_jacket_ocr_unresolved", "manual_jacket_top3_miss", "manual_ocr_pair_ambiguous", "manual_ocr_pair_incomplete", "manual_other", "rejected_capture_mismatch", "never_taken"]


def route_rules() -> tuple[list[tuple[F.Column, str, F.Column | None, str]], tuple[str, str]]:
    """Rules over rejected, gate_entity, mismatch, conflict, top3, title_ids, pair_ids and their flags; what no rule takes is unresolved."""
    c = F.col
    title, pair = F.get("title_ids", 0), F.get("pair_ids", 0)
    sole_title, sole_pair, near = F.size("title_ids") == 1, F.size("pair_ids") == 1, F.array_contains("top3", F.get("title_ids", 0))
    # Names of routes are fixed values; a reason says which rule took the row.
    rules = [
        (c("rejected"), "rejected_capture_mismatch", None, "capture_review_rejected"),
        (c("gate_entity").isNotNull(), "auto_jacket_gate", c("gate_entity"), "jacket_gate"),
        (c("mismatch"), "manual_other", None, "ocr_profile_set_mismatch"),
        (c("conflict"), "manual_jacket_ocr_conflict", None, "ocr_profile_song_id_conflict"),
        (sole_title & ~c("title_ambiguous") & near, "auto_jacket_top3_title_ocr", title, "unique_title_in_jacket_top3"),
        (sole_pair & ~c("pair_ambiguous") & ~c("snapshot_pair"), "auto_ocr_title_artist_pair", pair, "unique_pair_without_snapshot_reference"),
        (c("pair_ambiguous"), "manual_ocr_pair_ambiguous", None, "title_artist_pair_ambiguous"),
        (sole_title & ~near & ~(c("snapshot_title") | c("pair_complete")), "manual_ocr_pair_incomplete", None, "snapshot_missing_pair_incomplete"),
        (sole_title & ~near, "manual_jacket_top3_miss", None, "title_candidate_outside_jacket_top3"),
        (c("title_ambiguous"), "manual_jacket_ocr_unresolved", None, "title_ocr_ambiguous"),
    ]
    return rules, ("manual_jacket_ocr_unresolved", "title_ocr_unresolved")


def routed(t: Tables) -> DataFrame:
    k = F.col("k")
    none = F.array().cast("array<bigint>")
    d = t.part.select(F.col("p_partkey").alias("k")).withColumns({
        "rejected": k % 31 == 0, "gate_entity": F.when(k % 4 == 0, k), "mismatch": k % 29 == 0, "conflict": k % 23 == 0,
        "title_ids": F.when(k % 3 == 0, F.array(k)).otherwise(none), "pair_ids": F.when(k % 5 == 0, F.array(k + 1)).otherwise(none),
        "top3": F.when(k % 6 != 1, F.array(k, k + 7)).otherwise(F.array(k + 7)), "title_ambiguous": k % 7 == 0, "pair_ambiguous": k % 11 == 0,
        "pair_complete": k % 2 == 0, "snapshot_title": k % 13 > 5, "snapshot_pair": k % 17 > 8,
    })
    return V.route(d, *route_rules(), "bigint")


@query(f"WITH {ROUTE_SQL} SELECT * FROM m")
def g7_route(t: Tables) -> DataFrame:
    return routed(t).select("k", "route", "matched")


@query(f"""WITH {ROUTE_SQL}, c AS (SELECT route, count(*) AS evaluated, count(matched) AS auto, count(*) FILTER (matched = k) AS correct, count(*) FILTER (matched <> k) AS "false" FROM m GROUP BY route), v AS (SELECT unnest({ROUTES}) AS route)
    SELECT route, coalesce(evaluated, 0) AS evaluated, coalesce(auto, 0) AS auto, coalesce(correct, 0) AS correct, coalesce("false", 0) AS "false", round(CASE WHEN auto > 0 THEN correct / auto END, 6) AS precision, round(coalesce(evaluated, 0) / sum(coalesce(evaluated, 0)) OVER (), 6) AS coverage FROM v LEFT JOIN c USING (route)""")
def a17_policy_summary(t: Tables) -> DataFrame:
    return V.policy_summary(routed(t), "k", ROUTES).withColumns({"precision": F.round("precision", 6), "coverage": F.round("coverage", 6)})


@query("""WITH p AS (SELECT l_orderkey, l_linestatus AS profile, list_sort(list(DISTINCT l_suppkey % 4)) AS ids FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN len(ids) = 1 THEN ids[1] END) FILTER (len(ids) = 1))), ','), '') AS entity_ids, count(DISTINCT CASE WHEN len(ids) = 1 THEN ids[1] END) > 1 AS conflict, max((len(ids) > 1)::INT) = 1 AS ambiguous, list_sort(list(DISTINCT profile)) <> ['F', 'O'] AS profile_set_mismatch FROM p GROUP BY l_orderkey""")
def g8_resolve_profiles(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", F.col("l_linestatus").alias("profile")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 4)).alias("ids"))
    out = V.resolve_profiles(rows, "l_orderkey", "profile", "ids", ["O", "F"])
    return out.withColumn("entity_ids", F.array_join(F.col("entity_ids").cast("array<string>"), ","))


@query("""SELECT c_custkey, o.v AS orders_value, CASE WHEN o.v IS NULL THEN 'missing' ELSE 'ok' END AS orders_state, n_name AS nation_value, CASE WHEN n_name IS NULL THEN 'missing' ELSE 'ok' END AS nation_state, NULL::VARCHAR AS rank_value, 'not_run' AS rank_state
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS v FROM orders GROUP BY 1) o ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey""")
def j20_assemble(t: Tables) -> DataFrame:
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("value"))
    nation = t.customer.join(t.nation.filter("n_regionkey != 2"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("value"))
    return V.assemble(t.customer.select("c_custkey"), "c_custkey", {"orders": orders, "nation": nation, "rank": None}, "value")


REFS = """s AS (SELECT p_partkey AS song, p_name AS title, p_size % 4 <> 0 AS available, p_brand AS style, p_size AS level FROM part),
    rf AS (SELECT l_orderkey * 10 + l_linenumber AS ref, l_partkey * 2 AS song0, l_partkey AS song, CASE l_suppkey % 4 WHEN 0 THEN 'auto_confirmed' WHEN 1 THEN 'manual_confirmed' WHEN 2 THEN 'needs_review' ELSE 'unresolved' END AS status, l_returnflag AS reason, 'v' || (l_suppkey % 3) AS extractor, l_partkey AS pk, l_suppkey AS sk FROM lineitem)"""


def songs(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("song"), F.col("p_name").alias("title"), (F.col("p_size") % 4 != 0).alias("available"), F.col("p_brand").alias("style"), F.col("p_size").alias("level"))


def refs(t: Tables) -> DataFrame:
    k = F.col("l_suppkey") % 4
    status = F.when(k == 0, "auto_confirmed").when(k == 1, "manual_confirmed").when(k == 2, "needs_review").otherwise("unresolved")
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.col("l_partkey").alias("song"), status.alias("status"), F.col("l_returnflag").alias("reason"), F.concat(F.lit("v"), F.col("l_suppkey") % 3).alias("extractor"), F.col("l_suppkey").alias("sk"))


def stated(t: Tables) -> DataFrame:
    """References with their state: a fifth were collected under another title, and a seventh of the songs are gone."""
    named = refs(t).join(songs(t).select("song", F.col("title").alias("_t")), "song", "left").withColumn("title", F.when(F.col("song") % 5 == 0, "other").otherwise(F.col("_t"))).drop("_t")
    return V.reference_state(named, songs(t).filter("song % 7 != 0"), "song", F.lit("v1"))


@query(f"""WITH {REFS}, t AS (SELECT rf.*, CASE WHEN rf.song % 5 = 0 THEN 'other' ELSE s.title END AS seen, s.title AS now, coalesce(s.available, false) AS available FROM rf LEFT JOIN (SELECT * FROM s WHERE song % 7 <> 0) s USING (song))
    SELECT ref, song, sk, CASE WHEN NOT available THEN 'orphaned' WHEN extractor <> 'v1' THEN 'stale_extractor' WHEN seen <> now THEN 'identity_drift' ELSE status END AS state FROM t""")
def j23_f7_reference_state(t: Tables) -> DataFrame:
    return stated(t).select("ref", "song", "sk", "state")


@query(f"""WITH {REFS}, b AS (SELECT song, status, reason, ref, sk FROM rf WHERE song % 2 = 0 UNION ALL SELECT song, 'needs_review', 'candidate', ref, sk FROM rf WHERE song % 2 = 1),
    k AS (SELECT *, CASE WHEN status IN ('auto_confirmed', 'manual_confirmed') THEN 0 WHEN status = 'needs_review' THEN 1 ELSE 2 END AS r FROM b),
    g AS (SELECT song, min(r) AS r, min_by(reason, (r, ref * 1000 + sk)) AS reason, count(*) AS rows_ FROM k GROUP BY song)
    SELECT song, CASE r WHEN 0 THEN 'referenced' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'unresolved' ELSE 'uncollected' END AS coverage, coalesce(reason, '') AS reason, coalesce(rows_, 0) AS "rows" FROM s LEFT JOIN g USING (song)""")
def j24_coverage(t: Tables) -> DataFrame:
    r = refs(t).withColumn("order", F.col("ref") * 1000 + F.col("sk"))
    cands = r.filter("song % 2 = 1").withColumns({"status": F.lit("needs_review"), "reason": F.lit("candidate")})
    return V.coverage(songs(t).select("song"), r.filter("song % 2 = 0"), cands, "song", "order")


COVER = f"""{REFS}, ob AS (SELECT o_orderkey AS obs, 'Brand#' || (o_orderkey % 26) AS style, (o_custkey % 55)::INT AS level FROM orders), ch AS (SELECT DISTINCT style, level, song FROM s),
    j AS (SELECT obs, ch.song, r.song IS NOT NULL AS referenced FROM ob LEFT JOIN ch USING (style, level) LEFT JOIN (SELECT DISTINCT song FROM rf) r ON ch.song = r.song),
    cv AS (SELECT obs, song, CASE WHEN song IS NULL THEN NULL WHEN referenced THEN 'referenced' ELSE 'missing' END AS candidate_state, CASE WHEN count(song) OVER w = 0 THEN 'no_candidates' WHEN sum(referenced::INT) OVER w = count(song) OVER w THEN 'all' WHEN sum(referenced::INT) OVER w = 0 THEN 'none' ELSE 'partial' END AS row_status FROM j WINDOW w AS (PARTITION BY obs))"""


def observed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, str, str, list[str]]:
    """Observations, charts, references and the names that tell them apart."""
    obs = t.orders.select(F.col("o_orderkey").alias("obs"), F.concat(F.lit("Brand#"), F.col("o_orderkey") % 26).alias("style"), (F.col("o_custkey") % 55).cast("int").alias("level"))
    return obs, songs(t), refs(t), "obs", "song", ["style", "level"]


@query(f"WITH {COVER} SELECT * FROM cv")
def j25_candidate_coverage(t: Tables) -> DataFrame:
    return V.candidate_coverage(*observed(t)).select("obs", "song", "candidate_state", "row_status")


@query(f"""WITH {REFS}, ob AS (SELECT o_orderkey AS obs, 'Brand#' || (o_orderkey % 26) AS style, (o_custkey % 55)::INT AS level, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS other, o_orderkey % 13 = 0 AS blocked FROM orders),
    low AS (SELECT style, level, min(song) AS first FROM s GROUP BY ALL), e AS (SELECT ob.*, CASE WHEN obs % 2 = 0 AND other IS NOT NULL THEN coalesce(first, other) ELSE other END AS expected FROM ob LEFT JOIN low USING (style, level))
    SELECT obs, CASE WHEN expected IS NULL THEN 'expected_unresolved' WHEN blocked THEN 'not_evaluated' WHEN c.song IS NULL THEN 'expected_not_in_chart_candidates' WHEN expected % 5 = 0 THEN 'expected_missing_feature' ELSE 'expected_referenced' END AS expected_status,
    CASE WHEN expected IS NULL THEN 'missing_label' WHEN blocked THEN 'missing_level' WHEN c.song IS NULL THEN 'chart_filter_excluded_expected_song' WHEN expected % 5 = 0 THEN 'expected_song_has_no_jacket_reference' ELSE '' END AS expected_reason
    FROM e LEFT JOIN s c ON c.song = expected AND c.style = e.style AND c.level = e.level""")
def j25_expected_status(t: Tables) -> DataFrame:
    """Half of the observations expect a candidate of their block; a fifth of the songs have no reference here."""
    k = F.col("o_orderkey")
    obs = t.orders.select(k.alias("obs"), F.concat(F.lit("Brand#"), k % 26).alias("style"), (F.col("o_custkey") % 55).cast("int").alias("level"), F.when(k % 11 != 0, F.col("o_custkey")).alias("other"))
    low = songs(t).groupBy("style", "level").agg(F.min("song").alias("first"))
    expected = F.when((F.col("obs") % 2 == 0) & F.col("other").isNotNull(), F.coalesce("first", "other")).otherwise(F.col("other"))
    obs = obs.join(low, ["style", "level"], "left").withColumns({"expected": expected, "failure": F.lit(""), "block_status": F.when(F.col("obs") % 13 == 0, "missing_level").otherwise("ready")})
    return V.expected_status(obs, songs(t), refs(t).filter("song % 5 != 0"), "obs", "song", ["style", "level"]).select("obs", "expected_status", "expected_reason")


@query(f"""WITH {REFS} SELECT ref, sk, s.song AS assigned_song, s.title AS assigned_title, CASE WHEN s.song IS NULL THEN 'missing' WHEN rf.song % 5 = 0 THEN 'title' ELSE '' END AS drift FROM rf LEFT JOIN (SELECT * FROM s WHERE song % 7 <> 0) s USING (song)""")
def j27_assigned(t: Tables) -> DataFrame:
    """A fifth of the references were collected under another title; a seventh of the songs are gone."""
    named = refs(t).join(songs(t).select("song", F.col("title").alias("_t")), "song", "left").withColumn("title", F.when(F.col("song") % 5 == 0, "other").otherwise(F.col("_t"))).drop("_t")
    out = V.with_assigned(named, songs(t).filter("song % 7 != 0"), "song")
    return out.select("ref", "sk", F.col("assigned.song").alias("assigned_song"), F.col("assigned.title").alias("assigned_title"), "drift")


@query(f"WITH {COVER} SELECT 'observation' AS kind, row_status AS value, count(DISTINCT obs) AS n FROM cv GROUP BY ALL UNION ALL SELECT 'candidate', candidate_state, count(*) FROM cv WHERE candidate_state IS NOT NULL GROUP BY ALL")
def a25_coverage_totals(t: Tables) -> DataFrame:
    return V.block_coverage_totals(*observed(t))


@query(f"WITH {REFS} SELECT song, CASE WHEN song IN (SELECT song FROM rf) THEN 'present' WHEN available THEN 'available_only' ELSE 'absent' END AS presence FROM s")
def j26_presence(t: Tables) -> DataFrame:
    return V.presence(songs(t), refs(t), "song", "available").select("song", "presence")


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS history, count(*) AS revision_count FROM conversations GROUP BY conv_id), d AS (SELECT DISTINCT conv_id FROM conversations),
    k AS (SELECT turn AS conv_id, count(*) AS candidate_count FROM conversations GROUP BY turn)
    SELECT conv_id, coalesce(candidate_count, 0) AS candidate_count, revision_count, array_to_string(history, ',') AS history FROM d LEFT JOIN c USING (conv_id) LEFT JOIN k USING (conv_id)""")
def j27_review_projection(t: Tables) -> DataFrame:
    conv = t.conversations
    cands = conv.select(F.col("turn").alias("conv_id"), F.col("conv_id").alias("rank"), F.col("role").alias("entity"))
    out = V.review_projection(conv.select("conv_id").distinct(), cands, conv.select("conv_id", "turn", F.col("role").alias("action")), "conv_id", "turn")
    return out.select("conv_id", "candidate_count", "revision_count", F.array_join(F.transform("history", lambda h: h["action"]), ",").alias("history"))


@query(f"WITH {REFS} SELECT count(*) AS \"rows\", count(*) FILTER (status IN ('auto_confirmed', 'manual_confirmed')) AS confirmed, count(*) FILTER (status = 'auto_confirmed') AS auto, count(*) FILTER (status = 'auto_confirmed' AND reason = 'R') AS known_false, round(count(*) FILTER (status = 'auto_confirmed') / count(*), 6) AS auto_rate, count(*) FILTER (status = 'auto_confirmed') / count(*) >= 0.9 AS meets_target, count(*) FILTER (status = 'auto_confirmed') / count(*) >= 0.95 AS meets_stretch FROM rf")
def a24_coverage_summary(t: Tables) -> DataFrame:
    auto = F.col("status") == "auto_confirmed"
    return V.coverage_summary(refs(t), F.col("status").isin("auto_confirmed", "manual_confirmed"), auto, auto & (F.col("reason") == "R")).withColumn("auto_rate", F.round("auto_rate", 6))


@query(f"""WITH {REFS}, t AS (SELECT rf.*, CASE WHEN rf.song % 5 = 0 THEN 'other' ELSE s.title END AS seen, s.title AS now, coalesce(s.available, false) AS available FROM rf LEFT JOIN (SELECT * FROM s WHERE song % 7 <> 0) s USING (song)),
    u AS (SELECT CASE WHEN NOT available THEN 'orphaned' WHEN extractor <> 'v1' THEN 'stale_extractor' WHEN seen <> now THEN 'identity_drift' ELSE status END AS state, reason FROM t)
    SELECT 'state' AS field, state AS value, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'reason', reason, count(*) FROM u GROUP BY ALL""")
def a24_state_counts(t: Tables) -> DataFrame:
    """References by state, orphaned ones among them, and by reason."""
    return V.value_counts(stated(t), ["state", "reason"])


@query(f"""WITH {REFS}, u AS (SELECT CASE reason WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' ELSE 'other' END AS classification, reason, status FROM rf), p AS (SELECT 'classification' AS field, classification AS value FROM u UNION ALL SELECT 'reason', reason FROM u UNION ALL SELECT 'status', status FROM u) SELECT field, value, count(*) AS n FROM p GROUP BY ALL""")
def a26_unresolved_summary(t: Tables) -> DataFrame:
    return V.unresolved_summary(refs(t), "reason", {"R": "rejected", "A": "accepted"}, ["status"])


@query("""WITH p AS (SELECT [o_custkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderkey::VARCHAR, o_orderpriority, o_orderstatus] AS v FROM orders),
    h AS (SELECT sha256(array_to_string(list_transform(v, lambda x: coalesce(length(x)::VARCHAR || ':' || x, 'n')), ';')) AS d FROM p)
    SELECT count(*) AS "rows", sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(d, 16, 15))::BIGINT)::VARCHAR AS content FROM h""")
def a27_table_fingerprint(t: Tables) -> DataFrame:
    """Without the price: a double's text isn't the same in both engines."""
    return V.table_fingerprint(t.orders.drop("o_totalprice"))


@query(f"""WITH {REFS} SELECT rf.ref, rf.sk FROM rf JOIN s USING (song) WHERE status IN ('auto_confirmed', 'manual_confirmed') AND extractor = 'v1' AND available AND rf.song % 5 <> 0 AND song % 7 <> 0""")
def f7_current_references(t: Tables) -> DataFrame:
    """A fifth of the references were collected under another title; a seventh of the songs are gone."""
    names = songs(t).select("song", F.col("title").alias("_t"), F.col("style").alias("artist"))
    named = refs(t).join(names, "song").withColumn("title", F.when(F.col("song") % 5 == 0, "other").otherwise(F.col("_t"))).drop("_t")
    return V.current_references(named, songs(t).withColumnRenamed("style", "artist").filter("song % 7 != 0"), "song", F.lit("v1")).select("ref", "sk")


@query("""SELECT event_id, round(greatest(0.0, least(1.0, (value - 10) / 80.0)) * 0.6 + greatest(0.0, least(1.0, (user_id - 0) / 100.0)) * 0.4, 6) AS score, round(least((value * 7) % 360, 360 - (value * 7) % 360), 4) AS turn FROM events""")
def p21_p23_signals(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(S.signal_score([("value", 10, 90, 0.6), ("user_id", 0, 100, 0.4)]), 6).alias("score"), F.round(S.circular_distance(F.col("value") * 7, F.lit(0.0)), 4).alias("turn"))


@query("""WITH j AS (SELECT p_partkey, list_sort(list_distinct([p_size % 5, p_partkey % 3, p_size % 5])) AS ids FROM part) SELECT p_partkey, array_to_string(ids, ',') AS candidates, CASE WHEN len(ids) = 1 THEN ids[1]::VARCHAR ELSE '' END AS sole FROM j""")
def p24_p25_json_candidates(t: Tables) -> DataFrame:
    ids = F.array(F.col("p_size") % 5, F.col("p_partkey") % 3, F.col("p_size") % 5)
    text = F.to_json(F.transform(ids, lambda i: F.struct(i.cast("string").alias("song_id"))))
    found = json_candidates(text)
    return t.part.select("p_partkey", F.array_join(found, ",").alias("candidates"), sole(found).alias("sole"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN (o_orderdate::DATE + 7)::VARCHAR WHEN 'O' THEN (o_orderdate::DATE + 30)::VARCHAR END AS until FROM orders""")
def p28_retention(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "normal").when(F.col("o_orderstatus") == "O", "diagnostic").otherwise("permanent")
    return t.orders.select("o_orderkey", S.retention_until(kind, F.col("o_orderdate").cast("date")).cast("string").alias("until"))
