"""Guarded writes, text functions, vectors, sources and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import ids as I
from tallyspark.functions import text as X
from tallyspark.functions import vectors as V
from tallyspark.operators import guarded as G
from tallyspark.plans.registry import Tables, query
from tallyspark.sources import html as H
from tallyspark.sources import tables as S
from tallyspark.sources.scratch import scratch, work_table
from tallyspark.sources.versions import VersionedTable

# --- writes ----------------------------------------------------------------

REC = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 20 = 0 THEN '' ELSE 'p' || l_orderkey END AS play_id, l_quantity::INT * 10 + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 50 = 0 THEN 1000000 ELSE 0 END AS score,
    CASE WHEN l_linenumber = 4 THEN -1 ELSE 0 END AS good, CASE WHEN l_partkey % 9 = 0 THEN 'score:' ELSE 'k:' END || l_orderkey AS duplicate_key, l_discount * 11 AS conf, CASE WHEN l_suppkey % 3 = 0 THEN 'Z' ELSE '' END AS zone, CASE l_returnflag WHEN 'R' THEN 'ZZ' ELSE 'AA' END AS rank FROM lineitem)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def records(t: Tables) -> DataFrame:
    score = F.col("l_quantity").cast("int") * 10 + (F.col("l_linenumber") == 3).cast("int") + F.when(F.col("l_partkey") % 50 == 0, 1_000_000).otherwise(0)
    r = t.lineitem.select(*KEYS, F.when(F.col("l_suppkey") % 20 == 0, "").otherwise(F.concat(F.lit("p"), "l_orderkey")).alias("play_id"), score.alias("score"), F.when(F.col("l_linenumber") == 4, -1).otherwise(0).alias("good"),
        F.concat(F.when(F.col("l_partkey") % 9 == 0, "score:").otherwise("k:"), "l_orderkey").alias("duplicate_key"), (F.col("l_discount") * 11).alias("analysis_confidence"), F.concat(F.lit("2024-01-01 10:00:00"), F.when(F.col("l_suppkey") % 3 == 0, "Z").otherwise("")).alias("played_at"), F.when(F.col("l_returnflag") == "R", "ZZ").otherwise("AA").alias("rank"))
    fill = {c: F.lit("x") for c in ("song_id", "chart_id", "capture_hash")} | {c: F.lit(0) for c in G.COUNTS if c != "good"} | {"clear_type": F.lit("CLEAR"), "ok": F.lit(None).cast("int"), "calories": F.lit(None).cast("double")}
    return r.withColumns(fill)


@query(f"""WITH {REC} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN play_id = '' THEN 'play.play_id_required' END, CASE WHEN zone = '' THEN 'play.played_at_not_aware' END, CASE WHEN rank = 'ZZ' THEN 'play.rank_invalid' END,
    CASE WHEN score > 1000000 THEN 'play.score_out_of_range' END, CASE WHEN score <= 1000000 AND score % 10 <> 0 THEN 'play.score_not_multiple_of_10' END, CASE WHEN good < 0 THEN 'play.good_negative' END, CASE WHEN conf > 1 THEN 'play.confidence_invalid' END, CASE WHEN starts_with(duplicate_key, 'score:') THEN 'play.duplicate_key_uses_preview_format' END) AS errors FROM r""")
def g1_validate(t: Tables) -> DataFrame:
    return records(t).select(*KEYS, F.array_join(G.play_errors(), ",").alias("errors"))


def linked(t: Tables) -> DataFrame:
    """Wide records: lines with analysis, capture and play columns, some of which contradict each other."""
    k, n = F.col("l_orderkey") + F.col("l_suppkey"), F.col("l_linenumber")
    status = F.element_at(F.array(*[F.lit(x) for x in ("saved", "skipped", "error", "low_confidence")]), (k % 4 + 1).cast("int"))
    return t.lineitem.select(
        *KEYS, status.alias("analysis_status"), (n % 3 != 0).alias("has_play"), F.when(k % 5 == 0, "why").otherwise("").alias("skip_reason"), (k % 6 != 0).alias("confirmed_result"),
        (k % 7 == 0).alias("duplicate"), F.lit("h").alias("capture_hash"), F.when(k % 11 == 0, "other").otherwise("h").alias("play_capture_hash"),
    )


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey + l_suppkey AS k, l_linenumber % 3 <> 0 AS play FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN NOT play AND k % 4 = 0 THEN 'saved_analysis_requires_play' END, CASE WHEN NOT play AND k % 5 <> 0 THEN 'non_saved_analysis_requires_skip_reason' END,
    CASE WHEN play AND k % 4 <> 0 THEN 'play_requires_saved_analysis' END, CASE WHEN play AND k % 5 = 0 THEN 'saved_analysis_skip_reason_must_be_empty' END, CASE WHEN play AND k % 6 = 0 THEN 'play_requires_confirmed_result' END,
    CASE WHEN play AND k % 7 = 0 THEN 'play_must_not_be_duplicate' END, CASE WHEN play AND k % 11 = 0 THEN 'play.capture_hash_mismatch' END, CASE WHEN k % 7 = 0 AND k % 4 <> 1 THEN 'duplicate_requires_skipped_analysis' END) AS errors FROM r""")
def g1_link_errors(t: Tables) -> DataFrame:
    good, bad = G.validate(linked(t), G.link_errors())
    rows = good.withColumn("errors", F.array().cast("array<string>")).unionByName(bad)
    return rows.select(*KEYS, F.array_join("errors", ",").alias("errors"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 <> 0 AS play, l_partkey * 10 + l_linenumber % 2 AS dk, l_returnflag = 'R' AS dup FROM lineitem),
    p AS (SELECT *, play AND (l_partkey % 9 = 0 OR row_number() OVER (PARTITION BY play, dk ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) > 1) AS again FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN play AND NOT again THEN 'p' || l_orderkey END AS play_id, CASE WHEN again THEN 'skipped' WHEN play THEN 'saved' ELSE 'error' END AS analysis_status,
    CASE WHEN again THEN 'duplicate' ELSE 'ready' END AS save_boundary_status, CASE WHEN again THEN 'duplicate_key_already_saved' ELSE '' END AS skip_reason, dup OR again AS duplicate FROM p""")
def g2_save_log(t: Tables) -> DataFrame:
    """The log of saving all lines as records, of which a ninth of the parts' plays were saved before."""
    key = (F.col("l_partkey") * 10 + F.col("l_linenumber") % 2).alias("duplicate_key")
    play = F.col("l_linenumber") % 3 != 0
    rows = t.lineitem.select(
        *KEYS, key, play.alias("has_play"), F.when(play, F.concat(F.lit("p"), "l_orderkey")).alias("play_id"), F.when(play, "saved").otherwise("error").alias("analysis_status"),
        F.lit("ready").alias("save_boundary_status"), F.lit("").alias("skip_reason"), (F.col("l_returnflag") == "R").alias("duplicate"),
    )
    log = [*KEYS, "play_id", "analysis_status", "save_boundary_status", "skip_reason", "duplicate"]
    saved = t.lineitem.filter("l_partkey % 9 = 0").select(key).distinct()
    saved = saved.unionByName(t.part.filter("p_partkey % 9 = 0").select(F.explode(F.array(F.col("p_partkey") * 10, F.col("p_partkey") * 10 + 1)).alias("duplicate_key")))
    return G.save_records(saved, rows, [F.col(c) for c in KEYS], "duplicate_key_already_saved", ["duplicate_key", *KEYS], KEYS, log)[2]


@query("""WITH b AS (SELECT o_orderkey, o_custkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) AS known, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 10 <> 0)
    SELECT o_orderkey, CASE WHEN NOT known AND rn = 1 THEN 'inserted' ELSE 'duplicate' END AS outcome FROM b""")
def g2_insert_once(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey")
    return G.insert_once(o.filter("o_orderkey % 10 = 0"), o.filter("o_orderkey % 10 != 0"), "o_custkey", [F.col("o_orderkey")])[1].select("o_orderkey", "outcome")


@query("""WITH g AS (SELECT *, o_orderkey % 3 AS batch FROM orders WHERE o_totalprice >= 50000 OR o_orderstatus <> 'F')
    SELECT o_custkey, o_orderkey, o_totalprice, batch FROM g QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY batch, o_orderkey) = 1""")
def t9_saved_batches(t: Tables) -> DataFrame:
    """Three triggers of orders, validated and saved once a customer; the third one is seen twice.  The table's last version."""
    from tallyspark.streaming.stateful import save_batch

    table = VersionedTable(t.orders.sparkSession, scratch(t.orders.sparkSession, "saved-batches"), "o_custkey", 16)
    errors = I.reasons(((F.col("o_totalprice") < 50_000) & (F.col("o_orderstatus") == "F"), "too_small"))
    for n in (0, 1, 2, 2):
        batch = t.orders.filter(F.col("o_orderkey") % 3 == n).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
        save_batch(batch, table, lambda b, n=n: b.withColumn("batch", F.lit(n).cast("long")), errors, "o_custkey", [F.col("o_orderkey")])
    return table.read().select("o_custkey", "o_orderkey", "o_totalprice", "batch")


@query("""WITH d AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'withdrawn' ELSE '' END AS exclusion, p_size % 5 = 0 AS duplicate, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS artist FROM part)
    SELECT p_partkey, CASE WHEN exclusion <> '' OR duplicate THEN 'excluded' WHEN title = '' OR artist IS NULL THEN 'unresolved' ELSE 'ready' END AS adaptation,
    CASE WHEN exclusion <> '' THEN exclusion WHEN duplicate THEN 'duplicate' ELSE concat_ws(',', CASE WHEN title = '' THEN 'title' END, CASE WHEN artist IS NULL THEN 'artist' END) END AS adaptation_reason FROM d""")
def g3_adapt(t: Tables) -> DataFrame:
    s = F.col("p_size")
    d = t.part.select("p_partkey", F.when(s % 7 == 0, "withdrawn").otherwise("").alias("exclusion"), (s % 5 == 0).alias("duplicate"), F.when(s % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.when(s % 4 != 0, F.col("p_brand")).alias("artist"))
    return G.adapt(d, ["title", "artist"]).select("p_partkey", "adaptation", "adaptation_reason")


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN 'guess' ELSE 'ocr' END AS title_source, 0.97 + (c_custkey % 5) * 0.01 AS title_confidence FROM customer)
    SELECT c_custkey, concat_ws(',', CASE WHEN title = '' THEN 'title_missing' END, CASE WHEN title_source <> 'ocr' THEN 'title_source' END, CASE WHEN round(title_confidence, 3) < 0.98 OR round(title_confidence, 3) > 1.0 THEN 'title_confidence' END) AS reasons FROM f""")
def f6_promote(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    d = t.customer.select("c_custkey", F.when(k % 6 == 0, "").otherwise(F.col("c_name")).alias("title"), F.when(k % 4 == 0, "guess").otherwise("ocr").alias("title_source"), F.round(0.97 + (k % 5) * 0.01, 3).alias("title_confidence"))
    return G.promote(d, {"title": "ocr"}).select("c_custkey", F.array_join("promotion_reasons", ",").alias("reasons"))


@query("""WITH f AS (SELECT c_custkey, c_name AS score, CASE WHEN c_custkey % 4 = 0 THEN 'guess' ELSE 'ocr' END AS score_source, 0.98 + (c_custkey % 3) * 0.01 AS score_confidence, c_custkey % 5 = 0 AS failed, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '7' END AS ok, CASE WHEN c_custkey % 7 = 0 THEN 0.5 ELSE 0.99 END AS calories_confidence FROM customer),
    g AS (SELECT *, concat_ws(',', CASE WHEN score_source <> 'ocr' THEN 'score_source' END, CASE WHEN NOT failed AND ok = '' THEN 'ok_missing' END, CASE WHEN c_custkey % 17 = 0 THEN 'level_out_of_range' END, CASE WHEN c_custkey % 10 = 9 THEN 'rank_invalid' END) AS reasons FROM f)
    SELECT c_custkey, reasons, CASE WHEN calories_confidence >= 0.98 THEN 'kcal' END AS calories, round(CASE WHEN reasons = '' THEN least(score_confidence, CASE WHEN NOT failed THEN 0.985 END, CASE WHEN calories_confidence >= 0.98 THEN calories_confidence END) END, 4)::DOUBLE AS row_confidence FROM g""")
def f10_promote_final(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    d = t.customer.select("c_custkey", F.col("c_name").alias("score"), F.when(k % 4 == 0, "guess").otherwise("ocr").alias("score_source"), (0.98 + (k % 3) * 0.01).alias("score_confidence"), (k % 5 == 0).alias("failed"), F.when(k % 3 == 0, "").otherwise("7").alias("ok"), F.lit("ocr").alias("ok_source"), F.lit(0.985).alias("ok_confidence"), F.lit("kcal").alias("calories"), F.lit("ocr").alias("calories_source"), F.when(k % 7 == 0, 0.5).otherwise(0.99).alias("calories_confidence"))
    out = G.promote_final(d, {"score": "ocr", "ok": "ocr"}, {"calories": "ocr"}, F.col("failed"), "ok", checks=((k % 17 == 0, "level_out_of_range"), (k % 10 == 9, "rank_invalid")))
    return out.select("c_custkey", F.array_join("promotion_reasons", ",").alias("reasons"), "calories", F.round("row_confidence", 4).alias("row_confidence"))


REFS = "rf AS (SELECT o_orderkey AS ref_id, (o_orderkey % 3)::INT AS revision, CASE o_orderkey % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'auto_confirmed' WHEN 3 THEN 'manual_confirmed' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 5 IN (2, 3) THEN o_custkey END AS entity FROM orders)"
#: Batches of eight requests: of every third one some requests are bad; the others fit the state of their reference.
REQ = """kk AS (SELECT o_orderkey AS k, o_custkey, o_orderkey // 8 % 3 = 0 AS odd FROM orders),
    rq AS (SELECT CASE WHEN odd AND k % 64 = 9 THEN k - 1 ELSE k END * 7 AS action_id, k AS ref_id, k // 8 AS batch,
        CASE WHEN odd AND k % 4 = 3 THEN 'explode' WHEN odd AND k % 4 = 2 THEN 'reopen' WHEN k % 5 < 2 AND k % 2 = 0 THEN 'manual_confirm' WHEN k % 5 < 2 THEN 'reject' WHEN k % 5 = 3 AND k % 2 = 0 THEN 'reassign' ELSE 'reopen' END AS action,
        (k % 3 + CASE WHEN odd AND k % 22 = 0 THEN 1 ELSE 0 END)::INT AS expected_revision, CASE k % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'auto_confirmed' WHEN 3 THEN 'manual_confirmed' ELSE 'rejected' END AS expected_status,
        o_custkey, odd, k FROM kk),
    rr AS (SELECT *, CASE WHEN action IN ('manual_confirm', 'reassign') AND NOT (odd AND k % 24 = 0) THEN CASE WHEN k % 20 = 8 THEN o_custkey ELSE o_custkey + 1 END END AS entity FROM rq),
    hi AS (SELECT action_id AS hid, ref_id % 50 = 23 AND odd AS other FROM rr WHERE (ref_id % 10 = 7 OR (odd AND ref_id % 50 = 23)) AND ref_id % 64 NOT IN (8, 9))"""


def _status(k: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("needs_review", "unresolved", "auto_confirmed", "manual_confirmed", "rejected")]), (k % 5 + 1).cast("int"))


def references(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("ref_id"), (k % 3).cast("int").alias("revision"), _status(k).alias("status"), F.when((k % 5).isin(2, 3), F.col("o_custkey")).alias("entity"))


def requests(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    odd = F.expr("o_orderkey div 8 % 3 = 0")
    action = F.when(odd & (k % 4 == 3), "explode").when(odd & (k % 4 == 2), "reopen").when((k % 5 < 2) & (k % 2 == 0), "manual_confirm").when(k % 5 < 2, "reject").when((k % 5 == 3) & (k % 2 == 0), "reassign").otherwise("reopen")
    entity = F.when(action.isin("manual_confirm", "reassign") & ~(odd & (k % 24 == 0)), F.when(k % 20 == 8, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1))
    return t.orders.select(
        (F.when(odd & (k % 64 == 9), k - 1).otherwise(k) * 7).alias("action_id"), k.alias("ref_id"), F.expr("o_orderkey div 8").alias("batch"), action.alias("action"), (k % 3 + (odd & (k % 22 == 0)).cast("int")).cast("int").alias("expected_revision"), _status(k).alias("expected_status"), entity.alias("entity"),
    )


def receipts(t: Tables) -> DataFrame:
    """Actions that were applied before: some with the same payload, some with another."""
    from tallyspark.operators.guarded import REQUEST

    asked, odd = requests(t), F.expr("ref_id div 8 % 3 = 0") & (F.col("ref_id") % 50 == 23)
    return asked.filter(((F.col("ref_id") % 10 == 7) | odd) & ~(F.col("ref_id") % 64).isin(8, 9)).select("action_id", F.when(odd, "another").otherwise(I.row_sha256(*REQUEST)).alias("payload"))


VIOL = """vi AS (SELECT q.*, r.status, r.entity AS old, r.revision, other IS NOT NULL AND NOT other AND count(*) OVER (PARTITION BY action_id) = 1 AS receipt, concat_ws(',', CASE WHEN other THEN 'action_reused' END, CASE WHEN count(*) OVER (PARTITION BY action_id) > 1 THEN 'repeated_action' END,
        CASE WHEN r.revision <> expected_revision THEN 'stale_revision' END, CASE WHEN action = 'explode' THEN 'unknown_action' END,
        CASE WHEN (action = 'manual_confirm' AND status NOT IN ('needs_review', 'unresolved', 'auto_confirmed')) OR (action = 'reassign' AND status NOT IN ('auto_confirmed', 'manual_confirmed')) OR (action = 'reject' AND status = 'rejected') OR (action = 'reopen' AND status NOT IN ('rejected', 'manual_confirmed', 'auto_confirmed')) THEN 'transition_not_allowed' END,
        CASE WHEN action IN ('manual_confirm', 'reassign') AND q.entity IS NULL THEN 'entity_required' END) AS violations FROM rr q JOIN rf r USING (ref_id) LEFT JOIN hi ON hid = action_id),
    ou AS (SELECT *, max(violations <> '' AND NOT receipt) OVER (PARTITION BY batch) AS refused, CASE action WHEN 'manual_confirm' THEN 'manual_confirmed' WHEN 'reassign' THEN 'manual_confirmed' WHEN 'reject' THEN 'rejected' WHEN 'reopen' THEN 'needs_review' END AS to_status,
        CASE WHEN action <> 'reopen' THEN coalesce(entity, old) END AS to_entity FROM vi)"""


@query(f"WITH {REFS}, {REQ}, {VIOL} SELECT ref_id, action_id, CASE WHEN receipt THEN 'receipt' ELSE violations END AS violations FROM vi")
def g4_review_violations(t: Tables) -> DataFrame:
    return G.review_violations(references(t), requests(t), receipts(t)).select("ref_id", "action_id", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {REFS}, {REQ}, {VIOL} SELECT ref_id, batch, CASE WHEN NOT receipt AND violations <> '' THEN 'refused' WHEN refused THEN 'refused_with_batch' WHEN receipt THEN 'receipt' WHEN status = to_status AND old IS NOT DISTINCT FROM to_entity THEN 'no_op' ELSE 'applied' END AS outcome FROM ou""")
def g4_review_outcomes(t: Tables) -> DataFrame:
    return G.review_outcomes(references(t), requests(t), receipts(t), "batch").select("ref_id", "batch", "outcome")


@query(f"""WITH {REFS}, {REQ}, {VIOL}, g AS (SELECT ref_id, to_status, to_entity FROM ou WHERE NOT refused AND NOT receipt)
    SELECT ref_id, coalesce(to_status, status) AS status, CASE WHEN to_status IS NULL THEN entity ELSE to_entity END AS entity, revision + (to_status IS NOT NULL AND NOT (status = to_status AND entity IS NOT DISTINCT FROM to_entity))::INT AS revision FROM rf LEFT JOIN g USING (ref_id)""")
def g4_apply_reviews(t: Tables) -> DataFrame:
    """Batches with one bad request change nothing, the others all that they ask for."""
    return G.apply_reviews(references(t), requests(t), receipts(t), "batch")[0].select("ref_id", "status", "entity", "revision")


@query(f"""WITH {REFS}, {REQ}, {VIOL}, g AS (SELECT ref_id, to_status, to_entity FROM ou WHERE NOT refused AND NOT receipt),
    n AS (SELECT ref_id, coalesce(to_status, status) AS status, CASE WHEN to_status IS NULL THEN entity ELSE to_entity END AS entity, revision AS before, revision + (to_status IS NOT NULL AND NOT (status = to_status AND entity IS NOT DISTINCT FROM to_entity))::INT AS revision FROM rf LEFT JOIN g USING (ref_id))
    SELECT ref_id, status, entity, revision, before AS revision_before FROM n WHERE NOT (revision > before AND status = 'rejected' AND ref_id % 4 = 1)""")
def g4_g9_reviewed_versions(t: Tables) -> DataFrame:
    """References in versions: published, reviewed (changed rows replace theirs), some then deleted; the last version beside the first."""
    spark = t.orders.sparkSession
    table = VersionedTable(spark, scratch(spark, "references"), "ref_id", 16)
    table.publish(references(t), 0)
    new = G.apply_reviews(table.read(), requests(t), receipts(t), "batch")[0]
    changed = new.join(table.read().select("ref_id", F.col("revision").alias("_was")), "ref_id").filter("revision > _was").drop("_was")
    changed = work_table(changed, "reviewed")  # read five times below
    table.upsert(changed, 1)
    table.delete(changed.filter("status = 'rejected' AND ref_id % 4 = 1").select("ref_id"), 2)
    return table.read().join(table.read(1).select("ref_id", F.col("revision").alias("revision_before")), "ref_id")


@query(f"""WITH {REFS}, q AS (SELECT ref_id + CASE WHEN ref_id % 40 = 0 THEN 100000000 ELSE 0 END AS ref_id, CASE WHEN ref_id % 7 = 0 THEN coalesce(entity, 1) ELSE 5 END AS entity, ref_id % 11 = 0 AS old FROM rf)
    SELECT q.ref_id, CASE WHEN rf.ref_id IS NULL THEN 'unknown' WHEN status = 'auto_confirmed' AND rf.entity = q.entity THEN 'no_op' WHEN status IN ('auto_confirmed', 'manual_confirmed') THEN 'protected' WHEN old THEN 'stale' ELSE 'applied' END AS outcome FROM q LEFT JOIN rf USING (ref_id)""")
def g5_apply_confirmations(t: Tables) -> DataFrame:
    r = references(t)
    k = F.col("ref_id")
    q = r.withColumn("h", I.row_sha256("ref_id", "status", "entity", "revision")).select((k + F.when(k % 40 == 0, 100_000_000).otherwise(0)).alias("ref_id"), F.when(k % 7 == 0, F.coalesce("entity", F.lit(1))).otherwise(5).alias("entity"), F.when(k % 11 == 0, "old").otherwise(F.col("h")).alias("state_hash"))
    return G.apply_confirmations(r, q).select("ref_id", "outcome")


@query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 31 = 0 THEN 'rejected' WHEN p_partkey % 4 = 0 THEN 'auto' ELSE 'manual' END AS w FROM part)
    SELECT k, CASE w WHEN 'rejected' THEN 'rejected' WHEN 'manual' THEN 'manual' ELSE CASE WHEN k % 8 = 0 THEN 'no_op' ELSE 'apply' END END AS disposition FROM r""")
def g6_build_plan(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    route = F.when(k % 31 == 0, "rejected_capture_mismatch").when(k % 4 == 0, "auto_jacket_gate").otherwise("manual_other")
    rows = t.part.select(k.alias("k"), k.alias("ref_id"), route.alias("route"), k.alias("matched"))
    refs = t.part.filter("p_partkey % 8 = 0").select(k.alias("ref_id"), F.lit("auto_confirmed").alias("status"), k.alias("entity"))
    return G.build_plan(rows, refs, "k").select("k", "disposition")


@query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 31 = 0 THEN 'rejected' WHEN p_partkey % 4 <> 0 THEN 'manual' WHEN p_partkey % 8 = 0 THEN 'no_op' ELSE 'apply' END AS d FROM part)
    SELECT k AS ref_id, CASE WHEN d IN ('apply', 'no_op') THEN 'auto_confirmed' ELSE 'needs_review' END AS status, CASE WHEN d IN ('apply', 'no_op') THEN k END AS entity, 1 + (d = 'apply')::INT AS revision, CASE d WHEN 'apply' THEN 'applied' ELSE d END AS outcome FROM r""")
def g6_apply_plan(t: Tables) -> DataFrame:
    """A plan over all parts applied to the references that it was made for, with each row's outcome."""
    k = F.col("p_partkey")
    route = F.when(k % 31 == 0, "rejected_capture_mismatch").when(k % 4 == 0, "auto_jacket_gate").otherwise("manual_other")
    done = (k % 8 == 0) & (k % 31 != 0)
    refs = t.part.select(k.alias("ref_id"), F.when(done, "auto_confirmed").otherwise("needs_review").alias("status"), F.when(done, k).alias("entity"), F.lit(1).alias("revision"))
    new, outcome = G.apply_plan(refs, G.build_plan(t.part.select(k.alias("k"), k.alias("ref_id"), route.alias("route"), k.alias("matched")), refs, "k"))
    return new.join(outcome.select("ref_id", "outcome"), "ref_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def g9_cascade_delete(t: Tables) -> DataFrame:
    doomed = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return G.cascade_delete(doomed, "l_orderkey", t.lineitem)[0].select(*KEYS)


@query("""WITH f AS (SELECT p_partkey AS feature_id, p_brand || p_partkey // 20 AS ident, p_size % 3 <> 0 AS accepted, CASE WHEN p_partkey % 10 = 0 THEN 'old' ELSE p_name END AS canonical, p_name AS expected FROM part),
    g AS (SELECT *, accepted AND canonical = expected AS may, row_number() OVER (PARTITION BY ident, accepted AND canonical = expected ORDER BY feature_id) AS rn, ident IN (SELECT p_brand || p_partkey // 20 FROM part WHERE p_partkey % 9 = 4) AS known FROM f)
    SELECT feature_id, CASE WHEN NOT accepted THEN 'not_accepted' WHEN canonical <> expected THEN 'canonical_drift' WHEN known OR rn > 1 THEN 'duplicate' ELSE 'inserted' END AS outcome FROM g""")
def g10_store_features(t: Tables) -> DataFrame:
    f = t.part.select(F.col("p_partkey").alias("feature_id"), F.expr("p_brand || p_partkey div 20").alias("ident"), (F.col("p_size") % 3 != 0).alias("accepted"), F.when(F.col("p_partkey") % 10 == 0, "old").otherwise(F.col("p_name")).alias("canonical"), F.col("p_name").alias("expected_canonical"))
    store = f.filter("feature_id % 9 = 4").select("ident")
    return G.store_features(store, f, ["ident"])[1].select("feature_id", "outcome")


@query("""WITH rf AS (SELECT o_orderkey AS cap, o_orderstatus AS payload, o_orderkey % 4 AS revision, o_custkey AS ident FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_orderkey AS cap, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS payload, o_custkey AS ident FROM orders)
    SELECT b.cap AS capture_id, CASE WHEN rf.payload IS NOT NULL AND rf.payload <> b.payload THEN 'payload_conflict' WHEN rf.payload IS NOT NULL AND revision > 0 THEN 'reviewed_conflict' WHEN rf.payload IS NOT NULL THEN 'existing' WHEN b.ident IN (SELECT ident FROM rf) THEN 'existing_identity' ELSE 'created' END AS outcome FROM b LEFT JOIN rf USING (cap)""")
def g11_ingest(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("capture_id"), F.col("o_orderstatus").alias("payload_hash"), (F.col("o_orderkey") % 4).alias("revision"), F.col("o_custkey").alias("identity_hash"))
    batch = o.withColumn("payload_hash", F.when(F.col("capture_id") % 9 == 0, "X").otherwise(F.col("payload_hash"))).drop("revision")
    return G.ingest(o.filter("capture_id % 3 = 0"), batch).select("capture_id", "outcome")


@query("SELECT o_orderkey, NULL::INT AS ok, NULL::DOUBLE AS calories FROM orders")
def g12_migrate(t: Tables) -> DataFrame:
    return G.migrate(t.orders.select("o_orderkey"), 1, 3)[0]


@query("""WITH d AS (SELECT DISTINCT sha256(sha256(html)) AS d FROM pages), s AS (SELECT sha256(sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(d, 16, 15))::BIGINT)::VARCHAR) AS h FROM d) SELECT 'master_version' AS key, 'm-' || substr(h, 1, 16) AS value FROM s UNION ALL SELECT 'charts_count', count(*)::VARCHAR FROM part UNION ALL SELECT 'songs_count', count(DISTINCT p_name)::VARCHAR FROM part""")
def g14_p16_stamp_master(t: Tables) -> DataFrame:
    return G.stamp_master({"charts": t.part, "songs": t.part.select("p_name").distinct()}, t.pages.select(F.sha2("html", 256).alias("content_hash")))


@query("""WITH d AS (SELECT p_partkey - (p_partkey % 11 = 0)::INT AS ref_id, CASE p_size % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'hold' ELSE 'maybe' END AS status, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey % 30 END AS entity FROM part)
    SELECT ref_id, status, entity, concat_ws(',', CASE WHEN ref_id % 17 = 3 OR ref_id < 0 THEN 'unknown_reference' END, CASE WHEN count(*) OVER (PARTITION BY ref_id) > 1 THEN 'repeated_reference' END, CASE WHEN status = 'maybe' THEN 'status_invalid' END, CASE WHEN status = 'confirmed' AND entity IS NULL THEN 'entity_required' END,
    CASE WHEN status = 'rejected' AND entity IS NOT NULL THEN 'entity_forbidden' END, CASE WHEN entity IS NOT NULL AND entity NOT BETWEEN 0 AND 24 THEN 'entity_unknown' END) AS violations FROM d""")
def g15_validate_drafts(t: Tables) -> DataFrame:
    s = F.col("p_size")
    d = t.part.select((F.col("p_partkey") - (F.col("p_partkey") % 11 == 0).cast("int")).alias("ref_id"), F.when(s % 4 == 0, "confirmed").when(s % 4 == 1, "rejected").when(s % 4 == 2, "hold").otherwise("maybe").alias("status"), F.when(s % 3 != 0, F.col("p_partkey") % 30).alias("entity"))
    refs = t.part.filter("p_partkey % 17 != 3").select(F.col("p_partkey").alias("ref_id"))
    return G.validate_drafts(d, refs, t.nation.select(F.col("n_nationkey").cast("long").alias("entity"))).select("ref_id", "status", "entity", F.array_join("violations", ",").alias("violations"))


@query("""WITH v AS (SELECT c_custkey AS obs, c_nationkey AS e FROM customer WHERE c_custkey % 3 = 0), x AS (SELECT o_custkey AS obs, count(DISTINCT o_orderstatus) AS n, min(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 200 ELSE 300 END) AS e FROM orders WHERE o_totalprice > 200000 GROUP BY 1)
    SELECT c_custkey AS obs, coalesce(v.e, CASE WHEN n = 1 THEN x.e END) AS entity, CASE WHEN v.e IS NOT NULL THEN 'vector' ELSE 'text' END AS source FROM customer LEFT JOIN v ON c_custkey = v.obs LEFT JOIN x ON c_custkey = x.obs WHERE coalesce(v.e, CASE WHEN n = 1 THEN x.e END) IS NOT NULL""")
def g16_select_confirmations(t: Tables) -> DataFrame:
    c = t.customer
    code = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 200).otherwise(300)
    text = t.orders.select(F.col("o_custkey").alias("obs"), code.alias("entity"), (F.col("o_totalprice") > 200000).alias("available"))
    return G.select_confirmations(c.select(F.col("c_custkey").alias("obs")), c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("obs"), F.col("c_nationkey").alias("entity")), text, "obs")


@query("""WITH d AS (SELECT p_partkey, p_size % 3 <> 0 AS a, p_size % 4 <> 0 AS b, p_size % 10 = 1 AS dup FROM part), r AS (SELECT *, concat_ws(',', CASE WHEN NOT a THEN 'title' END, CASE WHEN NOT b THEN 'score' END) AS blockers, CASE WHEN a AND b THEN 'ready' WHEN a OR b THEN 'partial' ELSE 'blocked' END AS readiness FROM d),
    s AS (SELECT *, CASE WHEN dup THEN 'skip_duplicate' WHEN readiness = 'ready' THEN 'save' ELSE 'hold' END AS decision FROM r)
    SELECT p_partkey, blockers, readiness, decision, CASE decision WHEN 'save' THEN 'saved' WHEN 'skip_duplicate' THEN 'skipped' ELSE CASE readiness WHEN 'partial' THEN 'low_confidence' ELSE 'error' END END AS planned_status FROM s""")
def g17_readiness(t: Tables) -> DataFrame:
    s = F.col("p_size")
    d = t.part.select("p_partkey", F.when(s % 3 != 0, "ready").otherwise("missing").alias("title_status"), F.when(s % 4 != 0, "ready").otherwise("missing").alias("score_status"), (s % 10 == 1).alias("duplicate"))
    return G.readiness(d, ["title", "score"]).select("p_partkey", "blockers", "readiness", "decision", "planned_status")


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id % 10 = 0 THEN 'keys_not_exact' END, CASE WHEN event_id % 7 = 0 THEN 'mode_invalid' END, CASE WHEN event_id % 7 <> 0 AND event_id % 3 = 0 THEN 'time_mode_needs_timestamp' END, CASE WHEN event_id % 5 = 0 THEN 'duplicate_must_be_skipped' END, CASE WHEN event_id % 11 = 0 THEN 'retention_expiry_mismatch' END) AS violations FROM events""")
def g18_validate_documents(t: Tables) -> DataFrame:
    k = F.col("event_id")
    event = F.struct(F.when(k % 7 == 0, "guess").otherwise("time").alias("confirmation_mode"), F.when(k % 3 != 0, k).alias("timestamp_ms"), (k % 5 == 0).alias("duplicate"), F.lit("saved").alias("status"))
    day = F.lit("2024-01-01").cast("date")
    retention = F.struct(F.lit("normal").alias("class"), day.alias("basis"), F.when(k % 11 == 0, day).otherwise(F.date_add(day, 7)).alias("expires"))
    parts = [event.alias("event"), F.struct(F.lit("open").alias("state")).alias("review"), F.array(F.struct(F.lit("roi").alias("kind"), F.lit("ok").alias("status"), F.lit("s").alias("summary"))).alias("material"), retention.alias("retention")]
    text = F.when(k % 10 == 0, F.to_json(F.struct(*parts, F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct(*parts)))
    return G.validate_documents(t.events.select("event_id", text.alias("doc")), "doc").select("event_id", F.array_join("violations", ",").alias("violations"))


# --- checks ----------------------------------------------------------------


@query("""SELECT c_custkey AS key, 'left_only' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 <> 0) UNION ALL SELECT DISTINCT o_custkey, 'right_only' FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def u3_same_keys(t: Tables) -> DataFrame:
    return G.same_keys(t.customer.select(F.col("c_custkey").alias("key")), t.orders.filter("o_custkey % 5 != 0").select(F.col("o_custkey").alias("key")), "key")


@query("""WITH c AS (SELECT p_partkey AS chart_id, p_partkey // 8 AS song_id, p_brand AS style, p_type AS difficulty FROM part)
    SELECT 'metadata_missing' AS code, 'source_url' AS detail UNION ALL SELECT 'songs_count_mismatch', '7/' || count(*) FROM part WHERE p_partkey % 25 <> 0 UNION ALL SELECT 'chart_without_song', chart_id::VARCHAR FROM c WHERE song_id % 25 = 0
    UNION ALL SELECT 'chart_repeated', song_id || '/' || style || '/' || difficulty FROM c GROUP BY song_id, style, difficulty HAVING count(*) > 1 UNION ALL SELECT 'snapshot_count', count(*)::VARCHAR FROM pages UNION ALL SELECT 'snapshot_hash_mismatch', page_id::VARCHAR FROM pages WHERE page_id % 20 = 0""")
def u5_check_master(t: Tables) -> DataFrame:
    songs = t.part.filter("p_partkey % 25 != 0").select(F.col("p_partkey").alias("song_id"))
    charts = t.part.select(F.col("p_partkey").alias("chart_id"), F.expr("p_partkey div 8").alias("song_id"), F.col("p_brand").alias("style"), F.col("p_type").alias("difficulty"))
    meta = t.part.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(F.struct(F.lit("charts_count").alias("key"), F.col("n").cast("string").alias("value")), F.struct(F.lit("songs_count").alias("key"), F.lit("7").alias("value")))))
    snaps = t.pages.select(F.col("page_id").alias("snapshot_id"), F.col("html").alias("html_content"), F.when(F.col("page_id") % 20 == 0, "x").otherwise(F.sha2("html", 256)).alias("content_hash"))
    return G.check_master(songs, charts, meta, snaps, ["charts_count", "songs_count", "source_url"])


@query("""WITH s AS (SELECT page_id AS song_id, CASE WHEN page_id % 50 = 1 THEN 'u0' ELSE 'u' || page_id END AS url FROM pages), i AS (SELECT 'u' || page_id AS url, page_id % 9 = 0 AS bad, page_id % 13 = 0 AS other FROM pages WHERE page_id % 7 <> 3),
    p AS (SELECT song_id, s.url, count(i.url) FILTER (NOT bad) AS n, count(*) FILTER (NOT bad AND NOT other) AS same FROM s LEFT JOIN i USING (url) GROUP BY ALL)
    SELECT 'count_mismatch' AS code, count(*)::VARCHAR AS detail FROM s UNION ALL SELECT 'image_not_unique', song_id::VARCHAR FROM p WHERE n <> 1 UNION ALL SELECT 'image_differs', song_id::VARCHAR FROM p WHERE n = 1 AND same = 0
    UNION ALL SELECT 'image_unreferenced', url FROM i WHERE url NOT IN (SELECT url FROM s) UNION ALL SELECT 'url_repeated', url FROM s GROUP BY url HAVING count(*) > 1""")
def s4_snapshot_violations(t: Tables) -> DataFrame:
    k = F.col("page_id")
    name = F.concat(F.lit("u"), k)
    songs = t.pages.select(k.alias("song_id"), F.when(k % 50 == 1, "u0").otherwise(name).alias("url"), F.lit("h").alias("sha256"), F.lit("p").alias("path"))
    images = t.pages.filter("page_id % 7 != 3").select(name.alias("url"), F.when(k % 13 == 0, "other").otherwise("h").alias("sha256"), F.lit("p").alias("path"), F.when(k % 9 == 0, "timeout").alias("error"))
    return S.snapshot_violations(songs, images, t.pages.select(F.lit(3).alias("song_count")))


# --- text, ids, vectors, html ---------------------------------------------------



@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{00a0}\x{2003}]+', ' ', 'g'))) AS clean, try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS INT) AS first_int, md5(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits,
    contains(text, 'SA') OR contains(text, 'Shock') AS marked, regexp_extract(source, 'src([0-9]+)', 1) AS number, CASE WHEN contains(lower(text), 'remix') THEN 'Remix' WHEN contains(lower(text), 'the') THEN 'the' END AS suffix FROM documents""")
def p1_p6_p7_p9_p19_text(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.md5(X.norm_ws(x)).alias("clean"), X.first_int(x).alias("first_int"), F.md5(X.digits(x)).alias("digits"), X.contains_any(x, ("SA", "Shock")).alias("marked"), *X.extract_fields(F.col("source"), r"src(\d+)", ["number"]), X.suffix_token(x, ("Remix", "the")).alias("suffix"))


@query()
def p2_p4_keys(t: Tables) -> DataFrame:
    """Unicode folding has no SQL form: tested against unicodedata."""
    x = F.col("text")
    return t.documents.select("doc_id", F.md5(X.match_key(x)).alias("strict"), F.md5(X.alias_key(x)).alias("loose"), F.md5(X.title_key(x)).alias("title"))


@query("""SELECT p_partkey, CASE lower(p_type) WHEN 'standard' THEN 'SP' WHEN 'small' THEN 'DP' ELSE upper(p_type) END AS style, CASE WHEN starts_with(lower(p_brand), 'brand#') THEN CASE substr(p_brand, 7) WHEN '1' THEN 'one' ELSE substr(p_brand, 7) END ELSE p_brand END AS version FROM part""")
def p5_p14_maps(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.map_values(X.compatible("p_type"), {"standard": "SP", "small": "DP"}).alias("style"), X.version_label(F.col("p_brand"), ("brand#",), {"1": "one"}).alias("version"))


@query("""SELECT p_partkey, 'song_' || substr(sha1(p_name || chr(0) || p_brand), 1, 16) AS stable, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || '}') AS row_hash, CASE WHEN p_size % 3 <> 0 THEN sha256(p_name || chr(31) || p_brand || chr(31) || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END) END AS event,
    CASE WHEN p_size % 5 <> 0 THEN sha256('v1' || chr(0) || sha256(p_name) || chr(0) || sha256(p_brand)) END AS composite FROM part""")
def p15_p18_ids(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", I.stable_id("song", F.col("p_name"), F.col("p_brand")).alias("stable"), I.row_sha256("p_partkey", "p_brand").alias("row_hash"), I.event_key(F.col("p_name"), F.col("p_brand"), F.when(s % 2 == 0, F.col("p_type")), required=(F.when(s % 3 != 0, F.col("p_name")),)).alias("event"),
        I.composite_hash((F.lit("v1"),), (F.sha2("p_name", 256), F.when(s % 5 == 0, "short").otherwise(F.sha2("p_brand", 256)))).alias("composite"))


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'missing' WHEN p_size % 3 = 0 THEN 'unscored' ELSE 'ready' END AS a, CASE WHEN p_size % 5 = 0 THEN 'missing' ELSE 'ready' END AS b FROM part) SELECT p_partkey, a AS title_status, b AS level_status, a = 'ready' AND b = 'ready' AS ready, concat_ws(',', CASE WHEN a <> 'ready' THEN 'title:' || a END, CASE WHEN b <> 'ready' THEN 'level:' || b END) AS blockers FROM f""")
def p26_field_status(t: Tables) -> DataFrame:
    s = F.col("p_size")
    fields = {"title": (F.when(s % 4 == 0, "").otherwise(F.col("p_name")), F.when(s % 3 != 0, 0.9)), "level": (F.when(s % 5 != 0, s), F.lit(1.0))}
    return t.part.select("p_partkey", *I.field_status(fields))


@query("""WITH g AS (SELECT vec_id, embedding AS e, list_transform(range(1, 57), lambda k: (e[((k - 1) // 7) * 8 + (k - 1) % 7 + 2] > e[((k - 1) // 7) * 8 + (k - 1) % 7 + 1])::INT) AS bits FROM embeddings)
    SELECT vec_id, array_to_string(bits, '') AS bits, array_to_string(list_transform(range(0, 14), lambda n: lower(printf('%x', bits[n * 4 + 1] * 8 + bits[n * 4 + 2] * 4 + bits[n * 4 + 3] * 2 + bits[n * 4 + 4]))), '') AS hex,
    list_sum(list_transform(e, lambda v: least(255, greatest(0, round_even(v::DOUBLE * 255, 0)::INT))))::BIGINT AS packed FROM g""")
def v1_v8_hashes(t: Tables) -> DataFrame:
    bits = V.dhash_bits(F.col("embedding"), 7, 8)
    return t.embeddings.select("vec_id", F.array_join(bits.cast("array<string>"), "").alias("bits"), V.bits_to_hex(bits).alias("hex"), F.aggregate(V.pack_u8(F.col("embedding")), F.lit(0).cast("long"), lambda a, v: a + v).alias("packed"))


@query("""WITH h AS (SELECT vec_id, unnest(range(0, 4)) AS b, embedding AS e FROM embeddings) SELECT vec_id, b, round(len(list_filter(e, lambda v: v >= -1 AND v <= 1 AND least(3, floor((v::DOUBLE + 1) / 0.5)::INT) = b)) / greatest(1, len(list_filter(e, lambda v: v >= -1 AND v <= 1))), 6) AS share FROM h""")
def v3_histogram(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(V.histogram(F.transform("embedding", lambda v: v.cast("double")), 4, -1.0, 1.0)).alias("b", "share")).withColumn("share", F.round("share", 6))


@query("""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, list_transform(x, lambda v: (v > 0)::INT) AS p, list_transform(y, lambda v: (v > 0)::INT) AS q FROM p)
    SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda z: (z[1] <> z[2])::INT)) / len(p), 6) AS bits_apart, round(list_sum(list_transform(list_zip(p, q, range(0, 64)), lambda z: CASE WHEN z[1] <> z[2] THEN CASE WHEN z[3] % 2 = 0 THEN 5.0 ELSE 1.0 END ELSE 0.0 END)) / 192.0, 6) AS masked FROM s""")
def v5_v7_distances(t: Tables) -> DataFrame:
    e = t.embeddings
    a, b = e.select("vec_id", F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    bits = lambda c: F.transform(c, lambda v: (v > 0).cast("int"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k % 2 == 0).cast("int"))
    d = a.join(b, "vec_id").select("vec_id", bits("x").alias("p"), bits("y").alias("q"))
    return d.select("vec_id", F.round(V.hamming(F.col("p"), F.col("q")), 6).alias("bits_apart"), F.round(V.masked_hamming(F.col("p"), F.col("q"), mask), 6).alias("masked"))


@query("""WITH p AS (SELECT page_id AS page, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)
    SELECT page, unnest(range(0, len(h))) AS position, unnest(t) AS text, origin || unnest(h) AS link, true AS same_origin, NULL::VARCHAR AS error FROM p""")
def s5_html_rows(t: Tables) -> DataFrame:
    """Links of all pages; those of these tables are plain enough for a pattern in SQL."""
    return H.extract_html_rows(t.pages, "page_id", "url", "html", "a", "href")


@query("""WITH r AS (SELECT page_id AS page, unnest(range(0, 3)) AS row_no FROM pages) SELECT page, 0 AS table_no, row_no, CASE row_no WHEN 0 THEN 'page|n|' WHEN 1 THEN 'p' || page || '|1|x' ELSE 'p' || page || '|2|2' END AS cells FROM r""")
def s6_expand_tables(t: Tables) -> DataFrame:
    """A table put behind each page, whose own markup has none: spans both ways, a short row and a note anchor."""
    made = F.concat(F.lit("<table><tr><th>page</th><th>n</th></tr><tr><td rowspan=2>p"), "page_id", F.lit("<a>*1</a></td><td>1</td><td> x </td></tr><tr><td colspan=2>2</td></tr></table>"))
    rows = H.expand_tables(t.pages.withColumn("html", F.concat("html", made)), "page_id", "html")
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query("""WITH c AS (SELECT page_id AS page, 2 AS row_no, 'first' AS section, 'a' || page_id AS title, 'easy' AS difficulty, page_id % 7 AS level FROM pages
    UNION ALL SELECT page_id, 3, 'first', 'b' || page_id, 'hard', 12 FROM pages UNION ALL SELECT page_id, 5, 'page ' || page_id, 'c' || page_id, 'hard', page_id % 5 FROM pages WHERE page_id % 5 > 0)
    SELECT page, 0 AS table_no, row_no, section, title, 'single' AS style, difficulty, CASE WHEN row_no = 3 THEN 'LV12' ELSE level::VARCHAR END AS raw_level, level FROM c""")
def s7_w8_sectioned_table(t: Tables) -> DataFrame:
    """Two sections a page; rows take the last section above them."""
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    k, none = F.col("page_id"), F.lit("-")
    named = lambda letter: F.concat(F.lit(letter), k)
    section = lambda name: F.concat(F.lit("<tr><td colspan=3>"), name, F.lit("</td></tr>"))
    last = F.when(k % 5 > 0, (k % 5).cast("string")).otherwise("-")
    made = F.concat(F.lit("<table><tr><th>title</th><th>easy</th><th>hard</th></tr>"), section(F.lit("first")), row(named("a"), k % 7, none), row(named("b"), none, F.lit("LV12")), section(F.concat(F.lit("page "), k)), row(named("c"), none, last), F.lit("</table>"))
    cells = H.expand_tables(t.pages.withColumn("html", made), "page_id", "html")
    return H.parse_sectioned_table(cells, ["title", "easy", "hard"], ["title", "easy", "hard"], {"easy": ("single", "easy"), "hard": ("single", "hard")})


@query("SELECT page_id AS page, 'page ' || page_id AS key, page_id % 2 = 0 OR page_id % 3 = 0 AS flag, 'Page ' || page_id AS title, 'second' AS artist FROM pages")
def s8_flag_table(t: Tables) -> DataFrame:
    """Two rows of one title a page, each of which may have the mark."""
    row = lambda artist, on, mark: F.concat(F.lit("<tr><td>Page "), "page_id", F.lit(f"</td><td>{artist}</td><td>"), F.when(on, mark).otherwise("-"), F.lit("</td></tr>"))
    made = F.concat(F.lit("<table><tr><th>name</th><th>by</th><th>gp</th></tr>"), row("first", F.col("page_id") % 2 == 0, "○"), row("second", F.col("page_id") % 3 == 0, "〇"), F.lit("</table>"))
    return H.parse_flag_table(H.expand_tables(t.pages.withColumn("html", made), "page_id", "html"), "name", "by", "gp")


# --- masters of twenty parts each, with a manifest of supplements and declared sources --------

U5 = """u AS (SELECT p_partkey AS k, p_partkey // 20 AS master, p_name, p_brand, p_size, p_partkey % 4 = 0 AS given, p_partkey // 20 % 11 = 3 AS broken FROM part),
    m AS (SELECT master, count(*) FILTER (given) AS n, any_value(broken) AS broken FROM u GROUP BY master)"""


def supplements(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(manifests, charts): every fourth part is a supplement; by turns keys, values, notes, hashes and counts are off."""
    k = F.col("p_partkey")
    p = t.part.withColumns({"master": F.expr("p_partkey div 20"), "k": k})
    charts = p.select(
        "master", F.concat(F.lit("c"), k).alias("chart_id"), F.concat(F.lit("s"), k).alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("play_style"), F.when(k % 28 == 0, "EXPERT").otherwise("CHALLENGE").alias("difficulty"), F.col("p_size").alias("level"),
        F.concat(F.lit("x confirmed CHALLENGE supplement; source_url=u"), k, F.lit("; acquired_on="), F.when(k % 36 == 0, "never").otherwise("d")).alias("notes"),
    )
    fields = {"acquired_on": F.lit("d"), "chart_id": F.concat(F.lit("c"), k), "level": F.col("p_size"), "play_style": F.col("p_brand"), "song_id": F.concat(F.lit("s"), k), "source_url": F.concat(F.lit("u"), k), "title": F.when(k % 44 == 0, "other").otherwise(F.col("p_name"))}
    row = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    less = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items() if n != "title"]))
    given = p.filter(k % 4 == 0).select("master", F.when(k % 52 == 0, less).otherwise(row).alias("item"), F.when(k % 60 == 0, 2).otherwise(1).alias("times"))
    listed = given.select("master", F.explode(F.array_repeat("item", F.col("times"))).alias("item")).groupBy("master").agg(F.array_sort(F.collect_list("item")).alias("items"))  # twenty parts
    text = F.when(F.col("master") % 11 == 3, "{not json").otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    out = listed.withColumn("json", text).select("master", "json", F.when(F.col("master") % 13 == 5, "x").otherwise(F.sha2("json", 256)).alias("hash"), (F.size("items") + F.when(F.col("master") % 17 == 2, 1).otherwise(0)).alias("declared"))
    return out, charts


@query(f"""WITH {U5}, g AS (SELECT *, 'c' || k AS chart FROM u WHERE given AND NOT broken), c AS (SELECT master, sum(CASE WHEN k % 60 = 0 THEN 2 ELSE 1 END) AS n FROM u WHERE given GROUP BY master),
    i AS (SELECT master, k, row_number() OVER (PARTITION BY master ORDER BY item, copy) - 1 AS place FROM (SELECT master, k, unnest(range(0, CASE WHEN k % 60 = 0 THEN 2 ELSE 1 END)) AS copy,
        '{{"acquired_on":"d","chart_id":"c' || k || '","level":' || p_size AS item FROM g))
    SELECT master, 'supplement_hash_mismatch' AS code, '' AS detail FROM c WHERE master % 13 = 5 UNION ALL SELECT master, 'supplement_invalid_json', '' FROM c WHERE master % 11 = 3 UNION ALL SELECT master, 'supplement_count_mismatch', '' FROM c WHERE master % 17 = 2 AND master % 11 <> 3
    UNION ALL SELECT master, 'supplement_row_keys', place::VARCHAR FROM i WHERE k % 52 = 0 UNION ALL SELECT master, 'supplement_repeated', chart FROM g WHERE k % 60 = 0 AND k % 52 <> 0
    UNION ALL SELECT master, CASE WHEN k % 28 = 0 OR k % 44 = 0 THEN 'supplement_not_in_charts' ELSE 'supplement_note_mismatch' END, chart FROM g WHERE k % 52 <> 0 AND k % 60 <> 0 AND (k % 28 = 0 OR k % 44 = 0 OR k % 36 = 0)""")
def u5_supplement_manifests(t: Tables) -> DataFrame:
    return G.check_manifests(*supplements(t))


@query("""WITH m AS (SELECT page_id AS master, 'a' || page_id AS au, CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE 'h' || page_id END AS ah, CASE WHEN page_id % 3 = 0 THEN 'b' || page_id END AS bu, CASE WHEN page_id % 3 = 0 AND page_id % 5 <> 0 THEN 'h' || page_id END AS bh, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'c' || page_id END AS cu, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'h' || page_id END AS ch FROM pages),
    s AS (SELECT page_id AS master, p || page_id AS url, 'h' || page_id AS h FROM pages, (SELECT unnest(['a', 'b', 'c']) AS p) WHERE (p <> 'b' OR page_id % 3 = 0) AND (p <> 'c' OR page_id % 13 <> 0)),
    e AS (SELECT master, 'source' AS name, true AS must, au AS url, ah AS hash FROM m UNION ALL SELECT master, 'official_source', false, bu, bh FROM m UNION ALL SELECT master, 'new_song_source', false, cu, ch FROM m),
    j AS (SELECT e.*, s.h, coalesce(e.url, '') <> '' AS u, coalesce(hash, '') <> '' AS k FROM e LEFT JOIN s ON s.master = e.master AND s.url = e.url),
    w AS (SELECT master, count(*) FILTER (must OR u) AS want FROM j GROUP BY master), n AS (SELECT master, count(*) AS have FROM s GROUP BY master)
    SELECT master, name || CASE WHEN u <> k THEN '_incomplete' WHEN h IS NULL THEN '_url_unknown' ELSE '_hash_mismatch' END AS code, coalesce(url, '') AS detail FROM j WHERE u <> k OR (u AND h IS NULL) OR (u AND h <> hash)
    UNION ALL SELECT master, 'snapshot_count_mismatch', have || '/' || want FROM w JOIN n USING (master) WHERE have <> want""")
def u5_declared_sources(t: Tables) -> DataFrame:
    """A master for each page, with one to three declared sources and the snapshots that it holds."""
    k = F.col("page_id")
    mark = lambda p: F.concat(F.lit(p), k)
    masters = t.pages.select(
        k.alias("master"), mark("a").alias("source_url"), F.when(k % 7 == 0, "bad").otherwise(mark("h")).alias("source_hash"), F.when(k % 3 == 0, mark("b")).alias("official_source_url"), F.when((k % 3 == 0) & (k % 5 != 0), mark("h")).alias("official_source_hash"),
        F.when(k % 11 == 0, "").otherwise(mark("c")).alias("new_song_source_url"), F.when(k % 11 == 0, "").otherwise(mark("h")).alias("new_song_source_hash"),
    )
    urls = F.array_compact(F.array(mark("a"), F.when(k % 3 == 0, mark("b")), F.when(k % 13 != 0, mark("c"))))
    snapshots = t.pages.select(k.alias("master"), F.explode(urls).alias("url"), mark("h").alias("content_hash"))
    return G.check_sources(masters, snapshots, "source", ["official_source", "new_song_source"])
