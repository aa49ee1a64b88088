"""Guarded table writes: validate first, then publish one new version of a table (see ``sources.versions``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.ids import reasons, row_sha256
from tallyspark.operators.evaluate import order_free_hash, table_fingerprint
from tallyspark.sources.versions import Stale, VersionedTable

__all__ = ["Stale", "VersionedTable"]

# Names of grades, clears and counts.
GRADES = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "E")
CLEARS = ("MFC", "PFC", "GFC", "FULL COMBO", "CLEAR", "FAILED")
COUNTS = ("max_combo", "marvelous", "perfect", "great", "good", "miss", "ex_score")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def play_errors() -> Column:
    """Codes of all rules that a play record breaks, in order."""
    text = [(_blank(c), f"play.{c}_required") for c in ("play_id", "song_id", "chart_id", "rank", "clear_type", "capture_hash", "duplicate_key")]
    aware = F.coalesce(F.col("played_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp("played_at").isNotNull(), F.lit(False))
    rules = [
        *text, (~aware, "play.played_at_not_aware"), (~F.coalesce(F.col("rank").isin(*GRADES), F.lit(False)), "play.rank_invalid"), (~F.coalesce(F.col("clear_type").isin(*CLEARS), F.lit(False)), "play.clear_type_invalid"),
        (~F.coalesce(F.col("score").between(0, 1_000_000), F.lit(False)), "play.score_out_of_range"), (F.col("score").between(0, 1_000_000) & (F.col("score") % 10 != 0), "play.score_not_multiple_of_10"),
        *[(F.coalesce(F.col(c) < 0, F.lit(True)), f"play.{c}_negative") for c in COUNTS],
        (F.col("ok") < 0, "play.ok_negative"), ((F.col("calories") < 0) | F.isnan("calories"), "play.calories_invalid"),
        (~F.coalesce(F.col("analysis_confidence").between(0, 1), F.lit(False)), "play.confidence_invalid"), (F.col("duplicate_key").rlike("^(score|file):"), "play.duplicate_key_uses_preview_format"),
    ]
    return reasons(*rules)


def link_errors() -> Column:
    """Rules across analysis, capture and play columns of one wide record (analysis_*, capture_*, has_play)."""
    saved = F.col("analysis_status") == "saved"
    play = F.coalesce(F.col("has_play"), F.lit(False))
    return reasons(
        (~play & saved, "saved_analysis_requires_play"), (~play & _blank("skip_reason"), "non_saved_analysis_requires_skip_reason"), (play & ~saved, "play_requires_saved_analysis"), (play & ~_blank("skip_reason"), "saved_analysis_skip_reason_must_be_empty"),
        (play & ~F.col("confirmed_result"), "play_requires_confirmed_result"), (play & F.col("duplicate"), "play_must_not_be_duplicate"), (play & (F.col("play_capture_hash") != F.col("capture_hash")), "play.capture_hash_mismatch"),
        (F.col("duplicate") & (F.col("analysis_status") != "skipped"), "duplicate_requires_skipped_analysis"),
    )


def validate(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): invalid rows keep their ``errors``."""
    marked = df.withColumn("errors", errors)
    return marked.filter("size(errors) = 0").drop("errors"), marked.filter("size(errors) > 0")


def insert_once(saved: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, outcome of every batch row): the first row of a key that isn't saved yet is inserted, all others are duplicates."""
    first = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    known = saved.select(key).distinct().withColumn("_known", F.lit(True))
    marked = first.join(known, key, "left").withColumn("outcome", F.when(F.col("_known").isNull() & (F.col("_rn") == 1), "inserted").otherwise("duplicate"))
    return marked.filter("outcome = 'inserted'").select(*batch.columns), marked.select(*batch.columns, "outcome")


#: What the log says of a play that was saved before.
DUPLICATE_STATUS, DUPLICATE_BOUNDARY = "skipped", "duplicate"


def save_records(saved: DataFrame, records: DataFrame, order: list[Column], skip_reason: str, play_columns: list[str], capture_columns: list[str], log_columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plays to insert, captures, log rows) of wide records, each of which may have a play (has_play, duplicate_key).

    A play whose key is saved already, or comes later in the batch, isn't inserted: its log
    row loses play_id and becomes skipped, duplicate, with ``skip_reason``.  Captures and
    log rows are always written.
    """
    place = F.row_number().over(Window.partitionBy("has_play", "duplicate_key").orderBy(*order))
    known = saved.select("duplicate_key").distinct().withColumn("_saved", F.lit(True))
    marked = records.withColumn("_place", place).join(known, "duplicate_key", "left")
    again = F.col("has_play") & (F.coalesce("_saved", F.lit(False)) | (F.col("_place") > 1))
    marked = marked.withColumn("_again", again)
    plays = marked.filter("has_play AND NOT _again").select(*play_columns)
    changed = {
        "play_id": F.when(~F.col("_again"), F.col("play_id")), "analysis_status": F.when(F.col("_again"), DUPLICATE_STATUS).otherwise(F.col("analysis_status")),
        "save_boundary_status": F.when(F.col("_again"), DUPLICATE_BOUNDARY).otherwise(F.col("save_boundary_status")),
        "skip_reason": F.when(F.col("_again"), skip_reason).otherwise(F.col("skip_reason")), "duplicate": F.col("duplicate") | F.col("_again"),
    }
    return plays, marked.select(*capture_columns), marked.withColumns(changed).select(*log_columns)


def adapt(df: DataFrame, required: list[str]) -> DataFrame:
    """Adds adaptation (excluded, unresolved, ready), and why: an exclusion, duplicate, or the fields that are missing."""
    missing = reasons(*[(_blank(c), c) for c in required])
    out = df.withColumn("_missing", missing)
    excluded = ~_blank("exclusion") | F.coalesce(F.col("duplicate"), F.lit(False))
    why = F.when(~_blank("exclusion"), F.col("exclusion")).when(F.coalesce(F.col("duplicate"), F.lit(False)), "duplicate").otherwise(F.array_join("_missing", ","))
    return out.withColumns({"adaptation": F.when(excluded, "excluded").when(F.size("_missing") > 0, "unresolved").otherwise("ready"), "adaptation_reason": why}).drop("_missing")


def promote(df: DataFrame, spec: dict[str, str], least: float = 0.98) -> DataFrame:
    """Adds promoted and promotion_reasons; spec: field -> the source it must come from.  Columns <f>, <f>_source, <f>_confidence."""
    rules = []
    for field, source in spec.items():
        conf = F.col(f"{field}_confidence").cast("double")
        rules += [(_blank(field), f"{field}_missing"), (~F.coalesce(F.col(f"{field}_source") == source, F.lit(False)), f"{field}_source"), (~F.coalesce(~F.isnan(conf) & conf.between(least, 1.0), F.lit(False)), f"{field}_confidence")]
    return df.withColumn("promotion_reasons", reasons(*rules)).withColumn("promoted", F.size("promotion_reasons") == 0)


def promote_final(df: DataFrame, spec: dict[str, str], optional: dict[str, str], failed: Column, unless_failed: str, least: float = 0.98, checks: tuple[tuple[Column, str], ...] = ()) -> DataFrame:
    """promote(), but failed results need no ``unless_failed`` field, an optional metric with weak evidence becomes null,
    and row_confidence is the least confidence of the fields in use.  ``checks`` are further
    rules (what must not hold, its code), such as values outside a range or an enum."""
    needed = {f: s for f, s in spec.items() if f != unless_failed}
    out = promote(df, needed, least)
    conf = F.col(f"{unless_failed}_confidence").cast("double")
    extra = reasons((~failed & _blank(unless_failed), f"{unless_failed}_missing"), (~failed & ~F.coalesce(F.col(f"{unless_failed}_source") == spec[unless_failed], F.lit(False)), f"{unless_failed}_source"), (~failed & ~F.coalesce(conf.between(least, 1.0), F.lit(False)), f"{unless_failed}_confidence"))
    out = out.withColumn("promotion_reasons", F.concat("promotion_reasons", extra, reasons(*checks) if checks else F.array().cast("array<string>"))).withColumn("promoted", F.size("promotion_reasons") == 0)
    strong = {f: F.coalesce((F.col(f"{f}_source") == s) & F.col(f"{f}_confidence").between(least, 1.0), F.lit(False)) for f, s in optional.items()}
    out = out.withColumns({f: F.when(ok, F.col(f)) for f, ok in strong.items()})
    used = [F.col(f"{f}_confidence").cast("double") for f in needed] + [F.when(~failed, conf)] + [F.when(ok, F.col(f"{f}_confidence").cast("double")) for f, ok in strong.items()]
    return out.withColumn("row_confidence", F.when(F.col("promoted"), F.array_min(F.array_compact(F.array(*used)))))


# What a review does, and from which states it may.
ACTIONS = {"manual_confirm": "manual_confirmed", "reassign": "manual_confirmed", "reject": "rejected", "reopen": "needs_review"}
ALLOWED = {"manual_confirm": ("needs_review", "unresolved", "auto_confirmed"), "reassign": ("auto_confirmed", "manual_confirmed"), "reject": ("needs_review", "unresolved", "auto_confirmed", "manual_confirmed"), "reopen": ("rejected", "manual_confirmed", "auto_confirmed")}
#: What a request asks for: the same action id with another of it is another request.
REQUEST = ("ref_id", "action", "expected_revision", "expected_status", "entity")


def review_violations(refs: DataFrame, requests: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Requests (action_id, ref_id, action, expected_revision, expected_status, entity) with ``payload``, a hash of what they ask, and their violation codes; the good ones have none.

    An action id of ``history`` (action_id, payload) with the same payload has the only code
    ``receipt``: it was applied before and counts as done.  With another payload it is
    ``action_reused``.  One action id, or one reference, twice in the requests is a
    violation of both (``repeated_action``, ``conflicting_requests``).
    """
    known = refs.select("ref_id", F.col("revision").alias("_rev"), F.col("status").alias("_status"), F.lit(True).alias("_there"))
    out = requests.withColumn("payload", row_sha256(*REQUEST)).join(known, "ref_id", "left")
    if history is not None:
        out = out.join(history.groupBy("action_id").agg(F.min("payload").alias("_done")), "action_id", "left")
    else:
        out = out.withColumn("_done", F.lit(None).cast("string"))
    same = F.coalesce(F.col("_done") == F.col("payload"), F.lit(False))
    again = F.count(F.lit(1)).over(Window.partitionBy("action_id")) > 1
    twice = F.count(F.lit(1)).over(Window.partitionBy("ref_id")) > 1
    allowed = F.lit(False)
    for action, states in ALLOWED.items():
        allowed = allowed | ((F.col("action") == action) & F.col("_status").isin(*states))
    codes = reasons(
        (F.col("_done").isNotNull() & ~same, "action_reused"), (again, "repeated_action"), (F.col("_there").isNull(), "unknown_reference"), (F.col("_there") & (F.col("_rev") != F.col("expected_revision")), "stale_revision"), (F.col("_there") & (F.col("_status") != F.col("expected_status")), "stale_status"),
        (~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown_action"), (F.col("_there") & F.col("action").isin(*ACTIONS) & ~allowed, "transition_not_allowed"),
        (F.col("action").isin("manual_confirm", "reassign") & F.col("entity").isNull(), "entity_required"), (F.col("action").isin("reject", "reopen") & F.col("entity").isNotNull(), "entity_forbidden"), (twice, "conflicting_requests"),
    )
    return out.withColumn("violations", F.when(same & ~again & ~twice, F.array(F.lit("receipt"))).otherwise(codes)).drop("_rev", "_status", "_there", "_done")


def _accepted(judged: DataFrame, batch: str | None) -> DataFrame:
    """``judged`` with ``refused``: a request of the batch, this or another, has violations."""
    bad = F.max((F.size("violations") > 0) & (F.col("violations") != F.array(F.lit("receipt"))))
    if batch:
        return judged.join(judged.groupBy(F.col(batch).alias("_batch")).agg(bad.alias("refused")), F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    return judged.join(F.broadcast(judged.agg(F.coalesce(bad, F.lit(False)).alias("refused"))))


def review_outcomes(refs: DataFrame, requests: DataFrame, history: DataFrame | None = None, batch: str | None = None) -> DataFrame:
    """Each request with ``outcome``: applied, no_op (nothing would change), receipt, refused (with its violations), or refused_with_batch because of another."""
    judged = _accepted(review_violations(refs, requests, history), batch).join(refs.select("ref_id", F.col("status").alias("_was"), F.col("entity").alias("_had")), "ref_id", "left")
    bad = (F.size("violations") > 0) & (F.col("violations") != F.array(F.lit("receipt")))
    to, entity = _after("action", "entity", "_had")
    outcome = F.when(bad, "refused").when(F.col("refused"), "refused_with_batch").when(F.size("violations") > 0, "receipt").when((F.col("_was") == to) & F.col("_had").eqNullSafe(entity), "no_op").otherwise("applied")
    return judged.withColumn("outcome", outcome).drop("_was", "_had", "refused")


def _after(action: str, asked: str, had: str) -> tuple[Column, Column]:
    """Status and entity that a request leads to."""
    to = F.element_at(F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p]), F.col(action))
    return to, F.when(F.col(action) == "reopen", F.lit(None)).otherwise(F.coalesce(asked, had))


def apply_reviews(refs: DataFrame, requests: DataFrame, history: DataFrame | None = None, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new references, new history rows): a batch is applied as a whole or not at all.

    Any violation but a receipt refuses all requests of its batch.  Without ``batch``, the
    column that names it, all requests are one, and a refusal is an error at run time; with
    it refused batches change nothing (see ``review_outcomes``).  Requests that change
    nothing leave no history.
    """
    judged = _accepted(review_violations(refs, requests, history), batch)
    good = judged.filter("size(violations) = 0").select("ref_id", "action_id", "action", "payload", F.col("entity").alias("_entity"), "refused")
    if batch:
        good = good.filter("NOT refused")
        joined = refs.join(good, "ref_id", "left")
    else:
        stop = judged.agg(F.coalesce(F.max("refused"), F.lit(False)).alias("_stop"))
        refusal = F.raise_error(F.lit("the batch has requests that are refused")).cast("boolean")
        joined = refs.join(good.drop("refused"), "ref_id", "left").join(F.broadcast(stop)).filter(F.when(F.col("_stop"), refusal).otherwise(True)).drop("_stop")
    to, entity = _after("action", "_entity", "entity")
    touched = F.col("action").isNotNull()
    entity = F.when(touched, entity).otherwise(F.col("entity"))
    same = touched & (F.col("status") == to) & F.col("entity").eqNullSafe(entity)
    changed = touched & ~same
    new = joined.select(*[c for c in refs.columns if c not in ("status", "entity", "revision")], F.when(touched, to).otherwise(F.col("status")).alias("status"), entity.alias("entity"), (F.col("revision") + changed.cast("int")).alias("revision"))
    log = joined.filter(changed).select("action_id", "payload", "ref_id", "action", F.col("status").alias("before_status"), to.alias("after_status"), F.col("entity").alias("before_entity"), entity.alias("after_entity"), (F.col("revision") + 1).alias("revision"))
    return new.select(*refs.columns), log


def apply_confirmations(refs: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per request (ref_id, entity, state_hash): applied, no_op, stale, protected (confirmed by hand) or unknown."""
    state = refs.withColumn("_hash", row_sha256("ref_id", "status", "entity", "revision")).select("ref_id", F.col("status").alias("_status"), F.col("entity").alias("_entity"), "_hash")
    out = requests.join(state, "ref_id", "left")
    outcome = F.when(F.col("_hash").isNull(), "unknown").when((F.col("_status") == "auto_confirmed") & (F.col("_entity") == F.col("entity")), "no_op").when(F.col("_status").isin("auto_confirmed", "manual_confirmed"), "protected").when(F.col("_hash") != F.col("state_hash"), "stale").otherwise("applied")
    return out.select(*requests.columns, outcome.alias("outcome"))


def build_plan(rows: DataFrame, refs: DataFrame, truth: str) -> DataFrame:
    """Routed rows with disposition apply, no_op, manual or rejected; refused (an error at run time) if any automatic decision is false."""
    auto = F.startswith("route", F.lit("auto_"))
    false = rows.agg(F.coalesce(F.max((auto & (F.col("matched") != F.col(truth))).cast("int")), F.lit(0)).alias("_false"))
    known = refs.select("ref_id", F.col("status").alias("_status"), F.col("entity").alias("_entity"))
    disposition = F.when(~auto & F.startswith("route", F.lit("rejected")), "rejected").when(~auto, "manual").when(F.col("_status").isin("auto_confirmed", "manual_confirmed") & (F.col("_entity") == F.col("matched")), "no_op").otherwise("apply")
    out = rows.join(known, "ref_id", "left").join(F.broadcast(false)).join(F.broadcast(_state(refs)))
    refused = F.raise_error(F.lit("the plan has false automatic decisions")).cast("string")
    return out.withColumn("disposition", F.when(F.col("_false") > 0, refused).otherwise(disposition)).drop("_false", "_status", "_entity")


def _state(refs: DataFrame) -> DataFrame:
    """One row: the fingerprint of the references that a plan is made for."""
    return table_fingerprint(refs).select(F.concat_ws("/", F.col("rows").cast("string"), "content").alias("plan_fingerprint"))


def apply_plan(refs: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new references, outcome of every planned row); a plan made for other references is refused (an error at run time).

    Rows to apply make their reference automatically confirmed with the matched entity and
    raise its revision; a reference that isn't there is ``unknown``; all others keep their disposition.
    """
    now = F.broadcast(_state(refs).withColumnRenamed("plan_fingerprint", "_now"))
    stale = F.raise_error(F.lit("stale: the references changed since the plan was made")).cast("string")
    checked = plan.join(now).withColumn("disposition", F.when(F.col("_now") != F.col("plan_fingerprint"), stale).otherwise(F.col("disposition"))).drop("_now")
    todo = checked.filter("disposition = 'apply'").select("ref_id", F.col("matched").alias("_matched"))
    joined = refs.join(todo, "ref_id", "left")
    hit = F.col("_matched").isNotNull()
    changes = {"status": F.when(hit, "auto_confirmed").otherwise(F.col("status")), "entity": F.coalesce("_matched", "entity"), "revision": F.col("revision") + hit.cast("int")}
    there = refs.select("ref_id", F.lit(True).alias("_there"))
    done = F.when((F.col("disposition") == "apply") & F.col("_there").isNull(), "unknown").when(F.col("disposition") == "apply", "applied").otherwise(F.col("disposition"))
    outcome = checked.join(there, "ref_id", "left").withColumn("outcome", done).select(*plan.columns, "outcome")
    return joined.withColumns(changes).select(*refs.columns), outcome


def cascade_delete(doomed: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of the doomed keys."""
    return [t.join(doomed.select(key), key, "left_anti") for t in tables]


def store_features(store: DataFrame, features: DataFrame, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, outcome of all): only accepted rows whose canonical name hasn't drifted; a known identity is a duplicate.

    Of rows that may be inserted the first of an identity (by feature_id) is; one that was
    turned down before it doesn't count.
    """
    known = store.select(*identity).distinct().withColumn("_known", F.lit(True))
    may = F.coalesce("accepted", F.lit(False)) & F.col("canonical").eqNullSafe(F.col("expected_canonical"))
    first = features.withColumn("_may", may).withColumn("_rn", F.row_number().over(Window.partitionBy(*identity, "_may").orderBy("feature_id")))
    outcome = F.when(~F.coalesce("accepted", F.lit(False)), "not_accepted").when(~F.col("_may"), "canonical_drift").when(F.col("_known") | (F.col("_rn") > 1), "duplicate").otherwise("inserted")
    out = first.join(known, identity, "left").withColumn("outcome", outcome)
    return out.filter("outcome = 'inserted'").select(*features.columns), out.select(*features.columns, "outcome")


def ingest(refs: DataFrame, batch: DataFrame) -> DataFrame:
    """Outcome per captured row (capture_id, payload_hash, identity_hash): existing, payload_conflict, reviewed_conflict, existing_identity or created."""
    by_capture = refs.select("capture_id", F.col("payload_hash").alias("_payload"), F.col("revision").alias("_rev"))
    by_identity = refs.select("identity_hash", F.lit(True).alias("_same")).distinct()
    out = batch.join(by_capture, "capture_id", "left").join(by_identity, "identity_hash", "left")
    outcome = F.when(F.col("_payload").isNotNull() & (F.col("_payload") != F.col("payload_hash")), "payload_conflict").when(F.col("_payload").isNotNull() & (F.col("_rev") > 0), "reviewed_conflict").when(F.col("_payload").isNotNull(), "existing").when(F.col("_same"), "existing_identity").otherwise("created")
    return out.select(*batch.columns, outcome.alias("outcome"))


def migrate(df: DataFrame, source: int, target: int) -> tuple[DataFrame, list[dict]]:
    """(rows of the target version, a history row per step): 2 changes only order, 3 adds ok and calories as nulls."""
    if not 1 <= source <= target <= 3:
        raise ValueError(f"no way from version {source} to {target}")
    steps = []
    for version in range(source + 1, target + 1):
        if version == 3:
            df = df.withColumns({"ok": F.lit(None).cast("int"), "calories": F.lit(None).cast("double")})
        steps.append({"version": version, "change": "order" if version == 2 else "nullable metrics"})
    return df, steps


def stamp_master(tables: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """key/value metadata: row counts, and a version from the distinct source hashes in any order, added up and not listed."""
    both = F.concat_ws(":", *order_free_hash(F.col("content_hash")))
    version = sources.select("content_hash").distinct().agg(F.sha2(both, 256).alias("value")).select(F.lit("master_version").alias("key"), F.concat(F.lit("m-"), F.substring("value", 1, 16)).alias("value"))
    for name, df in sorted(tables.items()):
        version = version.unionByName(df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(f"{name}_count").alias("key"), "value"))
    return version


def validate_drafts(drafts: DataFrame, refs: DataFrame, songs: DataFrame) -> DataFrame:
    """Codes per draft (ref_id, status, entity): unknown or repeated id, status, entity needed, forbidden or unknown."""
    out = drafts.join(refs.select("ref_id", F.lit(True).alias("_ref")), "ref_id", "left").join(songs.select(F.col("entity"), F.lit(True).alias("_song")).distinct(), "entity", "left")
    twice = F.count(F.lit(1)).over(Window.partitionBy("ref_id")) > 1
    codes = reasons((F.col("_ref").isNull(), "unknown_reference"), (twice, "repeated_reference"), (~F.coalesce(F.col("status").isin("confirmed", "rejected", "hold"), F.lit(False)), "status_invalid"), ((F.col("status") == "confirmed") & F.col("entity").isNull(), "entity_required"), ((F.col("status") == "rejected") & F.col("entity").isNotNull(), "entity_forbidden"), (F.col("entity").isNotNull() & F.col("_song").isNull(), "entity_unknown"))
    return out.withColumn("violations", codes).drop("_ref", "_song")


def select_confirmations(unresolved: DataFrame, by_vector: DataFrame, by_text: DataFrame, obs_id: str) -> DataFrame:
    """Observations that a unique vector match, else a unique available text candidate, confirms: (obs, entity, source)."""
    v = by_vector.select(obs_id, F.col("entity").alias("_v"))
    t = by_text.filter("available").groupBy(obs_id).agg(F.collect_set("entity").alias("_t"))
    out = unresolved.join(v, obs_id, "left").join(t, obs_id, "left")
    text = F.when(F.size("_t") == 1, F.element_at("_t", 1))
    return out.select(obs_id, F.coalesce("_v", text).alias("entity"), F.when(F.col("_v").isNotNull(), "vector").otherwise("text").alias("source")).filter("entity IS NOT NULL")


def readiness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Ordered chain: blockers -> readiness -> decision -> planned status of the record."""
    blocked = reasons(*[(F.col(f"{f}_status") != "ready", f) for f in fields])
    out = df.withColumn("_b", blocked)
    ready = F.when(F.size("_b") == 0, "ready").when(F.size("_b") < len(fields), "partial").otherwise("blocked")
    out = out.withColumns({"blockers": F.array_join("_b", ","), "readiness": ready}).drop("_b")
    decision = F.when(F.col("duplicate"), "skip_duplicate").when(F.col("readiness") == "ready", "save").otherwise("hold")
    out = out.withColumn("decision", decision)
    return out.withColumn("planned_status", F.when(F.col("decision") == "save", "saved").when(F.col("decision") == "skip_duplicate", "skipped").when(F.col("readiness") == "partial", "low_confidence").otherwise("error"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which: no rows means the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right_only")))


def check_master(songs: DataFrame, charts: DataFrame, metadata: DataFrame, snapshots: DataFrame, required: list[str]) -> DataFrame:
    """Violations (code, detail): missing metadata, counts that differ, charts without song, repeated charts, snapshot number and hashes."""
    need = metadata.sparkSession.createDataFrame([(k,) for k in required], "key string")
    out = need.join(metadata, "key", "left_anti").select(F.lit("metadata_missing").alias("code"), F.col("key").alias("detail"))
    for name, df in (("songs", songs), ("charts", charts)):
        said = metadata.filter(F.col("key") == f"{name}_count").select(F.col("value").try_cast("long").alias("said"))
        have = df.agg(F.count(F.lit(1)).alias("have"))
        out = out.unionByName(said.join(F.broadcast(have)).filter("said IS NULL OR said != have").select(F.lit(f"{name}_count_mismatch").alias("code"), F.concat_ws("/", "said", "have").alias("detail")))
    out = out.unionByName(charts.join(songs, "song_id", "left_anti").select(F.lit("chart_without_song").alias("code"), F.col("chart_id").cast("string").alias("detail")))
    again = charts.groupBy("song_id", "style", "difficulty").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = out.unionByName(again.select(F.lit("chart_repeated").alias("code"), F.concat_ws("/", "song_id", "style", "difficulty").alias("detail")))
    number = snapshots.agg(F.count(F.lit(1)).alias("n")).filter("n < 1 OR n > 3")
    out = out.unionByName(number.select(F.lit("snapshot_count").alias("code"), F.col("n").cast("string").alias("detail")))
    wrong = snapshots.filter(F.sha2("html_content", 256) != F.col("content_hash"))
    return out.unionByName(wrong.select(F.lit("snapshot_hash_mismatch").alias("code"), F.col("snapshot_id").cast("string").alias("detail")))


#: What a row of a supplement manifest has, in order of name, and which difficulty it adds.
SUPPLEMENT_KEYS = ("acquired_on", "chart_id", "level", "play_style", "song_id", "source_url", "title")
SUPPLEMENT, SUPPLEMENT_NOTE = "CHALLENGE", "confirmed CHALLENGE supplement; source_url="


def check_manifests(manifests: DataFrame, charts: DataFrame) -> DataFrame:
    """Violations (master, code, detail) of supplement manifests (master, json, hash, declared) against each master's charts.

    supplement_hash_mismatch, supplement_invalid_json and supplement_count_mismatch tell of
    a manifest; supplement_row_keys (a row without exactly the keys), supplement_repeated,
    supplement_not_in_charts (no such chart, or other values) and supplement_note_mismatch
    of its rows.  Null texts are invalid JSON; masters without a manifest have no violations.
    """
    read = manifests.withColumn("_items", F.from_json("json", "array<string>"))
    whole = reasons(
        (~F.coalesce(F.sha2("json", 256) == F.col("hash"), F.lit(False)), "supplement_hash_mismatch"), (F.col("_items").isNull(), "supplement_invalid_json"),
        (F.col("_items").isNotNull() & ~F.coalesce(F.col("declared") == F.size("_items"), F.lit(False)), "supplement_count_mismatch"),
    )
    out = read.select("master", F.explode(whole).alias("code"), F.lit("").alias("detail"))
    rows = read.select("master", F.posexplode("_items").alias("at", "item"))
    exact = F.coalesce(F.array_sort(F.json_object_keys("item")) == F.array(*[F.lit(k) for k in SUPPLEMENT_KEYS]), F.lit(False))
    out = out.unionByName(rows.filter(~exact).select("master", F.lit("supplement_row_keys").alias("code"), F.col("at").cast("string").alias("detail")))
    given = rows.filter(exact).withColumn("s", F.from_json("item", ", ".join(f"{k} string" for k in SUPPLEMENT_KEYS)))
    given = given.select("master", "s.*").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("master", "chart_id")))
    out = out.unionByName(given.filter("_n > 1").select("master", F.lit("supplement_repeated").alias("code"), F.col("chart_id").alias("detail")).distinct())
    own = charts.select("master", F.col("chart_id").cast("string").alias("chart_id"), *[F.col(c).cast("string").alias(f"_{c}") for c in ("song_id", "title", "play_style", "difficulty", "level", "notes")])
    met = given.filter("_n = 1").join(own, ["master", "chart_id"], "left")
    same = (F.col("_difficulty") == SUPPLEMENT) & (F.col("_song_id") == F.col("song_id")) & (F.col("_title") == F.col("title")) & (F.col("_play_style") == F.col("play_style")) & (F.col("_level") == F.col("level"))
    note = F.concat(F.lit(SUPPLEMENT_NOTE), "source_url", F.lit("; acquired_on="), "acquired_on")
    code = F.when(~F.coalesce(same, F.lit(False)), "supplement_not_in_charts").when(~F.coalesce(F.endswith("_notes", note), F.lit(False)), "supplement_note_mismatch")
    return out.unionByName(met.withColumn("code", code).filter("code IS NOT NULL").select("master", "code", F.col("chart_id").alias("detail")))


def check_sources(masters: DataFrame, snapshots: DataFrame, required: str, optional: list[str]) -> DataFrame:
    """Violations (master, code, detail) of declared sources: columns <name>_url and <name>_hash against snapshots (master, url, content_hash).

    <name>_incomplete: a url without hash or the other way round (or, if ``required``,
    neither); <name>_url_unknown; <name>_hash_mismatch; snapshot_count_mismatch: another
    number of snapshots than sources that are declared.
    """
    given = lambda n, c: F.coalesce(F.col(f"{n}_{c}"), F.lit("")) != ""
    sources = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n == required).alias("must"), given(n, "url").alias("u"), given(n, "hash").alias("h"), F.col(f"{n}_url").alias("url"), F.col(f"{n}_hash").alias("hash")) for n in (required, *optional)])
    each = masters.select("master", F.inline(sources))
    known = snapshots.groupBy("master", "url").agg(F.max("content_hash").alias("_content"))
    met = each.join(known, ["master", "url"], "left")
    code = F.when((F.col("u") != F.col("h")) | (F.col("must") & ~F.col("u")), "incomplete").when(F.col("u") & F.col("_content").isNull(), "url_unknown").when(F.col("u") & (F.col("_content") != F.col("hash")), "hash_mismatch")
    out = met.withColumn("code", F.concat_ws("_", "name", code)).filter(code.isNotNull()).select("master", "code", F.coalesce("url", F.lit("")).alias("detail"))
    have = snapshots.groupBy("master").agg(F.count(F.lit(1)).alias("have"))
    want = each.groupBy("master").agg(F.count_if(F.col("must") | F.col("u")).alias("want")).join(have, "master", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return out.unionByName(want.filter("have != want").select("master", F.lit("snapshot_count_mismatch").alias("code"), F.concat_ws("/", "have", "want").alias("detail")))


DOCUMENT = ("event struct<confirmation_mode: string, timestamp_ms: bigint, duplicate: boolean, status: string>, review struct<state: string>, material array<struct<kind: string, status: string, summary: string>>, retention struct<class: string, basis: date, expires: date>")
DOCUMENT_KEYS = ("event", "material", "retention", "review")


def validate_documents(df: DataFrame, col: str) -> DataFrame:
    """Codes of nested JSON documents: unreadable, keys that aren't exact, enums, cross-field rules, element shape, retention recomputed."""
    d = F.from_json(F.col(col), DOCUMENT)
    keys = F.json_object_keys(F.col(col))
    days = F.when(F.col("_d.retention.class") == "normal", 7).when(F.col("_d.retention.class") == "diagnostic", 30)
    expiry = F.when(days.isNotNull(), F.date_add("_d.retention.basis", days))
    codes = reasons(
        (keys.isNull(), "not_an_object"), (keys.isNotNull() & (F.array_sort(keys) != F.array(*[F.lit(k) for k in DOCUMENT_KEYS])), "keys_not_exact"),
        (~F.coalesce(F.col("_d.event.confirmation_mode").isin("time", "frames"), F.lit(False)), "mode_invalid"), ((F.col("_d.event.confirmation_mode") == "time") & F.col("_d.event.timestamp_ms").isNull(), "time_mode_needs_timestamp"),
        (F.col("_d.event.duplicate") & (F.col("_d.event.status") != "skipped"), "duplicate_must_be_skipped"), (F.exists("_d.material", lambda m: m["kind"].isNull() | m["status"].isNull()), "material_incomplete"),
        (~F.coalesce(F.col("_d.retention.class").isin("normal", "diagnostic", "permanent"), F.lit(False)), "retention_class_invalid"), (~F.col("_d.retention.expires").eqNullSafe(expiry), "retention_expiry_mismatch"),
    )
    return df.withColumn("_d", d).withColumn("violations", codes).drop("_d")
