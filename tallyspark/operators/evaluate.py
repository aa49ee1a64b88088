"""Evaluation and review: counts, gates, routes, coverage and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.ids import reasons
from tallyspark.functions.text import digits_match
from tallyspark.operators.quantiles import quantiles


def value_counts(df: DataFrame, cols: list[str], vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """(field, value, n) for many columns at once; blanks are skipped, vocabulary values stay with 0.

    One unpivot and one aggregation, however many columns.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    counted = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value IS NOT NULL AND value != ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    if not vocabulary:
        return counted
    known = df.sparkSession.createDataFrame([(f, v) for f, values in vocabulary.items() for v in values], "field string, value string")
    return counted.join(known, ["field", "value"], "full_outer").select("field", "value", F.coalesce("n", F.lit(0)).alias("n"))


def groups_with_reps(df: DataFrame, keys: list[str], rep: str, order: list[Column], n: int = 3) -> DataFrame:
    """Count of each group and its first ``n`` representatives, joined by commas.

    Ranks are taken per group, but only the first n travel on, so a large group stays cheap.
    """
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n)
    shown = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(rep).cast("string").alias("r")))), lambda s: s["r"]), ",").alias("representatives"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(shown, keys)


def resolution_order(df: DataFrame, fields: list[str], actions: dict[str, tuple[str, int]], default: tuple[str, int] = ("review", 9)) -> DataFrame:
    """Blocked (field, status, reason) groups with action and priority by status, numbered in order of priority, count and name.

    Each field has columns <field>_status and <field>_reason; ready ones aren't blocked.
    """
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_status").alias("status"), F.col(f"{f}_reason").alias("reason")) for f in fields])
    blocked = df.select(F.explode(rows).alias("p")).select("p.*").filter("status != 'ready'")
    grouped = blocked.groupBy("field", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, v in actions.items() for x in (s, v[k])]), F.col("status")), F.lit(default[k]))
    named = grouped.withColumns({"action": pick(0), "priority": pick(1)})
    return named.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("priority", F.col("n").desc(), "field", "status", "reason")))


def match_bucket(df: DataFrame, by: list[str], value: str, expected: str, available: Column) -> DataFrame:
    """total, ok, unavailable, match, mismatch, empty, no_expected and evaluation_status for each group."""
    same = digits_match(F.col(value), F.col(expected))
    blank = F.coalesce(F.col(value) == "", F.lit(True))
    none = F.coalesce(F.col(expected) == "", F.lit(True))
    ok = F.coalesce(available, F.lit(False))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("unavailable"), F.count_if(ok & F.coalesce(same, F.lit(False))).alias("match"),
        F.count_if(ok & F.coalesce(~same, F.lit(False))).alias("mismatch"), F.count_if(ok & blank & ~none).alias("empty"), F.count_if(none).alias("no_expected"),
    )
    return out.withColumn("evaluation_status", evaluation_status())


def evaluation_status() -> Column:
    return F.when(F.col("no_expected") == F.col("total"), "no_expected").when((F.col("no_expected") > 0) | (F.col("unavailable") > 0), "partially_evaluated").otherwise("evaluated")


def recommend_profile(counts: DataFrame, field: str, profile: str, default: str) -> DataFrame:
    """Best profiles per field by match (most), mismatch, empty (least); all ties stay; gain over the default profile."""
    ranked = counts.withColumn("_r", F.rank().over(Window.partitionBy(field).orderBy(F.col("match").desc(), "mismatch", "empty"))).filter("_r = 1").drop("_r")
    base = counts.filter(F.col(profile) == default).select(field, F.col("match").alias("_base"))
    ready = F.when(F.col("match") == 0, "no_match").when(F.col("mismatch") > 0, "has_mismatch").when(F.col("empty") > 0, "has_empty").otherwise("ready")
    return ranked.join(base, field, "left").select(field, profile, "match", "mismatch", "empty", (F.col("match") - F.col("_base")).alias("gain"), ready.alias("readiness"))


def classification_summary(df: DataFrame, predicted: str, actual: str, by: list[str]) -> DataFrame:
    """Rows, correct ones, accuracy and numbers of false positives and negatives; ``misclassified`` has their ids."""
    wrong = lambda p, a: F.count_if((F.col(predicted) == p) & (F.col(actual) == a))
    grouped = df.groupBy(*by) if by else df
    right, n = F.count_if(F.col(predicted) == F.col(actual)), F.count(F.lit(1))
    return grouped.agg(n.alias("n"), right.alias("correct"), (right / n).alias("accuracy"), wrong(1, 0).alias("false_positives"), wrong(0, 1).alias("false_negatives"))


def misclassified(df: DataFrame, predicted: str, actual: str, ident: str, by: list[str]) -> DataFrame:
    """A row for every wrong prediction: its group, kind (false_positive, false_negative) and id."""
    kind = F.when((F.col(predicted) == 1) & (F.col(actual) == 0), "false_positive").when((F.col(predicted) == 0) & (F.col(actual) == 1), "false_negative")
    return df.select(*by, kind.alias("kind"), ident).filter("kind IS NOT NULL")


def recognition_bucket(df: DataFrame, by: list[str], status: str, length: Column, distance: str) -> DataFrame:
    return df.groupBy(*by, status, length.alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg(distance).alias("mean_distance"))


def topk_rows(scored: DataFrame, truth: DataFrame, obs_id: str, entity: str, max_distance: float, delta: float, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per confirmed observation: top entity, margin, rank of the truth, hits at each k and the decision.

    ``truth`` has obs_id, entity and in_snapshot; here a margin *below* delta is ambiguous.
    """
    order = Window.partitionBy(obs_id).orderBy("distance", "entity")
    rank = scored.withColumns({"rank": F.row_number().over(order), "margin": F.lead("distance").over(order) - F.col("distance")})
    top = rank.filter("rank = 1").select(obs_id, F.col("entity").alias("top_entity"), F.col("distance").alias("top_distance"), "margin")
    known = rank.select(obs_id, F.col("entity").alias(entity), F.col("rank").alias("expected_rank"))
    out = truth.join(top, obs_id).join(known, [obs_id, entity], "left")
    decision = F.when(~F.col("in_snapshot"), "hold_truth_not_in_snapshot").when(F.col("top_distance") > max_distance, "hold_distance").when(F.col("margin") < delta, "hold_ambiguous").when(F.col("top_entity") == F.col(entity), "matched_correct").otherwise("matched_false")
    return out.withColumns({**{f"top{k}": F.coalesce(F.col("expected_rank") <= k, F.lit(False)) for k in ks}, "decision": decision})


def topk_metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Accuracy at each k over truths in the snapshot; precision and both coverages of the decisions."""
    there, n = F.count_if("in_snapshot"), F.count(F.lit(1))
    right, wrong = F.count_if(F.col("decision") == "matched_correct"), F.count_if(F.col("decision") == "matched_false")
    ratio = lambda a, b: F.when(b > 0, a / b)
    at = [ratio(F.count_if(F.col("in_snapshot") & F.col(f"top{k}")), there).alias(f"top{k}_accuracy") for k in ks]
    return rows.agg(n.alias("confirmed"), there.alias("in_snapshot"), *at, (right + wrong).alias("emitted"), right.alias("correct"), wrong.alias("false"), ratio(right, right + wrong).alias("precision"), ratio(right + wrong, n).alias("coverage_confirmed"), ratio(right + wrong, there).alias("coverage_snapshot"))


def route(df: DataFrame, rules: list[tuple[Column, str, Column | None, str]], otherwise: tuple[str, str], entity_type: str = "string") -> DataFrame:
    """Adds route, matched and route_reason by the first of ``rules`` (condition, route, entity, reason) that holds.

    A null condition doesn't hold; rows that no rule takes get the route and reason of
    ``otherwise``.  The order of the rules is their meaning.
    """
    def outcome(to: str, entity: Column | None, why: str) -> Column:
        return F.struct(F.lit(to).alias("route"), (F.lit(None) if entity is None else entity).cast(entity_type).alias("matched"), F.lit(why).alias("reason"))

    out = df.withColumn("_taken", F.coalesce(*[F.when(rule, outcome(to, entity, why)) for rule, to, entity, why in rules]))
    return out.withColumns({
        "route": F.coalesce("_taken.route", F.lit(otherwise[0])), "matched": F.col("_taken.matched"), "route_reason": F.coalesce("_taken.reason", F.lit(otherwise[1])),
    }).drop("_taken")


def resolve_profiles(rows: DataFrame, obs_id: str, profile: str, ids: str, expected: list[str]) -> DataFrame:
    """Per observation over its profiles: all sole ids, conflict (two of them), ambiguous (a profile with several), profile set check."""
    out = rows.groupBy(obs_id).agg(F.array_sort(F.collect_set(F.when(F.size(ids) == 1, F.element_at(ids, 1)))).alias("entity_ids"), F.max((F.size(ids) > 1).cast("int")).alias("_many"), F.array_sort(F.collect_set(profile)).alias("_have"))
    return out.select(obs_id, "entity_ids", (F.size("entity_ids") > 1).alias("conflict"), (F.col("_many") == 1).alias("ambiguous"), (F.col("_have") != F.array(*[F.lit(p) for p in sorted(expected)])).alias("profile_set_mismatch"))


def policy_summary(rows: DataFrame, truth: str, routes: list[str]) -> DataFrame:
    """Per route, those without rows too: evaluated, auto, correct, false, precision and coverage (share of all rows)."""
    auto = F.startswith("route", F.lit("auto_"))
    hit = auto & F.coalesce(F.col("matched") == F.col(truth), F.lit(False))
    counted = rows.groupBy("route").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(auto).alias("auto"), F.count_if(hit).alias("correct"), F.count_if(auto & ~hit).alias("false"))
    known = rows.sparkSession.createDataFrame([(r,) for r in routes], "route string")
    out = known.join(counted, "route", "left").na.fill(0, ["evaluated", "auto", "correct", "false"])
    total = F.sum("evaluated").over(Window.partitionBy(F.lit(0)))
    return out.withColumns({"precision": F.when(F.col("auto") > 0, F.col("correct") / F.col("auto")), "coverage": F.when(total > 0, F.col("evaluated") / total)})


def adoption(df: DataFrame, method: str, evaluated: Column, exact: Column, auto: Column, correct: Column, least: int = 30, rate: float = 0.95) -> DataFrame:
    """Per method: counts, exact rate, precision, known false; adopted only if every gate holds; failed gates in order."""
    e = F.coalesce(evaluated, F.lit(False))
    a = e & F.coalesce(auto, F.lit(False))
    right = a & F.coalesce(correct, F.lit(False))
    out = df.groupBy(method).agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(e).alias("evaluated"), F.count_if(e & F.coalesce(exact, F.lit(False))).alias("exact"), F.count_if(a).alias("auto"), F.count_if(right).alias("correct_auto"), F.count_if(a & ~right).alias("known_false"))
    out = out.withColumns({"exact_rate": F.when(F.col("evaluated") > 0, F.col("exact") / F.col("evaluated")), "precision": F.when(F.col("auto") > 0, F.col("correct_auto") / F.col("auto"))})
    failed = reasons((F.col("evaluated") < least, "insufficient_evaluated"), (F.coalesce(F.col("exact_rate") < rate, F.lit(True)), "exact_rate_below_gate"), (F.col("known_false") > 0, "known_false_detected"), (F.col("auto") == 0, "no_auto_candidates"), (F.coalesce(F.col("precision") != 1.0, F.lit(True)), "precision_below_gate"))
    return out.withColumn("_f", failed).withColumns({"adopted": F.size("_f") == 0, "failed_gates": F.array_join("_f", ",")}).drop("_f")


def field_readiness(counts: DataFrame) -> DataFrame:
    """Ordered rules over target, match, mismatch, empty and no_expected."""
    rule = F.when(F.col("target") == 0, "no_target").when(F.col("no_expected") == F.col("target"), "needs_labels").when(F.col("mismatch") > 0, "has_mismatch").when(F.col("empty") > 0, "has_empty").when(F.col("no_expected") > 0, "partially_labelled").otherwise("ready")
    return counts.withColumn("adoption_status", rule)


def distribution(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Count, least, quartiles (linear between values) and most; nulls don't count.

    The quartiles are exact and found by counting, see ``quantiles``: no task holds a group.
    """
    known = df.groupBy(*by).agg(F.count(col).alias("n"), F.min(col).alias("low"), F.max(col).alias("high"))
    found = quantiles(df, col, by, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    same = F.lit(True)
    for c in by:
        same = same & known[c].eqNullSafe(found[c])
    return known.join(found, same, "left").select(*[known[c] for c in by], "n", "low", "p25", "median", "p75", "high")


def config_matrix(rows: DataFrame, item: str, config: str, status: str, baseline: str) -> DataFrame:
    """Status of the baseline against each other configuration, per item: counts of each combination."""
    base = rows.filter(F.col(config) == baseline).select(item, F.col(status).alias("baseline_status"))
    other = rows.filter(F.col(config) != baseline).select(item, config, F.col(status).alias("other_status"))
    return base.join(other, item).groupBy(config, "baseline_status", "other_status").agg(F.count(F.lit(1)).alias("n"))


def duplicate_hashes(df: DataFrame, content: str, name: str) -> DataFrame:
    """(sha256, names, name): a row for every name of a content that more than one name has, and how many those are."""
    hashed = df.select(F.sha2(F.col(content), 256).alias("sha256"), name).distinct()
    often = hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("names")).filter("names > 1")
    return hashed.join(often, "sha256").select("sha256", "names", name)


def compare_engines(a: DataFrame, b: DataFrame, keys: list[str], value: str, status: str) -> DataFrame:
    """same, different, unavailable_a or unavailable_b for each row of ``a``; values compare as digits."""
    other = b.select(*keys, F.col(value).alias("_v"), F.col(status).alias("_s"))
    out = a.join(other, keys, "left")
    result = F.when(F.coalesce(F.col(status) != "ok", F.lit(True)), "unavailable_a").when(F.coalesce(F.col("_s") != "ok", F.lit(True)), "unavailable_b").when(F.coalesce(digits_match(F.col(value), F.col("_v")), F.lit(False)), "same").otherwise("different")
    return out.select(*keys, F.col(value).alias("value_a"), F.col("_v").alias("value_b"), result.alias("comparison"))


def assemble(rows: DataFrame, key: str, parts: dict[str, DataFrame | None], value: str) -> DataFrame:
    """Left joins of material tables by key: each gives <name>_value and <name>_state (ok, missing, not_run for a table that is None)."""
    for name, part in parts.items():
        if part is None:
            rows = rows.withColumns({f"{name}_value": F.lit(None).cast("string"), f"{name}_state": F.lit("not_run")})
        else:
            rows = rows.join(part.select(key, F.col(value).cast("string").alias(f"{name}_value"), F.lit("ok").alias(f"{name}_state")), key, "left").withColumn(f"{name}_state", F.coalesce(f"{name}_state", F.lit("missing")))
    return rows


def reference_state(refs: DataFrame, songs: DataFrame, entity: str, version: Column, keep_confirmed: bool = False) -> DataFrame:
    """Adds state: orphaned (entity missing or unavailable), stale_extractor, identity_drift, else the stored status."""
    known = songs.select(entity, F.col("available").alias("_available"), F.col("title").alias("_title"))
    out = refs.join(known, entity, "left")
    state = F.when(~F.coalesce("_available", F.lit(False)), "orphaned").when(F.col("extractor") != version, "stale_extractor").when(F.col("title") != F.col("_title"), "identity_drift").otherwise(F.col("status"))
    if keep_confirmed:
        state = F.when(F.col("status") == "manual_confirmed", F.col("status")).otherwise(state)
    return out.withColumn("state", state).drop("_available", "_title")


def current_references(refs: DataFrame, songs: DataFrame, entity: str, version: Column) -> DataFrame:
    """References that still serve: confirmed, by the current extractor, of an available entity whose title and artist are as they were.

    The collected names are ``title`` and ``artist`` of ``refs``, the present ones those of
    ``songs``; null names compare as equal nulls.
    """
    known = songs.filter("available").select(entity, F.col("title").alias("_title"), F.col("artist").alias("_artist"))
    good = F.col("status").isin("auto_confirmed", "manual_confirmed") & (F.col("extractor") == version)
    joined = refs.filter(good).join(known, entity)
    return joined.filter(F.col("title").eqNullSafe(F.col("_title")) & F.col("artist").eqNullSafe(F.col("_artist"))).select(*refs.columns)


COVERAGE = ("referenced", "needs_review", "unresolved", "uncollected")


def coverage(songs: DataFrame, refs: DataFrame, cands: DataFrame, entity: str, order: str) -> DataFrame:
    """Per entity the best status of its references, or of candidate rows without an assignment; reason of the first such row."""
    rank = lambda c: F.when(c.isin("auto_confirmed", "manual_confirmed"), 0).when(c == "needs_review", 1).otherwise(2)
    both = refs.filter(F.col(entity).isNotNull()).select(entity, "status", "reason", order).unionByName(cands.select(entity, "status", "reason", order)).withColumn("_rank", rank(F.col("status")))
    best = both.groupBy(entity).agg(F.min("_rank").alias("_rank"), F.min_by("reason", F.struct("_rank", order)).alias("reason"), F.count(F.lit(1)).alias("rows"))
    out = songs.join(best, entity, "left")
    return out.select(*songs.columns, F.element_at(F.array(*[F.lit(c) for c in COVERAGE]), F.coalesce(F.col("_rank"), F.lit(3)) + 1).alias("coverage"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _blocks(charts: DataFrame, refs: DataFrame, entity: str, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates of blocks with ``_ref`` (referenced), and a row for each block: how many it has and how many of these are referenced."""
    have = refs.select(entity).distinct().withColumn("_have", F.lit(True))
    each = charts.select(*block, entity).distinct().join(have, entity, "left").withColumn("_ref", F.coalesce("_have", F.lit(False))).drop("_have")
    known = F.col(entity).isNotNull()
    return each, each.groupBy(*block).agg(F.count(entity).alias("_n"), F.count_if(known & F.col("_ref")).alias("_r"))


def _with_status(obs: DataFrame, sums: DataFrame, obs_id: str, block: list[str]) -> DataFrame:
    """``obs`` with the sums of their blocks and ``row_status``, over all rows of an observation."""
    every = Window.partitionBy(obs_id)
    n, r = F.coalesce(F.sum("_n").over(every), F.lit(0)), F.sum("_r").over(every)
    return obs.join(sums, block, "left").withColumn("row_status", F.when(n == 0, "no_candidates").when(r == n, "all").when(r == 0, "none").otherwise("partial"))


def candidate_coverage(obs: DataFrame, charts: DataFrame, refs: DataFrame, obs_id: str, entity: str, block: list[str]) -> DataFrame:
    """A row per (observation, candidate of its block): referenced or missing; and the observation's status all, partial, none or no_candidates.

    The status comes from sums by block, so it is known before the pairs are made, and pairs
    are neither moved nor sorted: observations and candidates meet by block.
    """
    each, sums = _blocks(charts, refs, entity, block)
    out = _with_status(obs, sums, obs_id, block).drop("_n", "_r").join(each, block, "left")
    return out.withColumn("candidate_state", F.when(F.col(entity).isNull(), None).when(F.col("_ref"), "referenced").otherwise("missing")).select(*obs.columns, entity, "candidate_state", "row_status")


def block_coverage_totals(obs: DataFrame, charts: DataFrame, refs: DataFrame, obs_id: str, entity: str, block: list[str]) -> DataFrame:
    """``coverage_totals`` of ``candidate_coverage`` from sums by block: no pair is made."""
    asked = _with_status(obs, _blocks(charts, refs, entity, block)[1], obs_id, block)
    counted = asked.groupBy("row_status").agg(F.count_distinct(obs_id).alias("n"))
    states = asked.agg(F.sum("_r").alias("referenced"), F.sum(F.col("_n") - F.col("_r")).alias("missing"))
    listed = F.inline(F.array(*[F.struct(F.lit("candidate").alias("kind"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("referenced", "missing")]))
    return counted.select(F.lit("observation").alias("kind"), F.col("row_status").alias("value"), "n").unionByName(states.select(listed).filter("n > 0"))


def expected_status(obs: DataFrame, candidates: DataFrame, refs: DataFrame, obs_id: str, entity: str, block: list[str] | None = None) -> DataFrame:
    """Adds expected_status and expected_reason for the entity that an observation should have.

    Reads ``expected`` (null: not known, for the reason in ``failure``) and ``block_status``;
    candidates are (obs_id, entity), references have the entity.  With ``block`` the candidates are
    (entity, *block), those of every observation of that block, and only the expected one is looked up.
    """
    by = block or [obs_id]
    own = candidates.select(*by, F.col(entity).alias("expected"), F.lit(True).alias("_in")).distinct()
    have = refs.select(F.col(entity).alias("expected"), F.lit(True).alias("_ref")).distinct()
    out = obs.join(own, [*by, "expected"], "left").join(have, "expected", "left")
    # Names of statuses and reasons.
    rules = [
        (F.col("expected").isNull(), "expected_unresolved", F.coalesce(F.nullif(F.col("failure"), F.lit("")), F.lit("missing_label"))),
        (F.col("block_status") != "ready", "not_evaluated", F.col("block_status")),
        (F.col("_in").isNull(), "expected_not_in_chart_candidates", F.lit("chart_filter_excluded_expected_song")),
        (F.col("_ref").isNull(), "expected_missing_feature", F.lit("expected_song_has_no_jacket_reference")),
    ]
    status = F.coalesce(*[F.when(rule, name) for rule, name, _ in rules], F.lit("expected_referenced"))
    reason = F.coalesce(*[F.when(rule, why) for rule, _, why in rules], F.lit(""))
    return out.withColumns({"expected_status": status, "expected_reason": reason}).drop("_in", "_ref")


def with_assigned(refs: DataFrame, songs: DataFrame, entity: str) -> DataFrame:
    """Adds ``assigned`` (the entity and its present title, null where there is none) and ``drift``: missing, title or none."""
    known = songs.select(entity, F.col("title").alias("_title"), F.lit(True).alias("_there"))
    out = refs.join(known, entity, "left")
    assigned = F.when(F.col("_there"), F.struct(F.col(entity), F.col("_title").alias("title")))
    drift = F.when(F.col(entity).isNull(), "").when(F.col("_there").isNull(), "missing").when(~F.col("title").eqNullSafe(F.col("_title")), "title").otherwise("")
    return out.withColumns({"assigned": assigned, "drift": drift}).drop("_title", "_there")


def coverage_totals(rows: DataFrame, obs_id: str) -> DataFrame:
    """Observations once each by status, and candidate rows by state."""
    once = rows.select(obs_id, "row_status").dropDuplicates([obs_id])
    a = once.groupBy(F.lit("observation").alias("kind"), F.col("row_status").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(rows.filter("candidate_state IS NOT NULL").groupBy(F.lit("candidate").alias("kind"), F.col("candidate_state").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def presence(songs: DataFrame, mapped: DataFrame, entity: str, available: str) -> DataFrame:
    """present in the snapshot, available_only, or absent."""
    have = mapped.select(entity).distinct().withColumn("_in", F.lit(True))
    return songs.join(have, entity, "left").withColumn("presence", F.when(F.col("_in"), "present").when(F.col(available), "available_only").otherwise("absent")).drop("_in")


def review_projection(refs: DataFrame, cands: DataFrame, history: DataFrame, ref_id: str, order: str, listed: int = 1000) -> DataFrame:
    """Per reference: its candidates by rank and its history in order, as arrays of structs, with how many there are.

    The ``listed`` best candidates and latest entries are listed, so a row stays bounded;
    the counts are those of all.
    """

    def gathered(rows: DataFrame, by: list[Column], entry: Column, name: str, count: str) -> DataFrame:
        top = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(ref_id).orderBy(*by))).filter(F.col("_rn") <= listed)
        lists = top.groupBy(ref_id).agg(F.array_sort(F.collect_list(entry)).alias(name))
        return rows.groupBy(ref_id).agg(F.count(F.lit(1)).alias(count)).join(lists, ref_id)

    c = gathered(cands, [F.col("rank"), F.col("entity")], F.struct("rank", "entity"), "candidates", "candidate_count")
    h = gathered(history, [F.col(order).desc(), F.col("action").desc()], F.struct(order, "action"), "history", "revision_count")
    out = refs.join(c, ref_id, "left").join(h, ref_id, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("candidate_count", "revision_count")})


def coverage_summary(rows: DataFrame, confirmed: Column, auto: Column, false: Column, target: float = 0.90, stretch: float = 0.95) -> DataFrame:
    """Audit of automatic confirmations: rate with its targets, audited and known false."""
    n = F.count(F.lit(1))
    rate = F.when(n > 0, F.count_if(auto) / n)
    return rows.agg(n.alias("rows"), F.count_if(confirmed).alias("confirmed"), F.count_if(auto).alias("auto"), F.count_if(false).alias("known_false"), rate.alias("auto_rate"), (rate >= target).alias("meets_target"), (rate >= stretch).alias("meets_stretch"))


def unresolved_summary(rows: DataFrame, reason: str, classes: dict[str, str], fields: list[str]) -> DataFrame:
    """Counts by class (of the reason), reason, and field status."""
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    named = rows.withColumns({"classification": F.coalesce(F.try_element_at(table, F.col(reason)), F.lit("other"))})
    return value_counts(named, ["classification", reason, *fields])


def order_free_hash(text: Column) -> list[Column]:
    """Two sums over the rows' SHA-256: 60 bits each, so the order of rows doesn't matter and every row counts."""
    digest = F.sha2(text, 256)
    return [F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for at in (1, 16)]


def fingerprint(columns: list[str]) -> list[Column]:
    """Aggregates ``rows`` and ``content``: row count and a hash that doesn't depend on the order of rows or columns.

    A row's text holds each column, by name, as its length and text, or a mark for null, so
    that values can't move between columns unseen.
    """
    text = {c: F.col(f"`{c}`").cast("string") for c in sorted(columns)}
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in text.values()]
    low, high = order_free_hash(F.concat_ws(";", *parts) if parts else F.lit(""))
    return [F.count(F.lit(1)).alias("rows"), F.concat_ws(":", low, high).alias("content")]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """The fingerprint of a table: one pass, no sort."""
    return df.agg(*fingerprint(df.columns))
