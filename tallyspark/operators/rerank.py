"""Second looks at ambiguous sets: row keys, masked bits and title suffixes.

``pairs`` always has a row for each (observation, candidate chart, reference of its entity)
of an ambiguous set; an observation's own reference is left out by whoever makes it.  All
work is by observation, and a set is as large as its ambiguity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import compatible
from tallyspark.functions.vectors import row_match_count, row_words, words_apart

#: Suffixes that tell versions of a title apart, and limits of the near-tie chain.
TITLE_SUFFIXES = ("type1", "type2", "type3")
CHAIN_DISTANCE, CHAIN_DELTA, VARIABLE_WEIGHT = 0.35, 0.01, 5.0


def variable_words(pairs: DataFrame, obs_id: str, words: str) -> DataFrame:
    """(obs_id, mask, diff_bits): a mask of the positions at which the references of an observation's set differ.

    ``words`` holds bits, 60 in a number; references of another length than the first are compared as far as they go.
    """
    each = pairs.select(obs_id, F.posexplode(words).alias("_at", "_w"))
    varies = each.groupBy(obs_id, "_at").agg(F.bit_or("_w").bitwiseXOR(F.bit_and("_w")).alias("_m"))
    listed = varies.groupBy(obs_id).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_l"))  # as long as a feature
    return listed.select(obs_id, F.transform("_l", lambda s: s["_m"]).alias("mask"), F.aggregate("_l", F.lit(0).cast("long"), lambda n, s: n + F.bit_count(s["_m"])).alias("diff_bits"))


def masked_pairs(pairs: DataFrame, obs_id: str, seen: str, known: str, weight: float = VARIABLE_WEIGHT) -> DataFrame:
    """``pairs`` with ``exact`` (all row keys equal), ``distance`` (share of weight of differing bits) and ``diff_bits``.

    Bits that vary among the references of the set weigh ``weight``, others 1; the distance
    is 1 where lengths differ.
    """
    rows = pairs.withColumns({"_s": row_words(F.col(seen)), "_k": row_words(F.col(known))})
    out = rows.join(variable_words(rows, obs_id, "_k"), obs_id)
    width = F.lit(4) * F.length(F.array_join(known, ""))
    same = (F.size("_s") == F.size("_k")) & (F.length(F.array_join(seen, "")) == F.length(F.array_join(known, "")))
    total = width + (weight - 1) * F.col("diff_bits")
    apart = words_apart(F.col("_s"), F.col("_k"), None) + (weight - 1) * words_apart(F.col("_s"), F.col("_k"), F.col("mask"))
    distance = F.when(same & (total > 0), apart / total).otherwise(F.lit(1.0))
    return out.withColumns({"exact": F.col(seen) == F.col(known), "distance": distance}).drop("_s", "_k", "mask")


def near_tie_chain(pairs: DataFrame, obs_id: str, entity: str, seen: str, known: str, max_distance: float = CHAIN_DISTANCE, delta: float = CHAIN_DELTA) -> DataFrame:
    """(obs_id, entity, distance, margin, chain): near ties that row keys settle; others have no row.

    An entity that alone has equal row keys is it, at distance 0 (``row_keys``).  Without any
    equal keys, and if the references differ at all, the masked distance decides: at most
    ``max_distance``, and by more than ``delta`` nearer than the next entity (``masked``).
    """
    best = masked_pairs(pairs, obs_id, seen, known).groupBy(obs_id, entity).agg(F.max("exact").alias("exact"), F.min("distance").alias("distance"), F.max("diff_bits").alias("diff_bits"))
    mine, order = Window.partitionBy(obs_id), Window.partitionBy(obs_id).orderBy("distance", entity)
    ranked = best.withColumns({"_exact": F.count_if("exact").over(mine), "_rn": F.row_number().over(order), "margin": F.lead("distance").over(order) - F.col("distance")})
    by_key = (F.col("_exact") == 1) & F.col("exact")
    by_mask = (F.col("_exact") == 0) & (F.col("_rn") == 1) & (F.col("diff_bits") > 0) & (F.col("distance") <= max_distance) & (F.col("margin") > delta)
    found = ranked.withColumn("chain", F.when(by_key, "row_keys").when(by_mask, "masked")).filter("chain IS NOT NULL")
    return found.select(obs_id, F.col(entity).alias("entity"), F.when(by_key, 0.0).otherwise(F.col("distance")).alias("distance"), F.when(~by_key, F.col("margin")).alias("margin"), "chain")


def one_chart(resolved: DataFrame, charts: DataFrame, obs_id: str, entity: str, chart: str) -> DataFrame:
    """The last check: exactly one candidate chart of the resolved entity may be left.

    Adds ``chart`` and ``chart_status``: resolved, chart_not_found, chart_ambiguous; unresolved where no entity was.
    """
    left = charts.select(obs_id, F.col(entity).alias("entity"), chart).distinct().groupBy(obs_id, "entity").agg(F.count(F.lit(1)).alias("_n"), F.min(chart).alias("_c"))
    out = resolved.join(left, [obs_id, "entity"], "left")
    status = F.when(F.col("entity").isNull(), "unresolved").when(F.col("_n").isNull(), "chart_not_found").when(F.col("_n") > 1, "chart_ambiguous").otherwise("resolved")
    return out.withColumns({"chart_status": status, "chart": F.when(F.col("_n") == 1, F.col("_c"))}).drop("_n", "_c")


def row_key_rerank(obs: DataFrame, pairs: DataFrame, obs_id: str, entity: str, chart: str, seen: str, known: str, order: list[str], delta: float = CHAIN_DELTA) -> DataFrame:
    """How the row keys of an ambiguous set speak, three ways side by side, without any of them deciding.

    ``obs`` (obs_id, seen) has every observation asked about.  exact_status: no_exact_match,
    resolved_candidate, ambiguous_candidate.  dict_status, by rows that agree and aren't
    blank: no_dict_match, resolved_candidate, ambiguous_candidate (another entity has as
    many), with dict_chart and dict_rows of the first by ``order``.  distance_status, by
    masked distance: ambiguous_candidate if another entity is within ``delta``, with
    top_chart and top_distance.  An observation without rows, or whose set has no
    references, is missing_feature in all three.
    """
    rated = masked_pairs(pairs.join(obs.filter(F.col(seen).isNotNull()).select(obs_id, seen), obs_id), obs_id, seen, known).withColumn("_rows", row_match_count(F.col(seen), F.col(known)))
    mine = Window.partitionBy(obs_id)
    near, alike = F.struct("distance", *order, chart), F.struct((-F.col("_rows")).alias("_less"), *order, chart)
    tops = rated.withColumns({"_near": F.min_by(F.struct(entity, chart, "distance"), near).over(mine), "_alike": F.min_by(F.struct(entity, chart, "_rows"), alike).over(mine)})
    found = tops.groupBy(obs_id).agg(
        F.count(F.lit(1)).alias("reference_count"), F.max("diff_bits").alias("diff_bits"), F.count_distinct(F.when(F.col("exact"), F.col(entity))).alias("_exact"), F.first("_near").alias("_near"), F.first("_alike").alias("_alike"),
        F.max((F.col(entity) != F.col(f"_near.{entity}")) & (F.col("distance") - F.col("_near.distance") <= delta)).alias("_close"), F.max((F.col(entity) != F.col(f"_alike.{entity}")) & (F.col("_rows") == F.col("_alike._rows"))).alias("_tied"),
    )
    out = obs.select(obs_id, F.col(seen).isNotNull().alias("_seen")).join(found, obs_id, "left")
    gone = F.col("reference_count").isNull()
    none = F.when(gone, "missing_feature")
    told = F.when(F.col("_alike._rows") <= 0, "no_dict_match").when(F.col("_tied"), "ambiguous_candidate").otherwise("resolved_candidate")
    why = F.when(~F.col("_seen"), "row_keys_unavailable").when(gone, "no_candidate_row_keys").when(F.col("_alike._rows") <= 0, "no_matching_rows").when(F.col("_tied"), "tied_row_matches").when(F.col("_close"), "near_top_distance").otherwise("")
    return out.select(
        obs_id, F.coalesce(none, F.when(F.col("_exact") == 0, "no_exact_match").when(F.col("_exact") == 1, "resolved_candidate").otherwise("ambiguous_candidate")).alias("exact_status"),
        F.coalesce(none, told).alias("dict_status"), F.col(f"_alike.{chart}").alias("dict_chart"), F.col("_alike._rows").alias("dict_rows"),
        F.coalesce(none, F.when(F.col("_close"), "ambiguous_candidate").otherwise("resolved_candidate")).alias("distance_status"), F.col(f"_near.{chart}").alias("top_chart"), F.col("_near.distance").alias("top_distance"),
        "reference_count", "diff_bits", why.alias("reason"),
    )


def suffix_of(text: Column, suffixes: tuple[str, ...] = TITLE_SUFFIXES) -> Column:
    """First of ``suffixes`` in the compatible, lower-cased text without spaces, in upper case; "" without one."""
    bare = F.regexp_replace(F.lower(compatible(text)), r"\s+", "")
    return F.coalesce(*[F.when(F.contains(bare, F.lit(s)), F.lit(s.upper())) for s in suffixes], F.lit(""))


def suffix_rerank(obs: DataFrame, candidates: DataFrame, obs_id: str, entity: str, chart: str, text: str, status: str, title_key: str, order: list[str], shown: Column, listed: int = 5) -> DataFrame:
    """Titles of an ambiguous set that carry the suffix that was read.

    ``obs`` has (obs_id, text, status), ``candidates`` the charts of the ambiguous entities
    with the folded ``title_key``.  rerank_status: missing_ocr (nothing read: reason
    title_ocr_not_run, the status itself, or empty_ocr), no_suffix,
    no_candidate_suffix_match, ambiguous_candidate (several entities), resolved_candidate;
    with the first chart and the first ``listed`` by ``order``.
    """
    read = obs.select(obs_id, text, status).withColumn("suffix", F.when(F.col(status) == "ok", suffix_of(F.col(text))))
    held = candidates.join(read.filter("suffix != ''").select(obs_id, "suffix"), obs_id).filter(F.contains(F.col(title_key), F.lower("suffix")))
    placed = held.withColumn("_rn", F.row_number().over(Window.partitionBy(obs_id).orderBy(*order, chart)))
    top = placed.groupBy(obs_id).agg(
        F.count_distinct(entity).alias("_entities"), F.max(F.when(F.col("_rn") == 1, F.col(entity))).alias("entity"), F.max(F.when(F.col("_rn") == 1, F.col(chart))).alias("chart"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= listed, F.struct("_rn", shown.alias("text"))))), lambda s: s["text"]), " | ").alias("top_candidates"),
    )
    out = read.join(top, obs_id, "left")
    absent, bad, empty = F.col(status).isNull(), F.col(status) != "ok", F.coalesce(F.col(text), F.lit("")) == ""
    state = F.when(absent | bad | empty, "missing_ocr").when(F.col("suffix") == "", "no_suffix").when(F.col("_entities").isNull(), "no_candidate_suffix_match").when(F.col("_entities") > 1, "ambiguous_candidate").otherwise("resolved_candidate")
    reason = F.when(absent, "title_ocr_not_run").when(bad, F.col(status)).when(empty, "empty_ocr").when(F.col("suffix") == "", "type_suffix_not_detected").when(F.col("_entities").isNull(), "suffix_not_in_ambiguous_candidates").when(F.col("_entities") > 1, "suffix_matches_multiple_ambiguous_songs").otherwise("")
    return out.select(obs_id, F.coalesce("suffix", F.lit("")).alias("suffix"), "entity", "chart", F.coalesce("top_candidates", F.lit("")).alias("top_candidates"), state.alias("rerank_status"), reason.alias("rerank_reason"))
