"""Resolving observations against a catalog: cascades of exact keys, blocks, fuzzy titles, merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.ids import reasons
from tallyspark.functions.text import best_titles, similarity_bound, title_similarity
from tallyspark.sources.scratch import work_table


#: Times the wanted number of pairs are scored to find out which others can matter.
FIRST = 4


def by_sorting(df: DataFrame) -> DataFrame:
    """``df`` for a join that may spill: rows of a catalog's keys are many times what its compressed file lets the planner expect, too many to broadcast."""
    return df.hint("merge")


def keyed(df: DataFrame, entity: str, steps: dict[int, Column | list[Column]]) -> DataFrame:
    """(step, key, entity) rows of a catalog; a step may have several keys; null and blank ones are left out."""
    listed = [(n, k) for n, keys in steps.items() for k in (keys if isinstance(keys, list) else [keys])]
    rows = F.array(*[F.struct(F.lit(n).alias("step"), k.alias("key")) for n, k in listed])
    return df.select(F.col(entity).alias("entity"), F.explode(rows).alias("r")).select("r.step", "r.key", "entity").filter("key IS NOT NULL AND key != ''")


def key_summary(catalog: DataFrame, by: tuple[str, ...] = ("step", "key"), lists: bool = False) -> DataFrame:
    """One row for each key of ``catalog``: ``hits`` (different entities), the least ``entity`` and, with ``lists``, all of them in order."""
    each = catalog.select(*by, "entity").distinct()
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("hits"), F.min("entity").alias("entity"), *([F.array_sort(F.collect_list("entity")).alias("entities")] if lists else []))


def cascade(obs: DataFrame, obs_id: str, steps: dict[int, Column], catalog: DataFrame, lists: bool = False) -> DataFrame:
    """Per observation with any hit: the first step that hits, its key, its number of different entities, the least, and with ``lists`` all of them.

    One equi-join over stacked (step, key) rows stands for a lookup after the other.  The
    catalog is summed up by key before, so a key that n entities and m observations share
    is m rows, not n times m; a list is gathered once a key.
    """
    known = ["hits", "entity", "key"]
    hits = keyed(obs, obs_id, steps).withColumnRenamed("entity", "_obs").join(by_sorting(key_summary(catalog)), ["step", "key"])
    best = hits.groupBy("_obs").agg(F.min("step").alias("step"), F.min_by(F.struct(*known), "step").alias("_best"))
    found = best.select(F.col("_obs").alias(obs_id), "step", *[F.col(f"_best.{c}").alias(c) for c in known])
    return with_lists(found, catalog) if lists else found


def with_lists(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of a cascade with ``entities``, the list of their (step, key).  To come last: lists meet their rows once and aren't moved with them."""
    gathered = key_summary(catalog, lists=True).select("step", "key", "entities")
    return found.join(by_sorting(gathered), ["step", "key"], "left")


def map_cascade(obs: DataFrame, obs_id: str, complete: Column, steps: dict[int, Column], catalog: DataFrame, labels: dict[int, tuple[str, str]]) -> DataFrame:
    """Adds entity, status and reason.  ``labels`` gives a step's (status if alone, reason if several).

    The first step with hits decides: one entity resolves, more are ambiguous.
    """
    found = cascade(obs.filter(complete), obs_id, steps, catalog)
    out = obs.withColumn("_complete", F.coalesce(complete, F.lit(False))).join(by_sorting(found), obs_id, "left")
    table = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, v in labels.items() for x in (n, v[k])]), F.col("step"))
    one = F.col("hits") == 1
    status = F.when(one, table(0)).otherwise("unresolved")
    reason = F.when(~F.col("_complete"), "missing_title_or_artist").when(F.col("hits").isNull(), "title_not_found").when(one, "").otherwise(table(1))
    return out.withColumns({"status": status, "reason": reason, "entity": F.when(one, F.col("entity"))}).drop("_complete", "hits", "key", "step")


def strict_lookup(obs: DataFrame, obs_id: str, complete: Column, exact: Column, folded: Column, catalog: DataFrame) -> DataFrame:
    """Exact keys (canonical and alias together), then normalised ones: status exact, normalized, ambiguous, not_found, incomplete."""
    found = cascade(obs.filter(complete), obs_id, {1: exact, 2: folded}, catalog)
    out = with_lists(obs.withColumn("_complete", F.coalesce(complete, F.lit(False))).join(by_sorting(found), obs_id, "left"), catalog)
    status = F.when(~F.col("_complete"), "incomplete").when(F.col("hits").isNull(), "not_found").when(F.col("hits") > 1, "ambiguous").when(F.col("step") == 1, "exact").otherwise("normalized")
    return out.withColumns({"status": status, "entities": F.coalesce("entities", F.array().cast("array<bigint>"))}).drop("_complete", "hits", "entity", "key", "step")


def resolve_title(obs: DataFrame, obs_id: str, title: Column, artist: Column | None, catalog: DataFrame, artists: DataFrame | None = None) -> DataFrame:
    """Unique canonical title, else unique alias; an artist only breaks ties among title hits.

    ``catalog`` has step 1 (titles) and 2 (aliases); ``artists`` (entity, artist) holds keys
    to compare.  status: resolved_title, resolved_alias, resolved_artist, ambiguous_title,
    ambiguous_alias, title_not_found, missing_label.
    """
    blank = F.coalesce(title == "", F.lit(True))
    found = cascade(obs.filter(~blank), obs_id, {1: title, 2: title}, catalog)
    out = obs.withColumns({"_blank": blank, "_artist": artist if artist is not None else F.lit(None).cast("string")}).join(by_sorting(found), obs_id, "left")
    if artists is not None:
        owned = catalog.join(by_sorting(artists.select(F.col("entity"), F.col("artist").alias("_artist"))), "entity").filter("_artist IS NOT NULL")
        sole = key_summary(owned, ("step", "key", "_artist")).filter("hits = 1").select("step", "key", "_artist", F.col("entity").alias("_broken"))
        out = out.join(by_sorting(sole), ["step", "key", "_artist"], "left").withColumn("_broken", F.when(F.col("hits") > 1, F.col("_broken")))
    else:
        out = out.withColumn("_broken", F.lit(None).cast("long"))
    by = F.when(F.col("step") == 1, "title").otherwise("alias")
    status = F.when(F.col("_blank"), "missing_label").when(F.col("hits").isNull(), "title_not_found").when(F.col("hits") == 1, F.concat(F.lit("resolved_"), by)).when(F.col("_broken").isNotNull(), "resolved_artist").otherwise(F.concat(F.lit("ambiguous_"), by))
    return out.withColumns({"status": status, "entity": F.when(F.col("hits") == 1, F.col("entity")).otherwise(F.col("_broken"))}).drop("_blank", "_artist", "_broken", "hits", "key", "step")


def resolve_pair(obs: DataFrame, obs_id: str, ok: Column, has_feature: Column, pair: Column, title: Column, catalog: DataFrame, available: DataFrame, candidates: bool = True) -> DataFrame:
    """Canonical pair, alias pair, then title alone (catalog steps 1, 2, 3): review status, reason, match kind, entity, candidates.

    A unique pair is auto_confirmed if the feature exists and the entity is available
    (``available``: entity, available); a title alone and several entities need review.
    Without ``candidates`` no list is gathered.
    """
    whole = F.coalesce(ok, F.lit(False)) & F.coalesce(pair != "", F.lit(False))
    found = cascade(obs.filter(whole), obs_id, {1: pair, 2: pair, 3: title}, catalog)
    out = obs.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_pair": F.coalesce(pair != "", F.lit(False)), "_feature": F.coalesce(has_feature, F.lit(False))})
    out = out.join(by_sorting(found), obs_id, "left").join(by_sorting(available.select(F.col("entity"), F.col("available").alias("_available"))), "entity", "left")
    out = with_lists(out, catalog) if candidates else out
    unique = (F.col("step") < 3) & (F.col("hits") == 1)
    kind = F.when(F.col("step") == 1, "canonical").otherwise("alias")
    status = F.when(~F.col("_ok") | ~F.col("_pair") | F.col("hits").isNull(), "unresolved").when(~unique, "needs_review").when(~F.col("_feature"), "unresolved").when(~F.coalesce("_available", F.lit(False)), "needs_review").otherwise("auto_confirmed")
    reason = (
        F.when(~F.col("_ok"), "observation_not_ok").when(~F.col("_pair"), "missing_title_or_artist").when(F.col("hits").isNull(), "identity_not_found").when(F.col("step") == 3, "title_match_artist_mismatch")
        .when(F.col("hits") > 1, F.concat(F.lit("ambiguous_"), kind, F.lit("_title_artist"))).when(~F.col("_feature"), "feature_extraction_failed").when(~F.coalesce("_available", F.lit(False)), "entity_not_available").otherwise(F.concat(kind, F.lit("_title_artist_exact")))
    )
    listed = {"candidates": F.coalesce("entities", F.array().cast("array<bigint>"))} if candidates else {}
    return out.withColumns({"status": status, "reason": reason, "entity": F.when(unique, F.col("entity")), **listed}).drop("_ok", "_pair", "_feature", "_available", "step", "hits", "key", "entities")


def block_ready(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds block_ready and block_reason; fields: name -> (status, normalised value).  Every one must be ready and normalisable."""
    missing = reasons(*[(~F.coalesce((s == "ready") & v.isNotNull() & (v.cast("string") != ""), F.lit(False)), n) for n, (s, v) in fields.items()])
    return df.withColumn("_m", missing).withColumns({"block_ready": F.size("_m") == 0, "block_reason": F.when(F.size("_m") > 0, F.concat(F.lit("missing_block_fields="), F.array_join("_m", ",")))}).drop("_m")


def block_candidates(obs: DataFrame, charts: DataFrame, block: list[str], available: Column | None = None) -> DataFrame:
    """Equi-join on the block keys; only available catalog rows."""
    return obs.join(charts.filter(available) if available is not None else charts, block)


def best_scored(cands: DataFrame, obs_id: str, seen: str, known: str, best: int = 5) -> DataFrame:
    """``cands`` (one row a pair) with ``score``: that of the title pairs that can be among the ``best`` of an observation, or tie with its best to six digits.

    Others are left out.  Every pair gets an upper bound that is much cheaper than its score;
    FIRST times ``best`` pairs with the best bounds are scored first, and of the rest only
    those whose bound reaches the last of the best among these scores.
    """
    mine = Window.partitionBy(obs_id)
    bound = cands.withColumn("_bound", similarity_bound(F.col(seen), F.col(known)))
    first = bound.withColumn("_first", F.row_number().over(mine.orderBy(F.desc("_bound"))) <= FIRST * best)
    scored = first.withColumn("_score", title_similarity(F.when(F.col("_first"), F.col(seen)), F.col(known)))
    # Scores of the first ones only: others are null and aren't listed.
    least = F.try_element_at(F.sort_array(F.collect_list("_score").over(mine), asc=False), F.lit(best))
    least = scored.withColumn("_least", least).filter("_first OR _bound >= _least - 0.000001")
    again = title_similarity(F.when(~F.col("_first"), F.col(seen)), F.col(known))
    return least.withColumn("score", F.coalesce("_score", again)).drop("_bound", "_first", "_score", "_least")


#: Different known and seen texts of a block that are compared at once; rows of a catalog that are shown.
KNOWN, SEEN, SHOWN = 2048, 512, 5
#: Tasks that compare, for each core: bins are small and what takes time is comparing, so they aren't dealt by size.
WAVES = 16


def _packed(texts: DataFrame, block: list[str], item: Column, name: str, size: int) -> DataFrame:
    """Rows (block, _bin, _bins, ``name``): the items of a block in bins of about ``size``, dealt by the hash of ``_text``; written out."""
    texts = work_table(texts, name)
    bins = texts.groupBy(*block).agg(F.expr(f"count(1) div {size} + 1").alias("_bins"))
    dealt = texts.join(bins, block).withColumn("_bin", F.pmod(F.xxhash64("_text"), "_bins"))
    return work_table(dealt.groupBy(*block, "_bin", "_bins").agg(F.array_sort(F.collect_list(item)).alias(name)), name)


def best_in_block(seen: DataFrame, charts: DataFrame, block: list[str], title_key: str, chart_id: str) -> DataFrame:
    """For each (block, ``_text``) of ``seen`` its best score, ``_ties`` (rows that tie with it to six digits) and ``_top``, the SHOWN best rows (negative score, title, artist, id).

    Texts of a block that are equal are one, on both sides, and bins of texts meet: a pair of
    texts is a number in an array and never a row.
    """
    row = F.struct("title", "artist", F.col(chart_id).alias("id"))
    keyed = work_table(charts.select(*block, "title", "artist", chart_id, F.coalesce(title_key, F.lit("")).alias("_text")), "titles").withColumn("_row", row)
    place = F.row_number().over(Window.partitionBy(*block, "_text").orderBy("title", "artist", chart_id))
    some = keyed.withColumn("_rn", place).filter(f"_rn <= {SHOWN}").groupBy(*block, "_text").agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    known = some.join(keyed.groupBy(*block, "_text").agg(F.count(F.lit(1)).alias("n")), [*block, "_text"])
    known = _packed(known, block, F.struct("rows", F.col("_text").alias("text"), "n"), "known", KNOWN)
    asked = _packed(seen.select(*block, "_text").distinct(), block, F.col("_text"), "seen", SEEN)
    # A bin of seen texts goes to each bin of known ones, so a block of many is many tasks.
    bins = known.groupBy(*block).agg(F.max("_bins").alias("_known"))
    asked = asked.join(bins, block).select(*block, "seen", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_known") - 1)).alias("_bin"))
    met = asked.join(by_sorting(known), [*block, "_bin"]).select(*block, "seen", "known").repartition(WAVES * charts.sparkSession.sparkContext.defaultParallelism)
    kinds = [met.schema[c].dataType.simpleString() for c in block]
    top = known.schema["known"].dataType.elementType["rows"].dataType.elementType
    top = "array<struct<score:double," + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in top) + ">>"
    shape = ", ".join([*[f"`{c}` {k}" for c, k in zip(block, kinds)], "_text string", "best double", "ties long", f"top {top}"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _compared(batch.slice(i, 1), block)

    found = met.mapInArrow(compare, shape)
    order = F.flatten(F.transform(F.collect_list("top"), lambda t: F.transform(t, lambda r: F.struct((-r["score"]).alias("low"), r["title"].alias("title"), r["artist"].alias("artist"), r["id"].alias("id")))))
    merged = found.groupBy(*block, "_text").agg(F.max("best").alias("top_score"), F.collect_list(F.struct("best", "ties")).alias("_each"), F.slice(F.array_sort(order), 1, SHOWN).alias("_top"))
    same = F.filter("_each", lambda e: F.round(e["best"], 6) == F.round("top_score", 6))
    return merged.withColumn("_ties", F.aggregate(same, F.lit(0).cast("long"), lambda total, e: total + e["ties"])).drop("_each")


def _compared(pair: pa.RecordBatch, block: list[str]) -> pa.RecordBatch:
    """A bin of seen texts against a bin of known ones: for each seen text its best rows."""
    seen, known = pair.column("seen").flatten(), pair.column("known").flatten()
    lists = known.field("rows")
    ends, rows = np.asarray(lists.offsets), lists.values
    take, scores, size, best, ties = [], [], [], [], []
    for top, tied in best_titles(seen.to_pylist(), known.field("text").to_pylist(), known.field("n").to_pylist(), SHOWN):
        level, mine = None, 0
        for score, j in top:
            if score != level:
                if mine >= SHOWN:
                    break
                level = score
            take += range(ends[j], ends[j + 1])
            scores += [score] * int(ends[j + 1] - ends[j])
            mine += int(ends[j + 1] - ends[j])
        size.append(mine)
        best.append(top[0][0])
        ties.append(tied)
    chosen = rows.take(pa.array(take, pa.int64()))
    row = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), *chosen.flatten()], names=["score", *[f.name for f in chosen.type]])
    top = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), row)
    again = pa.array(np.zeros(len(seen), np.int64))
    return pa.RecordBatch.from_arrays([*[pair.column(c).take(again) for c in block], seen, pa.array(best, pa.float64()), pa.array(ties, pa.int64()), top], names=[*block, "_text", "best", "ties", "top"])


def fuzzy_match(obs: DataFrame, obs_id: str, seen: str, ready: Column, charts: DataFrame, block: list[str], title_key: str, chart_id: str, threshold: float = 0.92) -> DataFrame:
    """Best title in the block: status matched, ambiguous (equal best to 6 digits), not_found, insufficient_input.

    Adds top_score, top_chart, match_reason and the five best candidates as text.  Catalog
    rows need title and artist; keys are folded before, once per row.  ``obs_id`` tells
    observations apart; each is judged by its own text and block, see ``best_in_block``.
    """
    good = F.coalesce(ready & (F.col(seen) != ""), F.lit(False))
    asked = obs.withColumns({"_good": good, "_text": F.when(good, F.col(seen))})
    top = best_in_block(asked.filter("_good"), charts, block, title_key, chart_id)
    out = asked.join(by_sorting(top), [*block, "_text"], "left").select(*[F.col(c) for c in obs.columns], "_good", "top_score", "_ties", "_top")
    shown = F.transform("_top", lambda r: F.format_string("%.4f:%s / %s [%s]", -r["low"], r["title"], r["artist"], r["id"].cast("string")))
    out = out.withColumns({"top_chart": F.try_element_at("_top", F.lit(1))["id"], "top_candidates": F.array_join(shown, " | ")})
    status = F.when(~F.col("_good"), "insufficient_input").when(F.col("top_score").isNull() | (F.col("top_score") < threshold), "not_found").when(F.col("_ties") > 1, "ambiguous").otherwise("matched")
    reason = F.when(~F.col("_good"), "missing_input").when(F.col("top_score").isNull(), "no_candidates").when(F.col("top_score") < threshold, "below_threshold").when(F.col("_ties") > 1, "tied_top_score").otherwise("")
    return out.withColumns({"match_status": status, "match_reason": reason}).drop("_good", "_ties", "_top")


def apply_availability(songs: DataFrame, entity: str, steps: dict[int, Column], official: DataFrame, names: tuple[str, ...] = ("pair", "alias_pair", "unique_title", "alias_unique_title")) -> DataFrame:
    """Match each song with the official list by four steps in order; adds official (its key), availability and available.

    One hit gives the step's name, several ambiguous_<name>, none not_found.
    """
    found = cascade(songs, entity, steps, official)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("step"))
    out = songs.join(by_sorting(found.withColumnRenamed("entity", "official")), entity, "left")
    status = F.when(F.col("hits").isNull(), "not_found").when(F.col("hits") == 1, label).otherwise(F.concat(F.lit("ambiguous_"), label))
    return out.withColumns({"availability": status, "available": F.coalesce(F.col("hits") == 1, F.lit(False)), "official": F.when(F.col("hits") == 1, F.col("official"))}).drop("step", "hits", "key")


def changed_names(matched: DataFrame, official: DataFrame, entity: str, title: str) -> DataFrame:
    """Alias rows (entity, alias, official title) for songs whose official name differs; the official name wins."""
    named = official.select(F.col("entity").alias("official"), F.col("title").alias("_official"))
    return matched.join(named, "official").filter(F.col("_official") != F.col(title)).select(entity, F.col(title).alias("alias"), F.col("_official").alias("official_title"))


def add_missing(songs: DataFrame, official: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``songs`` and the official rows whose key none of them has; the first row of a key wins.  Columns in common are kept."""
    new = official.join(songs.select(key).distinct(), key, "left_anti")
    new = new.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1")
    return songs.withColumn("added", F.lit(False)).unionByName(new.select(*songs.columns).withColumn("added", F.lit(True)))


def reuse_ids(base: DataFrame, extra: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """``extra`` with reused_id and reused_by: the id of the only base row of its first key, else of the next key, else its own (new)."""
    out = extra
    for key in keys:
        sole = base.groupBy(key).agg(F.min(entity).alias(f"_{key}_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
        out = out.join(sole, key, "left")
    found = [F.col(f"_{key}_id") for key in keys]
    by = F.coalesce(*[F.when(f.isNotNull(), key) for key, f in zip(keys, found)], F.lit("new"))
    return out.withColumns({"reused_id": F.coalesce(*found, F.col(entity)), "reused_by": by}).drop(*[f"_{key}_id" for key in keys])


def merge_sources(base: DataFrame, extra: DataFrame, keys: list[str], level: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): rows of ``extra`` with new keys are added; the same key with another level is a conflict; the base's row stays.

    Of several new rows of one key that of the least level, then of the least other values, is added.
    """
    both = base.select(*keys, F.col(level).alias("_base")).join(extra.select(*keys, F.col(level).alias("_extra")), keys)
    conflicts = both.filter(~F.col("_base").eqNullSafe(F.col("_extra"))).select(*keys, F.col("_base").alias("base_level"), F.col("_extra").alias("extra_level"))
    rest = [c for c in base.columns if c not in (*keys, level)]
    new = extra.join(base.select(*keys), keys, "left_anti").withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(level, *rest))).filter("_rn = 1")
    return base.unionByName(new.select(*base.columns)), conflicts


def apply_supplements(charts: DataFrame, songs: DataFrame, supplements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(charts, outcome): supplements (title, style, difficulty, level, source) by unique title; added, unchanged, conflict or not_unique."""
    unique = songs.groupBy("title").agg(F.count(F.lit(1)).alias("_n"), F.min("song_id").alias("song_id")).filter("_n = 1").drop("_n")
    keys = ["song_id", "style", "difficulty"]
    placed = supplements.join(unique, "title", "left").join(charts.select(*keys, F.col("level").alias("_have"), F.lit(True).alias("_found")), keys, "left")
    outcome = placed.withColumn("outcome", F.when(F.col("song_id").isNull(), "not_unique").when(F.col("_found").isNull(), "added").when(F.col("_have").eqNullSafe(F.col("level")), "unchanged").otherwise("conflict"))
    added = outcome.filter("outcome = 'added'").select(*keys, "level", F.concat(F.lit("confirmed supplement; source="), F.col("source")).alias("notes"))
    return charts.unionByName(added.select(*charts.columns)), outcome.select("title", "style", "difficulty", "level", "song_id", "outcome")
