"""Nearest references by vector distance, with margins and ambiguity as answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.vectors import l1
from tallyspark.operators.metric import ALONE, GROUP, SLACK, Part, distances, nearest_entities, nothing, stacked

MAX_DISTANCE, DELTA = 0.24, 0.015
#: Names of how close a pair is.
RISK_BANDS, OTHER_BAND = ((0.05, "A: extremely close"), (0.10, "B: high"), (0.11, "C: elevated")), "D: watch"
#: References that are compared at once; distances that are held at once; bytes of references that may be broadcast; most tasks of pairs of blocks for a core.
BLOCK, CELLS, SMALL_REFS, TASKS = 2048, 1 << 19, 32 << 20, 8


class Every:
    """References (ref, entity, w) in order of entity, in parts of one vector length each, for the least distance to each entity."""

    def __init__(self, kind: str, refs: pd.DataFrame):
        self.of = {}
        for size, q in refs.groupby(refs["w"].map(len)):
            q = q.sort_values(["entity", "ref"])
            ref, entity, w = q["ref"].to_numpy(), q["entity"].to_numpy(), stacked(q["w"])
            parts = [Part(kind, ref[at : at + BLOCK], entity[at : at + BLOCK], w[at : at + BLOCK]) for at in range(0, len(q), BLOCK)]
            names = entity[np.flatnonzero(np.append(True, entity[1:] != entity[:-1]))]
            # Parts follow each other, so a part's first entity is the last one of the part before, or the next.
            same = np.array([False, *[y.entity[0] == x.entity[-1] for x, y in zip(parts, parts[1:])]])
            begin = np.cumsum([0, *[len(x.names) for x in parts[:-1]]]) - np.cumsum(same)
            self.of[int(size)] = names, list(zip(begin.tolist(), parts))

    def least(self, obs: pd.DataFrame, leave_out: bool) -> Iterator[pd.DataFrame]:
        """Least distance and reference of each observation (obs, v) to each entity, ties by reference."""
        lengths = obs["v"].map(len)
        for size in set(lengths) & set(self.of):
            names, parts = self.of[size]
            same = obs[lengths == size]
            for at in range(0, len(same), max(1, CELLS // len(names))):
                p = same.iloc[at : at + max(1, CELLS // len(names))]
                ids, v = p["obs"].to_numpy(), stacked(p["v"])
                least, ref = np.full((len(p), len(names)), np.inf), np.empty((len(p), len(names)), parts[0][1].ref.dtype)
                for begin, part in parts:
                    to = slice(begin, begin + len(part.names))
                    for cut in range(0, len(p), max(1, CELLS // len(part.ref))):
                        some = slice(cut, cut + max(1, CELLS // len(part.ref)))
                        row, group, place, d = part.nearer(v[some], ids[some] if leave_out else None, least[some, to])
                        least[some, to][row, group], ref[some, to][row, group] = d, part.ref[place]
                row, group = np.nonzero(np.isfinite(least))
                yield pd.DataFrame({"obs": ids[row], "entity": names[group], "ref": ref[row, group], "distance": least[row, group]})


def entity_distances(obs: DataFrame, refs: DataFrame, obs_id: str, ref_id: str, entity: str, vector: str, kind: str = "l1", leave_out: bool = False, block: int | None = None, small: int = SMALL_REFS) -> DataFrame:
    """(obs_id, entity, distance, ref_id): the least distance of each observation to *each* entity, exactly.

    The complete table, for few entities or where every one is wanted: see
    ``nearest_entities`` for the k nearest, which compares a part of the pairs only.
    References of up to ``small`` bytes are broadcast and the observations stay where they
    are.  Beyond that both sides are cut into blocks, of GROUP bytes of references or about ``block`` rows, and each pair of
    blocks is a task's matrix, so a task's memory stays the same at any size.  ``leave_out``
    skips a reference with the observation's own id.  Null vectors and other lengths match
    nothing; rows of one observation id are one observation.
    """
    a = obs.filter(F.col(vector).isNotNull()).select(F.col(obs_id).alias("obs"), F.col(vector).alias("v"))
    b = refs.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(entity).isNotNull()).select(F.col(ref_id).alias("ref"), F.col(entity).alias("entity"), F.col(vector).alias("w"))
    kinds = {**dict(a.dtypes), **dict(b.dtypes)}
    schema = f"obs {kinds['obs']}, entity {kinds['entity']}, ref {kinds['ref']}, distance double"
    count, numbers = b.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    if 8 * numbers + 64 * count <= small:
        known = obs.sparkSession.sparkContext.broadcast(Every(kind, b.toPandas()))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield from known.value.least(rows, leave_out)

        part = a.mapInPandas(near, schema)
    else:
        held = block or max(1, GROUP * count // (8 * numbers))
        seen, cols, cores = a.count(), max(1, -(-count // held)), obs.sparkSession.sparkContext.defaultParallelism
        # Enough blocks for all cores, but none of so few observations that references are copied for little.
        rows = max(1, -(-seen // (block or max(1, min(held // 4, max(ALONE, seen * cols // (4 * cores)))))))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        cell, tasks = F.col("r") * cols + F.col("c"), min(4 * rows * cols, TASKS * cores)
        a = a.withColumn("r", F.pmod(F.xxhash64("obs"), F.lit(rows))).withColumn("c", every(cols)).select("obs", "v", cell.alias("cell")).repartition(tasks, "cell")
        b = b.withColumn("c", F.pmod(F.xxhash64("ref"), F.lit(cols))).withColumn("r", every(rows)).select("ref", "entity", "w", cell.alias("cell")).repartition(tasks, "cell")

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            found = list(Every(kind, y).least(x, leave_out)) if len(x) and len(y) else []
            return pd.concat(found, ignore_index=True) if found else nothing("obs", "entity", "ref", "distance")

        part = a.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(meet, schema)
    best = part.groupBy("obs", "entity").agg(F.min(F.struct("distance", "ref")).alias("m"))
    return best.select(F.col("obs").alias(obs_id), "entity", F.col("m.distance").alias("distance"), F.col("m.ref").alias("ref_id"))


def pair_distance(kind: str, a: Column, b: Column) -> Column:
    """Distance of two vectors of one length in SQL functions; null for two lengths."""
    if kind == "l1":
        return l1(a, b)
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(square / F.size(a)) if kind == "rmse" else F.sqrt(square))


def truth_reach(obs: DataFrame, refs: DataFrame, obs_id: str, ref_id: str, entity: str, vector: str, truth: str, kind: str = "l1", leave_out: bool = False, reach: str = "reach") -> DataFrame:
    """``obs`` with ``reach``: a distance within which its true entity is, by one reference of that entity; null where it has none.

    ``nearest_entities`` with this reach holds all entities that are nearer than the true one, and so its rank.
    """
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c))
    ends = refs.filter(whole).groupBy(F.col(entity).alias("_e"), F.size(vector).alias("_size")).agg(F.min(F.struct(F.col(ref_id).alias("id"), F.col(vector).alias("v"))).alias("_a"), F.max(F.struct(F.col(ref_id).alias("id"), F.col(vector).alias("v"))).alias("_b"))
    far = [F.when(~F.col(f"{c}.id").eqNullSafe(F.col(obs_id)) if leave_out else F.lit(True), pair_distance(kind, F.col(vector), F.col(f"{c}.v"))) for c in ("_a", "_b")]
    return obs.join(ends, (obs[truth] == F.col("_e")) & (F.size(obs[vector]) == F.col("_size")), "left").withColumn(reach, F.coalesce(F.least(*far), *far) * (1 + SLACK)).drop("_e", "_size", "_a", "_b")


def bit_masks(candidates: DataFrame, group: str, bits: str) -> DataFrame:
    """(group, mask): 1 at the positions of a bit array at which the candidates of a group differ."""
    each = candidates.select(group, F.posexplode(bits).alias("_at", "_bit"))
    varies = each.groupBy(group, "_at").agg((F.max("_bit") != F.min("_bit")).cast("int").alias("_varies"))
    listed = varies.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_at", "_varies"))).alias("_m"))  # as long as a vector
    return listed.select(group, F.transform("_m", lambda m: m["_varies"]).alias("mask"))


def ranked(scored: DataFrame, obs_id: str) -> DataFrame:
    """Adds rank by distance, then entity."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(obs_id).orderBy("distance", "entity")))


def top_margin(scored: DataFrame, obs_id: str) -> DataFrame:
    """Per observation: the nearest entity, its distance, the margin to the next entity (null if alone), and its reference."""
    order = Window.partitionBy(obs_id).orderBy("distance", "entity")
    return scored.withColumns({"rank": F.row_number().over(order), "margin": F.lead("distance").over(order) - F.col("distance")}).filter("rank = 1").drop("rank")


def near_ties(scored: DataFrame, obs_id: str, delta: float = DELTA) -> DataFrame:
    """Adds near_tie: another entity is within ``delta`` of the nearest; and is_top."""
    every, order = Window.partitionBy(obs_id), Window.partitionBy(obs_id).orderBy("distance", "entity")
    first = scored.withColumns({"_low": F.min("distance").over(every), "_rn": F.row_number().over(order)})
    tie = F.max(F.when((F.col("_rn") > 1) & (F.col("distance") - F.col("_low") <= delta), True).otherwise(False)).over(every)
    return first.withColumns({"near_tie": tie, "is_top": F.col("_rn") == 1}).drop("_low", "_rn")


def expected_rank(scored: DataFrame, truth: DataFrame, obs_id: str, entity: str) -> DataFrame:
    """Rank and distance of the true entity; null where it isn't among the references."""
    known = ranked(scored, obs_id).select(F.col(obs_id), F.col("entity").alias(entity), F.col("rank").alias("expected_rank"), F.col("distance").alias("expected_distance"))
    return truth.join(known, [obs_id, entity], "left")


def nearest_unique(scored: DataFrame, obs_id: str, max_distance: float = MAX_DISTANCE, delta: float = DELTA) -> DataFrame:
    """The nearest entity where it is near enough and no other is within ``delta`` of it; others are left out."""
    return top_margin(scored, obs_id).filter((F.col("distance") <= max_distance) & (F.col("margin").isNull() | (F.col("margin") > delta)))


def vector_match(obs: DataFrame, scored: DataFrame, obs_id: str, ready: Column, has_feature: Column, max_distance: float = MAX_DISTANCE, delta: float = DELTA) -> DataFrame:
    """Status per observation: matched, ambiguous (another entity within delta), not_found, missing_feature, insufficient_input."""
    top = top_margin(scored, obs_id)
    out = obs.withColumns({"_ready": F.coalesce(ready, F.lit(False)), "_feature": F.coalesce(has_feature, F.lit(False))}).join(top, obs_id, "left")
    status = F.when(~F.col("_ready"), "insufficient_input").when(~F.col("_feature"), "missing_feature").when(F.col("distance").isNull() | (F.col("distance") > max_distance), "not_found").when(F.col("margin") <= delta, "ambiguous").otherwise("matched")
    return out.withColumn("match_status", status).drop("_ready", "_feature")


def blocked_distances(obs: DataFrame, refs: DataFrame, block: list[str], obs_id: str, entity: str, distance: Column) -> DataFrame:
    """Least distance to each entity among references that share the observation's block; ``distance`` reads both sides' columns."""
    return obs.join(refs, block).withColumn("distance", distance).groupBy(obs_id, F.col(entity).alias("entity")).agg(F.min("distance").alias("distance"))


def rerank(scored: DataFrame, second: DataFrame, obs_id: str, delta: float, first_delta: float = DELTA) -> DataFrame:
    """Only entities of an ambiguous set (within ``first_delta`` of the top), ordered by a second distance
    (which leaves out an observation's own reference: see ``leave_out``): resolved_candidate, ambiguous_candidate (another entity within ``delta``) or missing_feature (none has a second distance)."""
    low = F.min("distance").over(Window.partitionBy(obs_id))
    near = scored.withColumn("_low", low).filter(F.col("distance") - F.col("_low") <= first_delta)
    many = near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(obs_id))).filter("_n > 1").select(obs_id, "entity")
    again = top_margin(many.join(second.select(obs_id, "entity", "distance"), [obs_id, "entity"]), obs_id)
    out = many.select(obs_id).distinct().join(again, obs_id, "left")
    return out.withColumn("rerank_status", F.when(F.col("distance").isNull(), "missing_feature").when(F.col("margin") <= delta, "ambiguous_candidate").otherwise("resolved_candidate"))


def gated_rerank(ambiguous: DataFrame, stages: list[tuple[str, DataFrame]], obs_id: str, max_distance: float = 0.35, delta: float = 0.01, chains: dict[str, DataFrame] | None = None) -> DataFrame:
    """Stages in order over (obs, entity) sets; a stage counts only if *every* entity of the set has a distance.

    Then over ``max_distance`` is insufficient and another entity within ``delta`` is
    ambiguous; the first stage that resolves decides.  An ambiguous stage is settled by its
    chain, if it has one and that has a row (obs, entity, distance, margin, chain): see
    ``rerank.near_tie_chain``.  Adds distance and margin of what decided.
    """
    sets = ambiguous.groupBy(obs_id).agg(F.count_distinct("entity").alias("_size"))
    out = sets
    for name, second in stages:
        inside = ambiguous.join(second.select(obs_id, "entity", "distance"), [obs_id, "entity"])
        whole = inside.groupBy(obs_id).agg(F.count_distinct("entity").alias("_have"))
        top = top_margin(inside, obs_id).join(whole, obs_id).select(obs_id, F.col("entity").alias(f"_e_{name}"), F.col("distance").alias(f"_d_{name}"), F.col("margin").alias(f"_m_{name}"), F.col("_have").alias(f"_h_{name}"))
        out = out.join(top, obs_id, "left")
        if chains and name in chains:
            out = out.join(chains[name].select(obs_id, F.col("entity").alias("_ce"), F.col("distance").alias("_cd"), F.col("margin").alias("_cm"), F.col("chain").alias("_cn")), obs_id, "left")
        else:
            out = out.withColumns({"_ce": F.lit(None).cast(dict(top.dtypes)[f"_e_{name}"]), "_cd": F.lit(None).cast("double"), "_cm": F.lit(None).cast("double"), "_cn": F.lit(None).cast("string")})
        tie = F.col(f"_m_{name}") <= delta
        state = F.when(F.coalesce(F.col(f"_h_{name}") < F.col("_size"), F.lit(True)), "incomplete").when(F.col(f"_d_{name}") > max_distance, "insufficient").when(tie & F.col("_cn").isNotNull(), F.concat(F.lit("resolved_"), "_cn")).when(tie, "ambiguous").otherwise("resolved")
        out = out.withColumn(f"{name}_state", state)
        chained = F.startswith(F.col(f"{name}_state"), F.lit("resolved_"))
        out = out.withColumns({f"_{c}_{name}": F.when(chained, F.col(f"_c{c}")).otherwise(F.col(f"_{c}_{name}")) for c in "edm"}).drop("_ce", "_cd", "_cm", "_cn")
    status, by = F.lit("unresolved"), F.lit(None).cast("string")
    picked = {c: F.lit(None) for c in "edm"}
    for name, _ in reversed(stages):
        good = F.startswith(F.col(f"{name}_state"), F.lit("resolved"))
        status, by = F.when(good, "resolved").otherwise(status), F.when(good, name).otherwise(by)
        picked = {c: F.when(good, F.col(f"_{c}_{name}")).otherwise(v) for c, v in picked.items()}
    return out.select(obs_id, status.alias("rerank_status"), picked["e"].alias("entity"), by.alias("decided_by"), picked["d"].alias("distance"), picked["m"].alias("margin"), *[f"{n}_state" for n, _ in stages])


def identity_signal(primary: Column, entity: Column, auxiliary: list[tuple[str, Column, Column]], failure: Column) -> list[Column]:
    """Columns signal_status, signal_source, signal_entity and signal_reason from a primary status and auxiliaries in fixed order."""
    resolved = [(n, s == "resolved_candidate", e) for n, s, e in auxiliary]
    ambiguous = primary == "ambiguous"
    source, found = F.lit(None).cast("string"), F.lit(None)
    for name, good, ent in reversed(resolved):
        source, found = F.when(good, name).otherwise(source), F.when(good, ent).otherwise(found)
    helped = ambiguous & source.isNotNull()
    known = primary.isin("insufficient_input", "missing_feature", "not_found")
    status = F.when(primary == "matched", "resolved_candidate").when(helped, "composite_resolved_candidate").when(ambiguous, "unresolved_ambiguous").when(known, F.concat(F.lit("unresolved_"), primary)).otherwise("unresolved_unknown")
    reason = F.when(primary == "matched", "unique_candidate").when(helped, F.concat(F.lit("ambiguous_"), source, F.lit("_resolved"))).when(ambiguous, "ambiguous_without_auxiliary_resolution").when(known, F.coalesce(F.nullif(failure, F.lit("")), primary)).otherwise(F.coalesce(F.nullif(primary, F.lit("")), F.lit("missing_match_status")))
    return [status.alias("signal_status"), F.when(primary == "matched", "primary").when(helped, source).alias("signal_source"), F.when(primary == "matched", entity).when(helped, found).alias("signal_entity"), reason.alias("signal_reason")]


def nearest_centroid(df: DataFrame, refs: DataFrame, obs_id: str, label: str, vector: str) -> DataFrame:
    """Euclidean distance to the mean vector of each label; ties by label."""
    means = refs.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"))
    centre = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    return nearest_entities(df, centre.withColumnRenamed("mean", vector).withColumnRenamed(label, "_label"), obs_id, "_label", "_label", vector, 1, kind="l2").drop("ref_id")


def digit_gate(segments: DataFrame, templates: DataFrame, item: str, pos: str, label: str, vector: str, max_distance: float = 0.28, min_margin: float = 0.02) -> DataFrame:
    """Per item: labels of its segments in order, status recognized or ambiguous with a reason, mean distance and confidence."""
    seg = segments.withColumn("_seg", F.struct(item, pos)).withColumn("_sid", F.xxhash64(item, pos))
    best = top_margin(nearest_entities(seg.select("_sid", vector), templates.withColumn("_tid", F.xxhash64(label, vector)), "_sid", "_tid", label, vector, 2), "_sid")
    # Without a second label the rival is at distance 1.
    joined = seg.select(item, pos, "_sid").join(best, "_sid").withColumn("margin", F.coalesce("margin", F.lit(1.0) - F.col("distance")))
    joined = joined.withColumn("_why", F.when(F.col("distance") > max_distance, "distance_above_threshold").when(F.col("margin") < min_margin, "low_margin"))
    read = joined.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(pos, F.col("entity").cast("string").alias("e")))).alias("_s"), F.avg("distance").alias("mean_distance"), F.max_by("_why", F.when(F.col("_why").isNotNull(), F.col(pos))).alias("reason"), F.count(F.lit(1)).alias("segments"))
    return read.select(item, F.array_join(F.transform("_s", lambda s: s["e"]), "").alias("value"), F.when(F.col("reason").isNull(), "recognized").otherwise("ambiguous").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), "mean_distance", (F.lit(1.0) - F.least(F.lit(1.0), F.col("mean_distance") / max_distance)).alias("confidence"), "segments")


#: Members of a signature that are joined pair by pair; rows of a block beyond that.
FEW, PAIR_BLOCK = 64, 1024


def _close_in_block(table: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of entities of a block pair, with their least distance up to ``threshold``; rows of side 0 meet those of side 1, or all meet each other."""
    out = []
    left, right = table[table["side"] == 0], table[table["side"] == 1]
    if not len(left) or (not len(right) and table["same"].iloc[0] != 1):
        return nothing("sig", "a", "b", "distance")
    right = left if table["same"].iloc[0] == 1 else right
    w, other = np.stack(right["v"].to_list()).astype(float), right["e"].to_numpy()
    for e, v in zip(left["e"].to_numpy(), left["v"]):
        d = distances("l1", np.asarray(v, float)[None, :], w)[0]
        use = np.flatnonzero((d <= threshold) & ((other > e) if table["same"].iloc[0] == 1 else (other != e)))
        if len(use):
            out.append(pd.DataFrame({"a": np.minimum(other[use], e), "b": np.maximum(other[use], e), "distance": d[use]}))
    if not out:
        return nothing("sig", "a", "b", "distance")
    least = pd.concat(out).groupby(["a", "b"], as_index=False)["distance"].min()
    least.insert(0, "sig", pd.Series([table["sig"].iloc[0]] * len(least), dtype=object))
    return least


def _close_in_rings(each: DataFrame, threshold: float, block: int) -> DataFrame:
    """(sig, a, b, distance) of signatures with many members, each (sig, size, e, v).

    By the triangle inequality only vectors whose distances to a pivot differ by at most the
    threshold can be that near: rings of this width meet themselves and the next one.  A
    ring of many is cut into blocks by entity, and each pair of blocks is a task of its own.
    """
    pivot = each.groupBy("sig", "size").agg(F.min_by("v", "e").alias("p"))
    # A little wider than the threshold, so that rounding parts no pair by more than a ring.
    ringed = each.join(pivot, ["sig", "size"]).withColumn("ring", F.floor(l1(F.col("v"), F.col("p")) / (threshold * (1 + 1e-9) + 1e-12)).cast("long")).drop("p")
    counts = ringed.groupBy("sig", "size", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    beside = [counts.select("sig", "size", (F.col("ring") - k).alias("ring"), F.col("blocks").alias(name)) for k, name in ((0, "own"), (1, "after"), (-1, "before"))]
    for other, how in zip(beside, ("inner", "left", "left")):
        ringed = ringed.join(other, ["sig", "size", "ring"], how)
    at = F.pmod(F.xxhash64("e"), F.col("own"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    place = lambda ring, same, i, j, side: F.struct(ring.alias("r"), F.lit(same).alias("same"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    zero, none = F.lit(0), F.lit(0).cast("long")
    inside = F.transform(upto(F.col("own")), lambda k: F.when(k == F.col("at"), place(F.col("ring"), 1, k, k, zero)).otherwise(place(F.col("ring"), 0, F.least(k, F.col("at")), F.greatest(k, F.col("at")), k < F.col("at"))))
    onward = F.transform(upto(F.coalesce("after", none)), lambda k: place(F.col("ring"), 2, F.col("at"), k, zero))
    back = F.transform(upto(F.coalesce("before", none)), lambda k: place(F.col("ring") - 1, 2, k, F.col("at"), F.lit(1)))
    dealt = ringed.withColumn("at", at).select("sig", "size", "e", "v", F.explode(F.concat(inside, onward, back)).alias("g")).select("sig", "size", "e", "v", "g.*")
    kind = dict(each.dtypes)
    return dealt.groupBy("sig", "size", "r", "same", "i", "j").applyInPandas(lambda t: _close_in_block(t, threshold), f"sig {kind['sig']}, a {kind['e']}, b {kind['e']}, distance double")


def near_pairs(vectors: DataFrame, entity: str, signature: str, vector: str, threshold: float = 0.12, few: int = FEW, block: int = PAIR_BLOCK) -> DataFrame:
    """Unordered pairs of entities that share a signature, with their least distance up to ``threshold``.

    Signatures make the pairs, so only entities that share one meet; ``vectors`` has a row
    per (entity, signature, reference), and all references of an entity count.  Signatures
    of up to ``few`` rows are joined; those of more are cut into rings and blocks, so one
    signature on all vectors runs in many tasks.  Only pairs that are near enough leave
    them, with the signature that they were found by.  Null vectors and entities, and
    vectors of two lengths, are near nothing.
    """
    rows = vectors.select(F.col(entity).alias("e"), F.col(signature).alias("sig"), F.col(vector).alias("v")).filter("e IS NOT NULL")
    refs = rows.filter("v IS NOT NULL").select("e", "v").distinct()
    each = rows.select("e", "sig").filter("sig IS NOT NULL").distinct().join(refs, "e").withColumn("size", F.size("v"))
    held = each.groupBy("sig", "size").agg(F.count(F.lit(1)).alias("_n"))
    each = each.join(held, ["sig", "size"])
    small, large = each.filter(F.col("_n") <= few).drop("_n"), each.filter(F.col("_n") > few).drop("_n")
    x, y = small.select("sig", "size", F.col("e").alias("a"), F.col("v").alias("va")), small.select("sig", "size", F.col("e").alias("b"), F.col("v").alias("vb"))
    met = x.join(y, ["sig", "size"]).filter("a < b").select("sig", "a", "b", l1(F.col("va"), F.col("vb")).alias("distance")).filter(F.col("distance") <= threshold)
    near = met.unionByName(_close_in_rings(large, threshold, block)).groupBy("a", "b").agg(F.min("distance").alias("distance"), F.array_sort(F.collect_set("sig")).alias("common"))
    band = F.lit(OTHER_BAND)
    for limit, name in reversed(RISK_BANDS):
        band = F.when(F.col("distance") <= limit, name).otherwise(band)
    return near.select("a", "b", F.round("distance", 6).alias("distance"), band.alias("risk_band"), F.size("common").alias("common_count"), F.array_join("common", " | ").alias("common_signatures"))


def partners(pairs: DataFrame) -> DataFrame:
    """(entity, partner, distance, min_distance, partner_count): a row for each partner of each entity."""
    both = pairs.select(F.col("a").alias("entity"), F.col("b").alias("partner"), "distance").unionByName(pairs.select(F.col("b").alias("entity"), F.col("a").alias("partner"), "distance"))
    known = both.groupBy("entity").agg(F.min("distance").alias("min_distance"), F.count(F.lit(1)).alias("partner_count"))
    return both.join(known, "entity")


def top_candidates(scored: DataFrame, obs_id: str, shown: Column, n: int = 5) -> DataFrame:
    """The n nearest as text, joined by bars."""
    best = ranked(scored, obs_id).filter(F.col("rank") <= n)
    return best.groupBy(obs_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("text")))), lambda s: s["text"]), " | ").alias("top_candidates"))
