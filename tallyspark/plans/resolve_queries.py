"""Resolution over ``part`` as catalog (titles made from name and key) and observations derived from it; vectors from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.scores import match_confidence
from tallyspark.operators import nearest as N
from tallyspark.operators import rerank as K
from tallyspark.operators import resolve as R
from tallyspark.plans.registry import Tables, query

SQL = """song AS (SELECT p_partkey AS song_id, p_name || ' ' || (p_partkey % 400) AS title, p_brand AS artist, p_size % 3 <> 0 AS available,
        p_type || ' No.' || (p_partkey % 150) AS alias, p_brand AS style, p_type AS difficulty, p_size AS level FROM part),
    obs AS (SELECT song_id AS obs_id, CASE song_id % 7 WHEN 0 THEN title WHEN 1 THEN upper(title) WHEN 2 THEN alias WHEN 3 THEN title WHEN 4 THEN upper(alias) WHEN 5 THEN 'nothing ' || song_id ELSE '' END AS title,
        CASE WHEN song_id % 7 = 3 THEN 'someone' WHEN song_id % 7 IN (1, 4) THEN lower(artist) ELSE artist END AS artist, style, difficulty, level FROM song),
    keyed AS (SELECT *, lower(replace(title, ' ', '')) AS t, lower(replace(artist, ' ', '')) AS a, lower(replace(alias, ' ', '')) AS l FROM song),
    seen AS (SELECT *, lower(replace(title, ' ', '')) AS t, lower(replace(artist, ' ', '')) AS a FROM obs)"""


def songs(t: Tables) -> DataFrame:
    s = t.part.select(F.col("p_partkey").alias("song_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 400).alias("title"), F.col("p_brand").alias("artist"), (F.col("p_size") % 3 != 0).alias("available"), F.concat("p_type", F.lit(" No."), F.col("p_partkey") % 150).alias("alias"), F.col("p_brand").alias("style"), F.col("p_type").alias("difficulty"), F.col("p_size").alias("level"))
    return s.withColumns({"t": X.match_key("title"), "a": X.match_key("artist"), "l": X.match_key("alias")})


def observations(t: Tables) -> DataFrame:
    k = F.col("song_id") % 7
    title = F.when(k.isin(0, 3), F.col("title")).when(k == 1, F.upper("title")).when(k == 2, F.col("alias")).when(k == 4, F.upper("alias")).when(k == 5, F.concat(F.lit("nothing "), F.col("song_id"))).otherwise("")
    artist = F.when(k == 3, "someone").when(k.isin(1, 4), F.lower("artist")).otherwise(F.col("artist"))
    o = songs(t).select(F.col("song_id").alias("obs_id"), title.alias("title"), artist.alias("artist"), "style", "difficulty", "level")
    return o.withColumns({"t": X.match_key("title"), "a": X.match_key("artist")})


def pair(*cols: str) -> F.Column:
    """Null where a part is blank, so that it never is a key."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & (F.col(c) != "")
    return F.when(whole, F.concat_ws("\x1f", *cols))


LABELS = {
    1: ("canonical_exact", "ambiguous_canonical_exact_pair"), 2: ("alias_exact", "ambiguous_alias_exact_pair"), 3: ("canonical_notation_difference", "ambiguous_canonical_normalized_pair"), 4: ("alias_notation_difference", "ambiguous_alias_normalized_pair"),
    5: ("canonical_unique_title_artist_difference", "ambiguous_canonical_exact_title"), 6: ("alias_unique_title_artist_difference", "ambiguous_alias_exact_title"),
    7: ("canonical_unique_title_notation_or_artist_difference", "ambiguous_canonical_normalized_title"), 8: ("alias_unique_title_notation_or_artist_difference", "ambiguous_alias_normalized_title"),
}
EIGHT = """c AS (SELECT 1 AS step, title || chr(31) || artist AS key, song_id FROM keyed UNION ALL SELECT 2, alias || chr(31) || artist, song_id FROM keyed UNION ALL SELECT 3, t || chr(31) || a, song_id FROM keyed UNION ALL SELECT 4, l || chr(31) || a, song_id FROM keyed
        UNION ALL SELECT 5, title, song_id FROM keyed UNION ALL SELECT 6, alias, song_id FROM keyed UNION ALL SELECT 7, t, song_id FROM keyed UNION ALL SELECT 8, l, song_id FROM keyed),
    o AS (SELECT obs_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS step, unnest([title || chr(31) || artist, title || chr(31) || artist, t || chr(31) || a, t || chr(31) || a, title, title, t, t]) AS key FROM seen WHERE t <> '' AND a <> ''),
    h AS (SELECT obs_id, step, count(DISTINCT song_id) AS n, min(song_id) AS song FROM o JOIN c USING (step, key) GROUP BY ALL),
    f AS (SELECT obs_id, min(step) AS step, min_by(n, step) AS n, min_by(song, step) AS song FROM h GROUP BY obs_id)"""


def _names(k: int) -> str:
    return "CASE step " + " ".join(f"WHEN {n} THEN '{v[k]}'" for n, v in LABELS.items()) + " END"


def eight(t: Tables) -> DataFrame:
    s = songs(t)
    return R.keyed(s, "song_id", {1: pair("title", "artist"), 2: pair("alias", "artist"), 3: pair("t", "a"), 4: pair("l", "a"), 5: F.col("title"), 6: F.col("alias"), 7: F.col("t"), 8: F.col("l")})


@query(f"""WITH {SQL}, {EIGHT} SELECT obs_id, CASE WHEN n = 1 THEN {_names(0)} ELSE 'unresolved' END AS status,
    CASE WHEN t = '' OR a = '' THEN 'missing_title_or_artist' WHEN n IS NULL THEN 'title_not_found' WHEN n = 1 THEN '' ELSE {_names(1)} END AS reason, CASE WHEN n = 1 THEN song END AS entity FROM seen LEFT JOIN f USING (obs_id)""")
def j14_map_cascade(t: Tables) -> DataFrame:
    steps = {1: pair("title", "artist"), 2: pair("title", "artist"), 3: pair("t", "a"), 4: pair("t", "a"), 5: F.col("title"), 6: F.col("title"), 7: F.col("t"), 8: F.col("t")}
    return R.map_cascade(observations(t), "obs_id", (F.col("t") != "") & (F.col("a") != ""), steps, eight(t), LABELS).select("obs_id", "status", "reason", "entity")


@query(f"""WITH {SQL}, c AS (SELECT 1 AS step, title AS key, song_id FROM keyed UNION ALL SELECT 1, alias, song_id FROM keyed UNION ALL SELECT 2, t, song_id FROM keyed UNION ALL SELECT 2, l, song_id FROM keyed),
    o AS (SELECT obs_id, unnest([1, 2]) AS step, unnest([title, t]) AS key FROM seen WHERE t <> ''),
    h AS (SELECT obs_id, step, count(DISTINCT song_id) AS n, list_sort(list(DISTINCT song_id)) AS e FROM o JOIN c USING (step, key) GROUP BY ALL),
    f AS (SELECT obs_id, min(step) AS step, min_by(n, step) AS n, min_by(e, step) AS e FROM h GROUP BY obs_id)
    SELECT obs_id, CASE WHEN t = '' THEN 'incomplete' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN step = 1 THEN 'exact' ELSE 'normalized' END AS status, coalesce(array_to_string(e, ','), '') AS entities FROM seen LEFT JOIN f USING (obs_id)""")
def j15_u1_strict_lookup(t: Tables) -> DataFrame:
    s = songs(t)
    cat = R.keyed(s, "song_id", {1: [F.col("title"), F.col("alias")], 2: [F.col("t"), F.col("l")]})
    out = R.strict_lookup(observations(t), "obs_id", F.col("t") != "", F.col("title"), F.col("t"), cat)
    return out.select("obs_id", "status", F.array_join(F.col("entities").cast("array<string>"), ",").alias("entities"))


TITLE = """c AS (SELECT 1 AS step, t AS key, song_id FROM keyed UNION ALL SELECT 2, l, song_id FROM keyed),
    h AS (SELECT obs_id, c.step, count(DISTINCT song_id) AS n, list_sort(list(DISTINCT song_id)) AS e FROM seen JOIN c ON t = key WHERE t <> '' GROUP BY ALL),
    f AS (SELECT obs_id, min(step) AS step, min_by(n, step) AS n, min_by(e, step) AS e FROM h GROUP BY obs_id)"""


@query(f"""WITH {SQL}, {TITLE} SELECT obs_id, CASE WHEN t = '' THEN 'missing_label' WHEN n IS NULL THEN 'title_not_found' ELSE CASE WHEN n = 1 THEN 'resolved_' ELSE 'ambiguous_' END || CASE step WHEN 1 THEN 'title' ELSE 'alias' END END AS status,
    CASE WHEN n = 1 THEN e[1] END AS entity FROM seen LEFT JOIN f USING (obs_id)""")
def j11_resolve_title(t: Tables) -> DataFrame:
    cat = R.keyed(songs(t), "song_id", {1: F.col("t"), 2: F.col("l")})
    return R.resolve_title(observations(t), "obs_id", F.col("t"), None, cat).select("obs_id", "status", "entity")


@query(f"""WITH {SQL}, {TITLE}, m AS (SELECT s.obs_id, s.a, unnest(e) AS song_id FROM seen s JOIN f USING (obs_id) WHERE n > 1),
    b AS (SELECT obs_id, min(m.song_id) AS broken FROM m JOIN keyed k ON m.song_id = k.song_id AND m.a = k.a GROUP BY obs_id HAVING count(DISTINCT m.song_id) = 1)
    SELECT obs_id, CASE WHEN t = '' THEN 'missing_label' WHEN n IS NULL THEN 'title_not_found' WHEN n = 1 THEN 'resolved_' || CASE step WHEN 1 THEN 'title' ELSE 'alias' END WHEN broken IS NOT NULL THEN 'resolved_artist' ELSE 'ambiguous_' || CASE step WHEN 1 THEN 'title' ELSE 'alias' END END AS status,
    CASE WHEN n = 1 THEN e[1] ELSE broken END AS entity FROM seen LEFT JOIN f USING (obs_id) LEFT JOIN b USING (obs_id)""")
def j12_resolve_title_artist(t: Tables) -> DataFrame:
    s = songs(t)
    cat = R.keyed(s, "song_id", {1: F.col("t"), 2: F.col("l")})
    return R.resolve_title(observations(t), "obs_id", F.col("t"), F.col("a"), cat, s.select(F.col("song_id").alias("entity"), F.col("a").alias("artist"))).select("obs_id", "status", "entity")


@query(f"""WITH {SQL}, c AS (SELECT 1 AS step, t || chr(31) || a AS key, song_id FROM keyed UNION ALL SELECT 2, l || chr(31) || a, song_id FROM keyed UNION ALL SELECT 3, t, song_id FROM keyed UNION ALL SELECT 3, l, song_id FROM keyed),
    o AS (SELECT obs_id, unnest([1, 2, 3]) AS step, unnest([t || chr(31) || a, t || chr(31) || a, t]) AS key FROM seen WHERE t <> '' AND a <> '' AND level % 11 <> 0),
    h AS (SELECT obs_id, step, count(DISTINCT song_id) AS n, min(song_id) AS e FROM o JOIN c USING (step, key) GROUP BY ALL),
    f AS (SELECT obs_id, min(step) AS step, min_by(n, step) AS n, min_by(e, step) AS e FROM h GROUP BY obs_id),
    x AS (SELECT s.*, f.step, f.n, f.e, k.available, s.level % 11 <> 0 AS ok, s.t <> '' AND s.a <> '' AS whole, s.level % 13 <> 0 AS feature FROM seen s LEFT JOIN f USING (obs_id) LEFT JOIN keyed k ON f.e = k.song_id)
    SELECT obs_id, CASE WHEN NOT ok OR NOT whole OR n IS NULL THEN 'unresolved' WHEN step = 3 OR n > 1 THEN 'needs_review' WHEN NOT feature THEN 'unresolved' WHEN NOT available THEN 'needs_review' ELSE 'auto_confirmed' END AS status,
    CASE WHEN NOT ok THEN 'observation_not_ok' WHEN NOT whole THEN 'missing_title_or_artist' WHEN n IS NULL THEN 'identity_not_found' WHEN step = 3 THEN 'title_match_artist_mismatch'
         WHEN n > 1 THEN 'ambiguous_' || CASE step WHEN 1 THEN 'canonical' ELSE 'alias' END || '_title_artist' WHEN NOT feature THEN 'feature_extraction_failed' WHEN NOT available THEN 'entity_not_available' ELSE CASE step WHEN 1 THEN 'canonical' ELSE 'alias' END || '_title_artist_exact' END AS reason,
    CASE WHEN step < 3 AND n = 1 THEN e END AS entity FROM x""")
def j13_resolve_pair(t: Tables) -> DataFrame:
    s = songs(t)
    cat = R.keyed(s, "song_id", {1: pair("t", "a"), 2: pair("l", "a"), 3: [F.col("t"), F.col("l")]})
    out = R.resolve_pair(observations(t), "obs_id", F.col("level") % 11 != 0, F.col("level") % 13 != 0, F.coalesce(pair("t", "a"), F.lit("")), F.col("t"), cat, s.select(F.col("song_id").alias("entity"), "available"), candidates=False)
    return out.select("obs_id", "status", "reason", "entity")


@query(f"""WITH {SQL} SELECT obs_id, nullif(title, '') IS NOT NULL AND level % 4 <> 0 AND level IS NOT NULL AS block_ready,
    CASE WHEN NOT (nullif(title, '') IS NOT NULL AND level % 4 <> 0) THEN 'missing_block_fields=' || concat_ws(',', CASE WHEN title = '' THEN 'title' END, CASE WHEN level % 4 = 0 THEN 'level' END) END AS block_reason FROM obs""")
def f2_block_ready(t: Tables) -> DataFrame:
    ok = F.lit("ready")
    fields = {"title": (ok, F.col("title")), "style": (ok, F.col("style")), "level": (F.when(F.col("level") % 4 == 0, "missing").otherwise("ready"), F.col("level"))}
    return R.block_ready(observations(t), fields).select("obs_id", "block_ready", "block_reason")


@query(f"WITH {SQL} SELECT obs_id, s.song_id FROM obs o JOIN song s USING (style, difficulty, level) WHERE s.available")
def j5_block_candidates(t: Tables) -> DataFrame:
    charts = songs(t).select("song_id", "style", "difficulty", "level", "available")
    return R.block_candidates(observations(t), charts, ["style", "difficulty", "level"], F.col("available")).select("obs_id", "song_id")


@query()
def j6_p20_fuzzy_match(t: Tables) -> DataFrame:
    """Ratcliff/Obershelp has no SQL form: tested against difflib."""
    charts = songs(t).select("song_id", F.col("title"), F.col("artist"), X.title_key("title").alias("known"), "style", "level")
    obs = observations(t).withColumn("seen", X.title_key("title")).select("obs_id", "seen", "style", "level")
    return R.fuzzy_match(obs, "obs_id", "seen", F.lit(True), charts, ["style", "level"], "known", "song_id").select("obs_id", "match_status", "match_reason", F.round("top_score", 6).alias("top_score"), "top_chart", "top_candidates")


OFFICIAL = "off AS (SELECT song_id, title AS otitle, artist AS oartist, t, a FROM keyed WHERE song_id % 5 <> 0)"


@query(f"""WITH {SQL}, {OFFICIAL}, c AS (SELECT 1 AS step, t || chr(31) || a AS key, song_id FROM off UNION ALL SELECT 2, t || chr(31) || a, song_id FROM off UNION ALL SELECT 3, t, song_id FROM off UNION ALL SELECT 4, t, song_id FROM off),
    o AS (SELECT song_id AS s, unnest([1, 2, 3, 4]) AS step, unnest([t || chr(31) || a, l || chr(31) || a, t, l]) AS key FROM keyed),
    h AS (SELECT s, step, count(DISTINCT song_id) AS n, min(song_id) AS e FROM o JOIN c USING (step, key) GROUP BY ALL),
    f AS (SELECT s, min(step) AS step, min_by(n, step) AS n, min_by(e, step) AS e FROM h GROUP BY s)
    SELECT song_id, CASE WHEN n IS NULL THEN 'not_found' ELSE CASE WHEN n = 1 THEN '' ELSE 'ambiguous_' END || CASE step WHEN 1 THEN 'pair' WHEN 2 THEN 'alias_pair' WHEN 3 THEN 'unique_title' ELSE 'alias_unique_title' END END AS availability,
    coalesce(n = 1, false) AS available, CASE WHEN n = 1 THEN e END AS official FROM keyed LEFT JOIN f ON song_id = s""")
def j16_apply_availability(t: Tables) -> DataFrame:
    s = songs(t)
    off = s.filter("song_id % 5 != 0")
    cat = R.keyed(off, "song_id", {1: pair("t", "a"), 2: pair("t", "a"), 3: F.col("t"), 4: F.col("t")})
    steps = {1: pair("t", "a"), 2: pair("l", "a"), 3: F.col("t"), 4: F.col("l")}
    return R.apply_availability(s.drop("available"), "song_id", steps, cat).select("song_id", "availability", "available", "official")


@query(f"""WITH {SQL}, {OFFICIAL}, u AS (SELECT t, min(song_id) AS e FROM off GROUP BY t HAVING count(DISTINCT song_id) = 1) SELECT k.song_id, k.title AS alias, o.title AS official_title FROM keyed k JOIN u USING (t) JOIN keyed o ON o.song_id = u.e WHERE o.title <> k.title
    UNION ALL SELECT k.song_id, k.title, o.title FROM keyed k JOIN u ON k.l = u.t JOIN keyed o ON o.song_id = u.e WHERE o.title <> k.title AND k.t NOT IN (SELECT t FROM off)""")
def j16_alias_rows(t: Tables) -> DataFrame:
    """Alias rows of songs that the official list knows by another title."""
    s = songs(t)
    off = s.filter("song_id % 5 != 0")
    steps = {1: F.col("t"), 2: F.col("l")}
    found = R.apply_availability(s.drop("available"), "song_id", steps, R.keyed(off, "song_id", {1: F.col("t"), 2: F.col("t")}), ("unique_title", "alias_unique_title"))
    return R.changed_names(found, off.select(F.col("song_id").alias("entity"), "title"), "song_id", "title")


@query(f"""WITH {SQL}, b AS (SELECT * FROM keyed WHERE song_id % 2 = 0), x AS (SELECT * FROM keyed WHERE song_id % 2 = 1), p AS (SELECT t, a, min(song_id) AS e FROM b GROUP BY ALL HAVING count(*) = 1), q AS (SELECT t, min(song_id) AS e FROM b GROUP BY ALL HAVING count(*) = 1)
    SELECT x.song_id, coalesce(p.e, q.e, x.song_id) AS reused_id, CASE WHEN p.e IS NOT NULL THEN 'exact' WHEN q.e IS NOT NULL THEN 'alias' ELSE 'new' END AS reused_by FROM x LEFT JOIN p ON x.t = p.t AND x.a = p.a LEFT JOIN q ON x.l = q.t""")
def j18_reuse_ids(t: Tables) -> DataFrame:
    """Odd songs take the id of the only even song of their title and artist, else of the one that their alias names."""
    s = songs(t)
    base = s.filter("song_id % 2 = 0").select("song_id", pair("t", "a").alias("exact"), F.col("t").alias("alias"))
    extra = s.filter("song_id % 2 = 1").select("song_id", pair("t", "a").alias("exact"), F.col("l").alias("alias"))
    return R.reuse_ids(base, extra, "song_id", ["exact", "alias"]).select("song_id", "reused_id", "reused_by")


@query(f"""WITH {SQL}, b AS (SELECT * FROM keyed WHERE song_id % 2 = 0), n AS (SELECT * FROM keyed WHERE song_id % 2 = 1 AND t NOT IN (SELECT t FROM b) QUALIFY row_number() OVER (PARTITION BY t ORDER BY song_id) = 1)
    SELECT song_id, title, false AS added FROM b UNION ALL SELECT song_id, title, true FROM n""")
def j17_add_missing(t: Tables) -> DataFrame:
    s = songs(t)
    return R.add_missing(s.filter("song_id % 2 = 0"), s.filter("song_id % 2 = 1"), "t", [F.col("song_id")]).select("song_id", "title", "added")


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.part.groupBy("p_brand", "p_type", (F.col("p_partkey") % 2).alias("half")).agg(F.max("p_size").alias("level"))
    return c.filter("half = 0").drop("half").filter("p_brand != 'Brand#3'"), c.filter("half = 1").drop("half")


HALVES = "c AS (SELECT p_brand, p_type, p_partkey % 2 AS half, max(p_size) AS level FROM part GROUP BY ALL), b AS (SELECT * FROM c WHERE half = 0 AND p_brand <> 'Brand#3'), e AS (SELECT * FROM c WHERE half = 1)"


@query(f"WITH {HALVES} SELECT p_brand, p_type, level FROM b UNION ALL SELECT p_brand, p_type, level FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.p_brand = e.p_brand AND b.p_type = e.p_type)")
def j18_merge_sources(t: Tables) -> DataFrame:
    return R.merge_sources(*_halves(t), ["p_brand", "p_type"], "level")[0]


@query(f"WITH {HALVES} SELECT p_brand, p_type, b.level AS base_level, e.level AS extra_level FROM b JOIN e USING (p_brand, p_type) WHERE b.level <> e.level")
def j18_merge_conflicts(t: Tables) -> DataFrame:
    return R.merge_sources(*_halves(t), ["p_brand", "p_type"], "level")[1]


@query(f"""WITH {SQL}, u AS (SELECT title, min(song_id) AS song_id FROM song GROUP BY title HAVING count(*) = 1), ch AS (SELECT song_id, style, difficulty, level FROM song WHERE song_id % 3 = 0),
    s AS (SELECT title, style, difficulty, CASE WHEN song_id % 6 = 0 THEN level + 1 ELSE level END AS level FROM song)
    SELECT s.title, s.style, s.difficulty, s.level, u.song_id, CASE WHEN u.song_id IS NULL THEN 'not_unique' WHEN ch.song_id IS NULL THEN 'added' WHEN ch.level = s.level THEN 'unchanged' ELSE 'conflict' END AS outcome
    FROM s LEFT JOIN u USING (title) LEFT JOIN ch ON ch.song_id = u.song_id AND ch.style = s.style AND ch.difficulty = s.difficulty""")
def j19_supplements(t: Tables) -> DataFrame:
    s = songs(t)
    charts = s.filter("song_id % 3 = 0").select("song_id", "style", "difficulty", "level", F.lit("").alias("notes"))
    supp = s.select("title", "style", "difficulty", F.when(F.col("song_id") % 6 == 0, F.col("level") + 1).otherwise(F.col("level")).alias("level"), F.lit("sheet").alias("source"))
    return R.apply_supplements(charts, s, supp)[1]


# --- vectors ---------------------------------------------------------------

L1 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len({a})"
L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))"
VEC = f"""o AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT vec_id AS ref, label AS entity, embedding AS w FROM embeddings WHERE vec_id % 5 <> 0),
    d AS (SELECT vec_id, entity, min({L1.format(a='embedding', b='w')}) AS distance FROM o, r GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, entity) AS rank, lead(distance) OVER (PARTITION BY vec_id ORDER BY distance, entity) - distance AS margin FROM d)"""


def vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings
    return e.filter("vec_id % 5 = 0"), e.filter("vec_id % 5 != 0")


def scored(t: Tables) -> DataFrame:
    """Every observation with every entity."""
    obs, refs = vectors(t)
    return N.entity_distances(obs, refs, "vec_id", "vec_id", "label", "embedding")


def nearest(t: Tables, k: int = 2, within: float = 0.0) -> DataFrame:
    """The k nearest entities of each observation, and those within a distance of the nearest."""
    obs, refs = vectors(t)
    return N.nearest_entities(obs, refs, "vec_id", "vec_id", "label", "embedding", k, within)


def nearest_and_truth(t: Tables) -> DataFrame:
    """The two nearest entities of each observation and all that are as near as its own label."""
    obs, refs = vectors(t)
    known = N.truth_reach(obs, refs, "vec_id", "vec_id", "label", "embedding", "label")
    return N.nearest_entities(known, refs, "vec_id", "vec_id", "label", "embedding", 2, reach="reach", truth="label")


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


#: Limits for these vectors: the median nearest distance, and a margin that some miss.
MAX_D, DELTA = 0.105, 0.004


@query(f"WITH {VEC} SELECT vec_id, entity, round(distance, 6) AS distance, round(margin, 6) AS margin FROM k WHERE rank = 1 AND distance <= {MAX_D} AND (margin IS NULL OR margin > {DELTA})")
def j8_nearest_unique(t: Tables) -> DataFrame:
    return _r(N.nearest_unique(nearest(t), "vec_id", MAX_D, DELTA).select("vec_id", "entity", "distance", "margin"))


@query(f"WITH {VEC} SELECT vec_id, entity, round(distance, 6) AS distance, round(margin, 6) AS margin FROM k WHERE rank = 1")
def w6_top_margin(t: Tables) -> DataFrame:
    return _r(N.top_margin(nearest(t), "vec_id").select("vec_id", "entity", "distance", "margin"))


@query(f"""WITH {VEC}, l AS (SELECT *, min(distance) OVER (PARTITION BY vec_id) AS low FROM k)
    SELECT vec_id, entity, round(distance, 6) AS distance, rank = 1 AS is_top, max(rank > 1 AND distance - low <= {DELTA}) OVER (PARTITION BY vec_id) AS near_tie FROM l""")
def w7_near_ties(t: Tables) -> DataFrame:
    return _r(N.near_ties(scored(t), "vec_id", DELTA).select("vec_id", "entity", "distance", "is_top", "near_tie"))


@query(f"WITH {VEC} SELECT o.vec_id, o.label, k.rank AS expected_rank, round(k.distance, 6) AS expected_distance FROM o LEFT JOIN k ON o.vec_id = k.vec_id AND o.label = k.entity")
def w5_expected_rank(t: Tables) -> DataFrame:
    return _r(N.expected_rank(nearest_and_truth(t), vectors(t)[0].select("vec_id", "label"), "vec_id", "label"))


@query(f"""WITH {VEC} SELECT o.vec_id, CASE WHEN o.vec_id % 15 = 0 THEN 'insufficient_input' WHEN o.vec_id % 35 = 0 THEN 'missing_feature' WHEN distance > {MAX_D} THEN 'not_found' WHEN margin <= {DELTA} THEN 'ambiguous' ELSE 'matched' END AS match_status,
    round(greatest(0.98, least(1.0, 0.98 + 0.02 * least(least(1.0, greatest(0.0, ({MAX_D} - distance) / {MAX_D})), coalesce(least(1.0, greatest(0.0, margin / {DELTA})), 1.0)))), 6) AS confidence
    FROM o LEFT JOIN k ON o.vec_id = k.vec_id AND rank = 1""")
def j7_p27_vector_match(t: Tables) -> DataFrame:
    obs = vectors(t)[0].select("vec_id")
    out = N.vector_match(obs, nearest(t), "vec_id", F.col("vec_id") % 15 != 0, F.col("vec_id") % 35 != 0, MAX_D, DELTA)
    return out.select("vec_id", "match_status", F.round(match_confidence(F.col("distance"), F.col("margin"), MAX_D, DELTA), 6).alias("confidence"))


@query(f"""WITH o AS (SELECT * FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0)
    SELECT o.vec_id, r.label AS entity, round(min({L1.format(a='o.embedding', b='r.embedding')}), 6) AS distance FROM o JOIN r ON o.vec_id // 50 = r.vec_id // 50 GROUP BY ALL""")
def v4_j7_blocked_distances(t: Tables) -> DataFrame:
    from tallyspark.functions.vectors import l1

    block = F.expr("vec_id div 50")
    obs, refs = vectors(t)
    obs = obs.select("vec_id", F.col("embedding").alias("v"), block.alias("block"))
    refs = refs.select(F.col("label"), F.col("embedding").alias("w"), block.alias("block"))
    return _r(N.blocked_distances(obs, refs, ["block"], "vec_id", "label", l1(F.col("v"), F.col("w"))))


SECOND = f"q AS (SELECT o.vec_id, e.label AS entity, min({L2.format(a='o.embedding', b='e.embedding')}) AS d2 FROM o, embeddings e WHERE e.label % 7 <> 3 AND e.vec_id <> o.vec_id GROUP BY ALL)"


def second(t: Tables) -> DataFrame:
    """Distances to all vectors but an observation's own one."""
    obs, every = vectors(t)[0], t.embeddings.filter("label % 7 != 3")
    return N.entity_distances(obs, every, "vec_id", "vec_id", "label", "embedding", "l2", leave_out=True)


@query(f"""WITH {VEC}, {SECOND}, n AS (SELECT *, min(distance) OVER (PARTITION BY vec_id) AS low FROM k), m AS (SELECT vec_id, entity FROM n WHERE distance - low <= 0.01 QUALIFY count(*) OVER (PARTITION BY vec_id) > 1),
    z AS (SELECT vec_id, entity, d2, lead(d2) OVER (PARTITION BY vec_id ORDER BY d2, entity) - d2 AS margin, row_number() OVER (PARTITION BY vec_id ORDER BY d2, entity) AS rn FROM m JOIN q USING (vec_id, entity))
    SELECT vec_id, entity, CASE WHEN d2 IS NULL THEN 'missing_feature' WHEN margin <= 0.02 THEN 'ambiguous_candidate' ELSE 'resolved_candidate' END AS rerank_status FROM (SELECT DISTINCT vec_id FROM m) LEFT JOIN (SELECT * FROM z WHERE rn = 1) USING (vec_id)""")
def j9_rerank(t: Tables) -> DataFrame:
    return N.rerank(nearest(t, 2, 0.01), second(t), "vec_id", 0.02, 0.01).select("vec_id", "entity", "rerank_status")


@query(f"""WITH {VEC}, {SECOND}, n AS (SELECT *, min(distance) OVER (PARTITION BY vec_id) AS low FROM k), m AS (SELECT vec_id, entity, distance FROM n WHERE distance - low <= 0.01 QUALIFY count(*) OVER (PARTITION BY vec_id) > 1),
    s AS (SELECT vec_id, count(*) AS size FROM m GROUP BY 1),
    a AS (SELECT vec_id, entity, d2 AS d, lead(d2) OVER w - d2 AS margin, row_number() OVER w AS rn, count(*) OVER (PARTITION BY vec_id) AS have FROM m JOIN q USING (vec_id, entity) WINDOW w AS (PARTITION BY vec_id ORDER BY d2, entity)),
    b AS (SELECT vec_id, entity, distance AS d, lead(distance) OVER w - distance AS margin, row_number() OVER w AS rn, count(*) OVER (PARTITION BY vec_id) AS have FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY distance, entity)),
    x AS (SELECT s.vec_id, a.entity AS ea, b.entity AS eb, CASE WHEN coalesce(a.have < size, true) THEN 'incomplete' WHEN a.d > 1.1 THEN 'insufficient' WHEN a.margin <= 0.02 THEN 'ambiguous' ELSE 'resolved' END AS title_state,
        CASE WHEN coalesce(b.have < size, true) THEN 'incomplete' WHEN b.d > 1.1 THEN 'insufficient' WHEN b.margin <= 0.02 THEN 'ambiguous' ELSE 'resolved' END AS artist_state
        FROM s LEFT JOIN a ON s.vec_id = a.vec_id AND a.rn = 1 LEFT JOIN b ON s.vec_id = b.vec_id AND b.rn = 1)
    SELECT vec_id, CASE WHEN title_state = 'resolved' OR artist_state = 'resolved' THEN 'resolved' ELSE 'unresolved' END AS rerank_status, CASE WHEN title_state = 'resolved' THEN ea WHEN artist_state = 'resolved' THEN eb END AS entity,
    CASE WHEN title_state = 'resolved' THEN 'title' WHEN artist_state = 'resolved' THEN 'artist' END AS decided_by, title_state, artist_state FROM x""")
def j28_gated_rerank(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    first = nearest(t, 2, 0.01)
    low = F.min("distance").over(Window.partitionBy("vec_id"))
    near = first.withColumn("_low", low).filter("distance - _low <= 0.01").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("vec_id"))).filter("_n > 1").select("vec_id", "entity")
    return N.gated_rerank(near, [("title", second(t)), ("artist", first)], "vec_id", 1.1, 0.02).drop("distance", "margin")


#: Sets of ten vectors: the first is looked at, the others are references of their label; a cell is set from a limit that differs by set.
SETS = """lim AS (SELECT vec_id, label, vec_id // 10 AS item, embedding, [0.05, 0.12, 0.2, 0.9][1 + (vec_id // 10) % 4] AS cut FROM embeddings),
    bit AS (SELECT vec_id, label, item, list_transform(embedding, lambda x: CASE WHEN x >= cut THEN 1 ELSE 0 END) AS b FROM lim),
    ob AS (SELECT item, vec_id, b AS seen FROM bit WHERE vec_id % 10 = 0 AND item % 9 <> 5), rf AS (SELECT item, vec_id AS ref, label AS entity, b AS known FROM bit WHERE vec_id % 10 <> 0 AND item % 7 <> 6),
    s0 AS (SELECT vec_id, coalesce(max(CASE WHEN ob.item % 5 = 2 AND ref % 10 = 3 THEN known END), any_value(seen)) AS seen FROM ob LEFT JOIN rf USING (item) GROUP BY vec_id),
    pp AS (SELECT vec_id, entity, ref, s0.seen, known FROM ob JOIN rf USING (item) JOIN s0 USING (vec_id)),
    va AS (SELECT vec_id, list(m ORDER BY i) AS mask, sum(m) AS diff_bits FROM (SELECT vec_id, i, CASE WHEN max(known[i]) <> min(known[i]) THEN 1 ELSE 0 END AS m FROM pp, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY vec_id),
    ra AS (SELECT *, seen = known AS exact, (list_sum(list_transform(range(1, 65), lambda i: CASE WHEN seen[i] <> known[i] THEN 1 + 4 * mask[i] ELSE 0 END)) / (64 + 4 * diff_bits)) AS distance,
        list_sum(list_transform(range(0, 8), lambda r: CASE WHEN seen[r * 8 + 1:r * 8 + 8] = known[r * 8 + 1:r * 8 + 8] AND list_sum(seen[r * 8 + 1:r * 8 + 8]) > 0 THEN 1 ELSE 0 END)) AS n_rows FROM pp JOIN va USING (vec_id))"""


def sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(observations, pairs) of SETS; of some sets the observation has a reference's very cells."""
    from tallyspark.functions.vectors import row_hashes

    item = F.expr("vec_id div 10")
    cut = F.element_at(F.array(*[F.lit(c) for c in (0.05, 0.12, 0.2, 0.9)]), (item % 4 + 1).cast("int"))
    e = t.embeddings.withColumns({"item": item, "rows": row_hashes(F.transform("embedding", lambda x: (x.cast("double") >= cut).cast("int")), 8, 1)})
    refs = e.filter("vec_id % 10 != 0 AND item % 7 != 6").select("item", F.col("vec_id").alias("ref"), F.col("label").alias("entity"), F.col("rows").alias("known"))
    obs = e.filter("vec_id % 10 = 0 AND item % 9 != 5").select("item", "vec_id", "rows")
    lent = refs.filter("item % 5 = 2 AND ref % 10 = 3").select("item", F.col("known").alias("lent"))
    obs = obs.join(lent, "item", "left").select("item", "vec_id", F.coalesce("lent", "rows").alias("seen"))
    return obs.drop("item"), obs.select("item", "vec_id").join(refs, "item").drop("item")


@query(f"""WITH {SETS}, t AS (SELECT vec_id, count(*) AS reference_count, max(diff_bits) AS diff_bits, count(DISTINCT CASE WHEN exact THEN entity END) AS ex, min_by({{'e': entity, 'c': ref, 'd': distance}}, {{'d': distance, 'c': ref}}) AS nr,
        min_by({{'e': entity, 'c': ref, 'r': n_rows}}, {{'r': -n_rows, 'c': ref}}) AS al FROM ra GROUP BY vec_id),
    u AS (SELECT vec_id, max(entity <> nr.e AND distance - nr.d <= 0.01) AS close, max(entity <> al.e AND n_rows = al.r) AS tied FROM ra JOIN t USING (vec_id) GROUP BY vec_id)
    SELECT s0.vec_id, CASE WHEN ex IS NULL THEN 'missing_feature' WHEN ex = 0 THEN 'no_exact_match' WHEN ex = 1 THEN 'resolved_candidate' ELSE 'ambiguous_candidate' END AS exact_status,
    CASE WHEN ex IS NULL THEN 'missing_feature' WHEN al.r = 0 THEN 'no_dict_match' WHEN tied THEN 'ambiguous_candidate' ELSE 'resolved_candidate' END AS dict_status, al.c AS dict_chart, al.r AS dict_rows,
    CASE WHEN ex IS NULL THEN 'missing_feature' WHEN close THEN 'ambiguous_candidate' ELSE 'resolved_candidate' END AS distance_status, nr.c AS top_chart, round(nr.d, 6) AS top_distance, reference_count, diff_bits,
    CASE WHEN ex IS NULL THEN 'no_candidate_row_keys' WHEN al.r = 0 THEN 'no_matching_rows' WHEN tied THEN 'tied_row_matches' WHEN close THEN 'near_top_distance' ELSE '' END AS reason FROM s0 LEFT JOIN t USING (vec_id) LEFT JOIN u USING (vec_id)""")
def j9_row_key_rerank(t: Tables) -> DataFrame:
    obs, pairs_ = sets(t)
    out = K.row_key_rerank(obs, pairs_.withColumn("chart", F.col("ref")), "vec_id", "entity", "chart", "seen", "known", [])
    return _r(out)


@query(f"""WITH {SETS}, f AS (SELECT vec_id, entity, bool_or(exact) AS exact, min(distance) AS distance, max(diff_bits) AS diff_bits FROM ra GROUP BY ALL),
    g AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY vec_id) AS n_exact, row_number() OVER w AS rn, lead(distance) OVER w - distance AS margin FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY distance, entity))
    SELECT vec_id, entity, CASE WHEN n_exact = 1 THEN 0.0 ELSE round(distance, 6) END AS distance, CASE WHEN n_exact <> 1 THEN round(margin, 6) END AS margin, CASE WHEN n_exact = 1 THEN 'row_keys' ELSE 'masked' END AS chain
    FROM g WHERE (n_exact = 1 AND exact) OR (n_exact = 0 AND rn = 1 AND diff_bits > 0 AND distance <= 0.35 AND margin > 0.01)""")
def j28_near_tie_chain(t: Tables) -> DataFrame:
    obs, pairs_ = sets(t)
    return _r(K.near_tie_chain(pairs_.join(obs, "vec_id"), "vec_id", "entity", "seen", "known"))


@query(f"""WITH {SETS}, am AS (SELECT DISTINCT vec_id, entity FROM pp), sz AS (SELECT vec_id, count(*) AS size FROM am GROUP BY 1),
    e1 AS (SELECT vec_id, entity, min(CASE WHEN ref % 3 = 0 THEN 0.2 ELSE 0.2 + (ref % 4) * 0.004 END + (vec_id // 10) % 6 * 0.04) AS d FROM pp WHERE NOT ((vec_id // 10) % 8 = 1 AND entity % 2 = 0) GROUP BY ALL),
    a AS (SELECT *, lead(d) OVER w - d AS m, row_number() OVER w AS rn, count(*) OVER (PARTITION BY vec_id) AS have FROM e1 WINDOW w AS (PARTITION BY vec_id ORDER BY d, entity)),
    e2 AS (SELECT vec_id, entity, min(0.1 + (ref % 5) * 0.02) AS d FROM pp WHERE (vec_id // 10) % 4 <> 3 OR entity % 3 <> 0 GROUP BY ALL),
    b AS (SELECT *, lead(d) OVER w - d AS m, row_number() OVER w AS rn, count(*) OVER (PARTITION BY vec_id) AS have FROM e2 WINDOW w AS (PARTITION BY vec_id ORDER BY d, entity)),
    f AS (SELECT vec_id, entity, bool_or(exact) AS exact, min(distance) AS distance, max(diff_bits) AS diff_bits FROM ra GROUP BY ALL),
    g AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY vec_id) AS n_exact, row_number() OVER w AS rn, lead(distance) OVER w - distance AS margin FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY distance, entity)),
    ch AS (SELECT vec_id, entity, CASE WHEN n_exact = 1 THEN 'row_keys' ELSE 'masked' END AS chain FROM g WHERE (n_exact = 1 AND exact) OR (n_exact = 0 AND rn = 1 AND diff_bits > 0 AND distance <= 0.35 AND margin > 0.01)),
    x AS (SELECT sz.vec_id, CASE WHEN coalesce(a.have < size, true) THEN 'incomplete' WHEN a.d > 0.35 THEN 'insufficient' WHEN a.m <= 0.01 AND chain IS NOT NULL THEN 'resolved_' || chain WHEN a.m <= 0.01 THEN 'ambiguous' ELSE 'resolved' END AS title_state,
        CASE WHEN coalesce(b.have < size, true) THEN 'incomplete' WHEN b.d > 0.35 THEN 'insufficient' WHEN b.m <= 0.01 THEN 'ambiguous' ELSE 'resolved' END AS artist_state, a.entity AS ae, b.entity AS be, ch.entity AS ce
        FROM sz LEFT JOIN a ON a.vec_id = sz.vec_id AND a.rn = 1 LEFT JOIN b ON b.vec_id = sz.vec_id AND b.rn = 1 LEFT JOIN ch ON ch.vec_id = sz.vec_id),
    y AS (SELECT vec_id, title_state, artist_state, CASE WHEN title_state = 'resolved' THEN ae WHEN title_state LIKE 'resolved_%' THEN ce WHEN artist_state = 'resolved' THEN be END AS entity,
        CASE WHEN title_state LIKE 'resolved%' THEN 'title' WHEN artist_state = 'resolved' THEN 'artist' END AS decided_by FROM x),
    c AS (SELECT vec_id, entity, count(DISTINCT ref) AS n, min(ref) AS c FROM pp WHERE ref % 10 <> 7 GROUP BY ALL)
    SELECT y.*, CASE WHEN y.entity IS NULL THEN 'unresolved' WHEN n IS NULL THEN 'chart_not_found' WHEN n > 1 THEN 'chart_ambiguous' ELSE 'resolved' END AS chart_status, CASE WHEN n = 1 THEN c END AS chart FROM y LEFT JOIN c ON c.vec_id = y.vec_id AND c.entity = y.entity""")
def j28_gated_chain(t: Tables) -> DataFrame:
    """Both stages, the near-tie chain of the first and the check of the chart; the stages' distances are made from the references' ids."""
    obs, pairs_ = sets(t)
    item, ref = F.expr("vec_id div 10"), F.col("ref")
    title = (F.when(ref % 3 == 0, 0.2).otherwise(F.lit(0.2) + (ref % 4) * 0.004) + item % 6 * 0.04).alias("distance")
    first = pairs_.filter(~((item % 8 == 1) & (F.col("entity") % 2 == 0))).select("vec_id", "entity", title).groupBy("vec_id", "entity").agg(F.min("distance").alias("distance"))
    other = pairs_.filter((item % 4 != 3) | (F.col("entity") % 3 != 0)).groupBy("vec_id", "entity").agg(F.min(F.lit(0.1) + (ref % 5) * 0.02).alias("distance"))
    chain = K.near_tie_chain(pairs_.join(obs, "vec_id"), "vec_id", "entity", "seen", "known")
    out = N.gated_rerank(pairs_.select("vec_id", "entity").distinct(), [("title", first), ("artist", other)], "vec_id", chains={"title": chain})
    charts = pairs_.filter("ref % 10 != 7").select("vec_id", "entity", "ref")
    return K.one_chart(out, charts, "vec_id", "entity", "ref").select("vec_id", "title_state", "artist_state", "entity", "decided_by", "chart_status", "chart")


SUFFIX = f"""WITH {SQL}, n AS (SELECT song_id, title || CASE song_id % 4 WHEN 0 THEN ' (Type1)' WHEN 1 THEN ' TYPE 2' WHEN 2 THEN ' type3' ELSE '' END AS title, artist, song_id // 6 AS item FROM song),
    k AS (SELECT *, lower(regexp_replace(title, '[ ()#]', '', 'g')) AS tk FROM n),
    o AS (SELECT item, CASE item % 6 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'ok' END AS st, CASE item % 6 WHEN 2 THEN '' WHEN 3 THEN 'no suffix' WHEN 4 THEN 'x type 3' ELSE 'X Ｔype' || (1 + item % 2) END AS txt FROM n GROUP BY item),
    r AS (SELECT *, CASE WHEN st = 'ok' THEN CASE WHEN txt LIKE '%ype%3%' THEN 'TYPE3' WHEN txt LIKE '%ype1%' THEN 'TYPE1' WHEN txt LIKE '%ype2%' THEN 'TYPE2' ELSE '' END ELSE '' END AS suffix FROM o),
    h AS (SELECT k.*, row_number() OVER (PARTITION BY item ORDER BY k.title, artist, song_id) AS rn FROM k JOIN r USING (item) WHERE suffix <> '' AND contains(tk, lower(suffix)) AND song_id % 12 <> 4),
    g AS (SELECT item, count(DISTINCT song_id) AS n, max(CASE WHEN rn = 1 THEN song_id END) AS entity, string_agg(title || ' / ' || artist || ' [' || song_id || ']', ' | ' ORDER BY rn) FILTER (rn <= 5) AS listed FROM h GROUP BY item)"""


@query(f"""{SUFFIX} SELECT item, suffix, entity, entity AS chart, coalesce(listed, '') AS top_candidates,
    CASE WHEN st IS NULL OR st <> 'ok' OR txt = '' THEN 'missing_ocr' WHEN suffix = '' THEN 'no_suffix' WHEN n IS NULL THEN 'no_candidate_suffix_match' WHEN n > 1 THEN 'ambiguous_candidate' ELSE 'resolved_candidate' END AS rerank_status,
    CASE WHEN st IS NULL THEN 'title_ocr_not_run' WHEN st <> 'ok' THEN st WHEN txt = '' THEN 'empty_ocr' WHEN suffix = '' THEN 'type_suffix_not_detected' WHEN n IS NULL THEN 'suffix_not_in_ambiguous_candidates' WHEN n > 1 THEN 'suffix_matches_multiple_ambiguous_songs' ELSE '' END AS rerank_reason
    FROM r LEFT JOIN g USING (item)""")
def j9_suffix_rerank(t: Tables) -> DataFrame:
    """Sets of six songs whose titles carry a version; what was read of each set is made from its number."""
    k, item = F.col("song_id") % 4, F.expr("song_id div 6")
    s = songs(t).select("song_id", F.concat("title", F.when(k == 0, " (Type1)").when(k == 1, " TYPE 2").when(k == 2, " type3").otherwise("")).alias("title"), "artist", item.alias("item"))
    m = F.col("item") % 6
    text = F.when(m == 2, "").when(m == 3, "no suffix").when(m == 4, "x type 3").otherwise(F.concat(F.lit("X Ｔype"), (F.col("item") % 2 + 1).cast("string")))
    read = s.select("item").distinct().select("item", text.alias("text"), F.when(m == 1, "failed").when(m != 0, "ok").alias("status"))
    cands = s.filter("song_id % 12 != 4").select("item", F.col("song_id").alias("song"), F.col("song_id").alias("chart"), "title", "artist", X.title_key("title").alias("key"))
    shown = F.format_string("%s / %s [%s]", "title", "artist", F.col("chart").cast("string"))
    return K.suffix_rerank(read, cands, "item", "song", "chart", "text", "status", "key", ["title", "artist"], shown)


@query(f"""WITH {VEC}, s AS (SELECT vec_id, CASE WHEN distance > {MAX_D} THEN 'not_found' WHEN margin <= {DELTA} THEN 'ambiguous' ELSE 'matched' END AS st, entity FROM k WHERE rank = 1)
    SELECT vec_id, CASE st WHEN 'matched' THEN 'resolved_candidate' WHEN 'ambiguous' THEN CASE WHEN vec_id % 2 = 0 OR vec_id % 3 = 0 THEN 'composite_resolved_candidate' ELSE 'unresolved_ambiguous' END ELSE 'unresolved_not_found' END AS signal_status,
    CASE st WHEN 'matched' THEN 'primary' WHEN 'ambiguous' THEN CASE WHEN vec_id % 2 = 0 THEN 'even' WHEN vec_id % 3 = 0 THEN 'third' END END AS signal_source,
    CASE WHEN st = 'matched' THEN entity WHEN st = 'ambiguous' AND vec_id % 2 = 0 THEN 1 WHEN st = 'ambiguous' AND vec_id % 3 = 0 THEN 2 END AS signal_entity,
    CASE st WHEN 'matched' THEN 'unique_candidate' WHEN 'ambiguous' THEN CASE WHEN vec_id % 2 = 0 THEN 'ambiguous_even_resolved' WHEN vec_id % 3 = 0 THEN 'ambiguous_third_resolved' ELSE 'ambiguous_without_auxiliary_resolution' END ELSE CASE WHEN vec_id % 4 = 0 THEN 'blurred' ELSE 'not_found' END END AS signal_reason FROM s""")
def j10_identity_signal(t: Tables) -> DataFrame:
    out = N.vector_match(vectors(t)[0].select("vec_id"), nearest(t), "vec_id", F.lit(True), F.lit(True), MAX_D, DELTA)
    aux = [(n, F.when(F.col("vec_id") % k == 0, "resolved_candidate").otherwise("missing"), F.lit(e)) for n, k, e in (("even", 2, 1), ("third", 3, 2))]
    return out.select("vec_id", *N.identity_signal(F.col("match_status"), F.col("entity"), aux, F.when(F.col("vec_id") % 4 == 0, "blurred").otherwise("")))


@query(f"""WITH r AS (SELECT label, embedding FROM embeddings WHERE vec_id % 5 <> 0), p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM r), c AS (SELECT label, i, avg(x::DOUBLE) AS x FROM p GROUP BY ALL),
    m AS (SELECT label, list(x ORDER BY i) AS mean FROM c GROUP BY label), d AS (SELECT vec_id, m.label AS entity, {L2.format(a='embedding', b='mean')} AS distance FROM embeddings, m WHERE vec_id % 5 = 0)
    SELECT vec_id, entity, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, entity) = 1""")
def v9_nearest_centroid(t: Tables) -> DataFrame:
    obs, refs = vectors(t)
    return _r(N.nearest_centroid(obs, refs, "vec_id", "label", "embedding"))


@query(f"""WITH d AS (SELECT a.vec_id, b.label AS entity, {L2.format(a='a.embedding', b='b.embedding')} / sqrt(len(a.embedding)) AS distance, b.vec_id AS ref_id FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT vec_id, entity, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, entity) = 1""")
def v10_leave_one_out(t: Tables) -> DataFrame:
    e = t.embeddings
    return _r(N.nearest_entities(e, e, "vec_id", "vec_id", "label", "embedding", 1, kind="rmse", leave_out=True).select("vec_id", "entity", "distance"))


@query(f"""WITH {VEC}, s AS (SELECT vec_id // 25 AS item, vec_id AS pos, entity, distance, coalesce(margin, 1.0 - distance) AS margin FROM k WHERE rank = 1),
    w AS (SELECT *, CASE WHEN distance > {MAX_D} THEN 'distance_above_threshold' WHEN margin < {DELTA} THEN 'low_margin' END AS why FROM s)
    SELECT item, string_agg(entity::VARCHAR, '' ORDER BY pos) AS value, CASE WHEN count(why) = 0 THEN 'recognized' ELSE 'ambiguous' END AS status, coalesce(max_by(why, pos) FILTER (why IS NOT NULL), '') AS reason,
    round(avg(distance), 6) AS mean_distance, round(1.0 - least(1.0, avg(distance) / {MAX_D}), 6) AS confidence, count(*) AS segments FROM w GROUP BY item""")
def v11_digit_gate(t: Tables) -> DataFrame:
    obs, refs = vectors(t)
    seg = obs.select(F.expr("vec_id div 25").alias("item"), F.col("vec_id").alias("pos"), "embedding")
    return _r(N.digit_gate(seg, refs.select("label", "embedding"), "item", "pos", "label", "embedding", MAX_D, DELTA))


PAIRS = f"""v AS (SELECT vec_id, 'a' || vec_id // 10 AS sig, embedding FROM embeddings UNION ALL SELECT vec_id, 'b' || vec_id // 7, embedding FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, count(DISTINCT a.sig) AS common_count, string_agg(DISTINCT a.sig::VARCHAR, ' | ' ORDER BY a.sig::VARCHAR) AS common_signatures, min({L1.format(a='a.embedding', b='b.embedding')}) AS d FROM v a JOIN v b ON a.sig = b.sig AND a.vec_id < b.vec_id GROUP BY ALL),
    pairs AS (SELECT a, b, round(d, 6) AS distance, CASE WHEN d <= 0.05 THEN 'A: extremely close' WHEN d <= 0.10 THEN 'B: high' WHEN d <= 0.11 THEN 'C: elevated' ELSE 'D: watch' END AS risk_band, common_count, common_signatures FROM p WHERE d <= 0.12)"""


def pairs(t: Tables) -> DataFrame:
    e = t.embeddings
    v = e.select("vec_id", F.expr("'a' || vec_id div 10").alias("sig"), "embedding").unionByName(e.select("vec_id", F.expr("'b' || vec_id div 7").alias("sig"), "embedding"))
    return N.near_pairs(v, "vec_id", "sig", "embedding", 0.12)


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def j22_u2_near_pairs(t: Tables) -> DataFrame:
    return pairs(t)


@query(f"WITH {PAIRS}, s AS (SELECT a AS entity, b AS partner, distance FROM pairs UNION ALL SELECT b, a, distance FROM pairs) SELECT *, min(distance) OVER (PARTITION BY entity) AS min_distance, count(*) OVER (PARTITION BY entity) AS partner_count FROM s")
def a23_partners(t: Tables) -> DataFrame:
    return N.partners(pairs(t))


@query(f"WITH {VEC} SELECT vec_id, string_agg(entity || ':' || rank, ' | ' ORDER BY rank) AS top_candidates FROM k WHERE rank <= 5 GROUP BY vec_id")
def l6_top_candidates(t: Tables) -> DataFrame:
    return N.top_candidates(nearest(t, 5), "vec_id", F.concat_ws(":", "entity", "rank"))
