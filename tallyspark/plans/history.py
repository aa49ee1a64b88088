"""History, bests and progress: lineitem as plays, part as catalog, orders as captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scores import clear_class, goal_score, grade, ordinal, CLEAR_ORDER, GRADE_ORDER
from tallyspark.operators import analytics as A
from tallyspark.operators import ranges
from tallyspark.plans.registry import Tables, query
from tallyspark.sources.scratch import work_table

IDS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
#: Times as ISO text in both engines.
STAMP = "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"


def plays(t: Tables) -> DataFrame:
    """A play is a line: entity part, time shipdate, score price x 10 (rounded down), extra quantity."""
    score = F.floor("l_extendedprice").cast("int") * 10
    line = t.lineitem.select(*IDS, "l_returnflag", "l_linestatus", "l_discount", "l_shipdate", score.alias("score"), F.col("l_quantity").cast("int").alias("extra"))
    line = line.withColumns({"grade": F.coalesce(grade(F.col("score")), F.lit("")), "clear": clear_class(counts_of(), F.col("l_returnflag") == "R")})
    line = A.with_order(line, "l_shipdate", *IDS)
    return line.withColumn("played_at", F.col("_time"))


def counts_of() -> dict:
    q = F.col("extra")
    return {"marvelous": q, "perfect": q % 4, "great": q % 3, "good": q % 2, "miss": (q % 5 == 0).cast("int"), "ok": F.lit(0)}


GRADE_SQL = "CASE WHEN score < 0 OR score > 1000000 OR score % 10 <> 0 THEN '' " + " ".join(f"WHEN score >= {b} THEN '{n}'" for b, n in ((990000, "AAA"), (950000, "AA+"), (900000, "AA"), (890000, "AA-"), (850000, "A+"), (800000, "A"), (790000, "A-"), (750000, "B+"), (700000, "B"), (690000, "B-"), (650000, "C+"), (600000, "C"), (590000, "C-"), (550000, "D+"))) + " ELSE 'D' END"
CLEAR_SQL = "CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN extra % 4 = 0 AND extra % 3 = 0 AND extra % 2 = 0 AND extra % 5 <> 0 THEN 'MFC' WHEN extra % 3 = 0 AND extra % 2 = 0 AND extra % 5 <> 0 THEN 'PFC' WHEN extra % 2 = 0 AND extra % 5 <> 0 THEN 'GFC' WHEN extra % 5 <> 0 THEN 'FULL COMBO' ELSE 'CLEAR' END"
PLAYS_SQL = f"""b AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount, {STAMP} AS played_at,
           floor(l_extendedprice)::INT * 10 AS score, l_quantity::INT AS extra FROM lineitem),
plays AS (SELECT *, {GRADE_SQL} AS grade, {CLEAR_SQL} AS clear FROM b)"""
GRADE_ORD = "CASE grade " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in GRADE_ORDER.items()) + " ELSE 0 END"
CLEAR_ORD = "CASE clear " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLEAR_ORDER.items()) + " ELSE 0 END"
CHRONO = "played_at, l_orderkey, l_linenumber, l_partkey, l_suppkey"
CHRONO_DESC = "played_at DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC"


def catalog(t: Tables) -> DataFrame:
    """Nine tenths of the parts, so that some plays miss their reference."""
    return t.part.filter("p_partkey % 10 != 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.col("p_brand").alias("style"), F.col("p_type").alias("version"), F.col("p_size").alias("level"))


BESTS_SQL = f"""bests AS (
    SELECT l_partkey, max(score) AS best_score, max(extra) AS best_extra, count(*) AS plays, max(played_at) AS last_time,
           first(grade ORDER BY score DESC, extra DESC, {CHRONO_DESC}) AS best_row_grade,
           first(clear ORDER BY score DESC, extra DESC, {CHRONO_DESC}) AS best_row_clear,
           first(l_linestatus ORDER BY score DESC, extra DESC, {CHRONO_DESC}) AS best_row_label,
           first(grade ORDER BY {GRADE_ORD} DESC, score DESC, extra DESC, {CHRONO_DESC}) AS achieved_grade,
           first(clear ORDER BY {CLEAR_ORD} DESC, score DESC, extra DESC, {CHRONO_DESC}) AS achieved_clear
    FROM plays GROUP BY l_partkey)"""
CATALOG_SQL = "cat AS (SELECT p_partkey AS l_partkey, p_name AS title, p_brand AS style, p_type AS version, p_size AS level FROM part WHERE p_partkey % 10 <> 0)"
ENRICHED_SQL = """enriched AS (
    SELECT x.*, CASE WHEN c.l_partkey IS NULL THEN 'unknown ' || x.l_partkey ELSE c.title END AS title, coalesce(c.style, '') AS style,
           coalesce(c.version, '') AS version, c.level, c.l_partkey IS NULL AS reference_missing
    FROM bests x LEFT JOIN cat c USING (l_partkey))"""
BOTH = f"WITH {PLAYS_SQL}, {BESTS_SQL}, {CATALOG_SQL}, {ENRICHED_SQL}"


def bests(t: Tables) -> DataFrame:
    return A.entity_bests(plays(t), ["l_partkey"], "score", "extra", "grade", "clear", "l_linestatus")


def enriched(t: Tables) -> DataFrame:
    found = {n: F.col(n) for n in ("title", "style", "version", "level")}
    return A.enrich(bests(t), catalog(t), ["l_partkey"], found, {"title": F.concat(F.lit("unknown "), F.col("l_partkey")), "style": F.lit(""), "version": F.lit("")})


@query(BOTH + " SELECT * FROM enriched")
def a1_j2_entity_bests(t: Tables) -> DataFrame:
    return enriched(t)


PREVIOUS = f"""prev AS (
    SELECT *, max(score) OVER w AS previous_score, max(extra) OVER w AS previous_extra FROM plays
    WINDOW w AS (PARTITION BY l_partkey ORDER BY {CHRONO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SHOWN = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "played_at", "score", "extra", "previous_score", "previous_extra")


def previous(t: Tables) -> DataFrame:
    return A.previous_best(plays(t), ["l_partkey"], ["score", "extra"])


@query(f"WITH {PLAYS_SQL}, {PREVIOUS} SELECT {', '.join(SHOWN)} FROM prev")
def w1_w2_previous_best(t: Tables) -> DataFrame:
    return previous(t).select(*SHOWN)


@query(f"WITH {PLAYS_SQL}, {PREVIOUS.replace('PARTITION BY l_partkey', 'PARTITION BY 1')} SELECT {', '.join(SHOWN)} FROM prev")
def w2_hot_entity(t: Tables) -> DataFrame:
    """All plays as those of one entity, which no single task holds."""
    rows = plays(t).select(*IDS, "played_at", "score", "extra", *A.ORDER, F.lit(1).alias("_all"))
    return ranges.previous_best(rows, ["_all"], ["score", "extra"], rows=100_000).select(*SHOWN)


@query(f"WITH {PLAYS_SQL}, {PREVIOUS} SELECT {', '.join(SHOWN)} FROM prev WHERE score > previous_score OR extra > previous_extra")
def f5_best_updates(t: Tables) -> DataFrame:
    return A.best_updates(previous(t), ["score", "extra"]).select(*SHOWN)


@query(f"""WITH {PLAYS_SQL}, {PREVIOUS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {CHRONO_DESC}) AS rn FROM prev)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, played_at, score FROM r WHERE rn <= 100 AND (previous_score IS NULL OR score > previous_score)""")
def w3_best_points(t: Tables) -> DataFrame:
    return A.best_points(plays(t), ["l_partkey"], "score").select(*IDS, "played_at", "score")


@query(f"""WITH {PLAYS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, extra DESC, {CHRONO_DESC}) AS a,
    row_number() OVER (PARTITION BY l_partkey ORDER BY extra DESC, score DESC, {CHRONO_DESC}) AS b FROM plays)
    SELECT 'score' AS by_, l_orderkey, l_linenumber, l_partkey, l_suppkey, score, extra FROM r WHERE a = 1
    UNION ALL SELECT 'extra', l_orderkey, l_linenumber, l_partkey, l_suppkey, score, extra FROM r WHERE b = 1""")
def w4_best_row(t: Tables) -> DataFrame:
    rows = plays(t)
    one = lambda by, m: A.best_row(rows, ["l_partkey"], m).select(F.lit(by).alias("by_"), *IDS, "score", "extra")
    return one("score", ["score", "extra"]).unionByName(one("extra", ["extra", "score"]))


@query(f"WITH {PLAYS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {CHRONO}) AS rank FROM plays")
def w9_numbered(t: Tables) -> DataFrame:
    return A.numbered(plays(t), [F.col(c) for c in A.ORDER], ["l_partkey"]).select(*IDS, "rank")


@query(f"""WITH {PLAYS_SQL} SELECT (played_at::TIMESTAMP - INTERVAL 7 HOURS)::DATE AS day, count(*) AS plays, sum(extra + extra % 4 + extra % 3 + extra % 2)::BIGINT AS steps,
    round(sum(CASE WHEN l_discount > 0 THEN l_discount END), 4) AS calories FROM plays GROUP BY 1""")
def a2_f4_day_summary(t: Tables) -> DataFrame:
    q = F.col("extra")
    rows = plays(t).withColumns({"day": A.play_day(F.col("l_shipdate").cast("timestamp")), "p": q % 4, "g": q % 3, "o": q % 2, "kcal": F.when(F.col("l_discount") > 0, F.col("l_discount"))})
    return A.day_summary(rows.groupBy("day"), ["extra", "p", "g"], "o", "kcal").withColumn("calories", F.round("calories", 4))


@query("SELECT count(*) AS plays, max(o_orderdate) AS last_saved FROM orders")
def a3_totals(t: Tables) -> DataFrame:
    return A.totals(t.orders, "o_orderdate")


@query(f"WITH {PLAYS_SQL} SELECT l_partkey, count(*) AS plays, count(*) FILTER (clear IN ('MFC','PFC','GFC','FC','FULL COMBO')) AS full_plays FROM plays GROUP BY 1")
def a4_entity_counts(t: Tables) -> DataFrame:
    return A.entity_counts(plays(t), ["l_partkey"], "clear", ("MFC", "PFC", "GFC", "FC", "FULL COMBO"))


OVERLAID = """laid AS (
    SELECT coalesce(b.l_partkey, c.l_partkey) AS l_partkey, c.title, c.style, c.version, c.level, coalesce(b.plays, 0) AS plays, b.best_score, b.last_time,
           coalesce(b.best_row_grade, '') AS best_row_grade, coalesce(b.best_row_clear, '') AS best_row_clear,
           coalesce(b.achieved_grade, '') AS achieved_grade, coalesce(b.achieved_clear, '') AS achieved_clear
    FROM cat c FULL JOIN bests b USING (l_partkey))"""


def laid(t: Tables) -> DataFrame:
    zeros = {"plays": F.lit(0), **{n: F.lit("") for n in ("best_row_grade", "best_row_clear", "achieved_grade", "achieved_clear")}}
    return A.overlay(catalog(t), bests(t).drop("best_extra", "best_row_label"), ["l_partkey"], zeros)


@query(BOTH + f", {OVERLAID} SELECT * FROM laid")
def j4_overlay(t: Tables) -> DataFrame:
    return laid(t)


@query(BOTH + f""", {OVERLAID} SELECT style, count(*) AS target, count(*) FILTER (plays > 0) AS recorded, count(*) FILTER (plays = 0) AS unrecorded,
    count(*) FILTER ({CLEAR_ORD.replace('CASE clear', "CASE coalesce(nullif(achieved_clear, ''), best_row_clear)")} >= 2) AS cleared,
    count(*) FILTER ({CLEAR_ORD.replace('CASE clear', "CASE coalesce(nullif(achieved_clear, ''), best_row_clear)")} >= 3) AS "full",
    count(*) FILTER (coalesce(nullif(achieved_grade, ''), best_row_grade) = 'AAA') AS top_grade FROM laid GROUP BY style""")
def a5_progress(t: Tables) -> DataFrame:
    return A.progress(laid(t), ["style"])


@query("""SELECT p_brand AS style, p_type AS difficulty, count(*) AS charts, count(*) FILTER (p_size >= 40) AS removed, count(*) FILTER (p_retailprice > 1500) AS limited FROM part GROUP BY ALL""")
def a6_build_summary(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("style"), F.col("p_type").alias("difficulty")).agg(F.count(F.lit(1)).alias("charts"), F.count_if(F.col("p_size") >= 40).alias("removed"), F.count_if(F.col("p_retailprice") > 1500).alias("limited"))


@query("SELECT n_name AS song, r_name AS version, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def j1_dimension_join(t: Tables) -> DataFrame:
    region = t.region
    return t.nation.join(region, F.col("n_regionkey") == region["r_regionkey"]).select(F.col("n_name").alias("song"), F.col("r_name").alias("version"), "n_nationkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(o_orderpriority, 'unknown') AS o_orderpriority
    FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0) ON l_orderkey = o_orderkey""")
def j3_capture_kind(t: Tables) -> DataFrame:
    captures = t.orders.filter("o_orderkey % 7 != 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return A.with_kind(t.lineitem.select(*IDS), captures, "l_orderkey", "o_orderpriority")


for _mode, _value, _where in (("level", 7, "level = 7"), ("version", "STANDARD", "version = 'STANDARD'"), ("title", " Gear", "contains(lower(title), 'gear')"), ("goal", 900_000, "plays > 0 AND best_score < 900000")):

    def _browse(t: Tables, mode: str = _mode, value: object = _value) -> DataFrame:
        return A.browse(enriched(t), mode, value).select("l_partkey", "title", "level", "version", "best_score", "plays")

    _browse.__name__ = f"f3_browse_{_mode}"
    query(BOTH + f" SELECT l_partkey, title, level, version, best_score, plays FROM enriched WHERE {_where}")(_browse)


@query(f"WITH {PLAYS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, played_at, score FROM plays ORDER BY {CHRONO_DESC} LIMIT 50 OFFSET 50")
def l1_l4_history_page(t: Tables) -> DataFrame:
    """A page is the feature: 50 rows from the 51st."""
    return A.page(plays(t), A.newest_first(), 50, 50).select(*IDS, "played_at", "score")


@query(f"WITH {PLAYS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, played_at, score FROM plays WHERE l_partkey = 17 ORDER BY {CHRONO_DESC} LIMIT 10")
def l2_entity_page(t: Tables) -> DataFrame:
    return A.entity_page(plays(t), {"l_partkey": 17}).select(*IDS, "played_at", "score")


_SORT_SQL = {
    "title": "lower(title), level NULLS LAST,", "level_asc": "level ASC NULLS LAST,", "level_desc": "level DESC NULLS LAST,", "score_asc": "best_score NULLS LAST,",
    "score_desc": "best_score DESC NULLS LAST,", "plays_desc": "plays DESC,", "recent": "last_time DESC,", "goal": "990000 - best_score,",
}
_PLACED_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS mode, l_partkey, row_number() OVER (ORDER BY {o} lower(title), l_partkey) AS place FROM enriched" + (" WHERE plays > 0 AND best_score < 990000" if m == "goal" else "")
    for m, o in _SORT_SQL.items()
)


@query(f"{BOTH} {_PLACED_SQL}")
def l3_sort_modes(t: Tables) -> DataFrame:
    """The place of every row in each order; the bests are worked out once."""
    out, rows = None, work_table(enriched(t).select("l_partkey", "title", "level", "best_score", "plays", "last_time"), "bests")
    for mode in _SORT_SQL:
        placed = A.places(A.sort_bests(rows, mode, "l_partkey", 990_000).select("l_partkey")).select(F.lit(mode).alias("mode"), "l_partkey", "place")
        out = placed if out is None else out.unionByName(placed)
    return out


@query(f"""WITH {PLAYS_SQL}, {PREVIOUS}, l AS (SELECT *, row_number() OVER (ORDER BY {CHRONO_DESC}) AS position FROM prev QUALIFY position <= 6),
    u AS (SELECT *, row_number() OVER (ORDER BY {CHRONO_DESC}) AS position FROM prev WHERE score > previous_score OR extra > previous_extra QUALIFY position <= 5)
    SELECT CASE WHEN position = 1 THEN 'latest' ELSE 'recent' END AS section, position, l_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM l
    UNION ALL SELECT 'best_update', position, l_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM u""")
def l5_home_feed(t: Tables) -> DataFrame:
    return A.home_feed(plays(t), ["l_partkey"], ["score", "extra"]).select("section", "position", *IDS, "score")


@query("""WITH s AS (SELECT p_partkey, p_name, p_brand, CASE WHEN lower(p_name) = 'plate' THEN 0 WHEN lower(p_type) = 'plate' THEN 1 WHEN starts_with(lower(p_name), 'plate') THEN 2
    WHEN contains(lower(p_name), 'plate') THEN 3 WHEN contains(lower(p_brand), 'plate') THEN 4 WHEN contains(p_partkey::VARCHAR, 'plate') THEN 5 END AS search_rank FROM part)
    SELECT * FROM s WHERE search_rank IS NOT NULL""")
def f8_ranked_search(t: Tables) -> DataFrame:
    parts = t.part.withColumns({"aliases": F.array("p_type"), "key": F.col("p_partkey").cast("string")})
    return A.ranked_search(parts, "Plate", "p_name", "p_brand", "key", "aliases").select("p_partkey", "p_name", "p_brand", "search_rank")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error'")
def f9_review_filter(t: Tables) -> DataFrame:
    return A.review_filter(t.events, ["event_type", "event_id"], event_type="error", user_id="all").select("event_id", "event_type", "user_id")


@query("SELECT l_suppkey, min_by(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def u4_dedupe_first(t: Tables) -> DataFrame:
    return A.dedupe_first(t.lineitem, ["l_suppkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]).select("l_suppkey", "l_partkey")


@query(f"WITH {PLAYS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, grade, {GRADE_ORD} AS grade_ord, clear, {CLEAR_ORD} AS clear_ord, CASE grade WHEN 'AAA' THEN 990000 WHEN 'AA+' THEN 950000 WHEN 'AA' THEN 900000 ELSE 990000 END AS goal FROM plays")
def p10_p13_grades(t: Tables) -> DataFrame:
    return plays(t).select(*IDS, "grade", ordinal(F.col("grade"), GRADE_ORDER).alias("grade_ord"), "clear", ordinal(F.col("clear"), CLEAR_ORDER).alias("clear_ord"), goal_score(F.col("grade")).alias("goal"))
