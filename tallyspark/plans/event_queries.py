"""Event operators over ``events``: stream user_id, time ts, order event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import events as E
from tallyspark.operators import ranges
from tallyspark.plans.registry import Tables, query

HOUR = 3_600_000
#: The table's events are hours apart, so spans are in hours: runs of 6 h, duplicates within 300 h.
MIN_MS, WINDOW_MS = 6 * HOUR, 300 * HOUR
CANDIDATE = ("view", "click", "purchase")


def epoch_ms(name: str) -> F.Column:
    """Milliseconds of a time without zone, read as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def frames(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("user_id").cast("string").alias("stream"), epoch_ms("ts").alias("timestamp_ms"), "event_type", "value")


def confirmed(t: Tables, timed: bool = True) -> DataFrame:
    rows = frames(t).withColumnRenamed("event_type", "kind")
    return E.confirm_events(rows, "stream", "timestamp_ms" if timed else None, "event_id", F.col("kind").isin(*CANDIDATE), F.col("kind") == "error", F.concat_ws(":", F.lit("kind"), "kind"), MIN_MS, 2, WINDOW_MS, 9)


FRAMES = "f AS (SELECT event_id, user_id::VARCHAR AS stream, (epoch_us(ts) // 1000) AS timestamp_ms, event_type AS kind FROM events)"


def _confirm_sql(timed: bool) -> str:
    order = "timestamp_ms, event_id" if timed else "event_id"
    place, limit = ("timestamp_ms", WINDOW_MS) if timed else ("frame_index", 9)
    sure = f"coalesce(d >= {MIN_MS}, false)" if timed else "run AND streak >= 2"
    duration = "CASE WHEN run THEN greatest(0, timestamp_ms - min(timestamp_ms) OVER (PARTITION BY stream, island, run)) END" if timed else "NULL::BIGINT"
    return f"""WITH {FRAMES},
    a AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY {order}) - 1 AS frame_index, kind IN {CANDIDATE} AS run, kind = 'error' AS moving FROM f),
    b AS (SELECT *, sum((NOT run)::INT) OVER (PARTITION BY stream ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM a),
    c AS (SELECT *, {duration} AS d, row_number() OVER (PARTITION BY stream, island, run ORDER BY {order}) AS streak FROM b),
    e AS (SELECT *, {sure} AS confirmed_result FROM c),
    g AS (SELECT *, confirmed_result AND coalesce({place} - lag({place}) OVER (PARTITION BY stream, kind, confirmed_result ORDER BY {order}) <= {limit}, false) AS duplicate FROM e),
    ev AS (SELECT event_id, stream, timestamp_ms, frame_index, d AS candidate_duration_ms, confirmed_result, duplicate, '{"time" if timed else "frames"}' AS confirmation_mode, 'kind:' || kind AS duplicate_key,
           CASE WHEN moving THEN 'rejected_transition' WHEN duplicate THEN 'duplicate' WHEN confirmed_result THEN 'confirmed' ELSE 'none' END AS event_type FROM g)"""


SHOWN = ("event_id", "stream", "timestamp_ms", "frame_index", "candidate_duration_ms", "confirmed_result", "duplicate", "confirmation_mode", "duplicate_key", "event_type")


@query(_confirm_sql(True) + f" SELECT {', '.join(SHOWN)} FROM ev")
def t1_t3_confirm_by_time(t: Tables) -> DataFrame:
    return confirmed(t).select(*SHOWN)


@query(_confirm_sql(False) + f" SELECT {', '.join(SHOWN)} FROM ev")
def t1_t3_confirm_by_frames(t: Tables) -> DataFrame:
    return confirmed(t, False).select(*SHOWN)


def _one_stream(sql: str) -> str:
    return sql.replace("user_id::VARCHAR AS stream", "'all' AS stream")


def one_stream(t: Tables, timed: bool) -> DataFrame:
    """All events as one stream, which no single task holds."""
    rows = frames(t).withColumn("stream", F.lit("all")).withColumnRenamed("event_type", "kind")
    return ranges.confirm_events(rows, "stream", "timestamp_ms" if timed else None, "event_id", F.col("kind").isin(*CANDIDATE), F.col("kind") == "error", F.concat_ws(":", F.lit("kind"), "kind"), MIN_MS, 2, WINDOW_MS, 9, rows=20_000)


@query(_one_stream(_confirm_sql(True)) + f" SELECT {', '.join(SHOWN)} FROM ev")
def t1_hot_stream_by_time(t: Tables) -> DataFrame:
    return one_stream(t, True).select(*SHOWN)


@query(_one_stream(_confirm_sql(False)) + f" SELECT {', '.join(SHOWN)} FROM ev")
def t2_hot_stream_by_frames(t: Tables) -> DataFrame:
    return one_stream(t, False).select(*SHOWN)


@query(_confirm_sql(True) + " SELECT event_id, stream, timestamp_ms FROM ev WHERE confirmed_result AND NOT duplicate")
def f1_save_candidates(t: Tables) -> DataFrame:
    return E.save_candidates(confirmed(t)).select("event_id", "stream", "timestamp_ms")


@query(_confirm_sql(True) + """ SELECT stream, count(*) AS frames, count(*) FILTER (event_type = 'confirmed') AS confirmed, count(*) FILTER (event_type = 'duplicate') AS duplicates,
    count(*) FILTER (event_type = 'rejected_transition') AS rejected, min(CASE WHEN event_type = 'confirmed' THEN frame_index END) AS first_confirmed_index,
    min(CASE WHEN event_type = 'confirmed' THEN timestamp_ms END) AS first_confirmed_ms, count(*) AS time_rows, 0 AS frames_rows FROM ev GROUP BY stream""")
def a14_event_summary(t: Tables) -> DataFrame:
    return E.event_summary(confirmed(t), ["stream"], "timestamp_ms")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'score:' || event_id ELSE 'file:' || event_type || event_id || '.png' END AS duplicate_key FROM events""")
def t4_dup_key(t: Tables) -> DataFrame:
    """A third of the file names have a score token; folders are separated in both ways."""
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a/score7/Result_Score"), "event_id", F.lit("_v2.png"))).otherwise(F.concat(F.lit("a/score7\\"), "event_type", "event_id", F.lit(".png")))
    return t.events.select("event_id", E.dup_key(name).alias("duplicate_key"))


@query("""WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 50 = 1 THEN 'x1' WHEN event_id % 50 = 2 THEN '-5' ELSE (epoch_us(ts) // 1000)::VARCHAR END AS raw FROM events),
    y AS (SELECT *, CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN raw::BIGINT END AS v FROM x),
    z AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM y)
    SELECT event_id, CASE WHEN raw = '' THEN 'empty' WHEN v IS NULL THEN 'not_integer' WHEN v < 0 THEN 'negative' WHEN v <= p THEN 'not_increasing' END AS ts_error FROM z""")
def s2_check_sequence(t: Tables) -> DataFrame:
    e = F.col("event_id") % 50
    raw = F.when(e == 0, "").when(e == 1, "x1").when(e == 2, "-5").otherwise(epoch_ms("ts").cast("string"))
    return E.check_sequence(t.events.withColumn("raw", raw), "user_id", "raw", "event_id").select("event_id", "ts_error")


@query("""WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
    SELECT event_id, i + max(round_even(i * 1000.0::DOUBLE / 1700.0::DOUBLE, 0)::BIGINT - i) OVER (PARTITION BY user_id ORDER BY i) AS timestamp_ms FROM x""")
def s9_assign_timestamps(t: Tables) -> DataFrame:
    return E.assign_timestamps(t.events, "user_id", "event_id", 1700.0).select("event_id", "timestamp_ms")


@query("SELECT event_id, 500 + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 250 AS timestamp_ms FROM events")
def s10_assign_interval(t: Tables) -> DataFrame:
    return E.assign_interval(t.events, "user_id", "event_id", 500, 250).select("event_id", "timestamp_ms")


@query("""WITH RECURSIVE x AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_id, user_id, t, i, t AS last, true AS accepted FROM x WHERE i = 1
          UNION ALL SELECT x.event_id, x.user_id, x.t, x.i, CASE WHEN x.t - r.last >= 86400000 THEN x.t ELSE r.last END, x.t - r.last >= 86400000 FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1)
    SELECT event_id, accepted FROM r""")
def t5_sample_min_gap(t: Tables) -> DataFrame:
    return E.sample_min_gap(frames(t), "stream", "timestamp_ms", "event_id", 24 * HOUR).select("event_id", "accepted")


@query("SELECT event_id, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM events")
def t8_order_guard(t: Tables) -> DataFrame:
    return E.order_guard(t.events, "user_id", "ts", "event_id").select("event_id", "late")


@query("""WITH s AS (SELECT event_id, event_type, event_id % 2 = 0 AS header, event_id % 3 <> 0 AS detail_panel, CASE WHEN event_id % 5 <> 0 THEN user_id % 4 = 0 END AS score_area, event_id % 7 = 0 AS rank, CASE WHEN event_id % 11 = 0 THEN 'countup' ELSE '' END AS t FROM events),
    r AS (SELECT *, header AND detail_panel AND t = '' AS result, event_type = 'purchase' AS expected FROM s)
    SELECT event_id, result AS result_candidate, header AND detail_panel AND (coalesce(score_area, false) OR rank OR result) AS result_shape_candidate, t AS transition_kind, expected AS expected_result_candidate, result = expected AS correct,
    coalesce(nullif(concat_ws(',', CASE WHEN header THEN 'header' END, CASE WHEN detail_panel THEN 'detail_panel' END, CASE WHEN score_area THEN 'score_area' END, CASE WHEN rank THEN 'rank' END, CASE WHEN t <> '' THEN 'transition_' || t END, CASE WHEN result THEN 'finished_result_frame' END), ''), 'no_signals') AS reason FROM r""")
def p22_classify(t: Tables) -> DataFrame:
    k = F.col("event_id")
    rows = t.events.select("event_id", "event_type", (k % 2 == 0).alias("header"), (k % 3 != 0).alias("detail_panel"), F.when(k % 5 != 0, F.col("user_id") % 4 == 0).alias("score_area"), (k % 7 == 0).alias("rank"))
    out = E.classify(rows, ["header", "detail_panel", "score_area", "rank"], ["header", "detail_panel"], ["score_area", "rank"], F.when(k % 11 == 0, "countup"), F.col("event_type") == "purchase")
    return out.drop("event_type", "header", "detail_panel", "score_area", "rank")


STABLE = """f AS (SELECT event_id, user_id::VARCHAR AS stream, epoch_us(ts) // 1000 - CASE WHEN event_id % 17 = 0 THEN 3000000000 ELSE 0 END AS timestamp_ms, [floor(value / 60) / 10, floor(value / 90) / 10]::DOUBLE[] AS v FROM events),
    a AS (SELECT *, array_to_string(v, ',') AS h, coalesce(timestamp_ms < max(timestamp_ms) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS bad FROM f),
    b AS (SELECT *, CASE WHEN NOT lag(bad) OVER w THEN lag(v) OVER w END AS p FROM a WINDOW w AS (PARTITION BY stream ORDER BY event_id)),
    c AS (SELECT *, CASE WHEN NOT bad THEN coalesce((abs(v[1] - p[1]) + abs(v[2] - p[2])) / 2, 1.0) END AS difference FROM b),
    d AS (SELECT *, bad OR p IS NULL OR difference > 0.08 AS anew FROM c),
    e AS (SELECT *, sum(anew::INT) OVER (PARTITION BY stream ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM d),
    g AS (SELECT *, NOT anew AND row_number() OVER w >= 2 AND timestamp_ms - first_value(timestamp_ms) OVER w >= 1000 AS settled FROM e WINDOW w AS (PARTITION BY stream, run ORDER BY event_id))"""


@query(f"""WITH {STABLE} SELECT event_id, round(difference, 6) AS difference, CASE WHEN bad THEN 'invalid' WHEN anew THEN 'change' WHEN NOT settled THEN 'settling' WHEN row_number() OVER (PARTITION BY stream, h, settled ORDER BY event_id) > 1 THEN 'repeat' ELSE 'stable' END AS state FROM g""")
def t7_stable_values(t: Tables) -> DataFrame:
    """Coarse values of each user's events in order of id; every seventeenth is put back in time."""
    rows = frames(t).withColumns({"timestamp_ms": F.col("timestamp_ms") - F.when(F.col("event_id") % 17 == 0, 3_000_000_000).otherwise(0), "v": F.array(F.floor(F.col("value") / 60) / 10, F.floor(F.col("value") / 90) / 10)})
    out = E.stable_values(rows.withColumn("h", F.array_join("v", ",")), "stream", "timestamp_ms", "event_id", "v", "h", frames=2, ms=1000)
    return out.select("event_id", F.round("difference", 6).alias("difference"), "state")
