"""History, bests and progress over scored events.

An event has an entity (one or more key columns), a time, an id and measures.  The
order of events is instant, then the time as text, then id: see ``with_order``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scores import CLEAR_ORDER, GRADE_ORDER, ordinal
from tallyspark.sources.scratch import work_table

ORDER = ("instant_ms", "_time", "_id")


def with_order(df: DataFrame, time: str, *ids: str) -> DataFrame:
    """Adds instant_ms, _time and _id.

    A timestamp column is its own instant.  Text compares by instant; without an offset it
    is UTC; junk gives a null instant.
    """
    ident = F.col(ids[0]) if len(ids) == 1 else F.struct(*ids)
    kind = dict(df.dtypes)[time]
    if kind.startswith("timestamp"):
        # a time without zone counts as UTC whatever the session's zone
        instant = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)") if kind == "timestamp_ntz" else F.unix_millis(time)
        return df.withColumns({"instant_ms": instant, "_time": F.substring(F.col(time).cast("string"), 1, 19), "_id": ident})
    text = F.col(time).cast("string")
    bare = text.rlike(r"\d:\d+[0-9:.]*$") & ~text.rlike(r"[+-]\d{2}:?\d{2}$")
    instant = F.unix_millis(F.try_to_timestamp(F.when(bare, F.concat(text, F.lit("Z"))).otherwise(text)))
    return df.withColumns({"instant_ms": instant, "_time": text, "_id": ident})


def previous_best(df: DataFrame, part: list[str], measures: list[str]) -> DataFrame:
    """Adds previous_<measure>: the best of strictly earlier events of the same entity.

    An event without an instant has no earlier ones and is earlier than none; it keeps a null.
    """
    before = Window.partitionBy(*part).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    timed = F.col("instant_ms").isNotNull()
    return df.withColumns({f"previous_{m}": F.when(timed, F.max(F.when(timed, F.col(m))).over(before)) for m in measures})


def is_best_update(measures: list[str]) -> Column:
    """An earlier best exists and this event is above it, in any measure."""
    found = F.lit(False)
    for m in measures:
        found = found | F.coalesce(F.col(m) > F.col(f"previous_{m}"), F.lit(False))
    return found


def best_updates(df: DataFrame, measures: list[str]) -> DataFrame:
    return df.filter(is_best_update(measures))


def best_points(df: DataFrame, part: list[str], measure: str, newest: int = 100) -> DataFrame:
    """First events and new bests among each entity's newest ones; bests are taken over all its history."""
    latest = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in ORDER])
    ranked = previous_best(df, part, [measure]).withColumn("_newest", F.row_number().over(latest))
    point = F.col(f"previous_{measure}").isNull() | (F.col(measure) > F.col(f"previous_{measure}"))
    return ranked.filter((F.col("_newest") <= newest) & point).drop("_newest")


def best_row(df: DataFrame, part: list[str], measures: list[str]) -> DataFrame:
    """The event with the highest measures, in the order given, then the latest."""
    order = [F.col(m).desc_nulls_last() for m in measures] + [F.col(c).desc_nulls_last() for c in ORDER]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter("_rn = 1").drop("_rn")


def numbered(df: DataFrame, order: list[Column], part: list[str], name: str = "rank") -> DataFrame:
    """1-based numbers within each partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def dedupe_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return numbered(df, order, key, "_rn").filter("_rn = 1").drop("_rn")


def entity_bests(df: DataFrame, part: list[str], score: str, extra: str, grade: str, clear: str, label: str) -> DataFrame:
    """Per entity: best of both measures, count, last time, attributes of the best event, best achieved grade and clear.

    One aggregation over one exchange.  The orders hold times and ids of any kind, so its
    buffers aren't of fixed width and Spark sorts the rows by entity, once on each side of
    the exchange; after the first side one row an entity and task is left.
    """
    time = [F.col(c) for c in ORDER]
    by_score = F.struct(F.col(score), F.col(extra), *time)
    by_grade = F.struct(ordinal(F.col(grade), GRADE_ORDER), F.col(score), F.col(extra), *time)
    by_clear = F.struct(ordinal(F.col(clear), CLEAR_ORDER), F.col(score), F.col(extra), *time)
    return df.groupBy(*part).agg(
        F.max(score).alias("best_score"), F.max(extra).alias("best_extra"), F.count(F.lit(1)).alias("plays"), F.max_by("_time", F.struct(*time)).alias("last_time"),
        F.max_by(grade, by_score).alias("best_row_grade"), F.max_by(clear, by_score).alias("best_row_clear"), F.max_by(label, by_score).alias("best_row_label"),
        F.coalesce(F.max_by(grade, by_grade), F.lit("")).alias("achieved_grade"), F.coalesce(F.max_by(clear, by_clear), F.lit("")).alias("achieved_clear"),
    )


def enrich(events: DataFrame, catalog: DataFrame, keys: list[str], attributes: dict[str, Column], missing: dict[str, Column]) -> DataFrame:
    """Left join on all keys; what the catalog lacks stays, with defaults and reference_missing."""
    side = catalog.select(*keys, *[c.alias(f"_{n}") for n, c in attributes.items()], F.lit(True).alias("_found"))
    gone = F.col("_found").isNull()
    joined = events.join(side, keys, "left")
    filled = {n: F.when(gone, missing[n] if n in missing else F.lit(None)).otherwise(F.col(f"_{n}")) for n in attributes}
    return joined.withColumns({**filled, "reference_missing": gone}).drop("_found", *[f"_{n}" for n in attributes])


def with_kind(events: DataFrame, captures: DataFrame, key: str, kind: str, default: str = "unknown") -> DataFrame:
    return events.join(captures.select(key, kind), key, "left").withColumn(kind, F.coalesce(kind, F.lit(default)))


def overlay(catalog: DataFrame, played: DataFrame, keys: list[str], zeros: dict[str, Column]) -> DataFrame:
    """All catalog keys; a played row wins over its catalog row; unmatched played rows stay."""
    both = catalog.join(played, keys, "full_outer")
    return both.withColumns({n: F.coalesce(F.col(n), c) for n, c in zeros.items()})


def play_day(time: Column, zone: str = "UTC", boundary_hours: int = 7) -> Column:
    """The day that begins at the boundary hour of local time."""
    return F.to_date(F.from_utc_timestamp(time, zone) - F.expr(f"interval {boundary_hours} hours"))


def day_summary(df: DataFrame, counts: list[str], optional: str, calories: str) -> DataFrame:
    """Events, sum of counts (optional one as 0), and calories: null where none is known."""
    total = sum((F.col(c) for c in counts), F.coalesce(F.col(optional), F.lit(0)))
    return df.agg(F.count(F.lit(1)).alias("plays"), F.sum(total).alias("steps"), F.sum(calories).alias("calories"))


def totals(df: DataFrame, created: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("plays"), F.max(created).alias("last_saved"))


def entity_counts(df: DataFrame, part: list[str], clear: str, full: Iterable[str]) -> DataFrame:
    """Plays and plays with one of the ``full`` labels."""
    return df.groupBy(*part).agg(F.count(F.lit(1)).alias("plays"), F.count_if(F.col(clear).isin(*full)).alias("full_plays"))


def progress(bests: DataFrame, part: list[str]) -> DataFrame:
    """Target, recorded and unrecorded entities, cleared, full and top-grade ones; achieved labels fall back to the best row's."""
    clear = ordinal(F.coalesce(F.nullif(F.col("achieved_clear"), F.lit("")), F.col("best_row_clear")), CLEAR_ORDER)
    top = F.coalesce(F.nullif(F.col("achieved_grade"), F.lit("")), F.col("best_row_grade")) == "AAA"
    grouped = bests.groupBy(*part) if part else bests
    return grouped.agg(F.count(F.lit(1)).alias("target"), F.count_if(F.col("plays") > 0).alias("recorded"), F.count_if(F.col("plays") == 0).alias("unrecorded"), F.count_if(clear >= 2).alias("cleared"), F.count_if(clear >= 3).alias("full"), F.count_if(top).alias("top_grade"))


def browse(bests: DataFrame, mode: str, value: object, style: str | None = None, style_col: str = "style") -> DataFrame:
    """Modes: level, version, title (substring, any case; blank takes all), goal (played and below the target)."""
    if style is not None:
        bests = bests.filter(F.col(style_col) == style)
    if mode == "level":
        return bests.filter(F.col("level") == value)
    if mode == "version":
        return bests.filter(F.col("version") == value)
    if mode == "title":
        return bests.filter(F.contains(F.lower("title"), F.lit(str(value or "").strip().lower())))
    if mode == "goal":
        return bests.filter((F.col("plays") > 0) & (F.col("best_score") < value))
    raise ValueError(f"unknown mode {mode!r}")


SORTS = {
    "title": [], "level_asc": [F.asc_nulls_last, "level"], "level_desc": [F.desc_nulls_last, "level"], "score_asc": [F.asc_nulls_last, "best_score"],
    "score_desc": [F.desc_nulls_last, "best_score"], "plays_desc": [F.desc_nulls_last, "plays"], "recent": [F.desc_nulls_last, "last_time"],
}


def sort_bests(bests: DataFrame, mode: str, key: str, goal: int | None = None) -> DataFrame:
    """Seven orders, and "goal" by distance to a target (played and below it); ties by title in any case, then key; a null level is last.

    Rows of one title are ordered by level before key in the title order.
    """
    if mode == "goal":
        bests = browse(bests, "goal", goal)
        first = [(F.lit(goal) - F.col("best_score")).asc_nulls_last()]
    else:
        spec = SORTS[mode]
        first = [spec[0](spec[1])] if spec else []
    tie = [F.asc_nulls_last("level")] if mode == "title" else []
    return bests.orderBy(*first, F.lower("title").asc_nulls_last(), *tie, key)


def places(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The 1-based place of every row of a sorted table.

    Rows are counted within each range of the sort, and the counts before a range are added,
    so no task holds more than its range; the sort is written out, as both steps read it.
    """
    kept = work_table(ordered.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_at", 33)
    ahead = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    rows = kept.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return rows.withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_ahead")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order; a negative offset or a limit below 1 is refused."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must be 0 or more and limit 1 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_first() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in ORDER]


def entity_page(df: DataFrame, part: dict[str, object], offset: int = 0, limit: int = 10) -> DataFrame:
    for name, value in part.items():
        df = df.filter(F.col(name) == value)
    return page(df, newest_first(), offset, limit)


def home_feed(df: DataFrame, part: list[str], measures: list[str], recent: int = 5, updates: int = 5) -> DataFrame:
    """The newest event, the next few, and the newest best updates, by section and position.

    The newest events need no history: they are a top-k of the table as it is.
    """
    latest = df.orderBy(*newest_first()).limit(recent + 1).withColumn("_update", F.lit(False))
    improved = best_updates(previous_best(df, part, measures), measures).drop(*[f"previous_{m}" for m in measures])
    improved = improved.orderBy(*newest_first()).limit(updates).withColumn("_update", F.lit(True))
    place = F.row_number().over(Window.partitionBy("_update").orderBy(*newest_first()))
    both = latest.unionByName(improved).withColumn("position", place)
    section = F.when(F.col("_update"), "best_update").when(F.col("position") == 1, "latest").otherwise("recent")
    return both.withColumn("section", section).drop("_update")


def ranked_search(df: DataFrame, query: str, title: str, artist: str, key: str, aliases: str) -> DataFrame:
    """0 exact title (or a blank query), 1 exact alias, 2 title begins, 3 title holds, 4 artist holds, 5 id holds; others go."""
    q = query.strip().lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rank = (
        F.when((F.lit(q) == "") | (low(title) == q), 0).when(F.exists(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.lower(a) == q), 1)
        .when(F.startswith(low(title), F.lit(q)), 2).when(F.contains(low(title), F.lit(q)), 3).when(F.contains(low(artist), F.lit(q)), 4).when(F.contains(low(key), F.lit(q)), 5)
    )
    return df.withColumn("search_rank", rank).filter("search_rank IS NOT NULL").orderBy("search_rank", title, key)


def review_filter(df: DataFrame, order: list[str], **chosen: str) -> DataFrame:
    """Equality filters, each of which may be "all"."""
    for name, value in chosen.items():
        if value != "all":
            df = df.filter(F.col(name) == value)
    return df.orderBy(*order)
