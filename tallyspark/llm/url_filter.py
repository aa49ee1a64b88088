"""URL filters: a temporal join of captures with dated list entries.

List changes (add or remove a key on a date) become validity intervals, and each capture
is judged by the entries that were active when it was fetched.  Keys are hosts, host
suffixes at label bounds ("example.org" holds for "a.example.org") and host + first path
part; a capture has a handful of keys, so the join is on key, with the interval as a
condition on one side.  A key's intervals don't overlap, so a capture meets an entry once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.llm.common import spill

FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without login and port; null where the text isn't scheme://host..."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(rest != "", F.regexp_replace(rest, r"\.+$", ""))


def path_key(url: Column) -> Column:
    """Host and first path part, as "host/part"; null without either."""
    part = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(part != "", F.concat(host_of(url), F.lit("/"), part))


def keys_of(url: Column) -> Column:
    """Array of (kind, key): the host, each shorter suffix with a dot in it, and host/part."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.struct(F.lit("suffix").alias("kind"), F.array_join(F.slice(labels, k, n), ".").alias("key"))))
    one = F.when(host.isNotNull(), F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"))))
    path = F.when(path_key(url).isNotNull(), F.array(F.struct(F.lit("path").alias("kind"), path_key(url).alias("key"))))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    return F.concat(*[F.coalesce(x, none) for x in (one, suffixes, path)])


def intervals(changes: DataFrame) -> DataFrame:
    """(list, kind, key, since, until) from changes (list, kind, key, on date, action add|remove).

    Of several changes of a key on one day the remove counts.  An add while active and a
    remove while inactive change nothing.  An entry never removed ends on 9999-12-31.
    Rows with a null key or date are passed over.
    """
    daily = changes.filter("key IS NOT NULL AND `on` IS NOT NULL").groupBy("list", "kind", "key", "on").agg(F.max((F.col("action") == "remove").cast("int")).alias("gone"))
    order = Window.partitionBy("list", "kind", "key").orderBy("on")
    turns = daily.withColumn("was", F.lag("gone", 1, 1).over(order)).filter("was != gone")
    spans = turns.withColumn("until", F.lead("on", 1, FOREVER).over(order).cast("date")).filter("gone = 0")
    return spans.select("list", "kind", "key", F.col("on").alias("since"), "until")


def judge(captures: DataFrame, changes: DataFrame, id_col: str, url_col: str, fetched_col: str) -> DataFrame:
    """Per capture row: id, host, fetched, n_active, lists (sorted, comma-joined), blocked.

    An entry holds from its first day to before its last.  A null or hostless URL and a
    null fetch date match nothing; repeated rows count apart; an empty list blocks nothing.
    """
    active = spill(intervals(changes), "intervals")
    base = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(fetched_col).alias("_at"))
    keyed = base.select("_id", "_url", "_at", F.explode(keys_of(F.col("_url"))).alias("k")).select("_id", "_url", "_at", F.col("k.kind").alias("_kind"), F.col("k.key").alias("_key"))
    met = keyed.join(active, (F.col("_kind") == active["kind"]) & (F.col("_key") == active["key"]) & (F.col("_at") >= active["since"]) & (F.col("_at") < active["until"]))
    # Equal rows (same id, URL and date) meet the same entries: one result serves them all.
    hits = met.groupBy("_id", "_url", "_at").agg(F.collect_set(F.struct("list", "kind", "key")).alias("hits"))
    hits = spill(hits.select(F.col("_id").alias("i"), F.col("_url").alias("u"), F.col("_at").alias("a"), F.size("hits").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.col("hits.list"))), ",").alias("lists")), "hits")
    joined = base.join(hits, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_url") == F.col("u")) & (F.col("_at") == F.col("a")), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select(F.col("_id").alias(id_col), host_of(F.col("_url")).alias("host"), F.col("_at").alias(fetched_col), n.alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), (n > 0).alias("blocked"))


def fetched_on(id_col: str) -> Column:
    """The tables have no fetch time: a day of 2024 derived from the id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col(id_col), F.lit(366)).cast("int"))


def _digit(text: Column, at: int) -> Column:
    """Two hex digits of the MD5 of a text, as a number: any engine has them."""
    return F.conv(F.substring(F.md5(text), at, 2), 16, 10).cast("int")


def changes_from(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A change list derived from all pages, as no table holds one: for about half of all hosts, a quarter
    of their parent domains and an eighth of host/path keys, an add, a remove and for some a second add."""
    keyed = pages.select(F.explode(keys_of(F.col(url_col))).alias("k")).select("k.kind", "k.key").distinct()
    name = F.concat_ws(":", "kind", "key")
    share = F.when(F.col("kind") == "host", 128).when(F.col("kind") == "suffix", 64).otherwise(32)
    day = F.lit("2024-01-01").cast("date")
    first = F.date_add(day, _digit(name, 3))
    second = F.date_add(first, _digit(name, 5) + 1)
    lists = F.when(_digit(name, 9) < 128, "malware").otherwise("spam")
    chosen = keyed.filter(_digit(name, 1) < share)
    steps = F.array(F.struct(first.alias("on"), F.lit("add").alias("action")), F.struct(second.alias("on"), F.lit("remove").alias("action")), F.struct(F.when(_digit(name, 7) < 64, F.date_add(second, 30)).alias("on"), F.lit("add").alias("action")))
    return chosen.select(lists.alias("list"), "kind", "key", F.inline(steps)).filter("`on` IS NOT NULL")


#: The same in DuckDB SQL, for the query over ``pages``.
ORACLE = r"""
WITH p AS (
    SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
           nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host,
           nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS part
    FROM pages),
k AS (
    SELECT page_id, fetched, 'host' AS kind, host AS key FROM p WHERE host IS NOT NULL
    UNION ALL
    SELECT page_id, fetched, 'suffix', array_to_string(list_slice(string_split(host, '.'), i, 127), '.')
    FROM p, range(2, 127) r(i) WHERE i < len(string_split(host, '.'))
    UNION ALL
    SELECT page_id, fetched, 'path', host || '/' || part FROM p WHERE host IS NOT NULL AND part IS NOT NULL),
d AS (
    SELECT DISTINCT kind, key, md5(kind || ':' || key) AS h FROM k),
e AS (
    SELECT kind, key, CASE WHEN ('0x' || substr(h, 9, 2))::INT < 128 THEN 'malware' ELSE 'spam' END AS list,
           DATE '2024-01-01' + ('0x' || substr(h, 3, 2))::INT AS since,
           DATE '2024-01-01' + ('0x' || substr(h, 3, 2))::INT + ('0x' || substr(h, 5, 2))::INT + 1 AS till,
           ('0x' || substr(h, 7, 2))::INT < 64 AS again
    FROM d WHERE ('0x' || substr(h, 1, 2))::INT < CASE kind WHEN 'host' THEN 128 WHEN 'suffix' THEN 64 ELSE 32 END),
i AS (
    SELECT list, kind, key, since, till FROM e
    UNION ALL SELECT list, kind, key, till + 30, DATE '9999-12-31' FROM e WHERE again),
m AS (
    SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
    FROM k JOIN i USING (kind, key) WHERE fetched >= since AND fetched < till GROUP BY page_id)
SELECT page_id, host, fetched, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN m USING (page_id)
"""
