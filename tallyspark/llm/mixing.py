"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of levels (domain, language, source).  Among siblings it
is filled up like water: each gets its share by weight, what exceeds a child's capacity
(tokens times ``max_epochs``) goes to its siblings, and only what all of them together
can't take stays with the parent, whose own siblings had it before.  All of it is integer
arithmetic.  A leaf's budget is whole epochs plus a token prefix of one more, in an order
seeded by epoch: each row has a place, a hash of its id, and the prefix ends at a cut,
which sums over ever smaller ranges of places find.  No leaf, however large, is sorted in
one task, and each row is judged by its own place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import spill

WORD = r"[^\x20\x09-\x0D]+"
#: Places have so many bits; up to so many rows of a leaf are put in order together.
PLACE_BITS, FEW_ROWS = 60, 4096
DEC = "decimal(38,0)"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weigh(column: Column, weights: dict[str, int], default: int = 1) -> Column:
    """Integer weight of a node by its name; a bounded parameter, so a map literal."""
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(default))


def allocate(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: Column) -> DataFrame:
    """``leaves`` (levels, capacity and what ``budget`` reads) with ``budget``: tokens for each leaf.

    ``weights`` gives a level's integer weight column; a weight of 0 gets nothing unless
    all siblings with weight are full.
    """
    plan = leaves.withColumn("_x", budget.cast(DEC))
    for depth, level in enumerate(levels):
        above, path = levels[:depth], levels[: depth + 1]
        nodes = plan.groupBy(*path).agg(F.sum("capacity").cast(DEC).alias("_c"), F.first("_x").alias("_x")).withColumn("_w", F.greatest(weights[level].cast(DEC), F.lit(0).cast(DEC)))
        order = Window.partitionBy(*(above or [F.lit(0)])).orderBy(F.when(F.col("_w") > 0, F.col("_c").cast("double") / F.col("_w").cast("double")).asc_nulls_last(), *path)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.partitionBy(*(above or [F.lit(0)]))
        nodes = nodes.withColumns({"_before": F.coalesce(F.sum("_c").over(before), F.lit(0)).cast(DEC), "_behind": F.sum("_w").over(behind).cast(DEC)})
        full = (F.col("_c") * F.col("_behind")) <= F.col("_w") * (F.col("_x") - F.col("_before"))
        # Children without weight come last and take what is left over, in order.
        nodes = nodes.withColumn("_full", F.min(F.when(F.col("_behind") > 0, full).otherwise(False).cast("int")).over(upto))
        nodes = nodes.withColumns({"_taken": F.coalesce(F.sum(F.when(F.col("_full") == 1, F.col("_c"))).over(every), F.lit(0)).cast(DEC), "_open": F.coalesce(F.sum(F.when(F.col("_full") == 0, F.col("_w"))).over(every), F.lit(0)).cast(DEC)})
        share = F.expr("(_x - _taken) * _w div nullif(_open, 0)").cast(DEC)
        spare = F.greatest(F.lit(0).cast(DEC), F.least(F.col("_c"), F.col("_x") - F.col("_before")))
        got = F.when(F.col("_full") == 1, F.col("_c")).when(F.col("_open") > 0, F.least("_c", share)).otherwise(spare)
        nodes = nodes.select(*path, got.cast(DEC).alias("_got"))
        plan = plan.join(nodes, path).drop("_x").withColumnRenamed("_got", "_x")
    return plan.withColumn("budget", F.col("_x").cast("long")).drop("_x")


def place_of(seed: str, epoch: Column, row_id: Column) -> Column:
    """Place of a row in an epoch's order: 60 bits of a seeded hash; rows of one id share it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch, row_id)), 1, 15), 16, 10).cast("long")


def _cuts(placed: DataFrame, names: list[str], leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``_cut``: the last place up to which a leaf's tokens fit into ``_rest``, or -1.

    A leaf's places are cut into 1024 parts and the part in which ``_rest`` is passed is cut
    again, until those parts hold few rows.  Sums are added up before they are shuffled, and
    a window holds no more than 1024 parts, or FEW_ROWS rows, of a leaf.
    """
    path = [f"_{n}" for n in names]
    zero = F.lit(0).cast("long")
    at = leaves.filter("_rest > 0").select(*path, "_rest", zero.alias("_from"), zero.alias("_ahead"))
    order, width = Window.partitionBy(*path).orderBy("_part"), PLACE_BITS
    while width:
        few = width < PLACE_BITS and (at.agg(F.max("_rows")).first()[0] or 0) <= FEW_ROWS
        shift = 0 if few else width - 10
        here = [F.col(n) == F.col(f"_{n}") for n in names] + [F.shiftright("_place", width) == F.shiftright("_from", width)]
        parts = placed.join(at, here).groupBy(*path, "_rest", "_ahead", F.shiftright("_place", shift).alias("_part"))
        parts = parts.agg(F.sum("n_tokens").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        parts = parts.withColumn("_upto", F.col("_ahead") + F.sum("_sum").over(order)).filter("_upto > _rest")
        passed = F.min_by(F.struct((F.col("_upto") - F.col("_sum")).alias("ahead"), F.col("_rows").alias("rows")), "_part")
        parts = parts.groupBy(*path, "_rest").agg(F.shiftleft(F.min("_part"), shift).alias("_from"), passed.alias("_x"))
        at = spill(parts.select(*path, "_rest", "_from", F.col("_x.ahead").alias("_ahead"), F.col("_x.rows").alias("_rows")), "mix-at")
        width = shift
    cut = at.select(*path, (F.col("_from") - 1).alias("_cut"))
    return leaves.join(cut, path, "left").withColumn("_cut", F.coalesce("_cut", F.lit(-1).cast("long")))


def _plan(facts: DataFrame, names: list[str], weights: dict[str, Column], share: tuple[int, int], max_epochs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """``facts`` (id, levels, n_tokens) with their place, and the leaves: budget, epochs and the last place of the prefix."""
    leaves = facts.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = spill(leaves.withColumn("capacity", F.col("tokens") * max_epochs), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = allocate(leaves, names, weights, F.lit(int(total) * share[0] // share[1]))
    some = F.col("tokens") > 0
    epochs = F.when(some, F.expr("budget div nullif(tokens, 0)")).otherwise(0).cast("long")
    rest = F.when(some, F.expr("budget % nullif(tokens, 0)")).otherwise(0).cast("long")
    plan = spill(plan.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("budget").alias("_budget"), epochs.alias("_epochs"), rest.alias("_rest")), "mix-plan")
    placed = facts.join(plan.drop("_budget", "_rest"), [F.col(n) == F.col(f"_{n}") for n in names])
    placed = spill(placed.select("_id", *names, "n_tokens", place_of(seed, F.col("_epochs"), F.col("_id")).alias("_place")), "mix-placed")
    return placed, spill(_cuts(placed, names, plan), "mix-cuts")


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], tokens: Column, id_col: str = "doc_id", share: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: str = "1") -> DataFrame:
    """Per row: id, the levels, n_tokens, leaf_budget, copies (how often the document is taken).

    The budget is ``share`` (numerator, denominator) of all tokens.  Null level names are
    empty names; null and empty texts have no tokens, cost nothing and are taken with whole
    epochs only; very long texts are counted where they are read; rows of one id in a leaf
    share a place and are taken or left together; an empty table gives no rows; other
    columns are ignored whatever their names.
    """
    names = list(levels)
    facts = spill(docs.select(F.col(id_col).alias("_id"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in levels.items()], tokens.alias("n_tokens")), "mix-facts")
    placed, leaves = _plan(facts, names, weights, share, max_epochs, seed)
    rows = placed.join(leaves, [F.col(n) == F.col(f"_{n}") for n in names])
    more = ((F.col("_place") <= F.col("_cut")) & (F.col("n_tokens") > 0)).cast("long")
    return rows.select(F.col("_id").alias(id_col), *names, "n_tokens", F.col("_budget").alias("leaf_budget"), (F.col("_epochs") + more).alias("copies"))


def keep_mixed_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], tokens: Column, id_col: str = "doc_id", share: tuple[int, int] = (1, 1), max_epochs: int = 1, seed: str = "1") -> DataFrame:
    """``docs`` with each row as often as ``mix_sources`` takes it; columns as given.

    A row is judged by its own place and its leaf's cut, so no text is moved or joined back.
    """
    names = list(levels)
    cols = [F.coalesce(c, F.lit("")).alias(n) for n, c in levels.items()]
    facts = spill(docs.select(F.col(id_col).alias("_id"), *cols, tokens.alias("n_tokens")), "mix-facts")
    _, leaves = _plan(facts, names, weights, share, max_epochs, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), *cols, (tokens > 0).alias("_some"))
    rows = rows.join(leaves, [F.col(n) == F.col(f"_{n}") for n in names])
    more = ((place_of(seed, F.col("_epochs"), F.col("_id")) <= F.col("_cut")) & F.col("_some")).cast("long")
    rows = rows.withColumn("_copies", (F.col("_epochs") + more).cast("int")).filter("_copies > 0")
    if max_epochs > 1:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


#: Production weights of the registered query: integers, by name.
DOMAINS = {"domain0": 3, "domain1": 2, "domain2": 1}
LANGUAGES = {"en": 4, "de": 2, "fr": 2, "es": 3}


def document_levels() -> dict[str, Column]:
    """``documents`` has no domain: one of three is derived from the source's name."""
    digit = F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 2), 16, 10).cast("int")
    return {"domain": F.concat(F.lit("domain"), (digit % 3).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def document_weights() -> dict[str, Column]:
    return {"domain": weigh(F.col("domain"), DOMAINS), "lang": weigh(F.col("lang"), LANGUAGES), "source": F.lit(1)}


def mix_documents(docs: DataFrame, share: tuple[int, int] = (1, 1), max_epochs: int = 4) -> DataFrame:
    return mix_sources(docs, document_levels(), document_weights(), count_words(F.col("text")), share=share, max_epochs=max_epochs)


def keep_mixed(docs: DataFrame, share: tuple[int, int] = (9, 10), max_epochs: int = 1) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as given.

    What ``mix_sources`` states of nulls, empty and long texts and repeated rows holds here too.
    """
    return keep_mixed_sources(docs, document_levels(), document_weights(), count_words(F.col("text")), share=share, max_epochs=max_epochs)


def _level_sql(path: list[str], source: str, weight: str) -> str:
    above, cols = path[:-1], ", ".join(path)
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    order = f"{part} ORDER BY CASE WHEN w > 0 THEN c::DOUBLE / w::DOUBLE END NULLS LAST, {cols}"
    return f"""
    SELECT {cols}, CASE WHEN full_ = 1 THEN c WHEN open_ > 0 THEN least(c, (x - taken) * w // nullif(open_, 0)) ELSE greatest(0, least(c, x - before_)) END AS x
    FROM (SELECT *, coalesce(sum(CASE WHEN full_ = 1 THEN c END) OVER ({part}), 0) AS taken, coalesce(sum(CASE WHEN full_ = 0 THEN w END) OVER ({part}), 0) AS open_
    FROM (SELECT *, min(CASE WHEN behind > 0 AND c * behind <= w * (x - before_) THEN 1 ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS full_
    FROM (SELECT *, coalesce(sum(c) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
                 sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
    FROM (SELECT {cols}, sum(tokens * 4)::HUGEINT AS c, first(x)::HUGEINT AS x, ({weight})::HUGEINT AS w FROM {source} GROUP BY ALL))))"""


def oracle() -> str:
    """The same mix in DuckDB SQL, with the production parameters."""

    def case(name: str, weights: dict[str, int]) -> str:
        return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"

    return rf"""
WITH f AS (
    SELECT doc_id, 'domain' || (('0x' || substr(md5(coalesce(source, '')), 1, 2))::INT % 3) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
    FROM documents),
l AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM f GROUP BY ALL),
l0 AS (SELECT *, (SELECT sum(tokens) FROM l) AS x FROM l),
d AS ({_level_sql(["domain"], "l0", case("domain", DOMAINS))}),
l1 AS (SELECT l.*, d.x FROM l JOIN d USING (domain)),
g AS ({_level_sql(["domain", "lang"], "l1", case("lang", LANGUAGES))}),
l2 AS (SELECT l.*, g.x FROM l JOIN g USING (domain, lang)),
s AS ({_level_sql(["domain", "lang", "source"], "l2", "1")}),
p AS (SELECT l.*, s.x AS budget, CASE WHEN tokens > 0 THEN s.x // nullif(tokens, 0) ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN s.x % nullif(tokens, 0) ELSE 0 END AS rest
      FROM l JOIN s USING (domain, lang, source)),
o AS (
    SELECT f.*, budget, epochs, rest,
           sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(md5('1:' || epochs || ':' || doc_id), 1, 15), doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM f JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS leaf_budget,
       (epochs + CASE WHEN upto <= rest AND n_tokens > 0 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM o"""
