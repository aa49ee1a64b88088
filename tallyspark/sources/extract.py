"""User code as part of a query: field extractors, event processors and table functions.

An extractor is a pandas function that gives a struct (value, confidence, status) for each
item; several profiles of it can run side by side.  A processor says of each event what is
to become of it.  Table functions parse a page to rows and are called laterally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql import types as T

from tallyspark.sources.html import grid, parse

EXTRACTED = "value string, confidence double, status string"
#: What may become of an event.
DISPOSITIONS = ("done", "retry", "skip")


def extractor(read: Callable[[pd.Series], pd.DataFrame]) -> Callable[[Column], Column]:
    """A column function from ``read``: a batch of items -> value, confidence and status of each.

    Confidence outside 0 to 1 is an error.  An item that is null has status ``missing`` and
    isn't shown to ``read``.
    """

    def run(items: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"value": pd.Series([None] * len(items), dtype=object), "confidence": 0.0, "status": "missing"})
        there = items.notna().to_numpy()
        if there.any():
            got = read(items[there]).reset_index(drop=True)
            if not got["confidence"].between(0, 1).all():
                raise ValueError("confidence outside 0 to 1")
            for c in out:
                out.loc[there, c] = got[c].to_numpy()
        return out

    return lambda col: F.pandas_udf(run, EXTRACTED)(col)


def extract(items: DataFrame, item_id: str, col: str, profiles: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(item_id, profile, value, confidence, status): every profile over every item, each item read once."""
    found = items.select(item_id, *[read(F.col(col)).alias(f"_p{k}") for k, read in enumerate(profiles.values())])
    each = F.array(*[F.struct(F.lit(name).alias("profile"), *[F.col(f"_p{k}.{c}").alias(c) for c in ("value", "confidence", "status")]) for k, name in enumerate(profiles)])
    return found.select(item_id, F.inline(each))


def best_profile(extracted: DataFrame, item_id: str, order: list[str], least: float = 0.0) -> DataFrame:
    """Per item the ``ok`` result of the highest confidence, at least ``least``; of equal ones the first profile in ``order``; else status none."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("profile"))
    good = (F.col("status") == "ok") & (F.col("confidence") >= least) & (place > 0)
    top = F.max(F.when(good, F.struct("confidence", (-place).alias("_place"), "profile", "value")))
    out = extracted.groupBy(item_id).agg(top.alias("_t"))
    return out.select(item_id, F.col("_t.profile").alias("profile"), F.col("_t.value").alias("value"), F.coalesce("_t.confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("_t").isNull(), "none").otherwise("ok").alias("status"))


def process(events: DataFrame, processor: Callable[[pd.DataFrame], pd.Series], columns: list[str], attempt: str, most: int) -> DataFrame:
    """Adds ``disposition`` and ``outcome``: what the user's ``processor`` says of each event, and what that means.

    ``processor`` gets ``columns`` of a batch and gives one of DISPOSITIONS for each row;
    anything else is an error.  outcome: resolved, skipped, retry, or unresolved where the
    ``most``-th attempt still asks to be tried again.
    """

    def run(*values: pd.Series) -> pd.Series:
        return pd.Series(processor(pd.concat(values, axis=1, keys=columns)).to_numpy(), dtype=object)

    said = F.pandas_udf(_of_arity(run, len(columns)), "string")(*columns)
    out = events.withColumn("_said", said)
    wrong = F.raise_error(F.concat(F.lit("unknown disposition: "), F.coalesce("_said", F.lit("null")))).cast("string")
    told = F.when(F.coalesce(F.col("_said").isin(*DISPOSITIONS), F.lit(False)), F.col("_said")).otherwise(wrong)
    outcome = F.when(F.col("disposition") == "done", "resolved").when(F.col("disposition") == "skip", "skipped").when(F.col(attempt) >= most, "unresolved").otherwise("retry")
    return out.withColumn("disposition", told).drop("_said").withColumn("outcome", outcome)


def _of_arity(run: Callable[..., pd.Series], n: int) -> Callable[..., pd.Series]:
    """``run`` as a function of n annotated series, which is how Spark learns what kind of function it is."""

    def call(*values: pd.Series) -> pd.Series:
        return run(*values)

    call.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return call


def _strings(given: tuple, names: tuple[str, ...]) -> None:
    if len(given) != len(names):
        raise ValueError(f"needs {', '.join(names)}")
    for argument, name in zip(given, names):
        if not isinstance(argument.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"{name} must be a string, not {argument.dataType.simpleString()}")


class HtmlRows:
    """Elements of a page: ``html_rows(html, url, tag, link_attr)``; link_attr null gives no links."""

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, tag: AnalyzeArgument, link_attr: AnalyzeArgument) -> AnalyzeResult:
        _strings((html, url, tag, link_attr), ("html", "url", "tag", "link_attr"))
        if not tag.isConstantExpression or not tag.value:
            raise ValueError("tag must be a constant")
        return AnalyzeResult(T.StructType([T.StructField("position", T.LongType()), T.StructField("text", T.StringType()), T.StructField("link", T.StringType()), T.StructField("same_origin", T.BooleanType()), T.StructField("error", T.StringType())]))

    def eval(self, html: str | None, url: str | None, tag: str, link_attr: str | None) -> Iterator[tuple]:
        for position, node in enumerate(n for n in parse(html).walk() if n.tag == tag):
            words = node.text()
            raw = node.attrs.get(link_attr, "") if link_attr else ""
            link = urljoin(url or "", raw) if raw else None
            same = urlsplit(link).netloc == urlsplit(url or "").netloc if link else None
            yield position, words, link, same, "missing_text" if not words else "missing_link" if link_attr and not link else None


class HtmlCells:
    """Rows of all tables of a page: ``html_cells(html)``."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        _strings((html,), ("html",))
        return AnalyzeResult(T.StructType([T.StructField("table_no", T.LongType()), T.StructField("row_no", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))]))

    def eval(self, html: str | None) -> Iterator[tuple]:
        for t, table in enumerate(n for n in parse(html).walk() if n.tag == "table"):
            for r, cells in enumerate(grid(table)):
                yield t, r, cells


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: ``FROM pages, LATERAL html_rows(html, url, 'a', 'href')``."""
    for name, cls in (("html_rows", HtmlRows), ("html_cells", HtmlCells)):
        spark.udtf.register(name, F.udtf(cls, useArrow=True))
