"""HTML pages to rows: elements by selector, and tables as rectangular grids.  Parsing is stdlib, per page, inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style"}
NOTE = re.compile(r"\*\d+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        for part in self.parts:
            if isinstance(part, Node):
                yield part
                yield from part.walk()

    def text(self) -> str:
        return " ".join(" ".join(p if isinstance(p, str) else p.text() for p in self.parts if isinstance(p, str) or p.tag not in HIDDEN).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("td", "th", "tr", "li", "p"):  # what such an element closes by beginning
            ends = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, (tag,))
            while len(self.open) > 1 and self.open[-1].tag in ends:
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def extract_html_rows(pages: DataFrame, page_id: str, url: str, html: str, tag: str, link_attr: str | None = None) -> DataFrame:
    """One row per ``tag`` element: page, position, text, absolute link, same_origin, and an error where text or link is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, base, text in zip(batch["page"], batch["url"], batch["html"]):
                for position, node in enumerate(n for n in parse(text).walk() if n.tag == tag):
                    words = node.text()
                    raw = node.attrs.get(link_attr, "") if link_attr else ""
                    link = urljoin(base or "", raw) if raw else None
                    same = urlsplit(link).netloc == urlsplit(base or "").netloc if link else None
                    error = "missing_text" if not words else "missing_link" if link_attr and not link else None
                    rows.append((key, position, words, link, same, error))
            yield pd.DataFrame(rows, columns=["page", "position", "text", "link", "same_origin", "error"])

    return pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, f"page {dict(pages.dtypes)[page_id]}, position long, text string, link string, same_origin boolean, error string")


def grid(table: Node) -> list[list[str]]:
    """Cells with spans carried into every place they cover; note anchors such as *1 are dropped."""
    rows: list[list[str]] = []
    carried: dict[int, tuple[int, str]] = {}
    for tr in (n for n in table.walk() if n.tag == "tr"):
        row: list[str] = []

        def carry() -> None:
            while len(row) in carried:
                left, value = carried.pop(len(row))
                if left > 1:
                    carried[len(row)] = (left - 1, value)
                row.append(value)

        for cell in (n for n in tr.parts if isinstance(n, Node) and n.tag in ("td", "th")):
            carry()
            for anchor in [n for n in cell.walk() if n.tag == "a" and NOTE.fullmatch(n.text())]:
                anchor.parts = []
            down, across = (int(m.group()) if (m := re.match(r"\d+", cell.attrs.get(a, "1"))) else 1 for a in ("rowspan", "colspan"))
            value = cell.text()
            for _ in range(max(1, across)):
                if down > 1:
                    carried[len(row)] = (down - 1, value)
                row.append(value)
        carry()
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def expand_tables(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page, table_no, row_no, cells) of all tables of all pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, t, r, cells) for key, text in zip(batch["page"], batch["html"]) for t, table in enumerate(n for n in parse(text).walk() if n.tag == "table") for r, cells in enumerate(grid(table))]
            yield pd.DataFrame(rows, columns=["page", "table_no", "row_no", "cells"])

    return pages.select(F.col(page_id).alias("page"), F.col(html).alias("html")).mapInPandas(run, f"page {dict(pages.dtypes)[page_id]}, table_no long, row_no long, cells array<string>")


def forward_fill(df: DataFrame, part: list[str], order: str, col: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    return df.withColumn(name, F.last(col, ignorenulls=True).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def parse_sectioned_table(cells: DataFrame, header: list[str], names: list[str], levels: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of tables whose first row is ``header``; rows of one value set the section; level columns become chart rows.

    ``levels``: column name -> (style, difficulty).  Levels without digits give no chart.
    """
    ok = cells.filter("row_no = 0").filter(F.col("cells") == F.array(*[F.lit(h) for h in header])).select("page", "table_no")
    rows = cells.join(ok, ["page", "table_no"]).filter("row_no > 0")
    distinct = F.array_distinct(F.filter("cells", lambda c: c != ""))
    rows = forward_fill(rows, ["page", "table_no"], "row_no", F.when(F.size(distinct) == 1, F.element_at(distinct, 1)), "section").filter(F.size(distinct) > 1)
    wide = rows.select("page", "table_no", "row_no", "section", *[F.get("cells", k).alias(n) for k, n in enumerate(names)])
    charts = F.array(*[F.struct(F.lit(s).alias("style"), F.lit(d).alias("difficulty"), F.col(c).alias("raw_level")) for c, (s, d) in levels.items()])
    out = wide.select("page", "table_no", "row_no", "section", *[n for n in names if n not in levels], F.inline(charts))
    return out.withColumn("level", F.regexp_extract("raw_level", r"(\d+)", 1).try_cast("int")).filter("level IS NOT NULL")


def parse_flag_table(cells: DataFrame, title: str, artist: str, flag: str, marks: tuple[str, ...] = ("○", "◯", "〇")) -> DataFrame:
    """Columns by header name; a circle is true; rows of one title are one, with flags or-ed and the last names kept."""
    head = cells.filter("row_no = 0").select("page", "table_no", F.map_from_entries(F.transform(F.array_distinct("cells"), lambda h: F.struct(h, F.array_position("cells", h).cast("int") - 1))).alias("at"))
    rows = cells.filter("row_no > 0").join(head, ["page", "table_no"])
    value = lambda n: F.get("cells", F.try_element_at("at", F.lit(n)))
    wide = rows.select("page", "row_no", value(title).alias("title"), value(artist).alias("artist"), value(flag).isin(*marks).alias("flag")).filter("title != ''")
    return wide.groupBy("page", F.lower("title").alias("key")).agg(F.max("flag").alias("flag"), F.max_by("title", "row_no").alias("title"), F.max_by("artist", "row_no").alias("artist"))
