"""User code in queries, and exact quantiles."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators.quantiles import quantiles
from tallyspark.sources import extract as X


def test_extractors_and_profiles(spark):
    half = X.extractor(lambda s: pd.DataFrame({"value": s.str[:1], "confidence": s.str.len() / 10, "status": np.where(s == "", "empty", "ok")}))
    same = X.extractor(lambda s: pd.DataFrame({"value": s.str.upper(), "confidence": 0.4, "status": "ok"}))
    items = spark.createDataFrame([(1, "abcd"), (2, ""), (3, None), (4, "abcdefgh")], "id int, t string").repartition(2)
    found = X.extract(items, "id", "t", {"half": half, "same": same})
    got = {(r["id"], r["profile"]): (r["value"], r["confidence"], r["status"]) for r in found.collect()}
    assert got[1, "half"] == ("a", 0.4, "ok") and got[2, "half"][2] == "empty" and got[3, "half"] == (None, 0.0, "missing") and got[4, "same"] == ("ABCDEFGH", 0.4, "ok") and len(got) == 8
    best = {r["id"]: (r["profile"], r["value"], r["status"]) for r in X.best_profile(found, "id", ["same", "half"], 0.4).collect()}
    assert best == {1: ("same", "ABCD", "ok"), 2: ("same", "", "ok"), 3: (None, None, "none"), 4: ("half", "a", "ok")}
    wrong = X.extractor(lambda s: pd.DataFrame({"value": s, "confidence": 2.0, "status": "ok"}))
    with pytest.raises(Exception, match="confidence"):
        X.extract(items, "id", "t", {"wrong": wrong}).collect()
    assert X.extract(items.limit(0), "id", "t", {"half": half}).count() == 0


def test_dispositions_are_checked(spark):
    events = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (3, "b", 1), (4, "c", 9)], "id int, kind string, tries int")
    said = {"a": "done", "b": "retry", "c": "skip"}
    got = X.process(events, lambda t: t["kind"].map(said), ["kind", "tries"], "tries", 3)
    assert {r["id"]: (r["disposition"], r["outcome"]) for r in got.collect()} == {1: ("done", "resolved"), 2: ("retry", "unresolved"), 3: ("retry", "retry"), 4: ("skip", "skipped")}
    for bad in ("later", None):
        with pytest.raises(Exception, match="unknown disposition"):
            X.process(events, lambda t, bad=bad: pd.Series([bad] * len(t), dtype=object), ["kind"], "tries", 3).select("outcome").collect()


def test_table_functions_are_called_laterally(spark):
    X.register(spark)
    pages = spark.createDataFrame([(1, "http://s/p", "<a href=/x>X &amp; Y</a><a>none</a><table><tr><td rowspan=2>a<td>b<tr><td>c</table>"), (2, None, None)], "id int, url string, html string")
    links = spark.sql("SELECT id, r.* FROM {pages}, LATERAL html_rows(html, url, 'a', 'href') r", pages=pages).collect()
    assert [tuple(r) for r in links] == [(1, 0, "X & Y", "http://s/x", True, None), (1, 1, "none", None, None, "missing_link")]
    cells = spark.sql("SELECT id, r.row_no, r.cells FROM {pages}, LATERAL html_cells(html) r", pages=pages).collect()
    assert sorted(map(tuple, cells)) == [(1, 0, ["a", "b"]), (1, 1, ["a", "c"])]
    for call, match in (("html_rows(html, id, 'a', 'href')", "url must be a string"), ("html_rows(html, url, url, 'href')", "constant")):
        with pytest.raises(Exception, match=match):
            spark.sql(f"SELECT r.* FROM {{pages}}, LATERAL {call} r", pages=pages).collect()


@pytest.mark.parametrize("parts", [2, 7, 4096])
def test_quantiles(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice(["a"] * 6 + ["b", None]), draw.choice([draw.gauss(0, 1), draw.randint(0, 3) * 1.0, 10.0 ** draw.randint(-12, 12)])) for _ in range(300)]
    rows += [("one", 5.0), ("same", 2.0), ("same", 2.0), ("null", None), ("nan", math.nan), ("far", -1.7e308), ("far", 1.7e308), ("far", 5e-324), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: (r["a"], r["b"], r["c"], r["d"]) for r in quantiles(df, "v", ["g"], {"a": 0.25, "b": 0.5, "c": 0.75, "d": 1.0}, parts).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None and v == v:
            groups[g].append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort()
        for q, found in zip((0.25, 0.5, 0.75, 1.0), got[g]):
            at = (len(values) - 1) * q
            lo = int(at)
            want = values[lo] * (1 - (at - lo)) + values[min(lo + 1, len(values) - 1)] * (at - lo)
            assert found == pytest.approx(want, rel=1e-12)
    assert quantiles(df.limit(0), "v", ["g"], {"a": 0.5}).count() == 0
    with pytest.raises(Exception, match="infinite"):
        quantiles(spark.createDataFrame([("x", math.inf)], "g string, v double"), "v", ["g"], {"a": 0.5}).collect()
