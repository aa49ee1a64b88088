"""Column functions on hand-made values."""

import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import ids, scores, text, vectors


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_keys_fold_unicode(spark):
    rows = [("Ｆｏｏ　“Bar”‥…",), ("Ёж Café",), ("A.B・C!",), ("",), (None,)]
    got = values(spark, rows, "t string", text.match_key("t"), text.alias_key("t"), text.title_key("t"))
    assert got[0] == ('foo"bar"...', 'foo"bar"...', "foobar‥…".replace("‥…", unicodedata.normalize("NFKC", "‥…").replace(".", "")))
    assert got[1][1] == "eжcafe"
    assert got[2][2] == "abc"
    assert got[3:] == [("", "", ""), (None, None, None)]


def test_similarity():
    assert text.similarity("", "x") == text.similarity(None, "x") == 0
    assert text.similarity("xx hello yy", "hello") == 1
    assert text.similarity("abcd", "abxd") == SequenceMatcher(None, "abcd", "abxd").ratio()


def test_digits_match_is_three_valued(spark):
    rows = [("007", "7"), ("0", "00"), ("8", "7"), ("", "7"), ("7", None)]
    got = values(spark, rows, "a string, b string", text.digits_match(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, True, False, None, None]


@pytest.mark.parametrize("score,want", [(1_000_000, "AAA"), (990_000, "AAA"), (989_990, "AA+"), (899_990, "AA-"), (550_000, "D+"), (0, "D"), (5, None), (-10, None), (1_000_010, None), (None, None)])
def test_grade(spark, score, want):
    assert values(spark, [(score,)], "s int", scores.grade(F.col("s"))) == [(want,)]


def test_clear_class(spark):
    names = ["marvelous", "perfect", "great", "good", "miss", "ok"]
    rows = [(9, 0, 0, 0, 0, 1, False), (9, 1, 0, 0, 0, 1, False), (9, 1, 1, 0, 0, 1, False), (9, 1, 1, 1, 0, 1, False), (9, 1, 1, 1, 1, 1, False), (9, 0, 0, 0, 0, None, False), (9, 0, 0, 0, -1, 1, False), (9, 0, 0, 0, None, 1, True), (9, 0, 0, 0, 0, 1, None)]
    got = values(spark, rows, ", ".join(f"{n} int" for n in names) + ", failed boolean", scores.clear_class({n: F.col(n) for n in names}, F.col("failed")))
    assert [g[0] for g in got] == ["MFC", "PFC", "GFC", "FULL COMBO", "CLEAR", None, None, "FAILED", None]


def test_distances(spark):
    rows = [([0.0, 1.0], [1.0, 1.0]), ([0.0], [1.0, 1.0])]
    got = values(spark, rows, "a array<double>, b array<double>", vectors.l1(F.col("a"), F.col("b")), vectors.rmse(F.col("a"), F.col("b")), vectors.hamming(F.col("a"), F.col("b")))
    assert got[0] == (0.5, 0.5**0.5, 0.5)
    assert got[1] == (None, float("inf"), None)


def test_composite_and_rows(spark):
    s = "struct<thumbnail: array<double>, histogram: array<double>, dhash_bits: array<int>>"
    a, b = ([0.0, 0.0], [1.0], [1, 0]), ([1.0, 0.0], [0.5], [1, 1])
    got = values(spark, [(a, b)], f"a {s}, b {s}", F.round(vectors.composite_distance(F.col("a"), F.col("b")), 6))
    assert got == [(round(0.7 * 0.5 + 0.2 * 0.5 + 0.1 * 0.5, 6),)]
    got = values(spark, [(["0f", "00", "a1"], ["0f", "00", "a2"])], "a array<string>, b array<string>", vectors.row_match_count(F.col("a"), F.col("b")))
    assert got == [(1,)]
    got = values(spark, [([1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0],)], "g array<double>", vectors.row_hashes(F.col("g"), 4))
    assert got == [(["9", "8"],)]


def test_unpack_checks_shape(spark):
    rows = [([0, 255],), ([0],), ([0, 256],)]
    got = values(spark, rows, "a array<int>", vectors.unpack_u8(F.col("a"), 2))
    assert [g[0] for g in got] == [[0.0, 1.0], None, None]


def test_retention_and_confidence(spark):
    with pytest.raises(Exception, match="unknown retention class"):
        values(spark, [("x",)], "k string", scores.retention_until(F.col("k"), F.current_date()))
    got = values(spark, [(0.0, None), (0.24, 1.0), (0.12, 0.0075)], "d double, m double", F.round(scores.match_confidence(F.col("d"), F.col("m"), 0.24, 0.015), 4))
    assert [g[0] for g in got] == [1.0, 0.98, 0.99]


def test_json_candidates(spark):
    rows = [('[{"song_id":"b"},{"song_id":"a"},{"song_id":"b"}]',), ("junk",), (None,), ('[{"song_id":"x"}]',)]
    got = values(spark, rows, "j string", ids.json_candidates(F.col("j")), ids.sole(ids.json_candidates(F.col("j"))))
    assert [(list(a), b) for a, b in got] == [(["a", "b"], ""), ([], ""), ([], ""), (["x"], "x")]


def test_compatible_form_before_lookup(spark):
    rows = [("ＳＰ",), (" single ",), ("ｓｉｎｇｌｅ＿play",), ("ＬＶ．１２",), (None,)]
    got = values(spark, rows, "t string", text.map_values(text.compatible("t"), text.STYLES), text.first_int(F.col("t")))
    assert got == [("SINGLE", None), ("SINGLE", None), ("SINGLE", None), ("LV.12", 12), (None, None)]


def test_folds_against_plain_steps():
    """Keys of odd characters, against the rule written out for one text."""
    odd = ["ＡＢＣ　d", "a\u00a0\u2003b", "‘x’—“y”", "e\u0301É ß", "ЖЁё", "...‥…・・", "\u0301 a", "㌀ ﬁ", "\x1c\x85z", "A-B_c!?"]
    for t in odd:
        quoted = "".join(text.QUOTES_AND_DASHES.get(c, c) for c in unicodedata.normalize("NFKC", t)).casefold()
        assert text.fold("strict", t) == "".join(re.sub(text.ELLIPSIS, "...", quoted).split())
        bare = [c for c in unicodedata.normalize("NFKD", t).casefold() if unicodedata.category(c) != "Mn"]
        assert text.fold("loose", t) == text.fold("strict", "".join(text.LOOK_ALIKES.get(c, c) for c in bare))
        assert text.fold("title", t) == "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if not c.isspace() and c not in text.TITLE_PUNCTUATION)


def test_folding_holds_a_slice_of_the_texts(monkeypatch):
    """Few texts are Python strings at once, whatever the batch; long ones, nulls and empty ones keep their place."""
    texts = ["Ａb c", None, "", "é" * 50, "x", "Ａb c", None, "tail"] * 3
    want = [None if t is None else text.fold("loose", t) for t in texts]
    held = []
    monkeypatch.setattr(text, "FOLDED", 20)
    monkeypatch.setattr(text, "set", lambda part: held.append(len(part)) or set(part), raising=False)
    assert text.fold_all("loose", pa.array(texts)).to_pylist() == want
    assert len(held) > 3 and max(held) < len(texts)
    assert text.fold_all("loose", pa.array([], pa.string())).to_pylist() == []
