"""Text normalisation, keys and comparison."""

from __future__ import annotations

import re
import string
import unicodedata
from bisect import insort
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What the keys fold or drop.
QUOTES_AND_DASHES = {"’": "'", "‘": "'", "＇": "'", "“": '"', "”": '"', "＂": '"', "－": "-", "–": "-", "—": "-", "～": "~", "〜": "~"}
ELLIPSIS = r"(?:\.{2,}|[…‥⋯]+|[・･]{2,})"
LOOK_ALIKES = {"А": "a", "В": "b", "Е": "e", "Ё": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "Х": "x", "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "х": "x"}
TITLE_PUNCTUATION = frozenset(string.punctuation + "　、。，．・･：；！？（）［］【】『』「」‘’“”")
STYLES = {"sp": "SINGLE", "single": "SINGLE", "singleplay": "SINGLE", "dp": "DOUBLE", "double": "DOUBLE", "doubleplay": "DOUBLE"}
DIFFICULTIES = {"beginner": "BEGINNER", "basic": "BASIC", "difficult": "DIFFICULT", "expert": "EXPERT", "challenge": "CHALLENGE", "beg": "BEGINNER", "bas": "BASIC", "dif": "DIFFICULT", "exp": "EXPERT", "cha": "CHALLENGE"}
SHOCK_MARKS = ("→", "SA", "Shock", "ショック")
CONTAINED_FROM = 5

_SPACES = r"[\s  　]+"


class Letters(dict):
    """A table for str.translate, filled as characters turn up: fixed changes, and characters that go."""

    def __init__(self, changes: dict[str, str], gone: Callable[[str], bool]):
        super().__init__()
        self.changes, self.gone = changes, gone

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = None if self.gone(c) else self.changes.get(c, c)
        return self[code]


def _never(c: str) -> bool:
    return False


#: What each key does to a text, in turn: a Unicode form, a table of letters, a pattern and its replacement, or case folding.
_STRICT = ("NFKC", Letters(QUOTES_AND_DASHES, _never), str.casefold, (re.compile(ELLIPSIS), "..."), Letters({}, str.isspace))
STEPS = {
    "strict": _STRICT,
    "loose": ("NFKD", str.casefold, Letters(LOOK_ALIKES, lambda c: unicodedata.category(c) == "Mn"), *_STRICT),
    "title": ("NFKC", str.casefold, Letters({}, lambda c: c.isspace() or c in TITLE_PUNCTUATION)),
}


def fold(kind: str, text: str) -> str:
    """The key of a text by the steps of its kind."""
    for step in STEPS[kind]:
        match step:
            case str():
                text = unicodedata.normalize(step, text)
            case Letters():
                text = text.translate(step)
            case (pattern, to):
                text = pattern.sub(to, text)
            case _:
                text = step(text)
    return text


def norm_ws(col: Column) -> Column:
    """White space, no-break and em spaces become one space; ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(col, _SPACES, " "))


#: Bytes of text that are Python strings at once.
FOLDED = 1 << 20


def fold_all(kind: str, texts: pa.Array) -> pa.Array:
    """``fold`` of a column, FOLDED bytes of text after the other, once for each different text of these."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // FOLDED)) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        part = texts.slice(a, b - a).to_pylist()
        found = {t: fold(kind, t) for t in set(part) if t is not None}
        out.append(pa.array([found.get(t) for t in part], pa.string()))
    return pa.concat_arrays(out)


def _folded(kind: str, col: Column | str) -> Column:
    """``fold_all`` over Arrow batches.  Made on use: workers import this module too."""

    def key(texts: pa.Array) -> pa.Array:
        return fold_all(kind, texts)

    return F.arrow_udf(key, "string")(col)


def compatible(col: Column | str) -> Column:
    """Unicode compatibility form (NFKC), a whole Arrow column at a time."""

    def normalise(texts: pa.Array) -> pa.Array:
        return pc.utf8_normalize(texts, form="NFKC")

    return F.arrow_udf(normalise, "string")(col)


def match_key(col: Column | str) -> Column:
    """Strict key: compatibility form, quotes, dashes and ellipses unified, case folded, no spaces."""
    return _folded("strict", col)


def alias_key(col: Column | str) -> Column:
    """Loose key: marks dropped and look-alike letters mapped before the strict key."""
    return _folded("loose", col)


def title_key(col: Column | str) -> Column:
    """Title key: compatibility form, case folded, no spaces or punctuation."""
    return _folded("title", col)


def similarity(seen: str | None, known: str | None) -> float:
    """Ratcliff/Obershelp ratio; 1 where ``known`` (five letters or more) lies inside ``seen``; 0 where either is blank."""
    if not seen or not known:
        return 0.0
    return 1.0 if len(known) >= CONTAINED_FROM and known in seen else SequenceMatcher(None, seen, known).ratio()


def title_similarity(seen: Column, known: Column) -> Column:
    """``similarity`` over Arrow batches; null where ``seen`` is null, so that pairs can be left out."""

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else similarity(x, y) for x, y in zip(a, b)], dtype=float)

    return F.pandas_udf(score, "double")(seen, known)


#: Letters of a text that a 64-bit word has room for; bits that are held at once.
WORD_BITS, MASK_CELLS = 64, 1 << 21


def common_letters(seen: list[str], known: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, a letter of all ``known`` at a time.

    Bit-parallel: a bit of ``v`` is nought where a letter of ``seen`` ends a longer match.
    ``seen`` of more than WORD_BITS letters gives the shorter length, which is no less.
    """
    size = np.array([[len(a), len(b)] for a, b in zip(seen, known)], np.int64).reshape(-1, 2)
    out = size.min(1)
    rows = np.flatnonzero((out > 0) & (size[:, 0] <= WORD_BITS))
    if not len(rows):
        return out
    letters = {c: i + 1 for i, c in enumerate(sorted({c for i in rows for c in seen[i]}))}
    texts = {t: i for i, t in enumerate(dict.fromkeys(seen[i] for i in rows))}
    if len(texts) * len(letters) > MASK_CELLS and len(rows) > 1:
        for half in np.array_split(rows, 2):
            out[half] = common_letters([seen[i] for i in half], [known[i] for i in half])
        return out
    mask = np.zeros((len(texts), len(letters) + 1), np.uint64)
    for text, i in texts.items():
        for at, c in enumerate(text):
            mask[i, letters[c]] |= np.uint64(1 << at)
    of = np.array([texts[seen[i]] for i in rows])
    width, others = int(size[rows, 1].max()), {t: i for i, t in enumerate(dict.fromkeys(known[i] for i in rows))}
    code = np.zeros((len(others), width), np.int64)
    for text, i in others.items():
        code[i, : len(text)] = [letters.get(c, 0) for c in text]
    code = code[[others[known[i]] for i in rows]]
    v = np.full(len(rows), np.iinfo(np.uint64).max, np.uint64)
    for at in range(width):
        hit = v & mask[of, code[:, at]]
        v = (v + hit) | (v - hit)
    inside = np.array([(1 << int(n)) - 1 for n in size[rows, 0]], np.uint64)
    out[rows] = np.bitwise_count(~v & inside)
    return out


def similarity_bounds(seen: pd.Series, known: pd.Series) -> pd.Series:
    """No less than ``similarity``: matching blocks are a common subsequence, so the longest of these bounds their letters."""
    a, b = seen.fillna("").to_list(), known.fillna("").to_list()
    out, step = [], max(1, MASK_CELLS // 256)
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        total = np.array([len(p) + len(q) for p, q in zip(x, y)])
        held = np.array([len(q) >= CONTAINED_FROM and q in p for p, q in zip(x, y)], bool)
        blank = np.array([not p or not q for p, q in zip(x, y)], bool)
        out.append(np.where(blank, 0.0, np.where(held, 1.0, 2.0 * common_letters(x, y) / np.maximum(total, 1))))
    return pd.Series(np.concatenate(out) if out else np.zeros(0))


def similarity_bound(seen: Column, known: Column) -> Column:
    """``similarity_bounds`` over Arrow batches."""

    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return similarity_bounds(a, b)

    return F.pandas_udf(bound, "double")(seen, known)


#: Letters of a known text for which common letters are counted; longer ones are bounded by their lengths.
WIDE = 256


def common_table(seen: list[str], known: list[str]) -> np.ndarray:
    """``common_letters`` of every seen text with every known one, or for long texts the shorter length, which is no less."""
    m, n = np.array([len(a) for a in seen], np.int64), np.array([len(b) for b in known], np.int64)
    out = np.minimum(m[:, None], n[None, :])
    rows, cols = np.flatnonzero((m > 0) & (m <= WORD_BITS)), np.flatnonzero((n > 0) & (n <= WIDE))
    if not len(rows) or not len(cols):
        return out
    letters = {c: i + 1 for i, c in enumerate(sorted({c for i in rows for c in seen[i]}))}
    code = np.zeros((int(n[cols].max()), len(cols)), np.int64)
    for k, j in enumerate(cols):
        code[: n[j], k] = [letters.get(c, 0) for c in known[j]]
    step = max(1, MASK_CELLS // (len(letters) + len(cols)) // 8)
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        mask = np.zeros((len(some), len(letters) + 1), np.uint64)
        for k, i in enumerate(some):
            for place, c in enumerate(seen[i]):
                mask[k, letters[c]] |= np.uint64(1 << place)
        v = np.full((len(some), len(cols)), np.iinfo(np.uint64).max, np.uint64)
        for places in code:
            hit = v & mask[:, places]
            v = (v + hit) | (v - hit)
        inside = np.array([(1 << int(k)) - 1 for k in m[some]], np.uint64)
        out[np.ix_(some, cols)] = np.bitwise_count(~v & inside[:, None])
    return out


def similarity_table(seen: list[str], known: list[str]) -> np.ndarray:
    """No less than ``similarity`` of every seen text with every known one."""
    common = common_table(seen, known)
    m, n = np.array([len(a) for a in seen], np.int64), np.array([len(b) for b in known], np.int64)
    held = (n >= CONTAINED_FROM) & (common >= n)  # what lies inside is common whole
    return np.where(held & (m[:, None] > 0), 1.0, 2.0 * common / np.maximum(m[:, None] + n, 1))


def six_digits(score: float) -> Decimal:
    """A score rounded as Spark's ``round`` does."""
    return Decimal(repr(score)).quantize(Decimal("0.000001"), ROUND_HALF_UP)


def best_titles(seen: list[str], known: list[str], count: list[int], best: int) -> Iterator[tuple[list[tuple[float, int]], int]]:
    """For each seen text the ``best`` known ones as (score, place), by score and place, and how many tie with the first to six digits, each counted ``count`` times.

    Known texts are scored by falling bound until no bound reaches what was found.
    """
    step, matchers = max(1, MASK_CELLS // max(1, len(known))), {}
    for at in range(0, len(seen), step):
        some = seen[at : at + step]
        for text, bounds in zip(some, similarity_table(some, known)):
            found, last = [], (-1.0, 0)  # (score, -place), rising
            tied, top, near = [], -1.0, -1.0
            for j in np.argsort(-bounds, kind="stable").tolist():
                bound = float(bounds[j])
                if bound < near and bound < last[0]:
                    break
                if bound < near and (bound, -j) < last:
                    continue
                score = _score(text, known[j], bound, matchers, j)
                if score >= near:
                    top = max(top, score)
                    near = top - 0.000001
                    tied.append((score, j))
                if len(found) < best or (score, -j) > found[0]:
                    insort(found, (score, -j))
                    found = found[-best:]
                    last = found[0] if len(found) == best else last
            first = six_digits(top) if tied else None
            yield [(s, -j) for s, j in reversed(found)], sum(count[j] for s, j in tied if s == top or (s >= near and six_digits(s) == first))


def _score(seen: str, known: str, bound: float, matchers: dict[int, SequenceMatcher], j: int) -> float:
    """``similarity``; what is known of ``known`` is kept from text to text."""
    if not bound or not seen or not known:
        return 0.0
    if len(known) >= CONTAINED_FROM and known in seen:
        return 1.0
    if (m := matchers.get(j)) is None:
        m = matchers[j] = SequenceMatcher(None, "", known)
    m.set_seq1(seen)
    return m.ratio()


def map_values(col: Column, mapping: dict[str, str], squeeze: str = r"[\s_]+") -> Column:
    """Look up the lower-cased, squeezed text; unknown values become the trimmed upper case.

    For texts that may hold full-width letters give ``compatible(col)``, which is what is looked up then.
    """
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(F.trim(col)), squeeze, "")), F.upper(F.trim(col)))


def first_int(col: Column) -> Column:
    """First run of digits of the compatible form (so full-width digits count) as a number; null without one."""
    found = F.regexp_extract(compatible(col), r"(\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


def digits(col: Column) -> Column:
    """All digits joined; "" without any."""
    return F.regexp_replace(col, r"\D+", "")


def contains_any(col: Column, tokens: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(col, F.lit(token))
    return found


def canonical_digits(col: Column) -> Column:
    """Digits without leading zeros; "0" stays."""
    return F.regexp_replace(digits(col), r"^0+(?=.)", "")


def digits_match(a: Column, b: Column) -> Column:
    """Three-valued: null where either has no digits, else whether the numbers are the same."""
    x, y = canonical_digits(F.coalesce(a, F.lit(""))), canonical_digits(F.coalesce(b, F.lit("")))
    return F.when((x != "") & (y != ""), x == y)


def extract_fields(col: Column, pattern: str, names: list[str]) -> list[Column]:
    """One column for each group of ``pattern``; absent ones are ""."""
    return [F.coalesce(F.regexp_extract(col, pattern, k + 1), F.lit("")).alias(name) for k, name in enumerate(names)]


def suffix_token(col: Column, tokens: tuple[str, ...]) -> Column:
    """First of ``tokens`` that the lower-cased text holds; null without one."""
    return F.coalesce(*[F.when(F.contains(F.lower(col), F.lit(t.lower())), F.lit(t)) for t in tokens])


def version_label(col: Column, prefixes: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """Spaces collapsed, a known prefix dropped, an alias replaced; anything else stays as it is."""
    text = norm_ws(col)
    for prefix in prefixes:
        text = F.when(F.startswith(F.lower(text), F.lit(prefix.lower())), F.trim(F.substr(text, F.lit(len(prefix) + 1)))).otherwise(text)
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(table, F.lower(text)), text)
