"""Secret scans: all rules in one automaton, one pass over the bytes.

The rules, read backwards, become one minimal search automaton; a single pass from the
end of a batch marks for every rule each byte at which a match starts.  Only the bytes of
matches are read again: from the leftmost start the same rules' anchored automaton, one
for all of them too, runs to the longest end, and the search goes on behind it.  For these
rules that is the leftmost, non-overlapping match of a regex.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.automaton import Dfa, alive, compile_rules, longest, scan
from tallyspark.llm.common import buffer_of, lean, slices, wide_rows


@dataclass(frozen=True)
class Rule:
    """A kind of span; ``least`` characters are needed in all, or, with ``value``, in what follows the first sign of those."""

    kind: str
    regex: str
    least: int = 0
    value: str = ""
    base: bool = False


#: The first three are fixed by contract, in this order; the rest add spans.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12, ":=", True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, "", True),
    Rule("hex", r"[0-9a-f]{16,}", 16, "", True),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("json_web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_login", r"[a-z]{2,}://[A-Za-z0-9._-]+:[A-Za-z0-9._!%+-]+@"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]+", 27),
)


def _value_length(text: bytes, signs: str) -> int:
    """Length of the value of an assignment: behind the first sign, blanks and one quote."""
    at = min(i for i in (text.find(s.encode()) for s in signs) if i >= 0) + 1
    while text[at : at + 1] == b" ":
        at += 1
    return len(text) - at - (text[at : at + 1] in (b'"', b"'"))


_compiled: dict[tuple[Rule, ...], tuple[Dfa, Dfa, np.ndarray]] = {}


def automata(rules: tuple[Rule, ...]) -> tuple[Dfa, Dfa, np.ndarray]:
    """The combined backward search automaton, the combined anchored one and its live rules, made once a process."""
    if rules not in _compiled:
        sources = [r.regex for r in rules]
        anchored = compile_rules(sources)
        _compiled[rules] = compile_rules(sources, backwards=True, search=True), anchored, alive(anchored)
    return _compiled[rules]


def spans_of(buf: np.ndarray, off: np.ndarray, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each document of a slice its (start, rule number, end) in bytes, sorted."""
    backward, forward, live = automata(rules)
    lo, n = int(off[0]), len(off) - 1
    # One byte that no UTF-8 text has stands between documents, so that no match crosses.
    cut = off - lo + np.arange(n + 1)
    data = np.full(int(cut[-1]), 0xFF, np.uint8)
    kept = np.ones(len(data), bool)
    kept[cut[1:] - 1] = False
    data[kept] = buf[lo : int(off[-1])]
    place, marks = scan(backward, data[::-1])
    place, marks = len(data) - 1 - place[::-1], marks[::-1]
    doc = np.searchsorted(cut, place, "right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    bound = np.searchsorted(doc, np.arange(n + 1))
    for d in np.unique(doc):
        text = data[cut[d] : cut[d + 1] - 1].tobytes()
        here, mark = place[bound[d] : bound[d + 1]] - cut[d], marks[bound[d] : bound[d + 1]]
        for k, rule in enumerate(rules):
            behind = 0
            for start in here[mark >> k & 1 > 0].tolist():
                if start < behind:
                    continue
                behind = longest(forward, live, text, start, 1 << k)
                size = _value_length(text[start:behind], rule.value) if rule.value else behind - start
                if size >= rule.least:
                    out[d].append((start, k, behind))
        out[d].sort()
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row, by start, then rule order; ends exclusive, in code points.

    Null and empty texts have no spans; repeated rows repeat; a very long text is scanned
    whole; columns of other names, ``spans`` too, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                buf, off = buffer_of(part.column("text"))
                rows = []
                for d, found in enumerate(spans_of(buf, off, rules)):
                    text = buf[off[d] : off[d + 1]] if found else None
                    points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80))) if found else None
                    rows.append([{"kind": rules[k].kind, "start": int(points[a]), "end": int(points[b])} for a, k, b in found])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, kind)], names=["id", "spans"])

    texts = wide_rows(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return found.withColumnRenamed("id", id_col)


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""

    def written(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    counts = [F.size(F.filter("spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return found.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
