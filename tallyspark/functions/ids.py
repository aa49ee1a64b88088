"""Ids, fingerprints and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL, UNIT = "\x00", "\x1f"


def _joined(sep: str, cols: tuple[Column, ...]) -> Column:
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def stable_id(prefix: str, *cols: Column) -> Column:
    """prefix_ and sixteen hex digits of SHA-1 over the parts, joined by NUL."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(_joined(NUL, cols)), 1, 16))


def row_sha256(*names: str) -> Column:
    """SHA-256 of the JSON object of the named columns in sorted order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def event_key(*cols: Column, required: tuple[Column, ...] = ()) -> Column:
    """SHA-256 over unit-separated parts; null where a required one is null or blank."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    return F.when(whole, F.sha2(_joined(UNIT, cols), 256))


def composite_hash(versions: tuple[Column, ...], hashes: tuple[Column, ...]) -> Column:
    """SHA-256 over NUL-joined versions and hashes; null unless every version is set and every hash is 64 hex digits."""
    good = F.lit(True)
    for v in versions:
        good = good & F.coalesce(v != "", F.lit(False))
    for h in hashes:
        good = good & F.coalesce(h.rlike("^[0-9a-f]{64}$"), F.lit(False))
    return F.when(good, F.sha2(_joined(NUL, versions + hashes), 256))


def evidence_json(**parts: Column) -> Column:
    """JSON text of nested evidence with keys in order."""
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))


def json_candidates(col: Column, key: str = "song_id") -> Column:
    """Distinct, sorted ids of a JSON array of objects; null or bad JSON gives an empty array."""
    ids = F.transform(F.from_json(col, f"array<struct<{key}: string>>"), lambda s: s[key])
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))), F.array().cast("array<string>"))


def sole(ids: Column) -> Column:
    """The only element, else ""."""
    return F.when(F.size(ids) == 1, F.element_at(ids, 1)).otherwise("")


def reasons(*rules: tuple[Column, str]) -> Column:
    """Codes of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), code) for rule, code in rules]))


def field_status(fields: dict[str, tuple[Column, Column]]) -> list[Column]:
    """For each field (value, confidence): its status; then ``ready`` and the blockers, joined by commas.

    A blank value is ``missing``, a null confidence ``unscored``, all others ``ready``.
    """
    status = {n: F.when(F.coalesce(F.trim(v.cast("string")) == "", F.lit(True)), "missing").when(c.isNull(), "unscored").otherwise("ready") for n, (v, c) in fields.items()}
    blocked = F.array_compact(F.array(*[F.when(s != "ready", F.concat(F.lit(f"{n}:"), s)) for n, s in status.items()]))
    return [*[s.alias(f"{n}_status") for n, s in status.items()], (F.size(blocked) == 0).alias("ready"), F.array_join(blocked, ",").alias("blockers")]
