"""Scores, grades, classes and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grade bounds, ranks in the order of achievement, and targets.
GRADES = ((990_000, "AAA"), (950_000, "AA+"), (900_000, "AA"), (890_000, "AA-"), (850_000, "A+"), (800_000, "A"), (790_000, "A-"), (750_000, "B+"), (700_000, "B"), (690_000, "B-"), (650_000, "C+"), (600_000, "C"), (590_000, "C-"), (550_000, "D+"))
GRADE_ORDER = {"AAA": 100, "AA+": 90, "AA": 80, "AA-": 70, "A+": 60, "A": 50, "A-": 40, "B+": 30, "B": 20, "B-": 10}
CLEAR_ORDER = {"MFC": 6, "PFC": 5, "GFC": 4, "FC": 3, "FULL COMBO": 3, "CLEAR": 2}
GOALS = {"AAA": 990_000, "AA+": 950_000, "AA": 900_000}
RETENTION_DAYS = {"normal": 7, "diagnostic": 30, "permanent": None}


def grade(score: Column) -> Column:
    """Grade of a score of 0 to 1,000,000 in steps of ten; null for any other."""
    valid = score.between(0, 1_000_000) & (score % 10 == 0)
    label = F.lit("D")
    for bound, name in reversed(GRADES):
        label = F.when(score >= bound, name).otherwise(label)
    return F.when(valid, label)


def clear_class(counts: dict[str, Column], failed: Column) -> Column:
    """Class from the six counts marvelous, perfect, great, good, miss and ok; null where one is missing or negative."""
    bad = F.lit(False)
    for c in counts.values():
        bad = bad | F.coalesce(c < 0, F.lit(True))
    none = lambda *names: sum((counts[n] for n in names), F.lit(0)) == 0
    label = F.when(none("perfect", "great", "good", "miss"), "MFC").when(none("great", "good", "miss"), "PFC").when(none("good", "miss"), "GFC").when(none("miss"), "FULL COMBO").otherwise("CLEAR")
    return F.when(failed, "FAILED").when(failed.isNull() | bad, None).otherwise(label)


def ordinal(col: Column, order: dict[str, int]) -> Column:
    """Rank of a label; 0 for all others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), col), F.lit(0))


def goal_score(label: Column, default: int = 990_000) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in GOALS.items() for x in pair]), label), F.lit(default))


def signal_score(spec: list[tuple[str, float, float, float]]) -> Column:
    """Sum of weight x position of each column between its bounds; spec rows are (column, low, high, weight)."""
    total = F.lit(0.0)
    for name, low, high, weight in spec:
        total = total + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(name) - low) / (high - low))) * weight
    return total


def circular_distance(a: Column, b: Column, period: float = 360.0) -> Column:
    turn = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(turn, F.lit(period) - turn)


def value_hue_distance(value: Column, hue: Column, value_ref: Column, hue_ref: Column, scale: float = 18.0) -> Column:
    """Euclidean length of the scaled value and hue distances."""
    return F.hypot((value - value_ref) / scale, circular_distance(hue, hue_ref) / scale)


def match_confidence(distance: Column, margin: Column, max_distance: float, delta: float) -> Column:
    """0.98 and up to 0.02 more by the weaker of distance and margin strength; no rival counts as full margin."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    far = clamp((F.lit(max_distance) - distance) / max_distance)
    apart = F.when(margin.isNotNull(), clamp(margin / delta)).otherwise(1.0)  # least and greatest pass nulls over
    return F.least(F.lit(1.0), F.lit(0.98) + F.lit(0.02) * F.least(far, apart))


def retention_until(kind: Column, basis: Column) -> Column:
    """Basis and the days of its class; null for permanent; an unknown class raises."""
    days = F.when(kind == "normal", 7).when(kind == "diagnostic", 30).when(kind == "permanent", F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unknown retention class: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    return F.date_add(basis, days)
