"""Scoring rules and derived rates of player figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_ratio

# Points per unit of each figure, and the bonus line in yards.
PASSER_WEIGHTS = {
    "passing_touchdowns": 4, "passing_yards": 0.04, "interceptions_thrown": -1, "rush_yards": 0.1, "rush_touchdowns": 6,
}
PASSER_BONUS = {"passing_yards": 300, "rush_yards": 100}
SKILL_WEIGHTS = {
    "rush_yards": 0.1, "rush_touchdowns": 6, "receptions": 1, "receiving_yards": 0.1, "receiving_touchdowns": 6,
}
SKILL_BONUS = {"rush_yards": 100, "receiving_yards": 100}
BONUS_POINTS = 3
RECEPTION_POINTS = {"standard": 0, "half": 0.5, "full": 1}


def weighted_points(weights: Mapping[str, float], bonus: Mapping[str, int], rounded_bonus: bool = False) -> Column:
    """Half-even rounded figures times weights, plus a bonus above each yard line."""
    total = F.lit(0.0)
    for col, w in weights.items():
        total = total + F.bround(F.col(col), 0) * w
    for col, line in bonus.items():
        x = F.bround(F.col(col), 0) if rounded_bonus else F.col(col)
        total = total + F.when(x > line, BONUS_POINTS).otherwise(0)
    return total


def passer_points() -> Column:
    return weighted_points(PASSER_WEIGHTS, PASSER_BONUS)


def skill_points(receptions: str = "full") -> Column:
    return weighted_points({**SKILL_WEIGHTS, "receptions": RECEPTION_POINTS[receptions]}, SKILL_BONUS)


def points_of(columns: Sequence[str], substring: bool = False) -> Column:
    """Score over whatever figures are present.

    Exact names by default.  ``substring=True`` also counts columns that only
    contain a figure's name (such as ``rush_yards_per_attempt``).
    """
    weights = {**PASSER_WEIGHTS, **SKILL_WEIGHTS}
    if substring:
        weights = {**{k: v for k, v in weights.items() if k != "interceptions_thrown"}, "interceptions": -1}
    bonus = {**PASSER_BONUS, **SKILL_BONUS}
    total = F.lit(0.0)
    for figure, w in weights.items():
        hits = [c for c in columns if (figure in c if substring else figure == c)]
        for c in hits:
            total = total + weighted_points({c: w}, {c: bonus[figure]} if figure in bonus else {}, rounded_bonus=True)
    return F.round(total, 2)


def passer_rates(digits: int = 2) -> dict[str, Column]:
    """The ten derived passing rates; a zero denominator gives 0."""
    comp, att, tds = F.col("completed_passes"), F.col("attempted_passes"), F.col("passing_touchdowns")
    ints, yards = F.col("interceptions_thrown"), F.col("passing_yards")
    sacks, lost = F.col("times_sacked"), F.col("yards_lost_from_sacks")
    adjusted = yards + tds * 20 - ints * 45
    rates = {
        "completion_percentage": safe_ratio(comp, att) * 100,
        "td_percentage": safe_ratio(tds, att) * 100,
        "interception_percentage": safe_ratio(ints, att) * 100,
        "yards_per_attempt": safe_ratio(yards, att),
        "adjusted_yards_per_attempt": safe_ratio(adjusted, att),
        "yards_per_completion": safe_ratio(yards, comp),
        "sack_percentage": safe_ratio(sacks, att + sacks) * 100,
        "net_gained_per_pass_attempt": safe_ratio(yards - lost, att + sacks),
        "adjusted_net_yards_per_pass_attempt": safe_ratio(adjusted - lost, att + sacks),
        "rush_yards_per_attempt": safe_ratio(F.col("rush_yards"), F.col("rush_attempts")),
    }
    return {k: F.bround(v, digits) for k, v in rates.items()}


def skill_rates(digits: int = 3) -> dict[str, Column]:
    """The twelve derived rushing and receiving rates."""
    ry, ra, rtd = F.col("rush_yards"), F.col("rush_attempts"), F.col("rush_touchdowns")
    recy, rec, rectd = F.col("receiving_yards"), F.col("receptions"), F.col("receiving_touchdowns")
    target = F.col("times_pass_target")
    touches, scrimmage, tds = ra + rec, ry + recy, rtd + rectd
    rates = {
        "rush_yards_per_attempt": safe_ratio(ry, ra),
        "receiving_yards_per_reception": safe_ratio(recy, rec),
        "catch_percentage": safe_ratio(rec, target) * 100,
        "receiving_yards_per_target": safe_ratio(recy, target),
        "total_touches": touches,
        "yards_from_scrimmage": scrimmage,
        "scrimmage_yards_per_touch": safe_ratio(scrimmage, touches),
        "total_touchdowns": tds,
        "touchdown_per_touch": safe_ratio(tds, touches),
        "touchdown_per_reception": safe_ratio(rectd, rec),
        "touchdown_per_rush": safe_ratio(rtd, ra),
        "touchdown_per_target": safe_ratio(rectd, target),
    }
    return {k: F.bround(v, digits) for k, v in rates.items()}
