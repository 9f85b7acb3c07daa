"""Two-sided rows (home and away columns) as one row per match and side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixed(prefixes: Sequence[str], stats: Sequence[str]) -> list[str]:
    return [f"{p}{s}" for p in prefixes for s in stats]


def sides(
    matches: DataFrame,
    stats: Sequence[str],
    keep: Sequence[str] = ("match_id", "season", "week", "period"),
    home: str = "home",
    away: str = "away",
) -> DataFrame:
    """One row per (match, side) with ``for_*`` and ``opp_*`` columns.

    A generator over a two-element array reads the input once; a union of two
    projections would compute it twice.
    """

    def side(team: str, opp: str, own: str, other: str, is_home: bool) -> Column:
        return F.struct(
            F.col(team).alias("team"),
            F.col(opp).alias("opp"),
            F.lit(is_home).alias("is_home"),
            *[F.col(f"{own}_{s}").alias(f"for_{s}") for s in stats],
            *[F.col(f"{other}_{s}").alias(f"opp_{s}") for s in stats],
        )

    pair = F.array(side(home, away, "home", "away", True), side(away, home, "away", "home", False))
    return matches.select(*keep, F.inline(pair))


def attach_both(
    spine: DataFrame,
    by_team: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("period",),
    home: str = "home",
    away: str = "away",
) -> DataFrame:
    """Role-playing join: the same per-team columns for the home and the away side."""
    out = spine
    for role, team in (("home", home), ("away", away)):
        dim = by_team.select(
            F.col("team").alias(team), *keys, *[F.col(c).alias(f"{role}_{c}") for c in cols]
        )
        out = out.join(dim, [team, *keys], "left")
    return out
