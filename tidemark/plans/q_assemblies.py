"""Training tables assembled from registered features."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import models as M
from tidemark.operators import ratings as R
from tidemark.operators.assemble import assemble, feature, tag
from tidemark.operators.folds import SPINE_FEATURES, Folds
from tidemark.operators.lookups import join_all
from tidemark.operators.sides import attach_both
from tidemark.plans import features as X
from tidemark.plans import q_history, q_scalars, q_state, q_tables, q_text  # noqa: F401
from tidemark.plans.q_history import _RANKED as RANKED
from tidemark.plans.q_history import BOTH, SIDE_VALUES, _last_n_sql, _rank_sql, on_matches, round6, team_keys
from tidemark.plans.q_state import _SEASON_RULE, _pair_sql
from tidemark.plans.registry import REGISTRY, query
from tidemark.plans.testbed import Tables, views
from tidemark.session import stored
from tidemark.sources.files import scratch
from tidemark.streaming.incremental import advance_ratings

MATCH_FEATURES = ["last_five_means", "rankings_on_spine", "betting_lines", "match_targets"]
FULL_FEATURES = [
    "season_record", "standings_on_spine", "last_results", "last_points_allowed", "last_points_scored",
    "head_to_head_results", "matchup_info", "coach_month_record",
]
PLAYER_FEATURES = [
    "player_season_average", "player_career_average", "player_last_points", "player_last_mean", "player_last_role_figures",
    "player_mean_role_figures", "opponent_allowed_points", "season_share_average", "listed_in_lineup",
]


def _register(name: str) -> None:
    @feature(name)
    def build(spine: DataFrame, t: Tables) -> DataFrame:
        # The features' own spine columns stay with the spine.
        df = REGISTRY[name].build(t)
        return df.select(*[c for c in df.columns if c not in spine.columns or c in ("match_id", "player")])


for _n in {*MATCH_FEATURES, *FULL_FEATURES, *PLAYER_FEATURES}:
    _register(_n)


@feature("means_on_spine")
def means_on_spine(spine: DataFrame, t: Tables) -> DataFrame:
    """Mean of the last five matches of both sides for any spine (match_id, period,
    home, away), history rows or a schedule still to be played."""
    state = H.last_n_means(t.sides, ["team"], {c: F.col(c) for c in SIDE_VALUES}, 5)
    known = H.resolve(team_keys(spine), state, ["team"], SIDE_VALUES)
    both = attach_both(spine.select(*SPINE), known, SIDE_VALUES)
    return both.drop("period", "home", "away")


@feature("meetings_on_spine")
def meetings_on_spine(spine: DataFrame, t: Tables) -> DataFrame:
    """Earlier meetings of the two sides, and how many of them the home side won."""
    key = ["lo", "hi"]
    past = t.matches.select(*H.unordered_pair("home", "away"), "period", "winner")
    won_by_lo = F.coalesce((F.col("winner") == F.col("lo")).cast("int"), F.lit(0))
    won_by_hi = F.coalesce((F.col("winner") == F.col("hi")).cast("int"), F.lit(0))
    totals = H.period_totals(past, key, {"lo_won": won_by_lo, "hi_won": won_by_hi})
    state = H.running_totals(totals, key, ["n", "lo_won", "hi_won"])
    keyed = spine.select("match_id", "period", "home", *H.unordered_pair("home", "away"))
    out = H.asof(keyed, state, key, ["n", "lo_won", "hi_won"])
    won = F.when(F.col("home") == F.col("lo"), F.col("lo_won")).otherwise(F.col("hi_won"))
    return out.select("match_id", F.coalesce("n", F.lit(0)).alias("meetings"), F.coalesce(won, F.lit(0)).alias("meetings_won"))


UPCOMING = ["means_on_spine", "meetings_on_spine"]
SPINE = ["match_id", "period", "home", "away"]


def held_back(t: Tables) -> tuple[Tables, DataFrame]:
    """Tables that end before the last period, and that period's schedule without results."""
    games = t.once("matches").matches
    last = games.agg(F.max("period")).scalar()
    return t.with_matches(games.filter(F.col("period") < last)), games.filter(F.col("period") == last).select(*SPINE)


_MEETINGS_SQL = """, met AS (SELECT m.match_id, count(p.match_id) AS meetings, count(*) FILTER (p.winner = m.home) AS meetings_won FROM matches m LEFT JOIN matches p
      ON least(p.home, p.away) = least(m.home, m.away) AND greatest(p.home, p.away) = greatest(m.home, m.away) AND p.period < m.period GROUP BY 1)"""


@query(
    "U-1 ML-14 PF-24 PF-25 J-6 SL-1",
    _last_n_sql(5) + _MEETINGS_SQL + " SELECT match_id, period, home, away, " + ", ".join(f"round({c}, 6) AS {c}" for c in BOTH)
    + ", meetings, meetings_won FROM j JOIN met USING (match_id) WHERE period = (SELECT max(period) FROM matches)",
)
def upcoming_features(t: Tables) -> DataFrame:
    """Features of a schedule that has no results yet; they equal the history rows of its period."""
    known, schedule = held_back(t)
    return round6(assemble(schedule, known, UPCOMING, ["match_id"]), BOTH)


_HOLD = _last_n_sql(5) + """, last AS (SELECT max(period) AS p FROM matches),
    h AS (SELECT j.match_id, j.home_for_points AS x, m.home_points AS y, j.period FROM j JOIN matches m USING (match_id)),
    mean AS (SELECT avg(x) AS x FROM h WHERE period < (SELECT p FROM last)),
    f AS (SELECT match_id, y, period, coalesce(x, (SELECT x FROM mean)) AS x FROM h),
    line AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f WHERE period < (SELECT p FROM last))
    SELECT match_id, round(i + s * x, 4) AS prediction FROM f, line WHERE period = (SELECT p FROM last)"""


@query("ML-14 ML-6 U-1", _HOLD)
def upcoming_predictions(t: Tables) -> DataFrame:
    """Model fitted on the history, saved, loaded again and applied to the schedule.

    Gaps in the schedule's features take the mean of the training rows."""
    known, schedule = held_back(t)
    cols = ["home_for_points"]
    # History and schedule in one spine: the state that both look up is folded once.
    games = known.matches.select(*SPINE, "home_points", F.lit(True).alias("played"))
    games = games.unionByName(schedule.withColumns({"home_points": F.lit(None).cast("long"), "played": F.lit(False)}))
    wide = stored(assemble(games, known, ["means_on_spine"], ["match_id"]).select("match_id", "played", "home_points", *cols))
    train = wide.filter("played").select("home_points", *cols)
    path = scratch(t.spark, "match-model")
    M.fit(H.fill_with_mean(train, cols), cols, "home_points", M.regressor()).save(path)
    rows = wide.filter("NOT played").select("match_id", *cols)
    out = M.score(PipelineModel.load(path), H.fill_with_mean(rows, cols, over=train), ["match_id"], "prediction")
    return out.withColumn("prediction", F.round("prediction", 4))


@query("ML-14 ML-6 U-1")
def upcoming_full_predictions(t: Tables) -> DataFrame:
    """Linear model of the home score on the full feature set, fitted on the history,
    saved, loaded again and applied to the schedule.

    History and schedule share every fold but those of the spine itself."""
    known, schedule = held_back(t)
    facts = Folds(known, schedule)
    facts.done["matches"] = known.matches  # written already
    upcoming = stored(facts.assemble(X.WIDE))
    # The label is a column of the spine: the wide rows are not shuffled for it.
    wide = stored(facts.over(known.matches.select(*SPINE, "home_points")).assemble(X.WIDE))
    cols = [c for c in upcoming.columns if c not in SPINE]
    used = M.varying(wide, cols)
    path = scratch(t.spark, "full-model")
    M.fit(H.fill_with_mean(wide, used), used, "home_points", M.regressor(regParam=0.01)).save(path)
    out = M.score(PipelineModel.load(path), H.fill_with_mean(upcoming, used, over=wide), ["match_id"], "prediction")
    return out.withColumn("prediction", F.round("prediction", 4))


def _joined(spine_sql: str, names: list[str], on: str) -> str:
    out = f"SELECT * FROM ({spine_sql}) s0"
    for i, n in enumerate(names):
        keep = "* EXCLUDE (period, home, away)" if n == "last_five_means" else "*"
        out += f" LEFT JOIN (SELECT {keep} FROM ({REGISTRY[n].sql}) x{i}) y{i} USING ({on})"
    return out


_SPINE = views("matches") + " SELECT match_id, period, home, away FROM matches"


def team_means(folds: Folds, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Means over the spine of the team state's ``cols``, home sides first, as ``names``:
    one row.  They come from the rows of teams and periods, which are written once, so
    the wide rows, which are many more, need not be written for them."""
    known = folds.done["team_wide"] = stored(folds("team_wide"))
    return H.role_means(folds.spine, known, cols).toDF(*names)


@query("J-2 J-3 PF-18", _joined(_SPINE, MATCH_FEATURES, "match_id"))
def match_table(t: Tables) -> DataFrame:
    """Current match model: last-five means, ranks, betting lines, targets.

    Histories come from shared folds; lines and targets are columns of the match."""
    t = t.once("matches")
    folds = Folds(t, t.matches.select(*SPINE))
    folds.done["matches"] = t.matches
    means = team_means(folds, [f"mean_{c}" for c in SIDE_VALUES], BOTH)
    wide = ["last_five_raw", "rankings_on_spine"]
    known = {*SPINE, *[c for n in wide for c in SPINE_FEATURES[n].columns()]}
    # Lines and targets come first, so the sides' columns pass one shuffle.
    own = [REGISTRY[n].build(t) for n in ("betting_lines", "match_targets")]
    own = [df.select("match_id", *[c for c in df.columns if c not in known]) for df in own]
    return round6(H.fill_with_mean(folds.assemble(wide, own), BOTH, means=means), BOTH)


@query("J-2 J-3", _joined(_SPINE, FULL_FEATURES, "match_id"))
def match_full_table(t: Tables) -> DataFrame:
    """Wider match model: records, standings, last results, meetings, coaches.

    All features come from shared folds: the matches are folded and written once."""
    t = t.once("matches")
    folds = Folds(t, t.matches.select(*SPINE))
    folds.done["matches"] = t.matches
    means = team_means(folds, [f"for_points_{i}" for i in range(1, 6)], X.SCORED)
    return round6(H.fill_with_mean(folds.assemble(X.FULL), X.SCORED, means=means), X.SCORED)


_RATED = _pair_sql(_SEASON_RULE)
_RATINGS_SQL = f"""SELECT m.match_id, h.rating AS home_rating, a.rating AS away_rating FROM ({views('matches')} SELECT match_id, period, home, away FROM matches) m
    JOIN ({_RATED}) h ON h.team = m.home AND h.period = m.period JOIN ({_RATED}) a ON a.team = m.away AND a.period = m.period"""
#: Registered features of a team and period, and the prefix of their columns.
TEAM_FEATURES = {
    "lineup_ratings_by_role": "lineup_", "lineup_share_means_by_role": "share_", "best_lineup_ratings": "", "split_games": "", "coach_ratings": "coach_",
}
#: Of a match; of a match and one of its sides.
LINE_COLUMNS = ["home_spread", "away_spread", "home_favoured", "ou_points"]
LEAGUE_COLUMNS = [f"{r}_{c}" for r in ("home", "away") for c in ("for_points", "opp_points")]
QUARTERS = [f"{c}_q{i}" for c in ("scored", "allowed") for i in range(1, 5)]
TEAM_COLUMNS = {
    "lineup_ratings_by_role": [f"{r.lower()}_{a}" for r in sorted(q_state.ROLE_ORDER) for a in ("avg", "min", "max")],
    "lineup_share_means_by_role": [f"{r.lower()}_avg" for r in sorted(q_state.ROLE_ORDER)],
    "best_lineup_ratings": [f"best_{r.lower()}" for r in q_state.ROLE_ORDER],
    "split_games": ["split_game"],
    "coach_ratings": ["rating"],
}


def _wide_sql() -> str:
    out = f"SELECT * FROM ({_SPINE}) s0"
    for i, n in enumerate(["season_record", "standings_on_spine", "last_results", "head_to_head_results", "matchup_info", "coach_month_record"]):
        out += f" LEFT JOIN ({REGISTRY[n].sql}) f{i} USING (match_id)"
    out += f" LEFT JOIN (SELECT match_id, {', '.join(LINE_COLUMNS)} FROM ({REGISTRY['betting_lines'].sql})) USING (match_id)"
    league = ", ".join(f"{c} AS league_{c}" for c in LEAGUE_COLUMNS)
    out += f" LEFT JOIN (SELECT match_id, {league} FROM ({REGISTRY['last_five_with_league_fallback'].sql})) USING (match_id)"
    for r in ("home", "away"):
        for n, prefix in TEAM_FEATURES.items():
            cols = ", ".join(f"{c} AS {r}_{prefix}{c}" for c in TEAM_COLUMNS[n])
            out += f" LEFT JOIN (SELECT team AS {r}, period, {cols} FROM ({REGISTRY[n].sql})) USING ({r}, period)"
        cols = ", ".join(f"{c} AS {r}_{c}" for c in QUARTERS)
        out += f" LEFT JOIN (SELECT match_id, team AS {r}, {cols} FROM ({REGISTRY['quarter_means'].sql})) USING (match_id, {r})"
    return out


@query("U-1 J-2 J-4 Q-4 Q-5 Q-7 A-6 A-11 A-12 F-11 F-12 H-2 H-13 H-26", _wide_sql())
def match_wide_table(t: Tables) -> DataFrame:
    """The widest match table: histories from shared folds, with lines, league means,
    quarter means, line-up ratings and shares, coach ratings of both sides.

    Matches and outings are written once; every part reads those."""
    t = t.once("matches", "outings")
    spine = t.matches.select(*SPINE)
    folds = Folds(t, spine)
    folds.done["matches"] = t.matches
    own = ["season_record", "standings_on_spine", "last_results", "head_to_head_results", "matchup_info", "coach_month_record"]
    league = q_history.last_five_with_league_fallback(t).select("match_id", *[F.col(c).alias(f"league_{c}") for c in LEAGUE_COLUMNS])
    lines = REGISTRY["betting_lines"].build(t).select("match_id", *LINE_COLUMNS)
    parts = {n: REGISTRY[n].build(t).select("team", "period", *TEAM_COLUMNS[n]) for n in TEAM_FEATURES}
    # One row per team and period of all parts: a full join folds them into one side table.
    team = None
    for n, prefix in TEAM_FEATURES.items():
        part = parts[n].select("team", "period", *[F.col(c).alias(prefix + c) for c in TEAM_COLUMNS[n]])
        team = part if team is None else team.join(part, ["team", "period"], "full")
    # Both sides' quarters of a match, by its id: the narrow rows meet, not the wide ones.
    quarters = stored(q_history.quarter_means(t))
    both = spine.select("match_id", "home", "away")
    for r in ("home", "away"):
        side = quarters.select("match_id", F.col("team").alias(r), *[F.col(c).alias(f"{r}_{c}") for c in QUARTERS])
        both = both.join(side, ["match_id", r], "left")
    return folds.assemble(own, [lines, league, both.drop("home", "away")], stored(team)).select(
        *SPINE, *[c for n in own for c in SPINE_FEATURES[n].columns()], *LINE_COLUMNS, *[f"league_{c}" for c in LEAGUE_COLUMNS],
        *[f"{r}_{c}" for r in ("home", "away") for c in team.columns if c not in ("team", "period")], *[f"{r}_{c}" for r in ("home", "away") for c in QUARTERS],
    )


#: Player features by their keys; a prefix where names meet.
PLAYER_MORE = {
    "season_offset_join": (["match_id", "player"], ["record", "ratio"]),
    "week_ranks": (["match_id"], ["week_rank", "max_rank"]),
    "primary_so_far": (["player", "team", "period"], ["is_primary"]),
    "team_calendar_shares": (["player", "team", "period"], [f"share_{i}" for i in range(1, 5)]),
    "team_calendar_share_differences": (["player", "team", "period"], [f"diff_{i}" for i in range(1, 4)]),
    "starts_info": (["player", "period"], ["career_games", "career_starts", "season_games", "season_starts", "last_games", "last_starts"]),
}


def _player_wide_sql() -> str:
    out = f"SELECT *, {', '.join(f'(position = {chr(39)}{r}{chr(39)})::INT AS is_{r.lower()}' for r in q_state.ROLE_ORDER)} FROM ({REGISTRY['player_table'].sql})"
    for n, (keys, cols) in PLAYER_MORE.items():
        out += f" LEFT JOIN (SELECT DISTINCT {', '.join([*keys, *cols])} FROM ({REGISTRY[n].sql})) USING ({', '.join(keys)})"
    best = ", ".join(f"best_{r.lower()}" for r in q_state.ROLE_ORDER)
    return out + f" LEFT JOIN (SELECT team, period, {best} FROM ({REGISTRY['best_lineup_ratings'].sql})) USING (team, period)"


_UP = ["season_record", "standings_on_spine", "last_results", "last_points_allowed", "head_to_head_results", "matchup_info", "coach_month_record"]
_RANKS_SQL = _rank_sql() + """, pk AS (SELECT k.team, k.period, """ + ", ".join(
    f"arg_max(r.{c}_rank, r.period) AS {c}_rank" for c in RANKED
) + """ FROM (SELECT DISTINCT team, period FROM sides) k JOIN ranks r ON r.team = k.team AND r.period < k.period GROUP BY ALL)
    SELECT match_id, """ + ", ".join(f"{r[0]}.{c}_rank AS {r}_{c}_rank" for r in ("home", "away") for c in RANKED) + """
    FROM matches m LEFT JOIN pk h ON h.team = home AND h.period = m.period LEFT JOIN pk a ON a.team = away AND a.period = m.period"""
_RAW_SQL = _last_n_sql(5) + """, r2 AS (SELECT kteam, kperiod, """ + ", ".join(
    [f"max(for_points) FILTER (rn = {i}) AS scored_{i}" for i in range(1, 6)]
    + [f"max({c}) FILTER (rn = {i}) AS {c}_{i}" for c in ("for_points", "for_yards", "opp_yards") for i in range(1, 4)]
) + """ FROM recent WHERE rn <= 5 GROUP BY ALL)
    SELECT j.match_id, """ + ", ".join(f"round({c}, 6) AS {c}" for c in BOTH) + ", " + ", ".join(
    f"{r[0]}.{c} AS {r}_{c}" for r in ("home", "away")
    for c in [*[f"scored_{i}" for i in range(1, 6)], *[f"{c}_{i}" for c in ("for_points", "for_yards", "opp_yards") for i in range(1, 4)]]
) + " FROM j LEFT JOIN r2 h ON h.kteam = home AND h.kperiod = j.period LEFT JOIN r2 a ON a.kteam = away AND a.kperiod = j.period"


@query(
    "U-1 J-2 ML-14 R-4 H-6 H-1 Q-2",
    "SELECT * FROM (" + _joined(_SPINE, _UP, "match_id") + f" LEFT JOIN ({_RANKS_SQL}) zr USING (match_id) LEFT JOIN ({_RAW_SQL}) zw USING (match_id)"
    + f" LEFT JOIN ({_RATINGS_SQL}) zq USING (match_id)) WHERE period = (SELECT max(period) FROM (SELECT year(l_shipdate) * 100 + month(l_shipdate) AS period FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier)))",
)
def upcoming_full_table(t: Tables) -> DataFrame:
    """The full feature set of a schedule without results: the matches of its period are
    not among the facts, and its rows equal the history rows."""
    known, schedule = held_back(t)
    folds = Folds(known, schedule)
    folds.done["matches"] = known.matches  # written already
    return folds.assemble(X.WIDE)


@query(
    "J-2 J-3 PF-24",
    _joined(views("outings") + " SELECT match_id, player, team, period, position FROM outings", PLAYER_FEATURES, "match_id, player"),
)
def player_table(t: Tables) -> DataFrame:
    """Player points model: averages, last games, opponent, shares, starter flag."""
    t = t.once("outings")  # every fold reads them
    return with_player_features(t.outings.select(*PLAYER_SPINE), t).drop("opp", "week")


#: An outing's keys and role, and what the features look up by.
PLAYER_SPINE = ["match_id", "player", "team", "period", "position", "opp", "week"]
#: Columns of the player features, in the order of ``PLAYER_FEATURES``.
PLAYER_COLUMNS = [
    ["season_avg"], ["career_avg"], [f"points_{i}" for i in range(1, 6)], ["avg_points"], [f"{s}_{i}" for s in "abc" for i in range(1, 5)],
    ["a", "b", "c"], [f"allowed_{i}" for i in range(1, 6)], ["share_avg"], ["is_starter"],
]


def with_player_features(spine: DataFrame, t: Tables, more: Sequence[tuple[DataFrame, list[str]]] = ()) -> DataFrame:
    """``spine`` (the columns of ``PLAYER_SPINE`` and more) with the player features of
    its outings, and with the frames ``more`` by their keys.

    Features by player share two folds and one join.  They belong to (match, player):
    where several outings have the same, each feature of one meets those of all, as in
    a join of the features one by one, which is done for those outings only."""
    key, known = ["match_id", "player"], q_history.player_known(t)
    cols = [c for part in PLAYER_COLUMNS for c in part]
    again = t.outings.filter("match_id IS NOT NULL").groupBy(*key).count().filter("count > 1").select(*key)
    again = stored(again)
    repeated = again.limit(1).count() > 0
    if repeated:
        known = stored(known)

    def joined(rows: DataFrame) -> DataFrame:
        return functools.reduce(lambda df, x: df.join(x[0], x[1], "left"), more, rows)

    # The narrow lookups first, so the wide rows pass one shuffle.
    rows = spine.join(again, key, "left_anti") if repeated else spine
    rows = joined(q_tables.with_listed(q_history.with_allowed(rows, t), t))
    out = q_history.with_player_known(rows, known)
    # A row without a match has no features.
    own = [c for c in rows.columns if c not in cols]
    out = out.select(*own, *[F.when(F.col("match_id").isNotNull(), F.col(c)).alias(c) for c in cols])
    if not repeated:
        return out
    rows = t.outings.select(*PLAYER_SPINE).join(again, key, "left_semi")
    base = stored(q_history.with_player_known(q_history.with_allowed(rows, t), known))
    parts = [(q_tables.with_listed(rows, t) if part == ["is_starter"] else base).select(*key, *part) for part in PLAYER_COLUMNS]
    return out.unionByName(join_all(joined(spine.join(again, key, "left_semi")), parts, key))


@query("U-1 J-2 J-8 ML-13 R-3 A-7 H-22 H-23 H-25 Q-7", _player_wide_sql())
def player_wide_table(t: Tables) -> DataFrame:
    """The widest player table: with earlier records, week ranks, primary flags, calendar
    shares and their differences, starts, role columns and the line-up's best ratings."""
    t = t.once("outings").once("starters")  # line-ups, starts and ratings read the latter
    roles = [(F.col("position") == r).cast("int").alias(f"is_{r.lower()}") for r in q_state.ROLE_ORDER]
    found = {n: (REGISTRY[n].build(t).select(*keys, *cols).distinct(), keys) for n, (keys, cols) in PLAYER_MORE.items() if not n.startswith("team_calendar_share")}
    # Shares and their differences: one frame, one row per key.
    found["shares"] = q_history.share_differences(q_history.team_share_slots(t, 4)), PLAYER_MORE["team_calendar_shares"][0]
    # Who shares a key stands side by side; narrow rows are shuffled first.
    wide = t.outings.select(*PLAYER_SPINE).join(q_state.best_lineup_ratings(t), ["team", "period"], "left")
    for n in ("season_offset_join", "week_ranks"):
        wide = wide.join(*found[n], "left")
    wide = with_player_features(wide, t, [found[n] for n in ("primary_so_far", "shares", "starts_info")])
    features = [c for part in PLAYER_COLUMNS for c in part]
    more = [c for _, cols in PLAYER_MORE.values() for c in cols]
    best = [f"best_{r.lower()}" for r in q_state.ROLE_ORDER]
    return wide.select("team", "period", "player", "match_id", "position", *features, *roles, *more, *best)


@query(
    "H-27 H-28 H-29 J-2",
    f"SELECT * FROM ({REGISTRY['season_projection'].sql}) a LEFT JOIN ({REGISTRY['projected_per_game'].sql}) b USING (player, season) LEFT JOIN ({REGISTRY['starter_flags'].sql}) c USING (player, season)",
)
def season_table(t: Tables) -> DataFrame:
    """Season projection with per-game and starter features."""
    out = q_history.season_projection(t)
    for f in (q_history.projected_per_game(t), q_history.starter_flags(t)):
        out = out.join(f, ["player", "season"], "left")
    return out


@query(
    "A-14 H-19 J-2",
    f"SELECT * FROM ({REGISTRY['markets_wide'].sql}) a JOIN (SELECT player, season, points_before, yards_before FROM ({REGISTRY['earlier_season_sums'].sql})) b USING (player, season)",
)
def props_table(t: Tables) -> DataFrame:
    """Market lines in columns with the player's earlier figures."""
    return q_tables.markets_wide(t).join(q_history.earlier_season_sums(t), ["player", "season"])


@query(
    "Q-2 J-4 J-7",
    _RATINGS_SQL,
)
def ratings_on_spine(t: Tables) -> DataFrame:
    """Both sides' rating going into the period, the last known one where a team was idle."""
    t = t.once("matches")  # ratings, keys and spine read them
    games = t.matches
    ratings = R.pair_ratings(games)
    keys = games.select("period", F.explode(F.array("home", "away")).alias("team"))
    known = H.resolve(keys, ratings, ["team"], ["rating"], strict=False).withColumn("rating", F.round("rating", 4))
    return on_matches(t, known, ["rating"]).select("match_id", "home_rating", "away_rating")


@query("Q-3 ST-2", _RATED)
def ratings_advanced(t: Tables) -> DataFrame:
    """Ratings stored up to a period inside a season, then advanced by the others."""
    t = t.once("matches")  # both steps read them
    known = R.pair_ratings(t.matches.filter("period < 199706"))
    return advance_ratings(known, t.matches).withColumn("rating", F.round("rating", 4))


def number_tagger(texts: pd.Series) -> pd.Series:
    """Sample tagger: numbers."""
    return texts.map(lambda s: [("NUMBER", m.start(), m.end()) for m in re.finditer(r"[0-9]+", s)])


@query(
    "T-3 T-15",
    views("plays") + " , n AS (SELECT match_id, num, unnest(regexp_extract_all(detail, '[0-9]+')) AS entity FROM plays) SELECT match_id, num, entity, count(*) AS n FROM n GROUP BY ALL",
)
def tagged_entities(t: Tables) -> DataFrame:
    """Entities of a user-supplied tagger."""
    return tag(t.plays, ["match_id", "num"], "detail", number_tagger).groupBy("match_id", "num", "entity").agg(F.count(F.lit(1)).alias("n"))
