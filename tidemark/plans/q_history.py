"""Windowed history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import history as H
from tidemark.operators.ranking import carry_forward, ranked, ranked_many
from tidemark.operators.scan import Lag, Lead, chunked_scan
from tidemark.operators.sides import attach_both, sides
from tidemark.plans.registry import query
from tidemark.plans.testbed import MATCH_STATS, Tables, match_id, views

SIDE_VALUES = [f"{p}_{s}" for p in ("for", "opp") for s in MATCH_STATS]


def round6(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def team_keys(matches: DataFrame, *extra: str) -> DataFrame:
    """Distinct (team, period) of both sides, for state lookups."""
    return matches.select(*extra, "period", F.explode(F.array("home", "away")).alias("team")).distinct()


def on_matches(t: Tables, known: DataFrame, cols) -> DataFrame:
    """match_id, period, home, away and both sides' columns; ids that follow from the
    other keys are made after the joins and pass no shuffle."""
    if not t.derived_ids:
        return attach_both(t.matches.select("match_id", "period", "home", "away"), known, cols)
    out = attach_both(t.matches.select("period", "home", "away"), known, cols)
    return out.select(match_id(), "period", "home", "away", *[f"{r}_{c}" for r in ("home", "away") for c in cols])


def last_n_match_means(t: Tables, n: int, null_as_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides' means on the spine, and the one row of column means."""
    state = H.last_n_means(t.sides, ["team"], {c: F.col(c) for c in SIDE_VALUES}, n, null_as_zero=null_as_zero)
    known = H.before(state, ["team"], SIDE_VALUES)
    return on_matches(t, known, SIDE_VALUES), H.role_means(t.matches, known, SIDE_VALUES)


BOTH = [f"{r}_{c}" for r in ("home", "away") for c in SIDE_VALUES]


def _last_n_sql(n: int, agg: str = "avg") -> str:
    means = ", ".join(f"{agg}({c}) AS {c}" for c in SIDE_VALUES)
    return (
        views("sides")
        + f""", recent AS (
          SELECT k.team AS kteam, k.period AS kperiod, s.*,
                 row_number() OVER (PARTITION BY k.team, k.period ORDER BY s.period DESC, s.match_id DESC) AS rn
          FROM (SELECT DISTINCT team, period FROM sides) k JOIN sides s ON s.team = k.team AND s.period < k.period),
        means AS (SELECT kteam, kperiod, {means} FROM recent WHERE rn <= {n} GROUP BY kteam, kperiod),
        j AS (SELECT m.match_id, m.period, m.home, m.away,
                 {", ".join(f"h.{c} AS home_{c}, a.{c} AS away_{c}" for c in SIDE_VALUES)}
              FROM matches m LEFT JOIN means h ON h.kteam = m.home AND h.kperiod = m.period
                             LEFT JOIN means a ON a.kteam = m.away AND a.kperiod = m.period)"""
    )


@query(
    "H-1 J-2 J-4 PF-11 SL-3 SL-7",
    _last_n_sql(5)
    + " SELECT match_id, period, home, away, "
    + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM j)), 6) AS {c}" for c in BOTH)
    + " FROM j",
)
def last_five_means(t: Tables) -> DataFrame:
    """Mean of the last five matches for both sides, gaps filled with column means.

    State, spine and column means read the matches; they are written once."""
    t = t.once("matches")
    wide, means = last_n_match_means(t, 5)
    return round6(H.fill_with_mean(wide, BOTH, means=means), BOTH)


@query(
    "H-2 SL-3 SL-5 A-3",
    views("sides")
    + """, recent AS (
      SELECT k.team AS kteam, k.period AS kperiod, s.for_points, s.opp_points, s.winner,
             row_number() OVER (PARTITION BY k.team, k.period ORDER BY s.period DESC, s.match_id DESC) AS rn
      FROM (SELECT DISTINCT team, period FROM sides) k JOIN sides s ON s.team = k.team AND s.period < k.period),
    mine AS (SELECT kteam, kperiod, sum(coalesce(CASE WHEN winner IS NOT NULL THEN for_points END, 0)) / count(*) AS p,
                    sum(opp_points) / count(*) AS o
             FROM recent WHERE rn <= 5 GROUP BY kteam, kperiod),
    league AS (
      SELECT k.period AS kperiod, m.home_points, m.away_points,
             row_number() OVER (PARTITION BY k.period ORDER BY m.period DESC, m.match_id DESC) AS rn
      FROM (SELECT DISTINCT period FROM matches) k
      JOIN (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY period ORDER BY match_id DESC) <= 20) m ON m.period < k.period),
    base AS (SELECT kperiod, (sum(home_points) + sum(away_points)) / (2 * count(*)) AS lp FROM league WHERE rn <= 20 GROUP BY kperiod)
    SELECT m.match_id, m.home, round(coalesce(h.p, b.lp), 6) AS home_for_points, round(coalesce(h.o, b.lp), 6) AS home_opp_points,
           m.away, round(coalesce(a.p, b.lp), 6) AS away_for_points, round(coalesce(a.o, b.lp), 6) AS away_opp_points
    FROM matches m LEFT JOIN mine h ON h.kteam = m.home AND h.kperiod = m.period
                   LEFT JOIN mine a ON a.kteam = m.away AND a.kperiod = m.period
                   LEFT JOIN base b ON b.kperiod = m.period""",
)
def last_five_with_league_fallback(t: Tables) -> DataFrame:
    """Nulls count as zero; a team without history takes the league's last twenty matches."""
    values = {"for_points": F.when(F.col("winner").isNotNull(), F.col("for_points")), "opp_points": F.col("opp_points")}
    state = H.last_n_means(t.sides, ["team"], values, 5, null_as_zero=True)
    known = H.before(state, ["team"], list(values))
    league = H.newest(t.matches, ["period"], ["match_id"], 20)
    w = Window.orderBy("period", "match_id").rowsBetween(-19, 0)
    # At most 20 rows per period of the calendar reach this window.
    league = league.select(
        F.lit(1).alias("one"), "period", "_rn",
        ((F.sum("home_points").over(w) + F.sum("away_points").over(w)) / (2 * F.count(F.lit(1)).over(w))).alias("lp"),
    ).filter("_rn = 1")
    base = H.resolve(t.matches.select("period", F.lit(1).alias("one")), league, ["one"], ["lp"]).drop("one")
    out = attach_both(t.matches.select("match_id", "period", "home", "away"), known, list(values)).join(base, "period", "left")
    cols = [f"{r}_{c}" for r in ("home", "away") for c in values]
    return round6(
        out.select("match_id", "home", "away", *[F.coalesce(c, "lp").alias(c) for c in cols]), cols
    )


def _array_sql(n: int, value: str, pad: str, prefix: str) -> str:
    cols = ", ".join(f"coalesce(h[{i}], {pad}) AS home_{prefix}_{i}, coalesce(a[{i}], {pad}) AS away_{prefix}_{i}" for i in range(1, n + 1))
    return (
        views("sides")
        + f""", recent AS (
          SELECT k.team AS kteam, k.period AS kperiod, {value} AS v,
                 row_number() OVER (PARTITION BY k.team, k.period ORDER BY s.period DESC, s.match_id DESC) AS rn
          FROM (SELECT DISTINCT team, period FROM sides) k JOIN sides s ON s.team = k.team AND s.period < k.period),
        arr AS (SELECT kteam, kperiod, list(v ORDER BY rn) AS l FROM recent WHERE rn <= {n} GROUP BY kteam, kperiod)
        SELECT match_id, {cols} FROM (
          SELECT m.match_id, x.l AS h, y.l AS a FROM matches m
          LEFT JOIN arr x ON x.kteam = m.home AND x.kperiod = m.period
          LEFT JOIN arr y ON y.kteam = m.away AND y.kperiod = m.period)"""
    )


def recent_slots(t: Tables, n: int, fields: dict, pad, prefix: str, fill: float | None = None) -> DataFrame:
    """Last n rows of each side as columns; ``fill`` pads with that part of the column mean."""
    t = t.once("matches")  # state and spine read them
    state = H.last_n_rows(t.sides, ["team"], fields, n)
    cols = [c for f in fields for c in H.slots(F.col("recent"), n, prefix if len(fields) == 1 else f, None, f)]
    state = state.select("team", "period", *cols)
    names = state.columns[2:]
    known = H.before(state, ["team"], names)
    spine = t.matches
    both = on_matches(t, known, names).drop("period", "home", "away")
    wide = [f"{r}_{c}" for r in ("home", "away") for c in names]
    if fill is not None:
        return round6(H.fill_with_mean(both, wide, fill, means=H.role_means(spine, known, names)), wide)
    return both.select("match_id", *[F.coalesce(c, pad).alias(c) for c in wide])


@query("H-3 SL-4 F-33", _array_sql(6, "s.won", "-1", "won"))
def last_results(t: Tables) -> DataFrame:
    """Last six results per side, newest first, padded with -1."""
    return recent_slots(t, 6, {"won": F.col("won")}, F.lit(-1), "won")


@query("H-4 SL-4", _array_sql(10, "s.opp_points", "-1", "allowed"))
def last_points_allowed(t: Tables) -> DataFrame:
    return recent_slots(t, 10, {"opp_points": F.col("opp_points")}, F.lit(-1), "allowed")


_P5 = [f"{r}_scored_{i}" for r in ("home", "away") for i in range(1, 6)]


@query(
    "H-5 PF-11",
    "WITH j AS (" + _array_sql(5, "s.for_points", "NULL", "scored") + ") SELECT match_id, "
    + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM j)), 6) AS {c}" for c in _P5) + " FROM j",
)
def last_points_scored(t: Tables) -> DataFrame:
    """Last five points scored per side; missing slots take the column mean."""
    return recent_slots(t, 5, {"for_points": F.col("for_points")}, None, "scored", fill=1.0)


_FLAT = [f"{r}_{f}_{i}" for r in ("home", "away") for f in ("for_points", "for_yards", "opp_yards") for i in range(1, 4)]


@query(
    "H-6 SL-6",
    views("sides") + """, recent AS (
      SELECT k.team AS kteam, k.period AS kperiod, s.for_points, s.for_yards, s.opp_yards,
             row_number() OVER (PARTITION BY k.team, k.period ORDER BY s.period DESC, s.match_id DESC) AS rn
      FROM (SELECT DISTINCT team, period FROM sides) k JOIN sides s ON s.team = k.team AND s.period < k.period),
    flat AS (SELECT kteam, kperiod, """
    + ", ".join(f"max({f}) FILTER (rn = {i}) AS {f}_{i}" for f in ("for_points", "for_yards", "opp_yards") for i in range(1, 4))
    + """ FROM recent WHERE rn <= 3 GROUP BY kteam, kperiod),
    j AS (SELECT m.match_id, """
    + ", ".join(f"{r[0]}.{f}_{i} AS {r}_{f}_{i}" for r in ("home", "away") for f in ("for_points", "for_yards", "opp_yards") for i in range(1, 4))
    + """ FROM matches m LEFT JOIN flat h ON h.kteam = m.home AND h.kperiod = m.period
                         LEFT JOIN flat a ON a.kteam = m.away AND a.kperiod = m.period)
    SELECT match_id, """
    + ", ".join(f"round(coalesce({c}, 0.8 * (SELECT avg({c}) FROM j)), 6) AS {c}" for c in _FLAT) + " FROM j",
)
def last_stats_flat(t: Tables) -> DataFrame:
    """Last three matches by three figures, newest first, padded with 0.8 of the mean."""
    t = t.once("matches")
    fields = {f: F.col(f) for f in ("for_points", "for_yards", "opp_yards")}
    return recent_slots(t, 3, fields, None, "", fill=0.8)


@query(
    "H-7 J-11",
    views("sides") + """, p AS (SELECT *, least(team, opp) AS lo, greatest(team, opp) AS hi FROM sides),
    recent AS (
      SELECT k.team AS kteam, k.opp AS kopp, k.period AS kperiod, s.won,
             row_number() OVER (PARTITION BY k.team, k.opp, k.period ORDER BY s.period DESC, s.match_id DESC) AS rn
      FROM (SELECT DISTINCT home AS team, away AS opp, period FROM matches) k
      JOIN sides s ON s.team = k.team AND s.opp = k.opp AND s.period < k.period),
    arr AS (SELECT kteam, kopp, kperiod, list(won ORDER BY rn) AS l FROM recent WHERE rn <= 5 GROUP BY ALL)
    SELECT m.match_id, """ + ", ".join(f"coalesce(l[{i}], 0)::INT AS met_{i}" for i in range(1, 6))
    + " FROM matches m LEFT JOIN arr ON kteam = home AND kopp = away AND kperiod = period",
)
def head_to_head_results(t: Tables) -> DataFrame:
    """Home side's results in the last five meetings of the same two sides, padded with 0."""
    met = t.matches.select(
        "match_id", "period", *H.unordered_pair("home", "away"), F.coalesce("winner", F.lit(-1)).alias("winner")
    )
    state = H.last_n_rows(met, ["lo", "hi"], {"winner": F.col("winner")}, 5)
    targets = t.matches.select("match_id", "period", "home", *H.unordered_pair("home", "away"))
    out = H.asof(targets, state, ["lo", "hi"], ["recent"], in_history=True)
    won = F.transform("recent", lambda r: (r["winner"] == F.col("home")).cast("int"))
    return out.select("match_id", *H.slots(won, 5, "met", F.lit(0)))


@query(
    "H-8 J-11 J-16",
    views("matches", "divisions") + """, prior AS (
      SELECT m.match_id, m.home, p.home AS ph, p.winner, p.period AS pp, p.match_id AS pid
      FROM matches m JOIN matches p ON least(m.home, m.away) = least(p.home, p.away)
        AND greatest(m.home, m.away) = greatest(p.home, p.away) AND p.period < m.period),
    agg AS (SELECT match_id, avg(coalesce(winner = home, false)::INT) AS ratio,
                   coalesce((arg_max(coalesce(winner, -1), (pp, pid)) = any_value(home))::INT, 0) AS last_won
            FROM prior GROUP BY match_id)
    SELECT m.match_id, round(coalesce(ratio, 0.5), 6) AS met_ratio, coalesce(last_won, 1) AS met_last_won,
           (h.division = a.division)::INT AS same_division, (h.conference = a.conference)::INT AS same_conference
    FROM matches m LEFT JOIN agg USING (match_id) JOIN divisions h ON h.team = m.home JOIN divisions a ON a.team = m.away""",
)
def matchup_info(t: Tables) -> DataFrame:
    """Head-to-head win ratio and last winner, and whether both sides share a group."""
    met = t.matches.select("match_id", "period", "winner", *H.unordered_pair("home", "away"))
    state = (
        met.groupBy("lo", "hi", "period")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("winner") == F.col("lo")).alias("lo_won"),
            F.count_if(F.col("winner") == F.col("hi")).alias("hi_won"),
            F.max_by(F.coalesce("winner", F.lit(-1)), "match_id").alias("last_winner"),
        )
    )
    w = Window.partitionBy("lo", "hi").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    state = state.select(
        "lo", "hi", "period", "last_winner", *[F.sum(c).over(w).alias(c) for c in ("n", "lo_won", "hi_won")]
    )
    targets = t.matches.select("match_id", "period", "home", "away", *H.unordered_pair("home", "away"))
    out = H.asof(targets, state, ["lo", "hi"], ["n", "lo_won", "hi_won", "last_winner"], in_history=True)
    groups = t.divisions
    for role in ("home", "away"):
        out = out.join(groups.select(*[F.col(c).alias(f"{role}_{c}") for c in ("division", "conference")], F.col("team").alias(role)), role)
    home_won = F.when(F.col("home") == F.col("lo"), F.col("lo_won")).otherwise(F.col("hi_won"))
    return out.select(
        "match_id",
        F.round(F.coalesce(home_won / F.col("n"), F.lit(0.5)), 6).alias("met_ratio"),
        F.coalesce((F.col("last_winner") == F.col("home")).cast("int"), F.lit(1)).alias("met_last_won"),
        (F.col("home_division") == F.col("away_division")).cast("int").alias("same_division"),
        (F.col("home_conference") == F.col("away_conference")).cast("int").alias("same_conference"),
    )


@query(
    "H-9",
    views("sides") + """, pt AS (SELECT team, season, period, count(*) AS n, sum(won) AS w FROM sides GROUP BY ALL),
    st AS (SELECT k.team, k.period, coalesce(sum(p.n), 0) AS n, coalesce(sum(p.w), 0) AS w
           FROM pt k LEFT JOIN pt p ON p.team = k.team AND p.season = k.season AND p.period < k.period GROUP BY ALL)
    SELECT m.match_id, h.w::BIGINT AS home_wins, (h.n - h.w)::BIGINT AS home_losses,
           round(coalesce(h.w / nullif(h.n, 0), 0) * 100, 6) AS home_pct,
           a.w::BIGINT AS away_wins, (a.n - a.w)::BIGINT AS away_losses,
           round(coalesce(a.w / nullif(a.n, 0), 0) * 100, 6) AS away_pct
    FROM matches m JOIN st h ON h.team = home AND h.period = m.period JOIN st a ON a.team = away AND a.period = m.period""",
)
def season_record(t: Tables) -> DataFrame:
    """Wins, losses and win percentage in the season so far."""
    totals = H.period_totals(t.sides, ["team", "season"], {"won": F.col("won")})
    state = H.running_totals(totals, ["team", "season"], ["n", "won"])
    known = H.before(state, ["team", "season"], ["n", "won"]).select(
        "team",
        "period",
        F.coalesce("won", F.lit(0)).alias("wins"),
        F.coalesce(F.col("n") - F.col("won"), F.lit(0)).alias("losses"),
        F.round(F.coalesce(F.try_divide("won", "n"), F.lit(0)) * 100, 6).alias("pct"),
    )
    out = attach_both(t.matches.select("match_id", "period", "home", "away"), known, ["wins", "losses", "pct"])
    return out.drop("period", "home", "away")


_RANKED = ["for_points", "for_yards", "for_turnovers", "opp_points", "opp_yards", "opp_turnovers"]


def season_ranks(t: Tables) -> DataFrame:
    """Per (season, team, period): league ranks of season-to-date means, idle teams carried."""
    totals = H.period_totals(t.sides, ["team", "season"], {c: F.col(c) for c in _RANKED})
    state = H.running_totals(totals, ["team", "season"], ["n", *_RANKED])
    means = state.select("team", "season", "period", *[(F.col(c) / F.col("n")).alias(c) for c in _RANKED])
    grid = carry_forward(means, ["team"], _RANKED).filter(F.col(_RANKED[0]).isNotNull())
    # More is better for own figures and for the opponents' turnovers.
    direction = {c: c.startswith("for_") != c.endswith("turnovers") for c in _RANKED}
    return ranked_many(grid, ["period"], ["season", "team"], direction)


def _rank_sql() -> str:
    def direction(c: str) -> str:
        high = (c.startswith("for_") and not c.endswith("turnovers")) or c == "opp_turnovers"
        return "DESC" if high else "ASC"

    return views("sides") + f""", pt AS (
      SELECT team, season, period, count(*) AS n, {", ".join(f"sum({c}) AS {c}" for c in _RANKED)} FROM sides GROUP BY ALL),
    grid AS (SELECT DISTINCT a.team, a.season, b.period FROM pt a JOIN pt b ON a.season = b.season),
    st AS (SELECT g.team, g.season, g.period, {", ".join(f"sum(p.{c}) / sum(p.n) AS {c}" for c in _RANKED)}
           FROM grid g JOIN pt p ON p.team = g.team AND p.season = g.season AND p.period <= g.period GROUP BY ALL),
    ranks AS (SELECT *, {", ".join(f"rank() OVER (PARTITION BY period ORDER BY {c} {direction(c)}) AS {c}_rank" for c in _RANKED)} FROM st)"""


@query(
    "H-10 R-4 SL-10 PF-17",
    _rank_sql() + " SELECT team, season, period, " + ", ".join(f"round({c}, 6) AS {c}, {c}_rank" for c in _RANKED) + " FROM ranks",
)
def season_rankings(t: Tables) -> DataFrame:
    return round6(season_ranks(t), _RANKED)


@query(
    "R-4 J-6 J-20 H-10",
    _rank_sql() + """, sl AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY period DESC) AS rn FROM ranks),
    picked AS (
      SELECT k.team, k.period, coalesce(arg_max(r.for_points_rank, r.period) FILTER (r.season = k.season),
                                        arg_max(r.for_points_rank, r.period)) AS rk
      FROM (SELECT DISTINCT team, season, period FROM sides) k JOIN ranks r ON r.team = k.team AND r.period < k.period
      GROUP BY k.team, k.period)
    SELECT match_id, h.rk AS home_rank, a.rk AS away_rank FROM matches m
    LEFT JOIN picked h ON h.team = home AND h.period = m.period LEFT JOIN picked a ON a.team = away AND a.period = m.period""",
)
def rankings_on_spine(t: Tables) -> DataFrame:
    """Newest earlier league rank for both sides of each match."""
    ranks = season_ranks(t).select("team", "period", F.col("for_points_rank").alias("rank"))
    known = H.before(ranks, ["team"], ["rank"])
    return attach_both(t.matches.select("match_id", "period", "home", "away"), known, ["rank"]).select(
        "match_id", "home_rank", "away_rank"
    )


@query(
    "H-11 A-2 SL-28",
    views("sides") + """, pt AS (SELECT team, season, period, sum(for_yards) AS o, sum(opp_yards) AS d, count(*) AS n FROM sides GROUP BY ALL),
    k AS (SELECT DISTINCT team, season, period FROM sides),
    cur AS (SELECT k.team, k.period, sum(o) / sum(n) AS o, sum(d) / sum(n) AS d FROM k JOIN pt p
            ON p.team = k.team AND p.season = k.season AND p.period < k.period GROUP BY ALL),
    prev AS (SELECT team, season + 1 AS season, sum(o) / sum(n) AS o, sum(d) / sum(n) AS d FROM pt GROUP BY ALL)
    SELECT s.match_id, s.team, round(coalesce(c.o, p.o), 6) AS offence, round(coalesce(c.d, p.d), 6) AS defence
    FROM sides s LEFT JOIN cur c ON c.team = s.team AND c.period = s.period LEFT JOIN prev p ON p.team = s.team AND p.season = s.season""",
)
def season_play_value(t: Tables) -> DataFrame:
    """Season-to-date mean value for and against; last season where this one has none."""
    t = t.once("matches")  # targets and both seasons' folds read them
    out = H.season_means(
        t.sides.select("match_id", "team", "season", "week", "period"),
        t.sides,
        ["team"],
        {"offence": F.col("for_yards"), "defence": F.col("opp_yards")},
        previous_season="missing", in_history=True,
    )
    return round6(out.select("match_id", "team", "offence", "defence"), ["offence", "defence"])


@query("H-12", _array_sql(3, "s.for_yards", "0", "value"))
def last_play_value(t: Tables) -> DataFrame:
    return recent_slots(t, 3, {"for_yards": F.col("for_yards")}, F.lit(0), "value")


@query(
    "A-2",
    views("sides") + """, recent AS (
      SELECT k.team AS kteam, k.period AS kperiod, s.for_points, s.opp_points, s.is_home,
             row_number() OVER (PARTITION BY k.team, k.period ORDER BY s.period DESC, s.match_id DESC) AS rn
      FROM (SELECT DISTINCT team, period FROM sides) k JOIN sides s ON s.team = k.team AND s.period < k.period),
    m AS (SELECT kteam, kperiod, avg(for_points) FILTER (is_home) AS fh, avg(for_points) FILTER (NOT is_home) AS fa,
                 avg(opp_points) FILTER (is_home) AS oh, avg(opp_points) FILTER (NOT is_home) AS oa
          FROM recent WHERE rn <= 10 GROUP BY ALL)
    SELECT s.match_id, s.team,
           round((coalesce(fh, 0) + coalesce(fa, 0)) / nullif((fh IS NOT NULL)::INT + (fa IS NOT NULL)::INT, 0), 6) AS scored,
           round((coalesce(oh, 0) + coalesce(oa, 0)) / nullif((oh IS NOT NULL)::INT + (oa IS NOT NULL)::INT, 0), 6) AS allowed
    FROM sides s LEFT JOIN m ON kteam = team AND kperiod = period""",
)
def last_ten_mean_of_role_means(t: Tables) -> DataFrame:
    """Mean of the home mean and the away mean over the last ten matches."""
    at_home = F.col("is_home")
    values = {
        "fh": F.when(at_home, F.col("for_points")),
        "fa": F.when(~at_home, F.col("for_points")),
        "oh": F.when(at_home, F.col("opp_points")),
        "oa": F.when(~at_home, F.col("opp_points")),
    }
    state = H.last_n_means(t.sides, ["team"], values, 10)
    out = H.asof(t.sides.select("match_id", "team", "period"), state, ["team"], list(values), in_history=True)

    def both(x: str, y: str):
        have = F.col(x).isNotNull().cast("int") + F.col(y).isNotNull().cast("int")
        return F.round(F.try_divide(F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), have), 6)

    return out.select("match_id", "team", both("fh", "fa").alias("scored"), both("oh", "oa").alias("allowed"))


_Q = range(1, 5)


@query(
    "H-13 F-25 A-2",
    views("quarters") + """, r AS (SELECT match_id, period, home AS team, true AS is_home, """ + ", ".join(f"home_p{i} AS f{i}, away_p{i} AS o{i}" for i in _Q)
    + " FROM quarters UNION ALL SELECT match_id, period, away, false, " + ", ".join(f"away_p{i}, home_p{i}" for i in _Q) + """ FROM quarters),
    recent AS (SELECT k.team AS kteam, k.period AS kperiod, r.*, row_number() OVER (PARTITION BY k.team, k.period ORDER BY r.period DESC, r.match_id DESC) AS rn
      FROM (SELECT DISTINCT team, period FROM r) k JOIN r ON r.team = k.team AND r.period < k.period),
    m AS (SELECT kteam, kperiod, """ + ", ".join(f"(avg({c}{i}) FILTER (is_home) + avg({c}{i}) FILTER (NOT is_home)) / 2 AS {c}{i}" for c in "fo" for i in _Q)
    + " FROM recent WHERE rn <= 10 GROUP BY ALL) SELECT r.match_id, r.team, " + ", ".join(f"round(m.f{i}, 6) AS scored_q{i}, round(m.o{i}, 6) AS allowed_q{i}" for i in _Q)
    + " FROM r LEFT JOIN m ON kteam = team AND kperiod = period",
)
def quarter_means(t: Tables) -> DataFrame:
    """Points per quarter scored and allowed: mean of the home mean and the away mean
    over the last ten matches, without overtime; null unless both roles occurred."""
    t = t.once("quarters")  # history and targets read them
    slots = [X.quarter_slots(F.col(f"{r}_parts")).alias(f"{r}_quarters") for r in ("home", "away")]
    rows = sides(t.quarters.select("match_id", "period", "home", "away", *slots), ["quarters"], ("match_id", "period"))
    values = {
        "fh": F.when(F.col("is_home"), F.col("for_quarters")), "fa": F.when(~F.col("is_home"), F.col("for_quarters")),
        "oh": F.when(F.col("is_home"), F.col("opp_quarters")), "oa": F.when(~F.col("is_home"), F.col("opp_quarters")),
    }
    state = H.last_n_array_means(rows, ["team"], values, 4, 10)
    out = H.asof(rows.select("match_id", "team", "period"), state, ["team"], list(values), in_history=True)
    mean = lambda x, y, i: F.round((F.get(x, F.lit(i)) + F.get(y, F.lit(i))) / 2, 6)
    return out.select(
        "match_id", "team", *[mean("fh", "fa", i).alias(f"scored_q{i + 1}") for i in range(4)], *[mean("oh", "oa", i).alias(f"allowed_q{i + 1}") for i in range(4)]
    )


# --- players -------------------------------------------------------------

_PK = """, pk AS (SELECT DISTINCT player, season, week, period FROM outings),
  pp AS (SELECT player, season, period, count(*) AS n, sum(points) AS s, sum(share) AS sh FROM outings GROUP BY ALL)"""


@query(
    "H-14 SL-22 SL-1",
    views("outings") + _PK + """,
    cur AS (SELECT k.player, k.period, sum(n) AS n, sum(s) AS s FROM pk k JOIN pp p
            ON p.player = k.player AND p.season = k.season AND p.period < k.period GROUP BY ALL),
    prev AS (SELECT player, season + 1 AS season, sum(n) AS n, sum(s) AS s FROM pp GROUP BY ALL)
    SELECT o.match_id, o.player,
      round(coalesce(CASE WHEN o.week = 1 THEN CASE WHEN p.n >= 2 THEN p.s / p.n END
                          ELSE CASE WHEN c.n >= 2 THEN c.s / c.n END END, 0), 6) AS season_avg
    FROM outings o LEFT JOIN cur c ON c.player = o.player AND c.period = o.period
                   LEFT JOIN prev p ON p.player = o.player AND p.season = o.season""",
)
def player_season_average(t: Tables) -> DataFrame:
    """At least two earlier games; week 1 looks at last season; else 0."""
    out = H.season_means(
        t.outings.select("match_id", "player", "season", "week", "period"), t.outings, ["player"],
        {"season_avg": F.col("points")}, min_count=2, in_history=True,
    )
    return out.select("match_id", "player", F.round(F.coalesce("season_avg", F.lit(0)), 6).alias("season_avg"))


@query(
    "H-15 J-10",
    views("outings") + _PK + """, cur AS (SELECT k.player, k.period, sum(n) AS n, sum(s) AS s FROM pk k JOIN pp p
            ON p.player = k.player AND p.period < k.period GROUP BY ALL)
    SELECT o.match_id, o.player, round(coalesce(CASE WHEN n >= 2 THEN s / n END, 0), 6) AS career_avg
    FROM outings o LEFT JOIN cur c ON c.player = o.player AND c.period = o.period""",
)
def player_career_average(t: Tables) -> DataFrame:
    out = H.to_date(t.outings.select("match_id", "player", "period"), t.outings, ["player"], {"s": F.col("points")}, in_history=True)
    avg = F.when(F.col("n") >= 2, F.col("s") / F.col("n"))
    return out.select("match_id", "player", F.round(F.coalesce(avg, F.lit(0)), 6).alias("career_avg"))


def _player_recent(n: int) -> str:
    return views("outings") + f""", recent AS (
      SELECT k.player AS kp, k.period AS kperiod, o.*,
             row_number() OVER (PARTITION BY k.player, k.period ORDER BY o.period DESC, o.match_id DESC) AS rn
      FROM (SELECT DISTINCT player, period FROM outings) k JOIN outings o ON o.player = k.player AND o.period < k.period
      QUALIFY rn <= {n})"""


@query(
    "H-16 SL-4",
    _player_recent(5) + ", arr AS (SELECT kp, kperiod, list(points ORDER BY rn) AS l FROM recent GROUP BY ALL) SELECT match_id, player, "
    + ", ".join(f"coalesce(l[{i}], 0) AS points_{i}" for i in range(1, 6))
    + " FROM outings LEFT JOIN arr ON kp = player AND kperiod = period",
)
def player_last_points(t: Tables) -> DataFrame:
    state = H.last_n_rows(t.outings, ["player"], {"points": F.col("points")}, 5)
    out = H.asof(t.outings.select("match_id", "player", "period"), state, ["player"], ["recent"], in_history=True)
    return out.select("match_id", "player", *H.slots(F.col("recent"), 5, "points", F.lit(0), "points"))


@query(
    "H-17",
    _player_recent(3) + """, m AS (SELECT kp, kperiod, avg(points) AS v FROM recent GROUP BY ALL)
    SELECT match_id, player, round(coalesce(v, 0), 6) AS avg_points FROM outings LEFT JOIN m ON kp = player AND kperiod = period""",
)
def player_last_mean(t: Tables) -> DataFrame:
    state = H.last_n_means(t.outings, ["player"], {"avg_points": F.col("points")}, 3)
    out = H.asof(t.outings.select("match_id", "player", "period"), state, ["player"], ["avg_points"], in_history=True)
    return out.select("match_id", "player", F.round(F.coalesce("avg_points", F.lit(0)), 6).alias("avg_points"))


# The figures that count for each role, in slots a to c.
ROLE_FIGURES = {
    "QB": ("yards", "tds", "attempts"),
    "RB": ("yards", "attempts", "tds"),
    "WR": ("points", "yards", "tds"),
    "TE": ("points", "tds", "yards"),
    "OL": ("attempts", "attempts", "attempts"),
}
_SLOTS = "abc"


def role_figures(i: int):
    out = None
    for role, figs in ROLE_FIGURES.items():
        hit = F.col("position") == role
        out = F.when(hit, F.col(figs[i])) if out is None else out.when(hit, F.col(figs[i]))
    return out


def _role_case(i: int) -> str:
    return "CASE position " + " ".join(f"WHEN '{r}' THEN {f[i]}" for r, f in ROLE_FIGURES.items()) + " END"


@query(
    "H-18",
    _player_recent(4) + ", arr AS (SELECT kp, kperiod, "
    + ", ".join(f"list({_role_case(i)} ORDER BY rn) AS l{s}" for i, s in enumerate(_SLOTS))
    + " FROM recent GROUP BY ALL) SELECT match_id, player, "
    + ", ".join(f"coalesce(l{s}[{i}], 0) AS {s}_{i}" for s in _SLOTS for i in range(1, 5))
    + " FROM outings LEFT JOIN arr ON kp = player AND kperiod = period",
)
def player_last_role_figures(t: Tables) -> DataFrame:
    """Last four games of the figures that count for the player's role."""
    fields = {s: role_figures(i) for i, s in enumerate(_SLOTS)}
    state = H.last_n_rows(t.outings, ["player"], fields, 4)
    out = H.asof(t.outings.select("match_id", "player", "period"), state, ["player"], ["recent"], in_history=True)
    cols = [c for s in _SLOTS for c in H.slots(F.col("recent"), 4, s, F.lit(0), s)]
    return out.select("match_id", "player", *cols)


@query(
    "H-19",
    _player_recent(5) + ", m AS (SELECT kp, kperiod, "
    + ", ".join(f"avg({_role_case(i)}) AS {s}" for i, s in enumerate(_SLOTS))
    + " FROM recent GROUP BY ALL) SELECT match_id, player, "
    + ", ".join(f"round(coalesce({s}, 0), 6) AS {s}" for s in _SLOTS)
    + " FROM outings LEFT JOIN m ON kp = player AND kperiod = period",
)
def player_mean_role_figures(t: Tables) -> DataFrame:
    values = {s: role_figures(i) for i, s in enumerate(_SLOTS)}
    state = H.last_n_means(t.outings, ["player"], values, 5)
    out = H.asof(t.outings.select("match_id", "player", "period"), state, ["player"], list(values), in_history=True)
    return out.select("match_id", "player", *[F.round(F.coalesce(s, F.lit(0)), 6).alias(s) for s in _SLOTS])


@query(
    "H-20",
    views("outings") + """, allowed AS (
      SELECT opp AS team, position, period, avg(points) AS pts FROM outings GROUP BY ALL),
    recent AS (
      SELECT k.team AS kteam, k.position AS kpos, k.period AS kperiod, a.pts,
             row_number() OVER (PARTITION BY k.team, k.position, k.period ORDER BY a.period DESC) AS rn
      FROM (SELECT DISTINCT opp AS team, position, period FROM outings) k
      JOIN allowed a ON a.team = k.team AND a.position = k.position AND a.period < k.period),
    arr AS (SELECT kteam, kpos, kperiod, list(pts ORDER BY rn) AS l FROM recent WHERE rn <= 5 GROUP BY ALL)
    SELECT match_id, player, """
    + ", ".join(f"round(coalesce(l[{i}], 0), 6) AS allowed_{i}" for i in range(1, 6))
    + " FROM outings LEFT JOIN arr ON kteam = opp AND kpos = position AND kperiod = period",
)
def opponent_allowed_points(t: Tables) -> DataFrame:
    """The opponent's last five periods: mean points it allowed to the player's role."""
    rows = t.outings.select("match_id", "player", "opp", "position", "period")
    return with_allowed(rows, t).select("match_id", "player", *[f"allowed_{i}" for i in range(1, 6)])


def with_allowed(rows: DataFrame, t: Tables) -> DataFrame:
    """``rows`` (opp, position, period and more) with the points allowed before."""
    allowed = t.outings.groupBy(F.col("opp"), "position", "period").agg((F.sum("points") / F.count(F.lit(1))).alias("pts"))
    w = Window.partitionBy("opp", "position").orderBy("period").rowsBetween(-4, 0)
    state = allowed.select("opp", "position", "period", F.reverse(F.collect_list("pts").over(w)).alias("recent"))
    out = H.asof(rows, state, ["opp", "position"], ["recent"], in_history=True)
    rounded = F.transform("recent", lambda x: F.round(x, 6))
    return out.select(*rows.columns, *H.slots(rounded, 5, "allowed", F.lit(0)))


@query(
    "H-21",
    views("outings") + _PK + """,
    cur AS (SELECT k.player, k.period, sum(sh) / sum(n) AS v FROM pk k JOIN pp p
            ON p.player = k.player AND p.season = k.season AND p.period < k.period GROUP BY ALL),
    prev AS (SELECT player, season + 1 AS season, sum(sh) / sum(n) AS v FROM pp GROUP BY ALL)
    SELECT o.match_id, o.player, round(CASE WHEN o.week = 1 THEN p.v ELSE c.v END, 6) AS share_avg
    FROM outings o LEFT JOIN cur c ON c.player = o.player AND c.period = o.period
                   LEFT JOIN prev p ON p.player = o.player AND p.season = o.season""",
)
def season_share_average(t: Tables) -> DataFrame:
    out = H.season_means(
        t.outings.select("match_id", "player", "season", "week", "period"), t.outings, ["player"], {"share_avg": F.col("share")}, in_history=True
    )
    return out.select("match_id", "player", F.round("share_avg", 6).alias("share_avg"))


def player_known(t: Tables) -> DataFrame:
    """What is known of a player before each of its periods: the figures of the seven
    features by player, from one fold of the totals and one of the newest games."""
    o, key = t.outings, ["player"]
    sums = {"s": F.col("points"), "sn": F.col("points").isNotNull().cast("int"), "h": F.col("share"), "hn": F.col("share").isNotNull().cast("int")}
    totals = H.period_totals(o, ["player", "season"], sums)
    career = Window.partitionBy("player").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    year = Window.partitionBy("player", "season").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("player").orderBy("season").rangeBetween(-1, -1)
    cols = ["n", *sums]
    # The windows by player come first: those by season need no other shuffle.
    wide = totals.select("*", *[F.sum(c).over(career).alias(f"career_{c}") for c in ("n", "s")], *[F.sum(c).over(last).alias(f"last_{c}") for c in cols])
    wide = wide.select("*", *[F.sum(c).over(year).alias(f"now_{c}") for c in cols])

    def mean(prefix: str, value: str, least: int):
        return F.when(F.coalesce(f"{prefix}_n", F.lit(0)) >= least, F.try_divide(f"{prefix}_{value}", f"{prefix}_{value}n"))

    seasons = {f"{k}_{x}": mean(x, v, least) for k, v, least in (("season_avg", "s", 2), ("share_avg", "h", 1)) for x in ("now", "last")}
    to_date = F.when(F.col("career_n") >= 2, F.col("career_s") / F.col("career_n")).alias("career_avg")
    totals = wide.select("player", "period", *[c.alias(k) for k, c in seasons.items()], to_date)
    roles = {s: role_figures(i) for i, s in enumerate(_SLOTS)}
    games = H.newest(o.select("player", "period", "match_id", "points", *[v.alias(k) for k, v in roles.items()]), ["player", "period"], ["match_id"], 5)
    # Means and lists of fewer games see only that many of a period, ties included.
    last_5, last_4, last_3 = (Window.partitionBy("player", *part).orderBy("period", "match_id") for part in ([], [F.col("_rn") <= 4], [F.col("_rn") <= 3]))
    five = {f"points_{i}": F.lag("points", i - 1).over(last_5) for i in range(1, 6)}
    five |= {f"mean_{s}": F.avg(s).over(last_5.rowsBetween(-4, 0)) for s in _SLOTS}
    four = {f"{s}_{i}": F.lag(s, i - 1).over(last_4) for s in _SLOTS for i in range(1, 5)}
    three = {"avg_points": F.avg("points").over(last_3.rowsBetween(-2, 0))}
    recent = games
    for part in (five, four, three):
        recent = recent.select("*", *[c.alias(k) for k, c in part.items()])
    before = [*five, *four, *three]
    recent = recent.filter("_rn = 1").select("player", "period", *before)
    return totals.join(H.before(recent, key, before), ["player", "period"])


def with_player_known(spine: DataFrame, known: DataFrame) -> DataFrame:
    """``spine`` (player, period, week and more) with the columns of the features by player."""
    out = spine.join(known, ["player", "period"], "left")
    # The season's figures look at the last one in week 1.
    first = F.col("week") == 1
    season = {k: F.when(first, F.col(f"{k}_last")).otherwise(F.col(f"{k}_now")) for k in ("season_avg", "share_avg")}
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = {"season_avg": F.round(zero(season["season_avg"]), 6), "career_avg": F.round(zero("career_avg"), 6)}
    cols |= {f"points_{i}": zero(f"points_{i}") for i in range(1, 6)}
    cols |= {"avg_points": F.round(zero("avg_points"), 6)}
    cols |= {f"{s}_{i}": zero(f"{s}_{i}") for s in _SLOTS for i in range(1, 5)}
    cols |= {s: F.round(zero(f"mean_{s}"), 6) for s in _SLOTS}
    cols |= {"share_avg": F.round(season["share_avg"], 6)}
    return out.select(*spine.columns, *[c.alias(k) for k, c in cols.items()])


def team_share_slots(t: Tables, n: int) -> DataFrame:
    """Player's share in the team's last n periods, newest first, 0 where absent."""
    place = F.row_number().over(Window.partitionBy("team").orderBy("period"))
    calendar = t.outings.select("team", "period").dropna().distinct().select("team", "period", place.alias("_at"))
    mine = t.outings.groupBy("player", "team", "period").agg(F.max("share").alias("share"))
    w = Window.partitionBy("player", "team").orderBy("_at")
    slots = [F.coalesce(F.max("share").over(w.rangeBetween(-i, -i)), F.lit(0.0)).alias(f"share_{i}") for i in range(1, n + 1)]
    return mine.join(calendar, ["team", "period"]).select("player", "team", "period", *slots)


_TEAM_SHARES = views("outings") + """, mine AS (SELECT player, team, period, max(share) AS share FROM outings GROUP BY ALL),
    cal AS (SELECT team, period, dense_rank() OVER (PARTITION BY team ORDER BY period) AS i FROM (SELECT DISTINCT team, period FROM outings)),
    m AS (SELECT mine.*, i FROM mine JOIN cal USING (team, period)),
    s AS (SELECT a.player, a.team, a.period, """ + ", ".join(
    f"coalesce(max(b.share) FILTER (a.i - b.i = {i}), 0) AS share_{i}" for i in range(1, 5)
) + """ FROM m a LEFT JOIN m b ON a.player = b.player AND a.team = b.team AND b.i BETWEEN a.i - 4 AND a.i - 1 GROUP BY ALL)"""


@query("H-22", _TEAM_SHARES + " SELECT * FROM s")
def team_calendar_shares(t: Tables) -> DataFrame:
    return team_share_slots(t, 4)


@query(
    "H-23 F-33",
    _TEAM_SHARES + " SELECT player, team, period, " + ", ".join(f"round(share_{i} - share_{i + 1}, 6) AS diff_{i}" for i in range(1, 4)) + " FROM s",
)
def team_calendar_share_differences(t: Tables) -> DataFrame:
    """First differences of the calendar shares, newest first."""
    return share_differences(team_share_slots(t, 4)).select("player", "team", "period", *[f"diff_{i}" for i in range(1, 4)])


def share_differences(shares: DataFrame) -> DataFrame:
    """Calendar shares (share_1 to share_4) with their first differences."""
    arr = F.array(*[f"share_{i}" for i in range(1, 5)])
    diffs = F.zip_with(F.slice(arr, 1, 3), F.slice(arr, 2, 3), lambda a, b: F.round(a - b, 6))
    return shares.select("*", *H.slots(diffs, 3, "diff"))


@query(
    "H-24 SL-17",
    views("matches", "divisions") + """, c AS (
      SELECT division AS coach, week AS month, period, count(*) AS n, sum(w) AS w FROM (
        SELECT home AS team, week, period, (home_points >= away_points)::INT AS w FROM matches
        UNION ALL SELECT away, week, period, (home_points < away_points)::INT FROM matches) JOIN divisions USING (team) GROUP BY ALL),
    st AS (SELECT k.coach, k.month, k.period, sum(p.w) / sum(p.n) AS v FROM c k JOIN c p
           ON p.coach = k.coach AND p.month = k.month AND p.period < k.period GROUP BY ALL)
    SELECT m.match_id, round(coalesce(v, 0), 6) AS home_coach_pct FROM matches m JOIN divisions d ON d.team = m.home
    LEFT JOIN st ON coach = division AND month = week AND st.period = m.period""",
)
def coach_month_record(t: Tables) -> DataFrame:
    """Career win rate of a coach in the same calendar month; a draw counts for the home side."""
    home_won = (F.col("home_points") >= F.col("away_points")).cast("int")
    rows = t.matches.select(
        "week", "period",
        F.inline(F.array(F.struct(F.col("home").alias("team"), home_won.alias("w")), F.struct(F.col("away").alias("team"), (1 - home_won).alias("w")))),
    )
    coach = t.divisions.select("team", F.col("division").alias("coach"))
    # Fold to (team, period) before the coach join: the join sees one row per team and period.
    folded = rows.groupBy("team", "week", "period").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("g"))
    folded = folded.join(coach, "team").groupBy("coach", "week", "period").agg(F.sum("w").alias("w"), F.sum("g").alias("g"))
    state = H.running_totals(folded, ["coach", "week"], ["w", "g"])
    targets = t.matches.select("match_id", "week", "period", F.col("home").alias("team")).join(coach, "team")
    out = H.asof(targets, state, ["coach", "week"], ["w", "g"], in_history=True)
    return out.select("match_id", F.round(F.coalesce(F.try_divide("w", "g"), F.lit(0)), 6).alias("home_coach_pct"))


@query(
    "H-25 SL-19",
    views("starters") + """, pl AS (SELECT player, season, period, count(*) AS g FROM outings GROUP BY ALL),
    st AS (SELECT player, season, period, count(*) AS s FROM starters GROUP BY ALL),
    k AS (SELECT DISTINCT player, season, period FROM outings)
    SELECT k.player, k.period,
      coalesce((SELECT sum(g) FROM pl WHERE pl.player = k.player AND pl.period < k.period), 0)::BIGINT AS career_games,
      coalesce((SELECT sum(s) FROM st WHERE st.player = k.player AND st.period < k.period), 0)::BIGINT AS career_starts,
      coalesce((SELECT sum(g) FROM pl WHERE pl.player = k.player AND pl.period < k.period AND pl.season = k.season), 0)::BIGINT AS season_games,
      coalesce((SELECT sum(s) FROM st WHERE st.player = k.player AND st.period < k.period AND st.season = k.season), 0)::BIGINT AS season_starts,
      coalesce((SELECT sum(g) FROM pl WHERE pl.player = k.player AND pl.season = k.season - 1), 0)::BIGINT AS last_games,
      coalesce((SELECT sum(s) FROM st WHERE st.player = k.player AND st.season = k.season - 1), 0)::BIGINT AS last_starts
    FROM k""",
)
def starts_info(t: Tables) -> DataFrame:
    """Games played and started: career, this season, last season."""
    return starts_table(t)


def starts_table(t: Tables) -> DataFrame:
    played = t.outings.groupBy("player", "season", "period").agg(F.count(F.lit(1)).alias("g"))
    started = t.starters.groupBy("player", "season", "period").agg(F.count(F.lit(1)).alias("s"))
    both = played.join(started, ["player", "season", "period"], "left").fillna(0, ["s"])
    career = Window.partitionBy("player").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    season = Window.partitionBy("player", "season").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    out = both.select(
        "player", "season", "period",
        *[F.coalesce(F.sum(c).over(career), F.lit(0)).alias(f"career_{n}") for c, n in (("g", "games"), ("s", "starts"))],
        *[F.coalesce(F.sum(c).over(season), F.lit(0)).alias(f"season_{n}") for c, n in (("g", "games"), ("s", "starts"))],
    )
    last = both.groupBy("player", (F.col("season") + 1).alias("season")).agg(
        F.sum("g").alias("last_games"), F.sum("s").alias("last_starts")
    )
    return out.join(last, ["player", "season"], "left").fillna(0, ["last_games", "last_starts"]).drop("season")


@query(
    "H-27 A-25 J-9",
    views("outings") + """, tot AS (SELECT player, season, sum(points) AS points, count(*) AS games FROM outings GROUP BY ALL HAVING sum(points) > 2)
    SELECT player, season, points::BIGINT AS points,
      round(coalesce((SELECT avg(p.points) FROM tot p WHERE p.player = t.player AND p.season < t.season), 0), 6) AS total_avg,
      round(coalesce((SELECT sum(p.points) / sum(p.games) FROM tot p WHERE p.player = t.player AND p.season < t.season), 0), 6) AS game_avg,
      (SELECT count(*) FROM tot p WHERE p.player = t.player AND p.season < t.season) AS years,
      coalesce((SELECT sum(p.points) FROM tot p WHERE p.player = t.player AND p.season = t.season - 1), 0)::BIGINT AS last_total
    FROM tot t""",
)
def season_projection(t: Tables) -> DataFrame:
    """Season-grain career means, per-game mean, years played and last season's total."""
    tot = (
        t.outings.groupBy("player", "season")
        .agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("games"))
        .filter("points > 2")
    )
    w = Window.partitionBy("player").orderBy("season")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.lag("season").over(w) == F.col("season") - 1
    return tot.select(
        "player", "season", "points",
        F.round(F.coalesce(F.avg("points").over(prior), F.lit(0)), 6).alias("total_avg"),
        F.round(F.coalesce(F.sum("points").over(prior) / F.sum("games").over(prior), F.lit(0)), 6).alias("game_avg"),
        F.count(F.lit(1)).over(prior).alias("years"),
        F.coalesce(F.when(prev, F.lag("points").over(w)), F.lit(0)).alias("last_total"),
    )


@query(
    "H-28 F-21 S-1",
    views("outings") + """, v AS (
      SELECT player, season, period, yards::DOUBLE AS yards FROM outings WHERE share > 0.95
      UNION ALL SELECT player, season, period, yards + yards * 2 * (1 - share) FROM outings WHERE share BETWEEN 0.1 AND 0.95)
    SELECT k.player, k.season, round(coalesce(avg(v.yards), 0), 4) AS per_game
    FROM (SELECT DISTINCT player, season FROM outings) k LEFT JOIN v ON v.player = k.player AND v.season < k.season GROUP BY ALL""",
)
def projected_per_game(t: Tables) -> DataFrame:
    """Per-game mean of earlier seasons, full games as they are and partial ones projected to full volume."""
    full = t.outings.filter("share > 0.95").select("player", "season", F.col("yards").cast("double").alias("yards"))
    part = t.outings.filter(F.col("share").between(0.1, 0.95)).select(
        "player", "season", (F.col("yards") + F.col("yards") * 2 * (1 - F.col("share"))).alias("yards")
    )
    out = H.to_date(
        t.outings.select("player", "season").distinct(), full.unionByName(part), ["player"], {"s": F.col("yards")}, period="season"
    )
    return out.select("player", "season", F.round(F.coalesce(F.col("s") / F.col("n"), F.lit(0)), 4).alias("per_game"))


@query(
    "H-29 A-18",
    views("outings") + """, s AS (SELECT player, season, avg(share) AS m, count(*) AS g FROM outings GROUP BY ALL),
    f AS (SELECT player, season, (m > (SELECT avg(share) FROM outings) AND g > 1)::INT AS st FROM s)
    SELECT f.player, f.season, f.st AS is_starter, (f.st = 1 AND coalesce(p.st, 0) = 0)::INT AS is_new_starter
    FROM f LEFT JOIN f p ON p.player = f.player AND p.season = f.season - 1""",
)
def starter_flags(t: Tables) -> DataFrame:
    """Season share above the overall mean over enough games, and new compared with last season."""
    overall = t.outings.agg(F.avg("share").alias("m")).scalar()
    s = t.outings.groupBy("player", "season").agg(F.avg("share").alias("m"), F.count(F.lit(1)).alias("g"))
    s = s.select("player", "season", ((F.col("m") > overall) & (F.col("g") > 1)).cast("int").alias("is_starter"))
    w = Window.partitionBy("player").orderBy("season").rangeBetween(-1, -1)
    was = F.coalesce(F.max("is_starter").over(w), F.lit(0))
    return s.withColumn("is_new_starter", ((F.col("is_starter") == 1) & (was == 0)).cast("int"))


@query(
    "H-30 SL-21",
    views("outings") + """, s AS (SELECT player, season, sum(points) AS p, sum(yards) AS y FROM outings GROUP BY ALL)
    SELECT player, season, coalesce((SELECT sum(p) FROM s x WHERE x.player = s.player AND x.season < s.season), 0)::BIGINT AS points_before,
      coalesce((SELECT sum(y) FROM s x WHERE x.player = s.player AND x.season < s.season), 0)::BIGINT AS yards_before FROM s""",
)
def earlier_season_sums(t: Tables) -> DataFrame:
    s = t.outings.groupBy("player", "season").agg(F.sum("points").alias("p"), F.sum("yards").alias("y"))
    w = Window.partitionBy("player").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    return s.select(
        "player", "season",
        F.coalesce(F.sum("p").over(w), F.lit(0)).alias("points_before"),
        F.coalesce(F.sum("y").over(w), F.lit(0)).alias("yards_before"),
    )


@query(
    "H-31 R-1",
    views("outings") + _PK + """, tgt AS (SELECT DISTINCT player, position, season, week, period FROM outings),
    cur AS (SELECT k.player, k.period, sum(s) AS s FROM pk k JOIN pp p ON p.player = k.player AND p.season = k.season AND p.period < k.period GROUP BY ALL),
    prev AS (SELECT player, season + 1 AS season, sum(s) AS s FROM pp GROUP BY ALL),
    v AS (SELECT t.player, t.position, t.period, coalesce(CASE WHEN t.week = 1 THEN p.s ELSE c.s END, 0)::BIGINT AS total FROM tgt t
          LEFT JOIN cur c ON c.player = t.player AND c.period = t.period LEFT JOIN prev p ON p.player = t.player AND p.season = t.season)
    SELECT *, row_number() OVER (PARTITION BY period, position ORDER BY total DESC, player) AS season_rank FROM v""",
)
def season_points_ranked(t: Tables) -> DataFrame:
    """Season points so far (last season's total in week 1), ranked per period and role."""
    totals = H.period_totals(t.outings, ["player", "season"], {"s": F.col("points")})
    state = H.running_totals(totals, ["player", "season"], ["s"])
    targets = t.outings.select("player", "position", "season", "week", "period").distinct()
    out = H.asof(targets, state, ["player", "season"], ["s"], in_history=True)
    last = totals.groupBy("player", (F.col("season") + 1).alias("season")).agg(F.sum("s").alias("p"))
    out = out.join(last, ["player", "season"], "left").select(
        "player", "position", "period",
        F.coalesce(F.when(F.col("week") == 1, F.col("p")).otherwise(F.col("s")), F.lit(0)).alias("total"),
    )
    return ranked(out, ["period", "position"], "total", "season_rank", tiebreak=["player"], width=16)


@query(
    "H-32",
    views("outings") + """, mine AS (SELECT player, team, period, max(share) AS share FROM outings GROUP BY ALL),
    cal AS (SELECT team, period, lead(period) OVER (PARTITION BY team ORDER BY period) AS next_period FROM (SELECT DISTINCT team, period FROM outings))
    SELECT m.player, m.team, m.period, m.share FROM mine m JOIN cal c ON c.team = m.team AND c.period = m.period
    LEFT JOIN mine n ON n.player = m.player AND n.team = m.team AND n.period = c.next_period
    WHERE m.share > 0.2 AND c.next_period IS NOT NULL AND coalesce(n.share, 0) = 0""",
)
def missing_next_match(t: Tables) -> DataFrame:
    """Players with a real share now and none in the team's next match."""
    mine = t.outings.groupBy("player", "team", "period").agg(F.max("share").alias("share"))
    nxt = H.calendar(t.outings, ["team"])
    after = mine.select("player", "team", F.col("period").alias("next_period"), F.col("share").alias("later"))
    return (
        mine.filter("share > 0.2")
        .join(nxt, ["team", "period"])
        .filter("next_period IS NOT NULL")
        .join(after, ["player", "team", "next_period"], "left")
        .filter(F.coalesce("later", F.lit(0)) == 0)
        .select("player", "team", "period", "share")
    )


@query(
    "H-33 J-6",
    views("outings") + """, pp AS (SELECT player, season, period, count(*) AS n, sum(points) AS p, sum(yards) AS y FROM outings GROUP BY ALL),
    k AS (SELECT player, season, period FROM pp UNION
          SELECT player, season, max(period) + 1 FROM pp GROUP BY ALL)
    SELECT k.player, k.season, k.period, round(sum(p) / sum(n), 6) AS points_mean, round(sum(y) / sum(n), 6) AS yards_mean
    FROM k LEFT JOIN pp ON pp.player = k.player AND pp.season = k.season AND pp.period < k.period GROUP BY ALL""",
)
def grading_features(t: Tables) -> DataFrame:
    """Season-to-date means at every played period and at the one still to come."""
    totals = H.period_totals(t.outings, ["player", "season"], {"p": F.col("points"), "y": F.col("yards")})
    state = H.running_totals(totals, ["player", "season"], ["n", "p", "y"])
    upcoming = totals.groupBy("player", "season").agg((F.max("period") + 1).alias("period"))
    keys = totals.select("player", "season", "period").unionByName(upcoming)
    out = H.resolve(keys, state, ["player", "season"], ["n", "p", "y"])
    return out.select(
        "player", "season", "period",
        F.round(F.col("p") / F.col("n"), 6).alias("points_mean"), F.round(F.col("y") / F.col("n"), 6).alias("yards_mean"),
    )


@query(
    "H-34",
    views("starters") + """ SELECT player, team, period, slot,
      (SELECT count(*) FROM starters x WHERE x.player = s.player AND x.period < s.period) AS starts_before FROM starters s""",
)
def career_starts(t: Tables) -> DataFrame:
    out = H.to_date(t.starters.select("player", "team", "period", "slot"), t.starters, ["player"], {}, in_history=True)
    return out.select("player", "team", "period", "slot", F.coalesce("n", F.lit(0)).alias("starts_before"))


@query(
    "H-35",
    views("starters") + """, qb AS (SELECT team, season, period, arg_min(player, slot) AS player FROM starters WHERE position = 'QB' GROUP BY ALL),
    pp AS (SELECT player, season, period, count(*) AS n, sum(points) AS s FROM outings GROUP BY ALL)
    SELECT qb.team, qb.period, qb.player, round(sum(s) / sum(n), 6) AS grade FROM qb
    LEFT JOIN pp ON pp.player = qb.player AND pp.season = qb.season AND pp.period < qb.period GROUP BY ALL""",
)
def first_passer_grade(t: Tables) -> DataFrame:
    """Season grade to date of the first passer on the depth chart."""
    qb = t.starters.filter("position = 'QB'").groupBy("team", "season", "week", "period").agg(F.min_by("player", "slot").alias("player"))
    out = H.season_means(qb, t.outings, ["player"], {"grade": F.col("points")}, previous_season=None, in_history=True)
    return out.select("team", "period", "player", F.round("grade", 6).alias("grade"))


@query(
    "H-36",
    views("outings") + """, c AS (
      SELECT k.match_id AS kid, o.points, row_number() OVER (PARTITION BY k.match_id ORDER BY o.period DESC, o.match_id DESC) AS rn
      FROM outings k JOIN outings o ON o.player = k.player AND o.is_home = k.is_home AND o.period < k.period),
    a AS (SELECT k.match_id AS kid, o.points, row_number() OVER (PARTITION BY k.match_id ORDER BY o.period DESC, o.match_id DESC) AS rn
      FROM outings k JOIN outings o ON o.player = k.player AND o.period < k.period)
    SELECT match_id, player, round(coalesce(
      (SELECT avg(points) FROM c WHERE kid = match_id AND rn <= 5), (SELECT avg(points) FROM a WHERE kid = match_id AND rn <= 20)), 6) AS matched_mean
    FROM outings""",
)
def condition_matched_mean(t: Tables) -> DataFrame:
    """Last five games under the same condition, else the last twenty of any kind."""
    value = {"v": F.col("points")}
    matched = H.last_n_means(t.outings, ["player", "is_home"], value, 5)
    anything = H.last_n_means(t.outings, ["player"], {"u": F.col("points")}, 20)
    out = t.outings.select("match_id", "player", "is_home", "period")
    out = H.asof(out, matched, ["player", "is_home"], ["v"], in_history=True)
    out = H.asof(out, anything, ["player"], ["u"], in_history=True)
    return out.select("match_id", "player", F.round(F.coalesce("v", "u"), 6).alias("matched_mean"))


@query(
    "H-37",
    views("outings") + """ SELECT match_id, player, round((SELECT avg(points) FROM outings x
       WHERE x.player = o.player AND x.period < o.period AND x.share >= 0.5), 6) AS qualified_mean FROM outings o""",
)
def qualified_career_mean(t: Tables) -> DataFrame:
    """Career mean over games with at least half of the volume."""
    good = t.outings.filter("share >= 0.5")
    out = H.to_date(t.outings.select("match_id", "player", "period"), good, ["player"], {"s": F.col("points")})
    return out.select("match_id", "player", F.round(F.col("s") / F.col("n"), 6).alias("qualified_mean"))


@query(
    "PF-12 PF-23 J-6",
    views("plays") + """ SELECT match_id, num, hundredths,
      lag(hundredths) OVER (PARTITION BY match_id ORDER BY num) AS before,
      lead(hundredths) OVER (PARTITION BY match_id ORDER BY num) AS after FROM plays""",
)
def neighbouring_plays(t: Tables) -> DataFrame:
    """Previous and next value in a match of any length."""
    plays = t.plays.select("match_id", "num", "hundredths")
    return chunked_scan(
        plays, ["match_id"], F.floor(F.col("num") / 4096), ["num"],
        [Lag("before", "hundredths"), Lead("after", "hundredths")],
    )
