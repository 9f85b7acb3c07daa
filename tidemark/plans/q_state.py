"""Standings and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import ratings as R
from tidemark.operators import standings as S
from tidemark.operators.sides import attach_both
from tidemark.plans.registry import REGISTRY, query
from tidemark.plans.testbed import Tables, views
from tidemark.session import stored

_W = "OVER (PARTITION BY team, season ORDER BY period, match_id)"

ROLE_ORDER = ["QB", "RB", "WR", "TE", "OL"]


def _ratio(p: str = "") -> str:
    return f"coalesce(round((2 * {p}w + {p}t) / nullif(2 * ({p}w + {p}l + {p}t), 0), 4), 0)"


_STAND = views("sides", "divisions", "season_length") + f""", m AS (
  SELECT s.*, (for_points > opp_points)::INT AS mw, (for_points < opp_points)::INT AS ml, (for_points = opp_points)::INT AS mt,
         (d.division = o.division)::INT AS dv, (d.conference = o.conference)::INT AS cf
  FROM sides s JOIN divisions d ON d.team = s.team JOIN divisions o ON o.team = s.opp),
st0 AS (SELECT match_id, season, week, period, team, opp, is_home, mw, ml, mt, sum(mw) {_W} AS w, sum(ml) {_W} AS l, sum(mt) {_W} AS t,
   sum(mw * cf) {_W} AS conf_w, sum(ml * cf) {_W} AS conf_l, sum(mt * cf) {_W} AS conf_t, sum(mw * dv) {_W} AS div_w, sum(ml * dv) {_W} AS div_l, sum(mt * dv) {_W} AS div_t,
   sum(for_points) {_W} AS pf, sum(opp_points) {_W} AS pa, sum(for_points // 7) {_W} AS tf, sum(opp_points // 7) {_W} AS ta FROM m),
st AS (SELECT *, {_ratio()} AS ratio, {_ratio('conf_')} AS conf_ratio, {_ratio('div_')} AS div_ratio,
   coalesce(round((2 * (w - mw) + t - mt) / nullif(2 * (w + l + t - 1), 0), 4), 0) AS ratio_before FROM st0)"""


@query(
    "Q-9",
    _STAND + " SELECT match_id, team, w::BIGINT AS w, l::BIGINT AS l, t::BIGINT AS t, pf::BIGINT AS points_for, pa::BIGINT AS points_against, tf::BIGINT AS tds_for, ta::BIGINT AS tds_against, ratio, conf_ratio, div_ratio FROM st",
)
def running_standings(t: Tables) -> DataFrame:
    st = S.running_standings(t.sides, t.divisions)
    return st.select("match_id", "team", "w", "l", "t", "points_for", "points_against", "tds_for", "tds_against", "ratio", "conf_ratio", "div_ratio")


_SOS = _STAND + f""", met AS (SELECT a.*, CASE WHEN a.is_home THEN b.ratio_before ELSE b.ratio END AS r FROM st a JOIN st b ON b.match_id = a.match_id AND b.team = a.opp),
sos AS (SELECT *, sum(r) {_W} AS sos, sum(r * mw) {_W} AS sov FROM met)"""


@query("Q-10 SL-11", _SOS + " SELECT match_id, team, round(sos, 4) AS sos, round(sov, 4) AS sov FROM sos")
def schedule_strength(t: Tables) -> DataFrame:
    """Strength of schedule and victory; the standings are joined with themselves, so
    they are written once, with the columns that this needs."""
    t = t.once("matches")
    st = S.running_standings(t.sides, t.divisions)
    st = S.with_schedule_strength(stored(st.select("match_id", "season", "period", "team", "opp", "is_home", "ratio", "ratio_before", "won")))
    return st.select("match_id", "team", F.round("sos", 4).alias("sos"), F.round("sov", 4).alias("sov"))


_SNAP = _STAND + """, ends AS (SELECT season, team, period, arg_max(ratio, match_id) AS ratio, arg_max(w, match_id) AS w FROM st JOIN season_length USING (season) WHERE week <= weeks + 1 GROUP BY ALL),
grid AS (SELECT season, team, period FROM (SELECT DISTINCT season, team FROM ends) JOIN (SELECT DISTINCT season, period FROM ends) USING (season)),
snap AS (SELECT season, team, period, last_value(ratio IGNORE NULLS) OVER g AS ratio, last_value(w IGNORE NULLS) OVER g AS w FROM grid LEFT JOIN ends USING (season, team, period)
   WINDOW g AS (PARTITION BY season, team ORDER BY period)),
snaps AS (SELECT snap.* FROM snap JOIN season_length USING (season) WHERE period % 100 <= weeks)"""


@query("Q-11 SL-12 PF-17", _SNAP + " SELECT season, team, period, ratio, w::BIGINT AS w FROM snaps")
def standing_snapshots(t: Tables) -> DataFrame:
    return S.snapshots(S.period_standings(t.sides), t.season_length, ["ratio", "w"])


@query(
    "Q-12 J-6 ST-3",
    _SNAP + """, k AS (SELECT DISTINCT team, season, period FROM sides),
    bf AS (SELECT k.team, k.period, arg_max(s.ratio, s.period) AS ratio FROM k JOIN snaps s ON s.team = k.team AND s.period < k.period AND s.ratio IS NOT NULL GROUP BY ALL),
    fin AS (SELECT team, season, arg_max(ratio, period) AS ratio FROM snaps GROUP BY ALL),
    pk AS (SELECT k.team, k.period, CASE WHEN k.period % 100 > weeks THEN fin.ratio ELSE coalesce(bf.ratio, sm.ratio) END AS ratio FROM k JOIN season_length USING (season)
       LEFT JOIN bf ON bf.team = k.team AND bf.period = k.period LEFT JOIN snaps sm ON sm.team = k.team AND sm.period = k.period LEFT JOIN fin ON fin.team = k.team AND fin.season = k.season)
    SELECT match_id, h.ratio AS home_ratio, a.ratio AS away_ratio FROM matches m LEFT JOIN pk h ON h.team = home AND h.period = m.period LEFT JOIN pk a ON a.team = away AND a.period = m.period""",
)
def standings_on_spine(t: Tables) -> DataFrame:
    t = t.once("matches")
    snaps = S.snapshots(S.period_standings(t.sides), t.season_length, ["ratio", "w"])
    known = S.attach_snapshots(t.sides, snaps, t.season_length, ["ratio"])
    return attach_both(t.matches.select("match_id", "period", "home", "away"), known, ["ratio"]).select("match_id", "home_ratio", "away_ratio")


def _pair_sql(season_rule: str, holders: str = "", holder_join: str = "") -> str:
    base = views("matches").replace("WITH ", "WITH RECURSIVE ", 1)
    return base + f""", cal AS MATERIALIZED (SELECT period, season, row_number() OVER (ORDER BY period) AS i, coalesce(lead(season) OVER (ORDER BY period), season) AS after FROM (SELECT DISTINCT period, season FROM matches)),
    g AS MATERIALIZED (SELECT i, cal.season, after, home, away, home_points, away_points, winner FROM matches JOIN cal USING (period)){holders},
    r AS (SELECT team, 1::BIGINT AS i, 1500.0::DOUBLE AS rating FROM (SELECT home AS team FROM matches UNION SELECT away FROM matches)
      UNION ALL
      SELECT x.team, x.i + 1, {season_rule}
      FROM (SELECT c.team, c.i, c.rating + coalesce(sum(mv.move), 0) AS nr FROM r c LEFT JOIN (
          SELECT team, i, sum(move) AS move FROM (
            SELECT g.i, g.home AS team, 20 * pow(abs(home_points - away_points) + 3, 0.8) / (7.5 + 0.006 * abs(h.rating - a.rating)) * (coalesce(winner = g.home, false)::INT - 1 / (1 + pow(10, (a.rating - h.rating) / 400))) AS move
              FROM g JOIN r h ON h.team = g.home AND h.i = g.i JOIN r a ON a.team = g.away AND a.i = g.i
            UNION ALL
            SELECT g.i, g.away, 20 * pow(abs(home_points - away_points) + 3, 0.8) / (7.5 + 0.006 * abs(h.rating - a.rating)) * (coalesce(winner = g.away, false)::INT - 1 / (1 + pow(10, (h.rating - a.rating) / 400)))
              FROM g JOIN r h ON h.team = g.home AND h.i = g.i JOIN r a ON a.team = g.away AND a.i = g.i) GROUP BY team, i) mv ON mv.team = c.team AND mv.i = c.i
        GROUP BY c.team, c.i, c.rating) x JOIN cal ON cal.i = x.i {holder_join})
    SELECT r.team, coalesce(cal.period, (SELECT max(period) FROM cal) + 1)::BIGINT AS period, round(r.rating, 4) AS rating FROM r LEFT JOIN cal USING (i)"""


_SEASON_RULE = "CASE WHEN cal.after <> cal.season AND x.nr <> 1500 THEN 0.75 * x.nr + 0.25 * 1505 ELSE x.nr END"


@query("Q-1 Q-3 ST-2", _pair_sql(_SEASON_RULE))
def team_ratings(t: Tables) -> DataFrame:
    """Ratings going into each period, by period supersteps."""
    return R.pair_ratings(t.matches).withColumn("rating", F.round("rating", 4))


_HOLDERS = """, hold AS MATERIALIZED (SELECT team, season, (s % 3 = 0)::INT AS fresh FROM (SELECT team, season, season + team AS s FROM (SELECT DISTINCT home AS team FROM matches), (SELECT DISTINCT season + 1 AS season FROM matches)))"""


_COACH_SQL = _pair_sql(
    "CASE WHEN cal.after <> cal.season AND hold.fresh = 1 THEN 1500 ELSE x.nr END", _HOLDERS, "LEFT JOIN hold ON hold.team = x.team AND hold.season = cal.after"
)


def coach_holders(t: Tables) -> DataFrame:
    """Who is new in which season: team, season, new_holder."""
    seasons = t.season_length.agg(F.collect_set(F.col("season") + 1).alias("s"))
    teams = t.matches.select(F.col("home").alias("team")).distinct()
    return teams.select("team", F.explode(seasons.scalar()).alias("season")).withColumn(
        "new_holder", ((F.col("season") + F.col("team")) % 3 == 0).cast("int")
    )


@query("Q-4 J-9", _COACH_SQL)
def coach_ratings(t: Tables) -> DataFrame:
    """The same recursion; a season change resets the rating of a new coach only."""
    return R.pair_ratings(t.matches, holders=coach_holders(t)).withColumn("rating", F.round("rating", 4))


# Fixed grades: mean points per player and period.
def grades(t: Tables, role_is_passer: bool) -> DataFrame:
    test = F.col("position") == "QB"
    return (
        t.outings.filter(test if role_is_passer else ~test)
        .groupBy("player", "season", "period")
        .agg((F.sum("points") / F.count(F.lit(1))).alias("grade"))
    )


def _grades_sql(op: str) -> str:
    return views("outings") + f", g AS (SELECT player, season, period, avg(points) AS grade FROM outings WHERE position {op} 'QB' GROUP BY ALL)"


def _passer_sql(window: str) -> str:
    return _grades_sql("=") + f""", m AS (SELECT *, avg(grade) OVER ({window}) AS mean, (SELECT avg(grade) FROM g) AS total FROM g),
    f AS (SELECT *, ((CASE WHEN grade < mean THEN grade - 1 ELSE grade END) - mean) * 1.5 + (mean - total) AS gain FROM m),
    s AS (SELECT player, season, sum(gain) AS s FROM f GROUP BY ALL)
    SELECT f.player, f.period, round(100 + sum(gain) OVER (PARTITION BY f.player, f.season ORDER BY f.period) + coalesce((SELECT sum(s.s * pow(0.1, f.season - s.season)) FROM s WHERE s.player = f.player AND s.season < f.season), 0), 4) AS rating FROM f"""


@query("Q-5 SL-27", _passer_sql("PARTITION BY player, season"))
def passer_ratings_season_mean(t: Tables) -> DataFrame:
    r = R.player_ratings(R.graded(grades(t, True), passer=True, mean="season"))
    return r.select("player", "period", F.round("rating", 4).alias("rating"))


@query("Q-5 SL-27", _passer_sql("PARTITION BY player, season ORDER BY period"))
def passer_ratings_to_date(t: Tables) -> DataFrame:
    r = R.player_ratings(R.graded(grades(t, True), passer=True, mean="to_date"))
    return r.select("player", "period", F.round("rating", 4).alias("rating"))


@query("Q-5", _grades_sql("<>") + " SELECT player, period, round(100 + sum(grade) OVER (PARTITION BY player, season ORDER BY period), 4) AS rating FROM g")
def skill_ratings(t: Tables) -> DataFrame:
    r = R.player_ratings(R.graded(grades(t, False), passer=False), keep=0)
    return r.select("player", "period", F.round("rating", 4).alias("rating"))


@query(
    "Q-6",
    _grades_sql("=") + """, s AS (SELECT player, season, sum(grade) AS s, row_number() OVER (PARTITION BY player ORDER BY season) AS i FROM g GROUP BY player, season)
    SELECT g.player, g.period, round(100 + sum(grade) OVER (PARTITION BY g.player, g.season ORDER BY g.period)
       + coalesce((SELECT sum(p.s * pow(0.1, c.i - p.i)) FROM s p WHERE p.player = g.player AND p.i < c.i), 0), 4) AS rating FROM g JOIN s c ON c.player = g.player AND c.season = g.season""",
)
def ratings_by_played_seasons(t: Tables) -> DataFrame:
    """Season changes counted between the player's own games."""
    r = R.player_ratings(R.graded(grades(t, True), passer=False), elapsed="played")
    return r.select("player", "period", F.round("rating", 4).alias("rating"))


@query(
    "Q-7 J-7",
    views("outings", "starters", "divisions") + """, g AS (SELECT player, season, period, avg(points) AS grade FROM outings WHERE position <> 'QB' GROUP BY ALL),
    r AS (SELECT player, period, 100 + sum(grade) OVER (PARTITION BY player, season ORDER BY period) AS rating FROM g)
    SELECT team, period, round(max(coalesce((SELECT arg_max(rating, r.period) FROM r WHERE r.player = s.player AND r.period < s.period), 100)), 4) AS best FROM starters s WHERE position = 'RB' GROUP BY ALL""",
)
def best_lineup_rating(t: Tables) -> DataFrame:
    """Best earlier rating among a line-up's runners."""
    r = R.player_ratings(R.graded(grades(t, False), passer=False), keep=0)
    best = R.best_in_lineup(t.starters, r, "RB")
    return best.select("team", "period", F.round("rating", 4).alias("best"))


@query(
    "Q-7 Q-5 J-7",
    f"""WITH p AS ({REGISTRY['passer_ratings_season_mean'].sql}), r AS (SELECT player, period, rating FROM p UNION ALL SELECT player, period, rating FROM ("""
    + _grades_sql("<>") + """ SELECT player, period, round(100 + sum(grade) OVER (PARTITION BY player, season ORDER BY period), 4) AS rating FROM g)),
    s AS (""" + views("starters") + """ SELECT * FROM starters),
    k AS (SELECT s.team, s.period, s.position, coalesce((SELECT arg_max(rating, r.period) FROM r WHERE r.player = s.player AND r.period < s.period), 100) AS best FROM s)
    SELECT team, period, """ + ", ".join(f"max(best) FILTER (position = '{r}')::DOUBLE AS best_{r.lower()}" for r in ROLE_ORDER) + " FROM k GROUP BY ALL",
)
def best_lineup_ratings(t: Tables) -> DataFrame:
    """Best earlier rating per role of a line-up: passers by their own rule."""
    others = R.player_ratings(R.graded(grades(t, False), passer=False), keep=0).select("player", "period", F.round("rating", 4).alias("rating"))
    passers = passer_ratings_season_mean(t).select("player", "period", "rating")
    return R.best_by_role(t.starters, passers.unionByName(others), ROLE_ORDER)


@query(
    "Q-8",
    _grades_sql("<>") + """, m AS (SELECT *, avg(grade) OVER (PARTITION BY player, season ORDER BY period) AS mean FROM g)
    SELECT player, period, round(100 + sum(5 * (grade - mean - CASE WHEN grade < mean THEN 3 ELSE 0 END)) OVER (PARTITION BY player, season ORDER BY period), 4) AS rating FROM m""",
)
def season_grade_sums(t: Tables) -> DataFrame:
    r = R.season_grade_sum(grades(t, False))
    return r.select("player", "period", F.round("rating", 4).alias("rating"))
