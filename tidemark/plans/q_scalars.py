"""Scalar conversions, derived rates and scoring rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import periods as P
from tidemark.functions import scalars as X
from tidemark.functions import scoring as Z
from tidemark.operators import history as H
from tidemark.operators.scan import Fill, Lag, chunked_scan
from tidemark.plans.registry import query
from tidemark.plans.testbed import Tables, views


@query(
    "F-1 F-2 F-31 F-3 F-13",
    """SELECT o_orderkey, month(o_orderdate) || ' | ' || year(o_orderdate) AS label, year(o_orderdate) * 100 + month(o_orderdate) AS period,
      CASE WHEN month(o_orderdate) = 12 THEN '1 | ' || (year(o_orderdate) + 1) ELSE (month(o_orderdate) + 1) || ' | ' || year(o_orderdate) END AS next_label,
      month(o_orderdate) || '-' || year(o_orderdate) AS file_label,
      (o_orderkey % 18 + 1) || ' | ' || (2000 + o_orderkey % 24) AS market_label, strftime(o_orderdate, '%m') AS month_text FROM orders""",
)
def period_labels(t: Tables) -> DataFrame:
    label = P.period_label(F.year("o_orderdate"), F.month("o_orderdate"))
    code = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("WK"), F.lpad((F.col("o_orderkey") % 18 + 1).cast("string"), 2, "0"))
    return t.table("orders").select("o_orderkey", "o_orderdate", label.alias("label"), code.alias("code")).select(
        "o_orderkey", "label", P.period_of(F.col("label")).alias("period"),
        P.next_label(F.col("label"), P.week_of(F.col("label")) == 12).alias("next_label"),
        P.file_safe(F.col("label")).alias("file_label"),
        P.market_period(F.col("code")).alias("market_label"),
        X.month_of(F.col("o_orderdate").cast("date").cast("string")).alias("month_text"),
    )


@query(
    "F-4 F-5 F-13 F-26",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 180 ELSE (o_orderkey % 16) * 60 + o_orderkey % 60 END::INT AS seconds,
      CASE WHEN o_orderkey % 12 + 1 IN (1, 12) OR o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 12 + 1 < 7 THEN 1 ELSE 2 END AS bucket,
      month(o_orderdate)::INT AS id_month, round((o_orderkey % 101) / 100.0, 6) AS fraction FROM orders""",
)
def clocks_and_percents(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    clock = F.when(k % 7 != 0, F.concat_ws(":", k % 16, F.lpad((k % 60).cast("string"), 2, "0")))
    time = F.concat(k % 12 + 1, F.lit(":30"), F.when(k % 5 == 0, "am").otherwise("pm"))
    return t.table("orders").select(
        "o_orderkey",
        X.clock_seconds(clock).alias("seconds"),
        X.kickoff_bucket(time).alias("bucket"),
        X.month_of_id(F.date_format("o_orderdate", "yyyyMMdd")).alias("id_month"),
        F.round(X.percent_fraction(F.concat(k % 101, F.lit("%"))), 6).alias("fraction"),
    )


@query(
    "F-6 F-7 F-8",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'Dome' ELSE (p_size + 20) || '|' || (CASE WHEN p_partkey % 4 = 0 THEN 65 ELSE p_partkey % 90 + 10 END) || '|' || (p_partkey % 25) END AS weather,
      contains(p_name, 'r')::INT AS turf,
      list_sum(list_transform(string_split(split_part(p_name, ' ', 1), ''), lambda c: ascii(c)))::INT AS first_word FROM part""",
)
def weather_and_ground(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    humidity = F.when(k % 4 != 0, F.concat(F.lit(", relative humidity "), k % 90 + 10, F.lit("%"))).otherwise("")
    text = F.when(k % 6 != 0, F.concat(F.col("p_size") + 20, F.lit(" degrees"), humidity, F.lit(", wind "), k % 25, F.lit(" mph")))
    return t.table("part").select(
        "p_partkey", X.weather(text).alias("weather"),
        X.turf_flag(F.replace("p_name", F.lit("r"), F.lit("turf"))).alias("turf"),
        X.first_word_code(F.col("p_name")).alias("first_word"),
    )


_LINE = """, d AS (SELECT *, CASE WHEN home_yards % 10 = 0 THEN NULL WHEN home_yards % 10 = 1 THEN 'Pick' ELSE 'Team ' || (CASE WHEN away_yards % 2 = 0 THEN home ELSE away END) || ' -' || (home_yards % 14) || '.5' END AS line,
      (away_yards % 60) || '.5 (' || (CASE WHEN home_yards % 2 = 0 THEN 'over' ELSE 'under' END) || ')' AS ou FROM matches)"""


@query(
    "F-9 F-10 F-11 F-12",
    views("matches") + _LINE + """, n AS (SELECT *, CASE WHEN line <> 'Pick' THEN split_part(line, '-', 2)::DOUBLE END AS pts, away_yards % 2 = 0 AS fav_home, (away_yards % 60) + 0.5 AS oup FROM d)
    SELECT match_id, CASE WHEN pts IS NULL THEN 0 WHEN (CASE WHEN fav_home THEN home_points - away_points ELSE away_points - home_points END) > pts THEN 1 ELSE 0 END AS covered,
      CASE WHEN pts IS NULL THEN 0.0 WHEN fav_home THEN -pts ELSE pts END AS home_spread, CASE WHEN pts IS NULL THEN 0.0 WHEN fav_home THEN pts ELSE -pts END AS away_spread,
      (pts IS NOT NULL AND fav_home)::INT AS home_favoured, oup::DOUBLE AS ou_points,
      (CASE WHEN home_yards % 2 = 0 THEN home_points + away_points > oup ELSE home_points + away_points < oup END)::INT AS ou_hit FROM n""",
)
def betting_lines(t: Tables) -> DataFrame:
    """Spread and total from their text forms: signed, covered, hit."""
    y, a = F.col("home_yards"), F.col("away_yards")
    fav = F.when(a % 2 == 0, F.col("home")).otherwise(F.col("away"))
    line = F.when(y % 10 == 1, F.lit("Pick")).when(y % 10 != 0, F.concat(F.lit("Team "), fav, F.lit(" -"), y % 14, F.lit(".5")))
    ou = F.concat(a % 60, F.lit(".5 ("), F.when(y % 2 == 0, "over").otherwise("under"), F.lit(")"))
    m = t.matches.select("match_id", "home", "away", "home_points", "away_points", line.alias("line"), ou.alias("ou"))
    # Names of the teams meet the favourite's name through an equi-join on the dimension.
    names = t.table("supplier").select(F.concat(F.lit("Team"), F.col("s_suppkey")).alias("name"), F.col("s_suppkey").alias("fav"))
    m = m.withColumns({"name": X.favourite(F.col("line")), "pts": X.spread(F.col("line"))}).join(names, "name", "left")
    fav_home = F.coalesce(F.col("fav") == F.col("home"), F.lit(False))
    signed = X.signed_spread(fav_home, F.col("pts"))
    return m.select(
        "match_id",
        F.coalesce(X.spread_covered(fav_home, F.col("pts"), F.col("home_points"), F.col("away_points")), F.lit(0)).alias("covered"),
        signed["home_spread"].alias("home_spread"), signed["away_spread"].alias("away_spread"), signed["home_favoured"].alias("home_favoured"),
        X.over_under_points(F.col("ou")).alias("ou_points"),
        X.over_under_hit(F.col("ou"), F.col("home_points") + F.col("away_points")).alias("ou_hit"),
    )


_FIG = """, p AS (SELECT match_id, position, cents, cents % 31 AS completed_passes, cents % 31 + cents % 13 AS attempted_passes, cents % 5 AS passing_touchdowns, cents % 4 AS interceptions_thrown,
   cents % 397 AS passing_yards, cents % 6 AS times_sacked, cents % 37 AS yards_lost_from_sacks, cents % 127 AS rush_yards, cents % 23 AS rush_attempts, cents % 3 AS rush_touchdowns,
   cents % 151 AS receiving_yards, cents % 11 AS receptions, cents % 2 AS receiving_touchdowns, cents % 11 + cents % 7 AS times_pass_target FROM outings)"""


def figures(t: Tables) -> DataFrame:
    c = F.col("cents")
    return t.outings.select(
        "match_id", "position", (c % 31).alias("completed_passes"), (c % 31 + c % 13).alias("attempted_passes"),
        (c % 5).alias("passing_touchdowns"), (c % 4).alias("interceptions_thrown"), (c % 397).alias("passing_yards"),
        (c % 6).alias("times_sacked"), (c % 37).alias("yards_lost_from_sacks"), (c % 127).alias("rush_yards"),
        (c % 23).alias("rush_attempts"), (c % 3).alias("rush_touchdowns"), (c % 151).alias("receiving_yards"),
        (c % 11).alias("receptions"), (c % 2).alias("receiving_touchdowns"), (c % 11 + c % 7).alias("times_pass_target"),
    )


def _r(n: str, d: str, k: int, scale: str = "") -> str:
    return f"round_even(coalesce(({n})::DOUBLE / nullif({d}, 0), 0){scale}, {k})"


@query(
    "F-15 F-16 F-32",
    views("outings") + _FIG + " SELECT match_id, "
    + ", ".join(f"{e} AS {n}" for n, e in {
        "completion_percentage": _r("completed_passes", "attempted_passes", 6, " * 100"),
        "td_percentage": _r("passing_touchdowns", "attempted_passes", 6, " * 100"),
        "interception_percentage": _r("interceptions_thrown", "attempted_passes", 6, " * 100"),
        "yards_per_attempt": _r("passing_yards", "attempted_passes", 6),
        "adjusted_yards_per_attempt": _r("passing_yards + 20 * passing_touchdowns - 45 * interceptions_thrown", "attempted_passes", 6),
        "yards_per_completion": _r("passing_yards", "completed_passes", 6),
        "sack_percentage": _r("times_sacked", "(attempted_passes + times_sacked)", 6, " * 100"),
        "net_gained_per_pass_attempt": _r("passing_yards - yards_lost_from_sacks", "(attempted_passes + times_sacked)", 6),
        "adjusted_net_yards_per_pass_attempt": _r("passing_yards - yards_lost_from_sacks + 20 * passing_touchdowns - 45 * interceptions_thrown", "(attempted_passes + times_sacked)", 6),
        "rush_yards_per_attempt": _r("rush_yards", "rush_attempts", 6),
    }.items()) + " FROM p",
)
def passer_rates(t: Tables) -> DataFrame:
    return figures(t).select("match_id", *[v.alias(k) for k, v in Z.passer_rates(6).items()])


@query(
    "F-15 F-17",
    views("outings") + _FIG + " SELECT match_id, rush_attempts + receptions AS total_touches, rush_yards + receiving_yards AS yards_from_scrimmage, rush_touchdowns + receiving_touchdowns AS total_touchdowns, "
    + ", ".join(f"{e} AS {n}" for n, e in {
        "rush_yards_per_attempt": _r("rush_yards", "rush_attempts", 6),
        "receiving_yards_per_reception": _r("receiving_yards", "receptions", 6),
        "catch_percentage": _r("receptions", "times_pass_target", 6, " * 100"),
        "receiving_yards_per_target": _r("receiving_yards", "times_pass_target", 6),
        "scrimmage_yards_per_touch": _r("rush_yards + receiving_yards", "(rush_attempts + receptions)", 6),
        "touchdown_per_touch": _r("rush_touchdowns + receiving_touchdowns", "(rush_attempts + receptions)", 6),
        "touchdown_per_reception": _r("receiving_touchdowns", "receptions", 6),
        "touchdown_per_rush": _r("rush_touchdowns", "rush_attempts", 6),
        "touchdown_per_target": _r("receiving_touchdowns", "times_pass_target", 6),
    }.items()) + " FROM p",
)
def skill_rates(t: Tables) -> DataFrame:
    return figures(t).select("match_id", *[v.alias(k) for k, v in Z.skill_rates(6).items()])


_QB = "4 * passing_touchdowns + 0.04::DOUBLE * passing_yards - interceptions_thrown + 0.1::DOUBLE * rush_yards + 6 * rush_touchdowns + 3 * (passing_yards > 300)::INT + 3 * (rush_yards > 100)::INT"
_SK = "0.1::DOUBLE * rush_yards + 6 * rush_touchdowns + {r} * receptions + 0.1::DOUBLE * receiving_yards + 6 * receiving_touchdowns + 3 * (rush_yards > 100)::INT + 3 * (receiving_yards > 100)::INT"


@query(
    "F-18 F-19 F-20 SL-9 SL-16",
    views("outings") + _FIG + f""" SELECT match_id, round(CASE WHEN position = 'QB' THEN {_QB} ELSE {_SK.format(r=1)} END, 4) AS points,
      round({_SK.format(r=0)}, 4) AS standard, round({_SK.format(r='0.5::DOUBLE')}, 4) AS half,
      round({_QB} + receptions + 0.1::DOUBLE * receiving_yards + 6 * receiving_touchdowns + 3 * (receiving_yards > 100)::INT, 2) AS all_figures FROM p""",
)
def scoring_rules(t: Tables) -> DataFrame:
    """Points by role, reception variants, and the rule over every figure present."""
    f = figures(t)
    by_role = F.when(F.col("position") == "QB", Z.passer_points()).otherwise(Z.skill_points())
    return f.select(
        "match_id", F.round(by_role, 4).alias("points"), F.round(Z.skill_points("standard"), 4).alias("standard"),
        F.round(Z.skill_points("half"), 4).alias("half"), Z.points_of(f.columns).alias("all_figures"),
    )


@query(
    "F-21",
    views("outings") + """ SELECT match_id, round(yards + yards * 2 * (1 - share), 6) AS projected FROM outings WHERE share BETWEEN 0.1 AND 0.95""",
)
def volume_projection(t: Tables) -> DataFrame:
    projected = X.project_volume(F.col("yards"), F.col("share"))
    return t.outings.filter(F.col("share").between(0.1, 0.95)).select("match_id", F.round(projected, 6).alias("projected"))


@query(
    "F-22 A-5",
    views("outings") + """, tm AS (SELECT team, period, sum(points) AS team_points, sum(attempts) AS team_attempts, sum(yards) AS team_yards FROM outings GROUP BY ALL)
    SELECT o.match_id, team_points::BIGINT AS team_points, (team_points > coalesce(x.p, 0))::INT AS won, round(coalesce(attempts / nullif(team_attempts, 0), 0), 6) AS attempt_share,
      round(coalesce(yards / nullif(team_yards, 0), 0), 6) AS yard_share FROM outings o JOIN tm USING (team, period)
    LEFT JOIN (SELECT team AS opp, period, team_points AS p FROM tm) x USING (opp, period) WHERE position = 'QB'""",
)
def grading_inputs(t: Tables) -> DataFrame:
    """What a passer's grade is made of: team points, result and shares of the team's totals."""
    tm = t.outings.groupBy("team", "period").agg(
        F.sum("points").alias("team_points"), F.sum("attempts").alias("team_attempts"), F.sum("yards").alias("team_yards")
    )
    other = tm.select(F.col("team").alias("opp"), "period", F.col("team_points").alias("opp_points"))
    qb = t.outings.filter("position = 'QB'").join(tm, ["team", "period"]).join(other, ["opp", "period"], "left")
    return qb.select(
        "match_id", "team_points", (F.col("team_points") > F.coalesce("opp_points", F.lit(0))).cast("int").alias("won"),
        F.round(X.safe_ratio(F.col("attempts"), F.col("team_attempts")), 6).alias("attempt_share"),
        F.round(X.safe_ratio(F.col("yards"), F.col("team_yards")), 6).alias("yard_share"),
    )


# Score steps per kind of play; the derived scores only move by these.
_STEP = "CASE kind WHEN 4 THEN 7 WHEN 2 THEN 6 WHEN 8 THEN 3 WHEN 13 THEN 8 WHEN 5 THEN 2 ELSE 0 END"


@query(
    "F-23 F-24",
    views("plays") + f""", s AS (SELECT match_id, num, sum(CASE WHEN num % 2 = 0 THEN {_STEP} ELSE 0 END) OVER w AS hs, sum(CASE WHEN num % 2 = 1 THEN {_STEP} ELSE 0 END) OVER w AS aws FROM plays WINDOW w AS (PARTITION BY match_id ORDER BY num)),
    d AS (SELECT *, hs - coalesce(lag(hs) OVER (PARTITION BY match_id ORDER BY num), 0) + aws - coalesce(lag(aws) OVER (PARTITION BY match_id ORDER BY num), 0) AS step FROM s)
    SELECT match_id, num, hs::BIGINT AS home_score, aws::BIGINT AS away_score, CASE step WHEN 6 THEN 'td|nex' WHEN 7 THEN 'td|ex' WHEN 8 THEN 'td|two' WHEN 3 THEN 'fg' WHEN 2 THEN 'sf' END AS event, step::INT AS points FROM d WHERE step > 0""",
)
def scoring_events(t: Tables) -> DataFrame:
    """Event codes from score changes, and the codes back to points."""
    s = scores(t)
    s = chunked_scan(s, ["match_id"], F.floor(F.col("num") / 4096), ["num"], [Lag("_h", "home_score"), Lag("_a", "away_score")])
    step = F.col("home_score") - F.coalesce("_h", F.lit(0)) + F.col("away_score") - F.coalesce("_a", F.lit(0))
    return s.withColumn("step", step).filter("step > 0").select(
        "match_id", "num", "home_score", "away_score", X.event_code(F.col("step")).alias("event"),
        X.event_points(X.event_code(F.col("step"))).alias("points"),
    )


def scores(t: Tables) -> DataFrame:
    """Running scores of both sides per play."""
    from tidemark.operators.scan import RunningSum

    plays = t.plays.select(
        "match_id", "num", "kind",
        F.when(F.col("num") % 2 == 0, F.expr(_STEP)).otherwise(0).alias("hp"),
        F.when(F.col("num") % 2 == 1, F.expr(_STEP)).otherwise(0).alias("ap"),
    )
    return chunked_scan(
        plays, ["match_id"], F.floor(F.col("num") / 4096), ["num"], [RunningSum("home_score", "hp"), RunningSum("away_score", "ap")]
    )


# Fixed values of a match's story: lead in scores and points of a blow-out start,
# its final margin, and the margin of a close match.
STREAK, STREAK_POINTS, BLOWOUT, CLOSE = 3, 21, 10, 7
# The derived plays lie within one month, so matches are dealt to seasons by their id.
SEASONS = 5


@query(
    "A-23",
    views("plays") + f""", s AS (SELECT match_id, num, kind, {_STEP} AS p, num % 2 AS side,
        sum(CASE WHEN num % 2 = 0 THEN {_STEP} ELSE 0 END) OVER w AS hs, sum(CASE WHEN num % 2 = 1 THEN {_STEP} ELSE 0 END) OVER w AS aws,
        sum((num % 2 = 0 AND {_STEP} > 0)::INT) OVER w AS hc, sum((num % 2 = 1 AND {_STEP} > 0)::INT) OVER w AS ac FROM plays WINDOW w AS (PARTITION BY match_id ORDER BY num)),
    g AS (SELECT match_id, max(hs) AS h, max(aws) AS a, max(abs(hs - aws)) AS gap, bool_or(hc - ac >= 3 AND hs >= 21) AS ph, bool_or(ac - hc >= 3 AND aws >= 21) AS pa,
        sum(CASE WHEN side = 0 AND kind IN (2, 5) THEN p ELSE 0 END) AS hn, sum(CASE WHEN side = 1 AND kind IN (2, 5) THEN p ELSE 0 END) AS an FROM s GROUP BY 1)
    SELECT match_id, (ph AND h - a > 10)::INT AS home_blowout, (pa AND a - h > 10)::INT AS away_blowout, (pa AND a < h AND NOT (a - h > 10))::INT AS home_comeback, (ph AND h < a AND NOT (h - a > 10))::INT AS away_comeback,
      CASE WHEN (ph AND h - a > 10) OR (pa AND a - h > 10) THEN gap ELSE 0 END::BIGINT AS blowout_size, CASE WHEN (ph AND h < a) OR (pa AND a < h) THEN gap ELSE 0 END::BIGINT AS comeback_size,
      (abs(h - a) <= 7)::INT AS is_close, (h + a >= avg(h + a) OVER (PARTITION BY match_id % 5))::INT AS high_scoring, hn::BIGINT AS home_non_offensive, an::BIGINT AS away_non_offensive FROM g""",
)
def match_attributes(t: Tables) -> DataFrame:
    """Blowout, comeback, close and high-scoring matches from the stream of scores."""
    from tidemark.operators.scan import RunningSum

    step = F.expr(_STEP)
    home = F.col("num") % 2 == 0
    plays = t.plays.select(
        "match_id", "num", "kind", F.when(home, step).otherwise(0).alias("hp"), F.when(~home, step).otherwise(0).alias("ap")
    ).withColumns({"hc1": (F.col("hp") > 0).cast("int"), "ac1": (F.col("ap") > 0).cast("int")})
    s = chunked_scan(
        plays, ["match_id"], F.floor(F.col("num") / 4096), ["num"],
        [RunningSum("hs", "hp"), RunningSum("aws", "ap"), RunningSum("hc", "hc1"), RunningSum("ac", "ac1")],
    )
    odd = F.col("kind").isin(2, 5)
    g = s.groupBy("match_id").agg(
        F.max("hs").alias("h"), F.max("aws").alias("a"), F.max(F.abs(F.col("hs") - F.col("aws"))).alias("gap"),
        F.bool_or((F.col("hc") - F.col("ac") >= STREAK) & (F.col("hs") >= STREAK_POINTS)).alias("ph"),
        F.bool_or((F.col("ac") - F.col("hc") >= STREAK) & (F.col("aws") >= STREAK_POINTS)).alias("pa"),
        F.sum(F.when(odd, F.col("hp")).otherwise(0)).alias("home_non_offensive"),
        F.sum(F.when(odd, F.col("ap")).otherwise(0)).alias("away_non_offensive"),
    )
    g = g.withColumn("season", F.col("match_id") % SEASONS)
    mean = g.groupBy("season").agg((F.sum(F.col("h") + F.col("a")) / F.count(F.lit(1))).alias("average"))
    g, average = g.join(mean, "season"), F.col("average")
    h, a, ph, pa = (F.col(c) for c in ("h", "a", "ph", "pa"))
    hb, ab = ph & (h - a > BLOWOUT), pa & (a - h > BLOWOUT)
    hc, ac = pa & (a < h), ph & (h < a)
    return g.select(
        "match_id", hb.cast("int").alias("home_blowout"), ab.cast("int").alias("away_blowout"),
        hc.cast("int").alias("home_comeback"), ac.cast("int").alias("away_comeback"),
        F.when(hb | ab, F.col("gap")).otherwise(0).alias("blowout_size"),
        F.when(hc | ac, F.col("gap")).otherwise(0).alias("comeback_size"),
        (F.abs(h - a) <= CLOSE).cast("int").alias("is_close"), (h + a >= average).cast("int").alias("high_scoring"),
        "home_non_offensive", "away_non_offensive",
    )


@query(
    "F-25 H-13",
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_shipdate, CAST(l_quantity AS BIGINT) AS pts FROM lineitem WHERE l_linenumber <= 7),
    a AS (SELECT l_orderkey, [CAST(coalesce(sum(pts) FILTER (l_linenumber = 1), 0) AS BIGINT), coalesce(sum(pts) FILTER (l_linenumber = 2), 0), coalesce(sum(pts) FILTER (l_linenumber = 3), 0), coalesce(sum(pts) FILTER (l_linenumber = 4), 0)] AS base,
       sum(pts) FILTER (l_linenumber = 5) AS p5, sum(pts) FILTER (l_linenumber = 6) AS p6, sum(pts) FILTER (l_linenumber = 7) AS p7 FROM q GROUP BY 1)
    SELECT l_orderkey, base[1]::BIGINT AS q1, base[2]::BIGINT AS q2, base[3]::BIGINT AS q3, base[4]::BIGINT AS q4, coalesce(p7, p6, p5, 0)::BIGINT AS ot FROM a""",
)
def quarter_scores(t: Tables) -> DataFrame:
    """Score lists of four to seven parts normalised to four quarters and the last overtime."""
    q = F.col("l_quantity").cast("bigint")
    parts = [F.sum(F.when(F.col("l_linenumber") == i, q)).alias(f"p{i}") for i in range(1, 8)]
    s = t.table("lineitem").groupBy("l_orderkey").agg(*parts)
    base = [F.coalesce(f"p{i}", F.lit(0)) for i in range(1, 5)]
    raw = (
        F.when(F.col("p7").isNotNull(), F.array(*base, F.coalesce("p5", F.lit(0)), F.coalesce("p6", F.lit(0)), F.col("p7")))
        .when(F.col("p6").isNotNull(), F.array(*base, F.coalesce("p5", F.lit(0)), F.col("p6")))
        .when(F.col("p5").isNotNull(), F.array(*base, F.col("p5")))
        .otherwise(F.array(*base))
    )
    slots = s.select("l_orderkey", X.quarter_slots(raw).alias("s"))
    return slots.select("l_orderkey", *[F.element_at("s", i + 1).alias(n) for i, n in enumerate(("q1", "q2", "q3", "q4", "ot"))])


@query(
    "F-27 F-28 F-33",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'OL' WHEN 'BUILDING' THEN 'DL-LB' WHEN 'FURNITURE' THEN 'DB' ELSE 'X-OL' END AS simple,
      [0, c_custkey % 7 - c_custkey % 5][1:2][2] AS first_difference FROM customer""",
)
def simple_positions(t: Tables) -> DataFrame:
    """Multi-position labels through a map with repeats dropped; array differences."""
    label = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "G-T").when(F.col("c_mktsegment") == "BUILDING", "NT-DE-ILB").when(F.col("c_mktsegment") == "FURNITURE", "CB-S").otherwise("X-G")
    # Detailed to simple positions.
    simple = {"G": "OL", "T": "OL", "C": "OL", "NT": "DL", "DE": "DL", "ILB": "LB", "OLB": "LB", "CB": "DB", "S": "DB"}
    k = F.col("c_custkey")
    diff = X.differences(F.array(k % 7, k % 5))
    return t.table("customer").select(
        "c_custkey", X.simple_positions(label, simple).alias("simple"), F.element_at(X.pad_right(diff, 2, F.lit(0).cast("bigint")), 1).alias("first_difference")
    )


@query(
    "F-29",
    views("plays") + """, m AS (SELECT match_id, num, CASE WHEN kind IN (0, 12) THEN (2000 + num % 20) || CASE WHEN kind = 0 THEN '*' ELSE '+' END END AS label FROM plays)
    SELECT match_id, num, regexp_replace(last_value(label IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY num), '[*+]', '', 'g') AS year_label FROM m""",
)
def year_labels(t: Tables) -> DataFrame:
    """Labels filled forward, marks stripped."""
    mark = F.when(F.col("kind") == 0, "*").otherwise("+")
    p = t.plays.select("match_id", "num", F.when(F.col("kind").isin(0, 12), F.concat(2000 + F.col("num") % 20, mark)).alias("label"))
    out = chunked_scan(p, ["match_id"], F.floor(F.col("num") / 4096), ["num"], [Fill("filled", "label")])
    return out.select("match_id", "num", X.strip_marks(F.col("filled")).alias("year_label"))


@query(
    "F-34 IO-9",
    """SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_total, round(avg(value), 4) AS mean_value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""",
)
def json_properties(t: Tables) -> DataFrame:
    e = t.table("events").withColumn("p", F.from_json("props", "k bigint")).filter("p.k IS NOT NULL")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_total"), F.round(F.avg("value"), 4).alias("mean_value"))
