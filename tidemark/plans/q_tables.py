"""Projections, filters, joins, aggregates, rankings and set operations."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import history as H
from tidemark.operators import lineups as L
from tidemark.operators import lookups as J
from tidemark.operators import setops as S
from tidemark.operators.ranking import carry_forward, hash_order, ranked, ranked_in, top_k
from tidemark.plans.registry import query
from tidemark.plans.testbed import ROLES, Tables, views
from tidemark.session import stored

ROLE_NAMES = tuple(sorted(ROLES.values()))
# Roles that a tier counts.
TIER_ROLES = ("QB", "RB", "WR", "TE")

# --- projections and filters ---------------------------------------------


@query("PF-2 PF-1", views("matches") + " SELECT match_id, season, week, home, away, period, winner FROM matches")
def drop_column_span(t: Tables) -> DataFrame:
    """Everything but the columns from one name to another."""
    cols = t.matches.columns
    span = cols[cols.index("home_points") : cols.index("away_turnovers") + 1]
    return t.matches.select(*[c for c in cols if c not in span])


@query(
    "PF-5 PF-6 PF-7 PF-9 PF-10",
    views("outings") + """ SELECT match_id, player, position, share FROM outings WHERE season >= 1997 AND share BETWEEN 0.2 AND 0.8
      AND position IN ('QB', 'RB') AND (points > 20 OR yards > 200) AND team IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""",
)
def filtered_outings(t: Tables) -> DataFrame:
    """Start cut, inclusive range, literal list, disjunction and a semi-join list."""
    region = t.table("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("team"))
    return (
        t.outings.filter(
            (F.col("season") >= 1997)
            & F.col("share").between(0.2, 0.8)
            & F.col("position").isin("QB", "RB")
            & ((F.col("points") > 20) | (F.col("yards") > 200))
        )
        .dropna(subset=["share"])
        .join(region, "team", "left_semi")
        .select("match_id", "player", "position", "share")
    )


@query(
    "PF-8 PF-15",
    "SELECT doc_id, (contains(text, 'the') OR contains(text, 'der') OR regexp_matches(text, '[0-9]{3}')) AS hit FROM documents",
)
def text_predicates(t: Tables) -> DataFrame:
    """OR over a list of substring and pattern predicates."""
    tests = [F.contains("text", F.lit("the")), F.contains("text", F.lit("der")), F.col("text").rlike("[0-9]{3}")]
    return t.table("documents").select("doc_id", functools.reduce(operator.or_, tests).alias("hit"))


@query(
    "PF-11 A-18",
    """WITH j AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, coalesce(quality, -1) AS quality_or_none, round(coalesce(quality, 0.8 * (SELECT avg(quality) FROM j)), 6) AS quality_scaled FROM j""",
)
def constant_and_mean_fill(t: Tables) -> DataFrame:
    labels = t.table("labels").select("doc_id", F.col("quality").cast("double").alias("quality_scaled"), F.col("quality").alias("quality_or_none"))
    j = t.table("documents").select("doc_id").join(labels, "doc_id", "left").fillna(-1, ["quality_or_none"])
    out = H.fill_with_mean(j, ["quality_scaled"], 0.8)
    return out.withColumn("quality_scaled", F.round("quality_scaled", 6))


@query(
    "PF-13 PF-14 PF-18 PF-19 PF-20",
    views("matches") + """ SELECT match_id, (winner = home)::INT AS home_win, home_points // 7 AS home_tds, (home_points % 7) // 3 AS home_fgs,
      away_points // 7 AS away_tds, (away_points % 7) // 3 AS away_fgs,
      (home_points >= 25)::INT AS over_25, (home_points >= 20)::INT AS over_20, (home_points >= 15)::INT AS over_15, (home_points < 5)::INT AS under_5,
      greatest(CASE WHEN home_points >= 25 THEN 25 END, CASE WHEN home_points >= 20 THEN 20 END, CASE WHEN home_points >= 15 THEN 15 END) AS highest_over
    FROM matches""",
)
def match_targets(t: Tables) -> DataFrame:
    """Home win, scores split into touchdowns and field goals, threshold flags."""

    def split(points: str):
        return F.struct(
            F.floor(F.col(points) / 7).alias("tds"), F.floor((F.col(points) - F.floor(F.col(points) / 7) * 7) / 3).alias("fgs")
        )

    p = F.col("home_points")
    steps = (25, 20, 15)
    return t.matches.select("match_id", "home_points", (F.col("winner") == F.col("home")).cast("int").alias("home_win"),
                            split("home_points").alias("h"), split("away_points").alias("a")).select(
        "match_id", "home_win",
        F.col("h.tds").alias("home_tds"), F.col("h.fgs").alias("home_fgs"),
        F.col("a.tds").alias("away_tds"), F.col("a.fgs").alias("away_fgs"),
        *[(p >= s).cast("int").alias(f"over_{s}") for s in steps],
        (p < 5).cast("int").alias("under_5"),
        F.greatest(*[F.when(p >= s, s) for s in steps]).alias("highest_over"),
    )


@query(
    "PF-17 J-1",
    views("matches", "season_length") + " SELECT match_id, season, week FROM matches JOIN season_length USING (season) WHERE week <= weeks",
)
def regular_season(t: Tables) -> DataFrame:
    """Matches up to the season's regular length."""
    return t.matches.join(t.season_length, "season").filter("week <= weeks").select("match_id", "season", "week")


@query(
    "PF-21",
    views("matches") + """ SELECT match_id, CASE WHEN season = 1996 AND week <= 3 THEN away_points ELSE home_points END AS home_points,
      CASE WHEN season = 1996 AND week <= 3 THEN home_points ELSE away_points END AS away_points FROM matches""",
)
def swapped_scores_repaired(t: Tables) -> DataFrame:
    """Swap both sides' scores for a known range of bad rows."""
    bad = (F.col("season") == 1996) & (F.col("week") <= 3)
    return t.matches.select(
        "match_id",
        F.when(bad, F.col("away_points")).otherwise(F.col("home_points")).alias("home_points"),
        F.when(bad, F.col("home_points")).otherwise(F.col("away_points")).alias("away_points"),
    )


@query(
    "PF-22",
    """SELECT o_orderkey, coalesce(fix.p, o_orderpriority) AS o_orderpriority FROM orders
    LEFT JOIN (SELECT l_orderkey, min(l_shipdate::DATE::VARCHAR) AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 GROUP BY 1) fix
    ON l_orderkey = o_orderkey""",
)
def patched_from_corrections(t: Tables) -> DataFrame:
    """Overwrite a column where a correction row exists."""
    fix = (
        t.table("lineitem").filter("l_returnflag = 'R' AND l_quantity = 50").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min(F.col("l_shipdate").cast("date").cast("string")).alias("o_orderpriority"))
    )
    return J.patch(t.table("orders").select("o_orderkey", "o_orderpriority"), fix, ["o_orderkey"], ["o_orderpriority"])


@query(
    "PF-23 PF-12",
    views("plays") + """, m AS (SELECT match_id, min(num) AS marker FROM plays WHERE kind = 12 GROUP BY 1),
    s AS (SELECT p.match_id, p.num, CASE WHEN p.num >= m.marker THEN lag(p.na) OVER (PARTITION BY p.match_id ORDER BY p.num) ELSE p.na END AS actor,
                 CASE WHEN kind = 15 THEN p.nb END AS carried FROM plays p LEFT JOIN m USING (match_id))
    SELECT match_id, num, actor, last_value(carried IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY num) AS carried FROM s""",
)
def shifted_and_filled(t: Tables) -> DataFrame:
    """Shift a column down from a marker row on, and fill another forward, per match."""
    from tidemark.operators.scan import Fill, Lag, chunked_scan

    plays = t.plays.select("match_id", "num", "kind", "na", F.when(F.col("kind") == 15, F.col("nb")).alias("seen"))
    marker = plays.filter("kind = 12").groupBy("match_id").agg(F.min("num").alias("marker"))
    out = chunked_scan(plays, ["match_id"], F.floor(F.col("num") / 4096), ["num"], [Lag("_before", "na"), Fill("carried", "seen")])
    out = out.join(marker, "match_id", "left")
    return out.select(
        "match_id", "num", F.when(F.col("num") >= F.col("marker"), F.col("_before")).otherwise(F.col("na")).alias("actor"), "carried"
    )


@query(
    "PF-24 PF-26 PF-27 F-28",
    views("starters", "outings") + """, sh AS (SELECT player, team, period, max(share) AS share, max((cents % 97) / 96.0::DOUBLE) AS d FROM outings GROUP BY ALL)
    SELECT s.team, s.period, s.player::VARCHAR AS player, s.position,
      round(CASE WHEN s.position IN ('QB', 'RB', 'WR', 'TE') THEN sh.share ELSE sh.d END, 6) AS role_share, 0 AS constant_flag
    FROM starters s JOIN sh USING (player, team, period) WHERE s.position IN ('QB', 'RB', 'WR', 'OL')""",
)
def spine_from_lineups(t: Tables) -> DataFrame:
    """Target spine: explode line-ups, keep roles, pick the share that fits the role."""
    spine = L.explode(t.lineups).filter(F.col("position").isin("QB", "RB", "WR", "OL"))
    sh = t.outings.groupBy(F.col("player").cast("string").alias("player"), "team", "period").agg(
        F.max("share").alias("off"), F.max((F.col("cents") % 97) / F.lit(96.0)).alias("def")
    )
    role = F.when(F.col("position").isin("QB", "RB", "WR", "TE"), F.col("off")).otherwise(F.col("def"))
    return spine.join(sh, ["player", "team", "period"]).select(
        "team", "period", "player", "position", F.round(role, 6).alias("role_share"), F.lit(0).alias("constant_flag")
    )


@query(
    "PF-28 J-17",
    views("matches", "lineups") + """, lm AS (SELECT team, period, starters, lead(period) OVER (PARTITION BY team ORDER BY period) AS nxt FROM lineups),
    sched AS (SELECT team, period, min(match_id) AS mid FROM (SELECT home AS team, period, match_id FROM matches UNION ALL SELECT away, period, match_id FROM matches) GROUP BY ALL)
    SELECT l.team, l.period, coalesce(s.mid, 'none') AS next_match, starters FROM lm l LEFT JOIN sched s ON s.team = l.team AND s.period = l.nxt""",
)
def lineups_rekeyed_to_next(t: Tables) -> DataFrame:
    """Last line-up under the key of the team's next match."""
    nxt = H.calendar(t.lineups, ["team"])
    sched = t.sides.groupBy("team", F.col("period").alias("next_period")).agg(F.min("match_id").alias("next_match"))
    return (
        t.lineups.select("team", "period", "starters").join(nxt, ["team", "period"]).join(sched, ["team", "next_period"], "left")
        .select("team", "period", F.coalesce("next_match", F.lit("none")).alias("next_match"), "starters")
    )


# --- joins ----------------------------------------------------------------


@query(
    "J-1 J-3",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def chained_inner_joins(t: Tables) -> DataFrame:
    o = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = t.table("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = t.table("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = t.table("region").select("r_regionkey", "r_name")
    return o.join(c, "c_custkey").join(n, "n_nationkey").join(r, "r_regionkey").select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "J-2 J-3 J-5 SL-24",
    views("outings") + """, a AS (SELECT player, count(*) AS games FROM outings GROUP BY 1), b AS (SELECT player, max(points) AS best FROM outings WHERE share > 0.5 GROUP BY 1)
    SELECT c_custkey AS player, coalesce(games, 0) AS games, coalesce(best, -1) AS best, coalesce(first_order, 0) AS first_order FROM customer
    LEFT JOIN a ON player = c_custkey LEFT JOIN b ON b.player = c_custkey
    LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1) f ON o_custkey = c_custkey""",
)
def assembled_with_defaults(t: Tables) -> DataFrame:
    """Left joins folded over a list, one on a dimension with repeated keys."""
    spine = t.table("customer").select(F.col("c_custkey").alias("player"))
    games = t.outings.groupBy("player").agg(F.count(F.lit(1)).alias("games"))
    best = t.outings.filter("share > 0.5").groupBy("player").agg(F.max("points").alias("best"))
    joined = J.join_all(spine, [games, best], ["player"]).fillna(0, ["games"]).fillna(-1, ["best"])
    dim = t.table("orders").select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return J.lookup(joined, dim, ["player"], {"first_order": 0}, order=["o_orderdate", "first_order"])


@query(
    "J-4 J-5",
    views("matches") + """ SELECT match_id, round(h.s_acctbal, 2) AS home_rating, round(a.s_acctbal, 2) AS away_rating FROM matches
      LEFT JOIN supplier h ON h.s_suppkey = home LEFT JOIN supplier a ON a.s_suppkey = away""",
)
def role_playing_join(t: Tables) -> DataFrame:
    """The same dimension for the home and the away side."""
    from tidemark.operators.sides import attach_both

    dim = t.table("supplier").select(F.col("s_suppkey").alias("team"), F.round("s_acctbal", 2).alias("rating"))
    return attach_both(t.matches.select("match_id", "home", "away"), dim, ["rating"], keys=()).drop("home", "away")


@query(
    "J-7",
    views("outings") + """ SELECT s.match_id, s.player, (SELECT arg_max(x.yards, (x.period, x.match_id)) FROM outings x WHERE x.player = s.player AND x.period <= s.period
         AND x.share >= 0.5) AS known_yards FROM outings s""",
)
def exact_else_last_known(t: Tables) -> DataFrame:
    """As-of lookup that prefers the same period."""
    good = t.outings.filter("share >= 0.5").groupBy("player", "period").agg(F.max_by("yards", "match_id").alias("known_yards"))
    out = H.asof(t.outings.select("match_id", "player", "period"), good, ["player"], ["known_yards"], strict=False)
    return out.select("match_id", "player", "known_yards")


@query(
    "J-8 F-14 SL-18",
    views("outings") + """, r AS (SELECT player, season, concat_ws('-', count(*) FILTER (points > 20), count(*) FILTER (points < 20), count(*) FILTER (points = 20)) AS record FROM outings GROUP BY ALL)
    SELECT o.match_id, o.player, r.record, round(coalesce((count_w + count_t) / nullif(count_w + count_l + count_t, 0), 0), 6) AS ratio FROM outings o
    LEFT JOIN (SELECT *, split_part(record, '-', 1)::INT AS count_w, split_part(record, '-', 2)::INT AS count_l, split_part(record, '-', 3)::INT AS count_t FROM r) r
      ON r.player = o.player AND r.season = CASE WHEN o.week = 1 THEN o.season - 1 ELSE o.season END""",
)
def season_offset_join(t: Tables) -> DataFrame:
    """Last season's record in week 1, this season's afterwards."""
    from tidemark.functions.periods import reference_season
    from tidemark.functions.scalars import record_ratio

    p = F.col("points")
    rec = t.outings.groupBy("player", "season").agg(
        F.concat_ws("-", F.count_if(p > 20), F.count_if(p < 20), F.count_if(p == 20)).alias("record")
    )
    targets = t.outings.select("match_id", "player", reference_season(F.col("season"), F.col("week")).alias("season"))
    return targets.join(rec, ["player", "season"], "left").select(
        "match_id", "player", "record", F.round(record_ratio(F.col("record")), 6).alias("ratio")
    )


@query(
    "J-9",
    views("outings") + """, s AS (SELECT team, season, position, arg_min(player, (-n, player)) AS coach FROM (
        SELECT team, season, position, player, count(*) AS n FROM outings WHERE position = 'QB' GROUP BY ALL) GROUP BY ALL)
    SELECT s.team, s.season, s.coach, (p.coach IS NULL OR p.coach <> s.coach)::INT AS is_new FROM s LEFT JOIN s p ON p.team = s.team AND p.season = s.season - 1""",
)
def new_since_last_year(t: Tables) -> DataFrame:
    """Is the leading person of a team another one than in the year before."""
    n = t.outings.filter("position = 'QB'").groupBy("team", "season", "player").agg(F.count(F.lit(1)).alias("n"))
    s = A.argmax_by(n, ["team", "season"], "n", "player", "coach")
    w = Window.partitionBy("team").orderBy("season").rangeBetween(-1, -1)
    before = F.max("coach").over(w)
    return s.withColumn("is_new", (before.isNull() | (before != F.col("coach"))).cast("int"))


@query(
    "J-12 SL-20",
    views("outings", "starters") + """ SELECT o.match_id, o.player, (s.player IS NOT NULL)::INT AS is_starter FROM outings o
      LEFT JOIN starters s ON s.player = o.player AND s.team = o.team AND s.period = o.period""",
)
def listed_in_lineup(t: Tables) -> DataFrame:
    """Membership in a delimited list by exploding it once."""
    return with_listed(t.outings.select("match_id", "player", "team", "period"), t).select("match_id", "player", "is_starter")


def with_listed(rows: DataFrame, t: Tables) -> DataFrame:
    """``rows`` (team, period, player and more) with the flag of the line-up."""
    listed = L.explode(t.lineups).select("team", "period", F.col("player").cast("bigint").alias("player"), F.lit(1).alias("is_starter"))
    out = rows.join(listed, ["team", "period", "player"], "left")
    return out.select(*rows.columns, F.coalesce("is_starter", F.lit(0)).alias("is_starter"))


@query(
    "J-13 J-14 F-30",
    views("players", "plays") + """, k AS (SELECT p_id, lower(regexp_replace(name, '[^A-Za-z]', '', 'g')) AS key, name, team FROM players),
    m AS (SELECT a AS mention FROM plays UNION SELECT b FROM plays UNION SELECT c FROM plays)
    SELECT mention, p_id, CASE WHEN p_id IS NOT NULL THEN true END AS id_fits
    FROM m LEFT JOIN k ON key = lower(regexp_replace(mention, '[^A-Za-z]', '', 'g'))""",
)
def names_to_ids(t: Tables) -> DataFrame:
    """Names in play lines to player ids through normalised names and aliases."""
    mentions = t.plays.select(F.explode(F.array("a", "b", "c")).alias("mention")).distinct()
    players = t.players.select("p_id", "name")
    aliases = players.select("p_id", F.upper("name").alias("aka"))
    out = J.resolve_names(mentions, players, aliases, "mention", [])
    return out.select("mention", "p_id", J.id_fits(F.col("p_id"), F.col("mention")).alias("id_fits"))


_MENTIONS = """, m AS (SELECT match_id, num, 1995 + num % 4 AS year, home, away,
      CASE num % 4 WHEN 0 THEN a WHEN 1 THEN list_last(string_split(a, ' ')) WHEN 2 THEN substr(b, 2, 7) ELSE upper(c) END AS mention FROM plays),
    d AS (SELECT DISTINCT p.p_id, p.name, upper(p.name) AS aka, p.team, o.season AS year FROM players p JOIN outings o ON o.player = p.num WHERE p.position IN ('QB', 'RB', 'WR', 'TE'))"""


@query(
    "J-13 J-14 T-16",
    views("players", "plays", "outings") + _MENTIONS + """, h AS (SELECT match_id, num, p_id, d.team FROM m JOIN d ON d.year = m.year AND d.team IN (m.home, m.away) AND (contains(name, mention) OR contains(aka, mention))),
    u AS (SELECT match_id, num, any_value(p_id) AS p_id, any_value(team) AS team FROM h GROUP BY ALL HAVING count(DISTINCT p_id) = 1)
    SELECT match_id, num, mention, p_id, team FROM m LEFT JOIN u USING (match_id, num)""",
)
def names_in_context(t: Tables) -> DataFrame:
    """Whole and partial names in play lines to the one player of either team in that
    year whose name or alias contains them; missing and ambiguous ones stay null."""
    n = F.col("num")
    partial = (
        F.when(n % 4 == 0, F.col("a")).when(n % 4 == 1, F.element_at(F.split("a", " "), -1)).when(n % 4 == 2, F.substring("b", 2, 7)).otherwise(F.upper("c"))
    )
    mentions = t.plays.select("match_id", "num", (1995 + n % 4).alias("year"), "home", "away", partial.alias("mention"))
    active = t.outings.select(F.col("player").alias("num"), F.col("season").alias("year")).distinct()
    known = t.players.filter(F.col("position").isin("QB", "RB", "WR", "TE")).join(active, "num")
    names = known.select("p_id", "year", "team", F.explode(F.array("name", F.upper("name"))).alias("name"))
    return J.resolve_contained(mentions, names, ["match_id", "num"], "mention", ["year"], ["home", "away"])


@query(
    "J-14",
    views("players") + """, f AS (SELECT split_part(name, ' ', 1) AS given, p_id, num, team, position FROM players),
    m AS (SELECT DISTINCT split_part(name, ' ', 1) AS given, team FROM players)
    SELECT m.given, m.team, (SELECT arg_max(f.p_id, (CASE WHEN f.team = m.team THEN 2 WHEN f.team = (m.team + 1) % 25 THEN 1 ELSE 0 END, -f.num))
       FROM f WHERE f.given = m.given AND f.team IN (m.team, (m.team + 1) % 25)) AS p_id FROM m""",
)
def ambiguous_names(t: Tables) -> DataFrame:
    """Many hits for a given name: prefer the own team, then the opponent's."""
    f = t.players.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("given"), "p_id", "num", "team")
    mentions = f.select("given", "team").distinct()
    # Candidates meet on (name, team): own team and opponent, never every namesake.
    wanted = mentions.select("given", F.col("team").alias("of"), F.inline(F.array(
        F.struct(F.col("team").alias("team"), F.lit(2).alias("score")), F.struct(((F.col("team") + 1) % 25).alias("team"), F.lit(1).alias("score")))))
    first = J.unique_by(f, ["given", "team"], ["num"])
    hits = wanted.join(first, ["given", "team"])
    return J.prefer(hits, ["given", "of"], F.col("score"), ["num"]).select("given", F.col("of").alias("team"), "p_id")


@query(
    "J-15 PF-7 S-3",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def unseen_keys(t: Tables) -> DataFrame:
    urgent = t.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.table("customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query(
    "J-17",
    views("matches") + """, props AS (SELECT o_orderkey AS prop, year(o_orderdate) * 100 + month(o_orderdate) AS period, o_custkey % (SELECT count(*) FROM supplier) AS team,
         (o_custkey * 7 + 1) % (SELECT count(*) FROM supplier) AS opp FROM orders),
    anyside AS (SELECT team, period, min(match_id) AS mid FROM (SELECT home AS team, period, match_id FROM matches UNION ALL SELECT away, period, match_id FROM matches) GROUP BY ALL)
    SELECT prop, coalesce(m.match_id, s1.mid, s2.mid) AS match_id FROM props p
    LEFT JOIN matches m ON m.home = p.team AND m.away = p.opp AND m.period = p.period
    LEFT JOIN anyside s1 ON s1.team = p.team AND s1.period = p.period LEFT JOIN anyside s2 ON s2.team = p.opp AND s2.period = p.period""",
)
def repaired_matchups(t: Tables) -> DataFrame:
    """Exact match-up if there is one, else the period's first match of either side."""
    n = t.table("supplier").agg(F.count(F.lit(1))).scalar()
    props = t.table("orders").select(
        F.col("o_orderkey").alias("prop"),
        (F.year("o_orderdate").cast("bigint") * 100 + F.month("o_orderdate")).alias("period"),
        (F.col("o_custkey") % n).alias("team"), ((F.col("o_custkey") * 7 + 1) % n).alias("opp"),
    )
    exact = t.matches.select("period", F.col("home").alias("team"), F.col("away").alias("opp"), "match_id")
    side = t.sides.groupBy("team", "period").agg(F.min("match_id").alias("mid"))
    other = side.select(F.col("team").alias("opp"), "period", F.col("mid").alias("mid2"))
    return (
        props.join(exact, ["period", "team", "opp"], "left").join(side, ["team", "period"], "left").join(other, ["opp", "period"], "left")
        .select("prop", F.coalesce("match_id", "mid", "mid2").alias("match_id"))
    )


@query(
    "J-18 A-1 T-17",
    views("plays") + """ SELECT match_id, round(avg(hundredths / 100.0) FILTER (num % 2 = 0), 6) AS home_value, round(avg(hundredths / 100.0) FILTER (num % 2 = 1), 6) AS away_value FROM plays GROUP BY 1""",
)
def paired_side_means(t: Tables) -> DataFrame:
    """Mean value added per match for each side, as home and away columns."""
    v = F.col("hundredths") / 100.0
    return t.plays.groupBy("match_id").agg(
        F.round(F.avg(F.when(F.col("num") % 2 == 0, v)), 6).alias("home_value"),
        F.round(F.avg(F.when(F.col("num") % 2 == 1, v)), 6).alias("away_value"),
    )


@query(
    "J-21 A-27",
    views("outings") + """, own AS (SELECT player, arg_min(opp, (-n, opp)) AS team FROM (SELECT player, opp, count(*) AS n FROM outings WHERE share > 0.9 GROUP BY ALL) GROUP BY 1),
    second AS (SELECT player, arg_min(opp, (-n, opp)) AS team FROM (SELECT player, opp, count(*) AS n FROM outings WHERE share > 0.6 GROUP BY ALL) GROUP BY 1)
    SELECT c_custkey AS player, coalesce(own.team, second.team, c_nationkey) AS team FROM customer LEFT JOIN own ON own.player = c_custkey LEFT JOIN second ON second.player = c_custkey""",
)
def backfilled_team(t: Tables) -> DataFrame:
    """Most common team, else the one of a wider source, else the master record."""
    own = A.mode_by(t.outings.filter("share > 0.9"), ["player"], "opp", "team")
    second = A.mode_by(t.outings.filter("share > 0.6"), ["player"], "opp", "team")
    base = t.table("customer").select(F.col("c_custkey").alias("player"), F.col("c_nationkey").cast("bigint").alias("home_team"))
    out = base.select("player", F.lit(None).cast("bigint").alias("team"))
    dims = [(own, ["player"]), (second, ["player"]), (base.select("player", F.col("home_team").alias("team")), ["player"])]
    return J.backfill(out, dims, "team")


# --- aggregates -----------------------------------------------------------


@query("A-2", views("outings") + """, i AS (SELECT team, season, is_home, avg(points) AS m FROM outings GROUP BY ALL)
    SELECT team, season, round(avg(m), 6) AS points_mean FROM i GROUP BY ALL""")
def team_mean_of_role_means(t: Tables) -> DataFrame:
    out = A.mean_of_means(t.outings, ["team", "season"], "is_home", "points", "points_mean")
    return out.withColumn("points_mean", F.round("points_mean", 6))


@query(
    "A-3 A-4 A-25",
    views("outings") + """ SELECT player, season, sum(points)::BIGINT AS points, round(sum(CASE WHEN share > 0.5 THEN yards ELSE 0 END) / count(*), 6) AS yards_per_row,
      count(*) FILTER (yards > 300) AS over_300, count(*) FILTER (tds >= 3) AS multi_td FROM outings GROUP BY ALL HAVING sum(points) > 2""",
)
def player_totals(t: Tables) -> DataFrame:
    """Season totals, null-as-zero means and conditional counts."""
    half = F.when(F.col("share") > 0.5, F.col("yards"))
    return t.outings.groupBy("player", "season").agg(
        F.sum("points").alias("points"),
        F.round(F.sum(F.coalesce(half, F.lit(0))) / F.count(F.lit(1)), 6).alias("yards_per_row"),
        F.count_if(F.col("yards") > 300).alias("over_300"),
        F.count_if(F.col("tds") >= 3).alias("multi_td"),
    ).filter("points > 2")


@query(
    "A-5 SL-23",
    views("outings") + """ SELECT match_id, team, period, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE attempts / nullif(sum(attempts) OVER w, 0) END, 6) AS volume
      FROM outings WINDOW w AS (PARTITION BY team, period, position)""",
)
def volume_shares(t: Tables) -> DataFrame:
    out = A.shares(t.outings.select("match_id", "team", "period", "position", "attempts"), ["team", "period", "position"], "attempts", "volume")
    return out.select("match_id", "team", "period", F.round("volume", 6).alias("volume"))


@query(
    "A-6",
    views("outings") + """, v AS (SELECT team, period, attempts / nullif(sum(attempts) OVER (PARTITION BY team, period), 0) AS share FROM outings WHERE position = 'QB')
    SELECT team, period, (count(*) FILTER (share > 0.3) > 1)::INT AS split_game FROM v GROUP BY ALL""",
)
def split_games(t: Tables) -> DataFrame:
    """More than one passer above three tenths of the attempts."""
    qb = t.outings.filter("position = 'QB'").select("team", "period", "attempts")
    out = A.shares(qb, ["team", "period"], "attempts", "s")
    # A lone passer has the whole volume, also when it is zero.
    return out.groupBy("team", "period").agg((F.count_if(F.col("s") > 0.3) > 1).cast("int").alias("split_game"))


@query(
    "A-7 A-8",
    views("outings") + """, g AS (SELECT team, season, position, player, sum(points) AS s FROM outings GROUP BY ALL)
    SELECT team, season, position, arg_min(player, (-s, player)) AS primary_player, max(s)::BIGINT AS points FROM g GROUP BY ALL""",
)
def primary_players(t: Tables) -> DataFrame:
    """Player with the most points per team, season and role."""
    g = t.outings.groupBy("team", "season", "position", "player").agg(F.sum("points").alias("s"))
    return g.groupBy("team", "season", "position").agg(
        F.min_by("player", F.struct((-F.col("s")).alias("s"), F.col("player").alias("p"))).alias("primary_player"),
        F.max("s").alias("points"),
    )


@query(
    "A-7 J-12",
    views("outings") + """, pt AS (SELECT player, team, position, season, period, sum(points) AS p FROM outings GROUP BY ALL),
    c AS (SELECT k.player, k.team, k.position, k.period, coalesce(sum(x.p), 0) AS s FROM (SELECT DISTINCT player, team, position, season, period FROM outings) k
          LEFT JOIN pt x ON x.player = k.player AND x.season = k.season AND x.period < k.period GROUP BY ALL)
    SELECT player, team, period, (row_number() OVER (PARTITION BY team, position, period ORDER BY s DESC, player) = 1)::INT AS is_primary FROM c""",
)
def primary_so_far(t: Tables) -> DataFrame:
    """Leader of the season so far among the period's players of a team and role."""
    keys = t.outings.select("player", "team", "position", "season", "period").distinct()
    s = H.to_date(keys, t.outings, ["player", "season"], {"s": F.col("points")}, in_history=True).fillna(0, ["s"])
    lead = A.argmax_by(s, ["team", "position", "period"], "s", "player", "leader")
    return s.join(lead, ["team", "position", "period"]).select(
        "player", "team", "period", (F.col("player") == F.col("leader")).cast("int").alias("is_primary")
    )


@query(
    "A-9 A-10 A-31 SL-15",
    views("outings") + """, c AS (SELECT player, opp, count(*) AS n, min(match_id) AS f FROM outings GROUP BY ALL)
    SELECT player, arg_min(opp, (-n, opp)) AS mode_opp, arg_max(opp, (f, opp)) AS newest_opp FROM c GROUP BY 1""",
)
def modes(t: Tables) -> DataFrame:
    """The mode, and the value whose first occurrence comes last."""
    mode = A.mode_by(t.outings, ["player"], "opp", "mode_opp")
    newest = A.latest_first_seen(t.outings, ["player"], "opp", "match_id", "newest_opp")
    return mode.join(newest, "player")


@query(
    "A-11 J-5",
    views("starters") + ", r AS (SELECT s.*, c_acctbal AS rating FROM starters s JOIN customer ON c_custkey = player) SELECT team, period, "
    + ", ".join(f"round({a}(rating) FILTER (position = '{r}'), 4) AS {r.lower()}_{a}" for r in ROLE_NAMES for a in ("avg", "min", "max")) + " FROM r GROUP BY ALL",
)
def lineup_ratings_by_role(t: Tables) -> DataFrame:
    """avg, min and max rating per role inside a line-up."""
    ratings = t.table("customer").select(F.col("c_custkey").cast("string").alias("player"), F.col("c_acctbal").alias("rating"))
    entries = L.explode(t.lineups).join(ratings, "player")
    out = L.by_role(entries, ["team", "period"], "rating", ROLE_NAMES)
    return out.select("team", "period", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query(
    "A-12 H-26",
    views("starters", "outings") + """, pm AS (SELECT s.team, s.period, s.position, (SELECT avg(share) FROM outings o WHERE o.player = s.player AND o.period < s.period) AS m FROM starters s)
    SELECT team, period, """ + ", ".join(f"round(avg(m) FILTER (position = '{r}'), 9) AS {r.lower()}_avg" for r in ROLE_NAMES) + " FROM pm GROUP BY ALL",
)
def lineup_share_means_by_role(t: Tables) -> DataFrame:
    """Mean per role of the starters' own earlier means."""
    entries = t.starters.select("team", "period", "position", "player")
    known = H.to_date(entries, t.outings, ["player"], {"s": F.col("share")}, in_history=True).withColumn("m", F.col("s") / F.col("n"))
    out = L.by_role(known, ["team", "period"], "m", ROLE_NAMES, ("avg",))
    return out.select("team", "period", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@query(
    "H-26 J-6",
    views("starters", "outings") + """, g AS (SELECT player, period, count(*) AS n FROM outings GROUP BY ALL),
    pm AS (SELECT s.team, s.period, s.position, coalesce((SELECT sum(n) FROM g WHERE g.player = s.player AND g.period < s.period), 0) AS m FROM starters s)
    SELECT team, period, """ + ", ".join(f"round(avg(m) FILTER (position = '{r}'), 6) AS {r.lower()}_avg" for r in ROLE_NAMES) + " FROM pm GROUP BY ALL",
)
def lineup_experience_by_role(t: Tables) -> DataFrame:
    """As-of games played, averaged over the line-up by role."""
    entries = t.starters.select("team", "period", "position", "player")
    known = H.to_date(entries, t.outings, ["player"], {}, in_history=True).fillna(0, ["n"])
    out = L.by_role(known, ["team", "period"], "n", ROLE_NAMES, ("avg",))
    return out.select("team", "period", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(
    "A-13 A-28 A-29 S-4",
    views("outings") + """ SELECT team, season, player // 10000 AS page, string_agg(player, '|' ORDER BY player) AS players
      FROM (SELECT DISTINCT team, season, player FROM outings) GROUP BY ALL""",
)
def season_rosters(t: Tables) -> DataFrame:
    """Distinct players per team and season as delimited pages."""
    return L.paged_list(t.outings, ["team", "season"], "player")


@query(
    "A-14 A-15",
    views("outings") + """, m AS (SELECT player, season, 'm' || (match_id % 4) AS market, max(yards) AS line FROM outings GROUP BY ALL)
    SELECT player, season, """ + ", ".join(f"max(line) FILTER (market = 'm{i}') AS m{i}" for i in range(4)) + " FROM m GROUP BY ALL",
)
def markets_wide(t: Tables) -> DataFrame:
    m = t.outings.groupBy("player", "season", F.concat(F.lit("m"), (F.col("match_id") % 4).cast("string")).alias("market")).agg(F.max("yards").alias("line"))
    return A.wide(m, ["player", "season"], "market", "line", [f"m{i}" for i in range(4)])


@query(
    "A-14",
    views("outings") + """, m AS (SELECT season, CASE WHEN match_id % 100003 = 5 THEN 'rare' ELSE 'm' || (match_id % 3) END AS market, max(yards) AS line FROM outings GROUP BY ALL)
    SELECT season, """ + ", ".join(f"max(line) FILTER (market = 'm{i}') AS m{i}" for i in range(3)) + " FROM m GROUP BY ALL",
)
def dense_markets_wide(t: Tables) -> DataFrame:
    """Markets in columns; the one that most seasons lack goes."""
    market = F.when(F.col("match_id") % 100003 == 5, "rare").otherwise(F.concat(F.lit("m"), (F.col("match_id") % 3).cast("string")))
    m = t.outings.groupBy("season", market.alias("market")).agg(F.max("yards").alias("line"))
    return A.wide(m, ["season"], "market", "line", ["m0", "m1", "m2", "rare"], max_null=0.1)


@query(
    "A-15",
    views("matches") + """ SELECT match_id, 'home_points' AS stat, home_points AS value FROM matches UNION ALL SELECT match_id, 'away_points', away_points FROM matches""",
)
def melted_points(t: Tables) -> DataFrame:
    return t.matches.select("match_id", "home_points", "away_points").unpivot("match_id", ["home_points", "away_points"], "stat", "value")


@query(
    "A-16 A-17",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL",
)
def frequency_table(t: Tables) -> DataFrame:
    # Distinct triples first: the second level counts rows.
    li = t.table("lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("suppliers"))


_M = ["home_points", "away_points", "home_yards", "away_yards"]


@query(
    "A-19 A-20",
    views("matches") + """, v AS (SELECT match_id, home, away, (home_points > away_points)::INT AS m1, (home_yards > away_yards)::INT AS m2, (home_attempts > away_attempts)::INT AS m3,
       (home_points + home_yards + home_attempts) / 3.0 AS mean3 FROM matches)
    SELECT match_id, round(mean3, 6) AS mean3, (2 * (m1 + m2 + m3) > 3)::INT AS vote, round(100.0 * greatest(m1 + m2 + m3, 3 - m1 - m2 - m3) / 3, 2) AS agreement,
      CASE WHEN 2 * (m1 + m2 + m3) > 3 THEN home ELSE away END AS winner FROM v""",
)
def consensus(t: Tables) -> DataFrame:
    """Row-wise vote of several models, agreement in percent and the winning side."""
    base = t.matches.select(
        "match_id", "home", "away",
        A.row_mean(["home_points", "home_yards", "home_attempts"]).alias("mean3"),
        *[(F.col(f"home_{s}") > F.col(f"away_{s}")).cast("int").alias(m) for m, s in (("m1", "points"), ("m2", "yards"), ("m3", "attempts"))],
    )
    vote, agreement = A.votes(["m1", "m2", "m3"])
    return base.select(
        "match_id", F.round("mean3", 6).alias("mean3"), vote.alias("vote"), agreement.alias("agreement"),
        F.when(vote == 1, F.col("home")).otherwise(F.col("away")).alias("winner"),
    )


@query(
    "A-21",
    views("matches") + """, v AS (SELECT (home_points > away_points)::INT AS label, (home_yards > away_yards)::INT AS m2, (home_attempts > away_attempts)::INT AS m3 FROM matches)
    SELECT 'm2' AS model, round(avg((m2 = label)::INT), 6) AS accuracy FROM v UNION ALL SELECT 'm3', round(avg((m3 = label)::INT), 6) FROM v""",
)
def model_accuracy(t: Tables) -> DataFrame:
    v = t.matches.select(
        *[(F.col(f"home_{s}") > F.col(f"away_{s}")).cast("int").alias(m) for m, s in (("label", "points"), ("m2", "yards"), ("m3", "attempts"))]
    )
    return A.accuracy(v, "label", ["m2", "m3"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "A-22 R-7",
    views("outings") + """, g AS (SELECT tds AS tier, team, period, count(*) AS size, min(points) AS lo, max(points) AS hi, """ + ", ".join(f"count(*) FILTER (position = '{r}') AS {r.lower()}" for r in TIER_ROLES) + """ FROM outings GROUP BY ALL),
    md AS (SELECT tier, arg_min(size, (-c, size)) AS modal_size FROM (SELECT tier, size, count(*) AS c FROM g GROUP BY ALL) GROUP BY 1)
    SELECT g.tier, any_value(modal_size) AS modal_size, min(lo) AS lowest, floor(avg(hi))::BIGINT AS mean_top, """ + ", ".join(f"{f}({r}) AS {r}_{f}" for r in map(str.lower, TIER_ROLES) for f in ("min", "max"))
    + " FROM g JOIN md ON md.tier = g.tier GROUP BY 1",
)
def tier_statistics(t: Tables) -> DataFrame:
    """Modal size, lowest low, mean of the tops and role counts per tier."""
    g = t.outings.groupBy(F.col("tds").alias("tier"), "team", "period").agg(
        F.count(F.lit(1)).alias("size"), F.min("points").alias("lo"), F.max("points").alias("hi"),
        *[F.count_if(F.col("position") == r).alias(r.lower()) for r in TIER_ROLES],
    )
    stats = g.groupBy("tier").agg(
        F.min("lo").alias("lowest"), F.floor(F.avg("hi")).alias("mean_top"),
        *[f(r).alias(f"{r}_{f.__name__}") for r in map(str.lower, TIER_ROLES) for f in (F.min, F.max)],
    )
    return stats.join(A.mode_by(g, ["tier"], "size", "modal_size"), "tier")


@query(
    "A-24",
    views("plays") + """ SELECT match_id, p AS player, round(avg(hundredths), 4) AS mean_value FROM (
      SELECT DISTINCT match_id, num, hundredths, unnest([na, nb, nc]) AS p FROM plays) GROUP BY ALL""",
)
def involvement_means(t: Tables) -> DataFrame:
    """Mean value over the plays a player is involved in."""
    actors = F.array_distinct(F.array("na", "nb", "nc"))
    rows = t.plays.select("match_id", "hundredths", F.explode(actors).alias("player"))
    return rows.groupBy("match_id", "player").agg(F.round(F.avg("hundredths"), 4).alias("mean_value"))


@query(
    "A-26",
    views("outings", "starters") + """, s AS (SELECT team, period, avg(yards) FILTER (position = 'QB') AS pass_mean, avg(yards) FILTER (position = 'RB' AND yards <> 0) AS rush_mean FROM outings GROUP BY ALL)
    SELECT st.team, st.period, st.player, round(pass_mean, 6) AS pass_mean, round(rush_mean, 6) AS rush_mean FROM starters st JOIN s ON s.team = st.team AND s.period = st.period WHERE position = 'OL'""",
)
def line_starters_share_stats(t: Tables) -> DataFrame:
    """Team figures handed to every line starter."""
    qb, rb = F.col("position") == "QB", (F.col("position") == "RB") & (F.col("yards") != 0)
    s = t.outings.groupBy("team", "period").agg(
        F.round(F.avg(F.when(qb, F.col("yards"))), 6).alias("pass_mean"), F.round(F.avg(F.when(rb, F.col("yards"))), 6).alias("rush_mean")
    )
    return t.starters.filter("position = 'OL'").select("team", "period", "player").join(s, ["team", "period"])


@query(
    "A-30 PF-11",
    views("outings") + """, r AS (SELECT DISTINCT team, season, player FROM outings),
    j AS (SELECT r.*, CASE WHEN season >= 1998 THEN CASE WHEN c_acctbal > 0 THEN c_acctbal END ELSE CASE WHEN c_acctbal > 5000 THEN c_acctbal END END AS v FROM r JOIN customer ON c_custkey = player)
    SELECT team, season, player, round(coalesce(v, (SELECT avg(v) FROM j)), 4) AS rating FROM j""",
)
def roster_ratings(t: Tables) -> DataFrame:
    """Season roster with a rating whose source depends on the year; gaps take the mean."""
    roster = t.outings.select("team", "season", "player").distinct()
    c = t.table("customer").select(F.col("c_custkey").alias("player"), F.col("c_acctbal").alias("v"))
    late = c.filter("v > 0").withColumnRenamed("v", "late")
    early = c.filter("v > 5000").withColumnRenamed("v", "early")
    j = J.join_all(roster, [late, early], ["player"])
    j = j.select("team", "season", "player", F.when(F.col("season") >= 1998, F.col("late")).otherwise(F.col("early")).alias("rating"))
    return H.fill_with_mean(j, ["rating"]).withColumn("rating", F.round("rating", 4))


# --- ranking --------------------------------------------------------------


@query(
    "R-1 R-2 R-3 SL-8",
    views("outings") + """ SELECT match_id, row_number() OVER (PARTITION BY period, position ORDER BY cents DESC, match_id) - 1 AS week_rank,
      count(*) OVER (PARTITION BY period, position) - 1 AS max_rank FROM outings""",
)
def week_ranks(t: Tables) -> DataFrame:
    """0-based rank per period and role, and the group's largest rank."""
    o = t.outings.select("match_id", "period", "position", "cents")
    r = ranked(o, ["period", "position"], "cents", "week_rank", tiebreak=["match_id"], base=0, width=1_000_000)
    top = o.groupBy("period", "position").agg((F.count(F.lit(1)) - 1).alias("max_rank"))
    return r.join(top, ["period", "position"]).select("match_id", "week_rank", "max_rank")


@query(
    "R-4",
    views("outings") + " SELECT match_id, rank() OVER (PARTITION BY period ORDER BY points DESC) AS min_rank, dense_rank() OVER (PARTITION BY period ORDER BY points DESC) AS dense FROM outings",
)
def tied_ranks(t: Tables) -> DataFrame:
    """Min and dense ranks with ties."""
    o = t.outings.select("match_id", "period", "points")
    r = ranked(o, ["period"], "points", "min_rank", method="rank", width=5)
    return ranked(r, ["period"], "points", "dense", method="dense_rank", width=5).select("match_id", "min_rank", "dense")


@query(
    "R-5",
    views("sides") + """, s AS (SELECT team, season, avg(for_points) AS f, avg(opp_points) AS a FROM sides GROUP BY ALL)
    SELECT team, season, row_number() OVER (PARTITION BY season ORDER BY f DESC, team) AS for_rank, row_number() OVER (PARTITION BY season ORDER BY a, team) AS against_rank FROM s""",
)
def season_team_ranks(t: Tables) -> DataFrame:
    s = t.sides.groupBy("team", "season").agg(F.avg("for_points").alias("f"), F.avg("opp_points").alias("a"))
    s = ranked(s, ["season"], "f", "for_rank", tiebreak=["team"], width=1)
    return ranked(s, ["season"], "a", "against_rank", tiebreak=["team"], descending=False, width=1).select("team", "season", "for_rank", "against_rank")


@query(
    "R-6 R-8 F-20",
    views("outings") + """, s AS (SELECT player, position, season, sum(points) AS p FROM outings GROUP BY ALL)
    SELECT player, season, row_number() OVER (PARTITION BY season ORDER BY p DESC, player) AS all_rank,
      row_number() OVER (PARTITION BY season, position ORDER BY p DESC, player) AS role_rank,
      row_number() OVER (PARTITION BY season, position IN ('RB', 'WR', 'TE') ORDER BY p DESC, player) AS flex_rank FROM s""",
)
def pool_ranks(t: Tables) -> DataFrame:
    """Ranks inside all players, the role and the flex pool."""
    s = t.outings.groupBy("player", "position", "season").agg(F.sum("points").alias("p"))
    s = s.withColumn("flex", F.col("position").isin("RB", "WR", "TE"))
    pools = {"all_rank": ["season"], "role_rank": ["season", "position"], "flex_rank": ["season", "flex"]}
    s = ranked_in(stored(s), pools, "p", ["player"], ["player", "season", "position"], width=8)
    return s.select("player", "season", "all_rank", "role_rank", "flex_rank")


@query(
    "R-9",
    views("outings") + " SELECT team, season, match_id, cents FROM outings QUALIFY row_number() OVER (PARTITION BY team, season ORDER BY cents DESC, match_id) <= 3",
)
def top_three_per_group(t: Tables) -> DataFrame:
    return top_k(t.outings.select("team", "season", "match_id", "cents"), ["team", "season"], [F.desc("cents"), F.asc("match_id")], 3)


@query("R-8 R-9", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(t: Tables) -> DataFrame:
    return t.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "R-11 A-13",
    views("outings", "starters") + """, g AS (SELECT team, season, period, player, sum(points) AS s, count(*) AS n FROM outings GROUP BY ALL),
    st AS (SELECT team, period, player, count(*) AS c FROM starters GROUP BY ALL),
    p AS (SELECT DISTINCT season, period FROM outings),
    k AS (SELECT p.season, p.period, g.team, g.player, (sum(s) / sum(n))::DOUBLE AS m, sum(coalesce(c, 0)) AS starts FROM p JOIN g ON g.season = p.season AND g.period < p.period
        LEFT JOIN st ON st.team = g.team AND st.period = g.period AND st.player = g.player GROUP BY ALL)
    SELECT team, season, period, player, row_number() OVER (PARTITION BY team, season, period ORDER BY m - CASE WHEN starts = 0 THEN 3 ELSE 0 END DESC, player) AS seat FROM k""",
)
def depth_chart(t: Tables) -> DataFrame:
    """A chart per team and period from the season's earlier games: all players by mean
    grade, those who never started minus three, one row per seat."""
    who = ["team", "player"]
    games = H.period_totals(t.outings, [*who, "season"], {"s": F.col("points")})
    starts = t.starters.groupBy(*who, "period").agg(F.count(F.lit(1)).alias("starts"))
    games = games.join(starts, [*who, "period"], "left").withColumn("starts", F.coalesce("starts", F.lit(0)))
    state = H.running_totals(games, [*who, "season"], ["n", "s", "starts"])
    every = carry_forward(state, who, ["n", "s", "starts"])
    known = H.before(every, [*who, "season"], ["n", "s", "starts"]).filter("n IS NOT NULL")
    grade = F.col("s") / F.col("n") - F.when(F.col("starts") == 0, 3).otherwise(0)
    charts = known.select("team", "season", "period", "player", grade.alias("grade"))
    return ranked(charts, ["team", "season", "period"], "grade", "seat", tiebreak=["player"]).drop("grade")


@query(
    "R-12",
    views("starters", "outings") + """, l AS (SELECT team, period, player, position FROM starters WHERE slot <= 4),
    ld AS (SELECT team, period, player, position, sum(points) AS score FROM outings GROUP BY ALL),
    have AS (SELECT team, period, position, count(*) AS have FROM l GROUP BY ALL),
    free AS (SELECT ld.*, row_number() OVER (PARTITION BY team, period, position ORDER BY score DESC, player) AS seat FROM ld ANTI JOIN l USING (team, period, player)
             WHERE position IN ('QB', 'RB', 'WR'))
    SELECT team, period, player, position, false AS added FROM l
    UNION ALL SELECT f.team, f.period, f.player, f.position, true FROM free f LEFT JOIN have h ON h.team = f.team AND h.period = f.period AND h.position = f.position
    WHERE seat <= CASE f.position WHEN 'QB' THEN 1 WHEN 'RB' THEN 2 ELSE 3 END - coalesce(have, 0)""",
)
def filled_lineups(t: Tables) -> DataFrame:
    """Complete line-ups per role from the leaders that are not listed."""
    listed = t.starters.filter("slot <= 4").select("team", "period", "player", "position")
    leaders = t.outings.groupBy("team", "period", "player", "position").agg(F.sum("points").alias("score"))
    return L.fill_slots(listed, leaders, ["team", "period"], {"QB": 1, "RB": 2, "WR": 3})


@query("R-13", "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('-', o_orderkey, 7)), o_orderkey LIMIT 100")
def seeded_sample(t: Tables) -> DataFrame:
    """A reproducible sample of fixed size."""
    return t.table("orders").select("o_orderkey").orderBy(hash_order(["o_orderkey"], 7), "o_orderkey").limit(100)


# --- sets -----------------------------------------------------------------


@query(
    "S-1 S-2 S-3",
    """SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier""",
)
def union_distinct_keys(t: Tables) -> DataFrame:
    c = t.table("customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    s = t.table("supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return S.union_distinct(c, s)


@query("S-3", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def key_difference(t: Tables) -> DataFrame:
    c = t.table("customer").select(F.col("c_nationkey").alias("nation")).distinct()
    return c.join(t.table("supplier").select(F.col("s_nationkey").alias("nation")), "nation", "left_anti")


@query(
    "S-4",
    views("starters", "outings") + """ SELECT team, period, player // 10000 AS page, string_agg(player, '|' ORDER BY player) AS players FROM (
      SELECT team, period, player FROM starters UNION SELECT team, period, player FROM outings) GROUP BY ALL""",
)
def lineup_and_everyone_seen(t: Tables) -> DataFrame:
    """Line-up plus everyone who recorded a figure."""
    both = t.starters.select("team", "period", "player").union(t.outings.select("team", "period", "player"))
    return L.paged_list(both, ["team", "period"], "player")


@query(
    "S-5 ST-5",
    views("outings") + """ SELECT player, season, 0 AS fresh, sum(points)::BIGINT AS points FROM outings WHERE season < 2001 GROUP BY ALL
      UNION ALL SELECT player, season, 1, sum(yards)::BIGINT FROM outings WHERE season >= 2001 GROUP BY ALL""",
)
def season_replaced(t: Tables) -> DataFrame:
    """A new batch takes the place of the stored rows of its seasons."""
    stored = t.outings.groupBy("player", "season").agg(F.sum("points").alias("points")).withColumn("fresh", F.lit(0))
    batch = t.outings.filter("season >= 2001").groupBy("player", "season").agg(F.sum("yards").alias("points")).withColumn("fresh", F.lit(1))
    return S.replace_keys(stored, batch, ["season"])


@query(
    "S-6 T-16",
    views("plays") + """ SELECT DISTINCT match_id, na AS player, array_to_string(list_sort(list_intersect([na % 32, (na + 7) % 32], [home, away])), '|') AS teams FROM plays""",
)
def possible_teams(t: Tables) -> DataFrame:
    """A player's teams that play in the match."""
    return t.plays.select("match_id", F.col("na").alias("player"), "home", "away").distinct().select(
        "match_id", "player", F.array_join(F.array_sort(F.array_intersect(F.array(F.col("player") % 32, (F.col("player") + 7) % 32), F.array("home", "away"))).cast("array<string>"), "|").alias("teams")
    )
