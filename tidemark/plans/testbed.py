"""The given tables in the roles of matches, outings, line-ups and plays.

Each view exists twice: as a DataFrame (``Tables``) and as a SQL text for the
oracle (``views``).  Figures are integers so that sums are exact in any order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import newest
from tidemark.operators.sides import sides
from tidemark.session import stored

MATCH_STATS = ("points", "yards", "attempts", "turnovers")

# Segment to role, given names of the derived players.
ROLES = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "TE", "MACHINERY": "OL"}
GIVEN = "Aaron Blake Chris Devon Eric Frank Grant Henry Isaac Jalen Kevin Lucas Tam-O Ve'Lor RoRo KZ".split()
# Forms of the last name in turn: what stands before and after it.
FORMS = [("", ""), ("", " III"), ("Van ", ""), ("Bo ", "-Vale"), ("", " Jr")]

LINEUP_SIZE = 22
CHUNK_ROWS = 65536

# One line per kind of play; a, b, c are names, y and z yards, tl a team code, tn a number.
PLAY_LINES = (
    "{a} pass complete short left to {b} for {y} yards (tackle by {c})",
    "{a} pass incomplete deep right intended for {b}",
    "{a} pass deep left intended for {b} is intercepted by {c} and returned for {y} yards, touchdown",
    "{a} left guard for {y} yards (tackle by {c})",
    "{a} up the middle for {z} yards, touchdown",
    "{a} sacked by {b} for -{z} yards",
    "{a} punts {y} yards, fair catch by {b}",
    "{a} kicks off {y} yards, returned by {b} for {z} yards (tackle by {c})",
    "{a} {y} yard field goal good",
    "{a} pass complete short right to {b} for {y} yards. Penalty on {c}: Defensive Holding, {z} yards (accepted) (no play)",
    "{a} right end for {y} yards. Penalty on {b}: Offside, 5 yards (declined), Penalty on {c}: Holding, 10 yards",
    "{a} right end for {y} yards. {tl} challenged the spot ruling, and the original play was overturned. {a} right end for {z} yards",
    "Timeout #{tn} by {tl}",
    "{a} kicks extra point good",
    "{a} kneels for -1 yards",
    "{tl} won the coin toss and deferred, {a} to kick off",
    "{a} pass complete short left to {b} for {y} yards. {b} fumbles (forced by {c}), recovered by {a}",
    "{a} pass complete short right to {b} for {y} yards, lateral to {c} for {z} yards",
    "{a} punts blocked by {b}, recovered by {c} and returned for {z} yards, touchdown",
    "{a} kicks off {y} yards, returned by {b} for {z} yards, touchdown",
    "{a} left tackle for {y} yards. Penalty on {a}: Holding, 10 yards (declined), Penalty on {b}: Offside, 5 yards (declined), Penalty on {c}: Illegal Contact, 5 yards",
    "{a} right guard for {y} yards. Penalty on {a}: Holding, 10 yards, Penalty on {b}: Offside, 5 yards, Penalty on {c}: Illegal Contact, {z} yards, Penalty on {b}: Taunting, 15 yards",
)
# Filled in by replacement: a CASE over finished lines would not fit one generated method.
PLAY_TEXT = "CASE kind " + " ".join(f"WHEN {i} THEN '{line}'" for i, line in enumerate(PLAY_LINES)) + " END"
for _slot in ("a", "b", "c", "y", "z", "tl", "tn"):
    PLAY_TEXT = f"replace({PLAY_TEXT}, '{{{_slot}}}', {_slot})"

# Roles of a, b, c per kind of play.
PLAY_ROLES = """
CASE
 WHEN kind IN (0, 1, 9) THEN 'PASSER,RECEIVER,TACKLER'
 WHEN kind = 2 THEN 'PASSER,RECEIVER,INTERCEPTOR'
 WHEN kind IN (3, 4, 10, 11) THEN 'RUSHER,PENALIZED,TACKLER'
 WHEN kind IN (5, 14) THEN 'PASSER,SACKER,NONE'
 WHEN kind = 6 THEN 'PUNTER,RETURNER,NONE'
 WHEN kind IN (7, 8, 13) THEN 'KICKER,RETURNER,TACKLER'
 WHEN kind = 16 THEN 'PASSER,FUMBLER,TACKLER'
 WHEN kind = 17 THEN 'PASSER,RECEIVER,LATERALER'
 WHEN kind = 18 THEN 'PUNTER,BLOCKER,RECOVERER'
 WHEN kind = 19 THEN 'KICKER,RETURNER,NONE'
 WHEN kind IN (20, 21) THEN 'RUSHER,PENALIZED,PENALIZED'
 ELSE 'NONE,NONE,NONE'
END
"""


def given_name(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GIVEN]), (k % len(GIVEN) + 1).cast("int"))


def last_name(k: Column) -> Column:
    return F.initcap(F.translate((k + 1000).cast("string"), "0123456789", "abcdefghij"))


def full_name(k: Column) -> Column:
    before, after = (F.element_at(F.array(*[F.lit(f[i]) for f in FORMS]), (k % len(FORMS) + 1).cast("int")) for i in (0, 1))
    return F.concat(given_name(k), F.lit(" "), before, last_name(k), after)


def match_id() -> Column:
    """A match's id, from its period and sides."""
    return F.concat_ws("-", "period", "home", "away").alias("match_id")


def named_matches(figures: DataFrame) -> DataFrame:
    """Match figures with id, period and winner."""
    period = F.col("season") * 100 + F.col("week")
    return figures.select(
        F.concat_ws("-", period, "home", "away").alias("match_id"),
        "*",
        period.alias("period"),
        F.when(F.col("home_points") > F.col("away_points"), F.col("home"))
        .when(F.col("home_points") < F.col("away_points"), F.col("away"))
        .alias("winner"),
    )


class Tables:
    """Lazy views over one folder of parquet files."""

    #: Whether match ids are made of period and sides, as ``named_matches`` does.
    derived_ids = True

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        #: Views that are written already.
        self.written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def with_matches(self, matches: DataFrame) -> Tables:
        """The same folder with other matches, e.g. those known before a period."""
        other = Tables(self.spark, self.sf_dir)
        other.matches, other.derived_ids = matches, False
        return other

    def once(self, *names: str) -> Tables:
        """The same tables with the named views written once, for plans that read
        them many times."""
        other = Tables(self.spark, self.sf_dir)
        other.derived_ids, other.written = self.derived_ids, dict(self.written)
        for name in names:
            if name in self.written:
                continue
            if name == "matches" and self.derived_ids:
                # What follows from the other columns is not written.
                other.written[name] = named_matches(stored(self.match_figures))
            else:
                other.written[name] = stored(getattr(self, name))
        for name, df in other.written.items():
            setattr(other, name, df)
        return other

    @cached_property
    def matches(self) -> DataFrame:
        """One row per (period, home, away); figures folded from order lines."""
        return named_matches(self.match_figures)

    @cached_property
    def match_figures(self) -> DataFrame:
        """The matches without the columns that follow from the others."""
        teams = self.table("supplier").agg(F.count(F.lit(1))).scalar()
        lines = self.table("lineitem").select(
            F.year("l_shipdate").cast("bigint").alias("season"),
            F.month("l_shipdate").cast("bigint").alias("week"),
            F.col("l_suppkey").alias("home"),
            (F.col("l_partkey") % teams).alias("away"),
            F.col("l_quantity").cast("bigint").alias("q"),
            F.col("l_linenumber").cast("bigint").alias("ln"),
            F.floor("l_extendedprice").alias("p"),
            "l_returnflag",
            "l_linestatus",
        )
        return (
            lines.filter("home <> away")
            .groupBy("season", "week", "home", "away")
            .agg(
                F.sum("q").alias("home_points"),
                F.sum(F.col("p") % 50 + 1).alias("away_points"),
                F.sum(F.floor(F.col("p") / 100)).alias("home_yards"),
                F.sum(F.col("q") * 7 + F.col("ln")).alias("away_yards"),
                F.count(F.lit(1)).alias("home_attempts"),
                F.sum("ln").alias("away_attempts"),
                F.count_if(F.col("l_returnflag") == "R").alias("home_turnovers"),
                F.count_if(F.col("l_linestatus") == "F").alias("away_turnovers"),
            )
        )
    @cached_property
    def quarters(self) -> DataFrame:
        """Score lists of both sides per match: the lines of a match, dealt to quarters
        by their number, the fifth and later ones to overtimes."""
        teams = self.table("supplier").agg(F.count(F.lit(1))).scalar()
        lines = self.table("lineitem").select(
            (F.year("l_shipdate").cast("bigint") * 100 + F.month("l_shipdate")).alias("period"),
            F.col("l_suppkey").alias("home"),
            (F.col("l_partkey") % teams).alias("away"),
            F.col("l_quantity").cast("bigint").alias("q"),
            (F.floor("l_extendedprice") % 50 + 1).alias("p"),
            F.col("l_linenumber").alias("ln"),
        )
        last = F.max("ln")

        def slots(points: str) -> Column:
            part = [F.coalesce(F.sum(F.when(F.col("ln") == i, F.col(points))), F.lit(0)) for i in range(1, 8)]
            return F.slice(F.array(*part), F.lit(1), F.greatest(last, F.lit(4)).cast("int"))

        folded = lines.filter("home <> away").groupBy("period", "home", "away").agg(slots("q").alias("home_parts"), slots("p").alias("away_parts"))
        return folded.select(F.concat_ws("-", "period", "home", "away").alias("match_id"), "*")

    @cached_property
    def sides(self) -> DataFrame:
        """One row per (match, side)."""
        return sides(self.matches, MATCH_STATS, ("match_id", "season", "week", "period", "winner")).withColumn(
            "won", F.coalesce((F.col("winner") == F.col("team")).cast("bigint"), F.lit(0))
        )

    @cached_property
    def season_length(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.year("l_shipdate").cast("bigint").alias("season"))
            .agg((F.max(F.month("l_shipdate")).cast("bigint") - 2).alias("weeks"))
        )

    @cached_property
    def divisions(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        return (
            self.table("supplier")
            .join(nation, "s_nationkey")
            .select(
                F.col("s_suppkey").alias("team"),
                F.col("s_nationkey").cast("bigint").alias("division"),
                F.col("n_regionkey").cast("bigint").alias("conference"),
            )
        )

    @cached_property
    def outings(self) -> DataFrame:
        """One row per player and match: orders with the customer's nation as the team."""
        customer = self.table("customer").select(
            F.col("c_custkey").alias("player"), F.col("c_nationkey").cast("bigint").alias("team"), "c_mktsegment"
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("match_id"),
            F.col("o_custkey").alias("player"),
            F.year("o_orderdate").cast("bigint").alias("season"),
            F.month("o_orderdate").cast("bigint").alias("week"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        )
        role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
        return orders.join(customer, "player").select(
            "match_id",
            "player",
            "team",
            ((F.col("team") + 1 + F.col("match_id") % 24) % 25).alias("opp"),
            F.element_at(role, F.col("c_mktsegment")).alias("position"),
            "season",
            "week",
            (F.col("season") * 100 + F.col("week")).alias("period"),
            "cents",
            (F.col("cents") % 41).alias("points"),
            (F.col("cents") % 397).alias("yards"),
            (F.col("cents") % 29).alias("attempts"),
            (F.col("cents") % 5).alias("tds"),
            ((F.col("cents") % 101) / F.lit(100.0)).alias("share"),
            (F.col("match_id") % 3 == 0).alias("is_home"),
        )

    @cached_property
    def starters(self) -> DataFrame:
        """First players of each team and period by points (a line-up has a fixed size)."""
        spent = self.outings.groupBy("team", "season", "week", "period", "player", "position").agg(
            F.sum("points").alias("points")
        )
        spent = spent.withColumn("_down", -F.col("player"))
        return newest(spent, ["team", "period"], ["points", "_down"], LINEUP_SIZE, "slot").drop("_down")

    @cached_property
    def lineups(self) -> DataFrame:
        """One delimited cell ``player:position|...`` per team and period."""
        entry = F.struct("slot", F.concat_ws(":", "player", "position").alias("e"))
        cell = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["e"]), "|")
        return self.starters.groupBy("team", "season", "week", "period").agg(cell.alias("starters"))

    @cached_property
    def players(self) -> DataFrame:
        """Player dimension with unique derived names and ids."""
        k = F.col("c_custkey")
        first, last = given_name(k), last_name(k)
        return self.table("customer").select(
            k.alias("num"),
            full_name(k).alias("name"),
            F.concat(F.substring(last, 1, 4), F.substring(first, 1, 2), k.cast("string")).alias("p_id"),
            F.col("c_nationkey").cast("bigint").alias("team"),
            F.element_at(
                F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("c_mktsegment")
            ).alias("position"),
        )

    @cached_property
    def plays(self) -> DataFrame:
        """One row per play: events with a text line and up to three actors."""
        n = self.table("customer").agg(F.count(F.lit(1))).scalar()
        e, u = F.col("event_id"), F.col("user_id")
        v = F.floor("value")
        base = self.table("events").select(
            u.alias("match_id"),
            e.alias("num"),
            (e % 22).alias("kind"),
            F.round(F.col("value") * 100).cast("bigint").alias("hundredths"),
            (u % 32).alias("home"),
            ((u + 7) % 32).alias("away"),
            ((e * 7 + u) % n).alias("na"),
            ((e * 11 + u * 3 + 1) % n).alias("nb"),
            ((e * 13 + u * 5 + 2) % n).alias("nc"),
            (v % 60).cast("string").alias("y"),
            (v % 9 + 1).cast("string").alias("z"),
            F.concat(F.lit("T"), F.translate((u % 100 + 100).cast("string"), "0123456789", "ABCDEFGHIJ")).alias("tl0"),
            (e % 3 + 1).cast("string").alias("tn"),
            (e % 4 + 1).alias("down"),
            (v % 10 + 1).alias("togo"),
            "event_type",
            "props",
        ).withColumn("tl", F.substring("tl0", 2, 3))

        named = base.withColumns({x: full_name(F.col(f"n{x}")) for x in "abc"})
        return named.select(
            "match_id", "num", "kind", "hundredths", "home", "away", "na", "nb", "nc", "a", "b", "c",
            "down", "togo", "tl", "event_type", "props",
            F.expr(PLAY_TEXT).alias("detail"),
            F.expr(PLAY_ROLES).alias("roles"),
        )


_LAST = "translate(CAST({k} + 1000 AS VARCHAR), '0123456789', 'abcdefghij')"


def _name(k: str) -> str:
    def pick(values) -> str:
        quoted = ["'" + v.replace("'", "''") + "'" for v in values]
        return f"[{', '.join(quoted)}][CAST({k} % {len(quoted)} AS INT) + 1]"

    last = _LAST.format(k=k)
    before, after = (pick([f[i] for f in FORMS]) for i in (0, 1))
    return f"({pick(GIVEN)} || ' ' || {before} || upper({last}[1]) || {last}[2:] || {after})"


_ROLE_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " END"

VIEWS: dict[str, str] = {
    "matches": """
      SELECT concat_ws('-', season * 100 + week, home, away) AS match_id, *, season * 100 + week AS period,
             CASE WHEN home_points > away_points THEN home WHEN home_points < away_points THEN away END AS winner
      FROM (
        SELECT CAST(year(l_shipdate) AS BIGINT) AS season, CAST(month(l_shipdate) AS BIGINT) AS week,
               l_suppkey AS home, l_partkey % (SELECT count(*) FROM supplier) AS away,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS home_points,
               CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) % 50 + 1) AS BIGINT) AS away_points,
               CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) // 100) AS BIGINT) AS home_yards,
               CAST(sum(CAST(l_quantity AS BIGINT) * 7 + l_linenumber) AS BIGINT) AS away_yards,
               count(*) AS home_attempts, CAST(sum(l_linenumber) AS BIGINT) AS away_attempts,
               count(*) FILTER (l_returnflag = 'R') AS home_turnovers,
               count(*) FILTER (l_linestatus = 'F') AS away_turnovers
        FROM lineitem
        WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier)
        GROUP BY ALL)""",
    "sides": """
      SELECT match_id, season, week, period, winner, home AS team, away AS opp, true AS is_home,
             home_points AS for_points, home_yards AS for_yards, home_attempts AS for_attempts, home_turnovers AS for_turnovers,
             away_points AS opp_points, away_yards AS opp_yards, away_attempts AS opp_attempts, away_turnovers AS opp_turnovers,
             CAST(coalesce(winner = home, false) AS BIGINT) AS won
      FROM matches
      UNION ALL
      SELECT match_id, season, week, period, winner, away, home, false,
             away_points, away_yards, away_attempts, away_turnovers,
             home_points, home_yards, home_attempts, home_turnovers,
             CAST(coalesce(winner = away, false) AS BIGINT)
      FROM matches""",
    "quarters": """
      SELECT concat_ws('-', period, home, away) AS match_id, period, home, away, """
    + ", ".join(f"CAST(coalesce(sum({c}) FILTER (ln = {i}), 0) AS BIGINT) AS {r}_p{i}" for r, c in (("home", "q"), ("away", "p")) for i in range(1, 8))
    + """, max(ln) AS parts FROM (
        SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS period, l_suppkey AS home, l_partkey % (SELECT count(*) FROM supplier) AS away,
          CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) % 50 + 1 AS p, l_linenumber AS ln FROM lineitem) WHERE home <> away GROUP BY ALL""",
    "season_length": """
      SELECT CAST(year(l_shipdate) AS BIGINT) AS season, CAST(max(month(l_shipdate)) AS BIGINT) - 2 AS weeks
      FROM lineitem GROUP BY 1""",
    "divisions": """
      SELECT s_suppkey AS team, CAST(s_nationkey AS BIGINT) AS division, CAST(n_regionkey AS BIGINT) AS conference
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "outings": f"""
      SELECT match_id, player, team, (team + 1 + match_id % 24) % 25 AS opp, position, season, week,
             season * 100 + week AS period, cents, cents % 41 AS points, cents % 397 AS yards,
             cents % 29 AS attempts, cents % 5 AS tds, (cents % 101) / 100.0::DOUBLE AS share, match_id % 3 = 0 AS is_home
      FROM (SELECT o_orderkey AS match_id, o_custkey AS player, CAST(c_nationkey AS BIGINT) AS team,
                   {_ROLE_CASE} AS position, CAST(year(o_orderdate) AS BIGINT) AS season,
                   CAST(month(o_orderdate) AS BIGINT) AS week, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
            FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "starters": f"""
      SELECT * FROM (
        SELECT team, season, week, period, player, position, CAST(sum(points) AS BIGINT) AS points,
               CAST(row_number() OVER (PARTITION BY team, period ORDER BY sum(points) DESC, player) AS INT) AS slot
        FROM outings GROUP BY team, season, week, period, player, position) WHERE slot <= {LINEUP_SIZE}""",
    "lineups": """
      SELECT team, season, week, period, string_agg(concat_ws(':', player, position), '|' ORDER BY slot) AS starters
      FROM starters GROUP BY team, season, week, period""",
    "players": f"""
      SELECT c_custkey AS num, {_name('c_custkey')} AS name,
             concat(upper({_LAST.format(k='c_custkey')}[1]), {_LAST.format(k='c_custkey')}[2:4],
                    [{", ".join(f"'{g[:2]}'" for g in GIVEN)}][CAST(c_custkey % {len(GIVEN)} AS INT) + 1], c_custkey) AS p_id,
             CAST(c_nationkey AS BIGINT) AS team, {_ROLE_CASE} AS position
      FROM customer""",
    "plays": f"""
      SELECT match_id, num, kind, hundredths, home, away, na, nb, nc, a, b, c, down, togo, tl, event_type, props,
             {PLAY_TEXT} AS detail, {PLAY_ROLES} AS roles
      FROM (
        SELECT *, {_name('na')} AS a, {_name('nb')} AS b, {_name('nc')} AS c
        FROM (
          SELECT user_id AS match_id, event_id AS num, event_id % 22 AS kind,
                 CAST(round(value * 100) AS BIGINT) AS hundredths,
                 user_id % 32 AS home, (user_id + 7) % 32 AS away,
                 (event_id * 7 + user_id) % (SELECT count(*) FROM customer) AS na,
                 (event_id * 11 + user_id * 3 + 1) % (SELECT count(*) FROM customer) AS nb,
                 (event_id * 13 + user_id * 5 + 2) % (SELECT count(*) FROM customer) AS nc,
                 CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR) AS y,
                 CAST(CAST(floor(value) AS BIGINT) % 9 + 1 AS VARCHAR) AS z,
                 translate(CAST(user_id % 100 + 100 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS tl,
                 CAST(event_id % 3 + 1 AS VARCHAR) AS tn, event_id % 4 + 1 AS down,
                 CAST(floor(value) AS BIGINT) % 10 + 1 AS togo, event_type, props
          FROM events))""",
}

_NEEDS = {
    "sides": ("matches",),
    "starters": ("outings",),
    "lineups": ("starters",),
}


def views(*names: str) -> str:
    """``WITH`` clause with the named views and what they need, for the oracle."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    # A view read several times is computed once.
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in ordered)
