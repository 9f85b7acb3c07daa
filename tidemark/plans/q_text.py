"""Play-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import playtext as X
from tidemark.operators import quality as Q
from tidemark.operators.scan import Fill, Lead, RowNumber, RunningSum, chunked_scan
from tidemark.plans.registry import query
from tidemark.plans.testbed import Tables, views
from tidemark.session import stored

CHUNK = 4096
P = views("plays")


def num_chunk():
    return F.floor(F.col("num") / CHUNK)


def roles(name: str):
    return F.contains("roles", F.lit(name))


def has_roles() -> dict:
    return {
        "passer": roles("PASSER"), "rusher": roles("RUSHER"), "punter": roles("PUNTER"), "kicker": roles("KICKER"),
        "fumbler": roles("FUMBLER"), "blocker": roles("BLOCKER"), "lateraler": roles("LATERALER"),
    }


# The names that the line was made from, where it holds them.
_NAMES = r"list_distinct(list_filter([a, b, c], lambda x: regexp_matches(detail, '\Q' || x || '\E($|[^A-Za-z-])')))"


@query("T-1", P + f" SELECT match_id, num, array_to_string(list_sort({_NAMES}), '|') AS names FROM plays")
def person_names(t: Tables) -> DataFrame:
    return t.plays.select("match_id", "num", F.array_join(F.array_sort(X.person_names(F.col("detail"))), "|").alias("names"))


@query(
    "T-1 T-2",
    f"""SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(text, '\\b[A-Z][a-z]+\\s[A-Z][a-z]+(?:\\s[A-Z][a-z]+)?\\b'), lambda x: NOT contains(x, 'San Francisco'))
        || regexp_extract_all(text, '[A-Z][a-z]+\\s[A-Z][a-z]+\\s[0-9]+[a-z]+')))::INT AS team_like,
      len(list_distinct(list_filter(regexp_extract_all(text, '({X.KICKOFF_TEAM})', 1), lambda x: x NOT IN ('Team', 'Football'))))::INT AS words FROM conversations""",
)
def team_names(t: Tables) -> DataFrame:
    """Candidate team names in free text."""
    return t.table("conversations").select(
        "conv_id", "turn", F.size(X.team_names(F.col("text"))).alias("team_like"), F.size(X.kickoff_teams(F.col("text"))).alias("words")
    )


@query(
    "T-3 T-4",
    P + f""", n AS (SELECT match_id, num, detail, unnest({_NAMES}) AS name FROM plays),
    s AS (SELECT *, string_split(detail, name) AS parts FROM n),
    o AS (SELECT match_id, num, name, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(name))) AS start FROM s)
    SELECT match_id, num, name, start::INT AS start, (start + length(name))::INT AS "end", (start = min(start) OVER (PARTITION BY match_id, num))::INT AS leading FROM o""",
)
def name_spans(t: Tables) -> DataFrame:
    """All offsets of each name, and whether the name leads the line."""
    p = t.plays.select("match_id", "num", "detail", X.person_names(F.col("detail")).alias("names"))
    lead = X.leading_name(F.col("detail"), F.col("names"))
    # Outer, with the empty ones taken away behind: an inner explosion puts a filter on its
    # list before it, for which names and spans would be worked out again.
    rows = p.select("match_id", "num", "detail", lead.alias("lead"), F.explode_outer("names").alias("name")).filter("name IS NOT NULL")
    rows = rows.select("match_id", "num", "name", "lead", F.instr("detail", F.col("name")).alias("first"), F.inline_outer(X.spans(F.col("detail"), F.col("name"))))
    rows = rows.filter("start IS NOT NULL")
    leading = (F.col("name") == F.col("lead")) & (F.col("start") == F.col("first") - 1)
    return rows.select("match_id", "num", "name", "start", "end", leading.cast("int").alias("leading"))


_TYPE = """CASE WHEN detail LIKE '%coin toss%' THEN 'coin_toss' WHEN detail LIKE '%Timeout%' THEN 'timeout' WHEN roles LIKE '%KICKER%' AND detail LIKE '%field goal%' THEN 'field_goal'
  WHEN roles LIKE '%KICKER%' AND detail LIKE '%extra point%' THEN 'extra_point' WHEN roles LIKE '%KICKER%' AND detail LIKE '%kicks off%' THEN 'kickoff' WHEN roles LIKE '%PUNTER%' THEN 'punt'
  WHEN roles LIKE '%RUSHER%' THEN 'run' WHEN roles LIKE '%PASSER%' AND detail LIKE '%kneels%' THEN 'kneel' WHEN roles LIKE '%PASSER%' AND detail LIKE '%sacked%' THEN 'sack'
  WHEN roles LIKE '%PASSER%' THEN 'pass' WHEN detail LIKE '%Penalty%' THEN 'penalty' WHEN detail LIKE '%challenged%' THEN 'challenge' END"""


@query(
    "T-5 PF-16",
    P + f""" SELECT match_id, num, {_TYPE} AS play_type, detail LIKE '%Penalty%' AND detail NOT LIKE '%coin toss%' AS is_penalty,
      detail LIKE '%challenged%' AND detail NOT LIKE '%coin toss%' AS is_challenge, kind = 16 AS is_fumble, kind = 18 AS is_block, kind = 17 AS contains_lateral FROM plays""",
)
def play_types(t: Tables) -> DataFrame:
    has = has_roles()
    flags = X.play_flags(F.col("detail"), has)
    return t.plays.select("match_id", "num", X.play_type(F.col("detail"), has).alias("play_type"), *[v.alias(k) for k, v in flags.items()])


_EFF = r"""rtrim(regexp_replace(coalesce(CASE WHEN NOT contains(detail, 'challenged') THEN detail
   WHEN contains(detail, 'overturned.') AND trim(split_part(detail, 'overturned.', 2)) <> '' THEN trim(split_part(detail, 'overturned.', 2))
   ELSE trim(regexp_extract(detail, '^(.*?)(?:Replay Assistant|[A-Z]{3}) challenged', 1)) END, detail), '\.?\s*Penalty.*$', ''))"""
_NUM = lambda pat: f"TRY_CAST(regexp_extract(d, '{pat}', 1) AS INT)"
_ATTR_SQL = {
    "pass_yards": f"CASE WHEN k = 'pass' THEN CASE WHEN contains(d, 'incomplete') OR contains(d, 'spiked') OR contains(d, 'no gain') THEN 0 ELSE {_NUM('for (-?[0-9]+)')} END END",
    "completed": f"CASE WHEN k = 'pass' THEN {_NUM('for (-?[0-9]+)')} IS NOT NULL AND NOT contains(d, 'intercepted') END",
    "is_interception": "CASE WHEN k = 'pass' THEN contains(d, 'intercepted') END",
    "is_spike": "CASE WHEN k = 'pass' THEN contains(d, 'spiked') END",
    "rush_yards": f"CASE WHEN k = 'run' THEN {_NUM('for (-?[0-9]+)')} END",
    "run_direction": "CASE WHEN k = 'run' THEN CASE WHEN contains(d, 'middle ') THEN 'm' WHEN contains(d, 'left end') THEN 'le' WHEN contains(d, 'right end') THEN 're' WHEN contains(d, 'left tackle') THEN 'lt' WHEN contains(d, 'left guard') THEN 'lg' WHEN contains(d, 'right guard') THEN 'rg' END END",
    "is_qb_run": "CASE WHEN k = 'run' AND pos = 'QB' THEN true END",
    "is_wr_run": "CASE WHEN k = 'run' AND pos = 'WR' THEN true END",
    "is_sneak": "CASE WHEN k = 'run' AND pos = 'QB' AND contains(d, 'middle') AND togo <= 2 AND down >= 3 THEN true END",
    "sack_yards": f"CASE WHEN k = 'sack' THEN {_NUM('for (-?[0-9]+)')} END",
    "is_off_touchdown": "CASE WHEN kind IN (18, 19) THEN st = lt WHEN k IN ('pass', 'run') THEN contains(d, 'touchdown') AND NOT contains(d, 'returned') END",
    "is_def_touchdown": "CASE WHEN kind IN (18, 19) THEN st <> lt WHEN k IN ('pass', 'run', 'sack') THEN contains(d, 'touchdown') AND contains(d, 'returned') END",
    "kickoff_yards": f"CASE WHEN k = 'kickoff' THEN {_NUM('kicks off (-?[0-9]+)')} END",
    "punt_yards": f"CASE WHEN k = 'punt' THEN {_NUM('punts (-?[0-9]+)')} END",
    "return_yards": f"CASE WHEN k IN ('kickoff', 'punt') THEN {_NUM('for (-?[0-9]+)')} END",
    "is_touchback": "CASE WHEN k IN ('kickoff', 'punt') THEN contains(d, 'touchback') END",
    "is_fair_catch": "CASE WHEN k = 'punt' THEN contains(d, 'fair catch') END",
    "is_muffed": "CASE WHEN k = 'punt' THEN contains(d, 'muffed') END",
    "is_good": "CASE WHEN k = 'field_goal' THEN contains(d, 'field goal good') WHEN k = 'extra_point' THEN contains(d, 'extra point good') END",
    "field_goal_yards": f"CASE WHEN k = 'field_goal' THEN {_NUM('(-?[0-9]+) yard')} END",
    "timeout_number": f"CASE WHEN k = 'timeout' THEN {_NUM('#([0-9])')} END",
    "timeout_team": "CASE WHEN k = 'timeout' THEN regexp_extract(d, ' by (.+)$', 1) END",
    "toss_winner": "CASE WHEN k = 'coin_toss' THEN split_part(d, ' ', 1) END",
    "toss_deferred": "CASE WHEN k = 'coin_toss' THEN contains(d, 'deferred') END",
    "is_safety": "CASE WHEN k IS NOT NULL THEN contains(d, 'safety') END",
}


_PENS_SQL = r"""regexp_extract_all(regexp_replace(regexp_replace(detail, ', Penalty', '. Penalty', 'g'), '\) Penalty', '). Penalty', 'g'), '(Penalty.*?(?:\. |$))', 1)"""
_PEN_ROWS = P + f""", nx AS (SELECT *, lead(togo) OVER (PARTITION BY match_id ORDER BY num) AS next_togo FROM plays),
  pr AS (SELECT match_id, num, coalesce(next_togo > togo, false) AS against, {_PENS_SQL} AS ps FROM nx WHERE contains(detail, 'Penalty')),
  u AS (SELECT match_id, num, against, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM pr),
  parsed AS (SELECT match_id, num, i::INT AS i, trim(regexp_replace(regexp_extract(p, ': ([^,(]*)', 1), '[.:]', '', 'g')) AS type, regexp_extract(p, '(\\S+):', 1) AS penalizer,
     coalesce(TRY_CAST(regexp_extract(p, '([0-9]{{1,2}}) yards', 1) AS INT), CASE WHEN contains(p, '1 yard') THEN 1 END, 0) AS yards,
     contains(lower(p), 'declined') AS declined, contains(p, '(no play)') AS no_play, (contains(p, '(offset)') OR contains(p, '(Offsetting)')) AS "offset", against FROM u)"""


def penalty_plays(t: Tables) -> DataFrame:
    p = with_penalties(t.plays.select("match_id", "num", "detail", "togo"))
    return p.filter(F.contains("detail", F.lit("Penalty")))


def with_penalties(plays: DataFrame) -> DataFrame:
    """Plays with the array of their penalties, judged by the next play's yards to go."""
    p = chunked_scan(plays, ["match_id"], num_chunk(), ["num"], [Lead("next_togo", "togo")], levels=2)
    return p.withColumn("pens", X.penalties(F.col("detail"), F.col("togo"), F.col("next_togo")))


@query("T-10", _PEN_ROWS + " SELECT match_id, num, i, type, penalizer, yards, declined, no_play, \"offset\", against AS against_possession FROM parsed")
def penalty_rows(t: Tables) -> DataFrame:
    return penalty_plays(t).select("match_id", "num", F.posexplode("pens").alias("i", "p")).select("match_id", "num", "i", "p.*")


_NET_SQL = _PEN_ROWS + """, g AS (SELECT match_id, num, count(*) AS n, bool_and(declined) AS alld, bool_and("offset") AS allo, bool_or(no_play) AS np,
       count(*) FILTER (NOT declined) AS na, sum(yards) FILTER (NOT declined) AS acc, sum(yards) AS tot, max(yards) AS most, CASE WHEN any_value(against) THEN -1 ELSE 1 END AS sgn FROM parsed GROUP BY ALL),
    net AS (SELECT match_id, num, CASE WHEN n IN (1, 2, 3) AND alld THEN NULL WHEN n = 1 THEN tot * sgn WHEN allo AND n IN (2, 3, 4, 6, 8) THEN CASE WHEN NOT np THEN tot * sgn END WHEN n = 2 THEN acc * sgn
        WHEN n = 3 THEN CASE WHEN np THEN NULL WHEN na = 3 THEN tot * sgn WHEN na = 1 THEN acc ELSE acc * sgn END WHEN n = 4 THEN CASE WHEN np THEN most ELSE tot END * sgn END::INT AS net_yards,
      CASE WHEN n = 1 THEN alld WHEN n IN (2, 3) AND alld THEN true WHEN allo AND n IN (2, 3, 4, 6, 8) THEN NOT np WHEN n IN (3, 4) THEN NOT np ELSE false END AS stands FROM g)"""


@query("T-11", _NET_SQL + " SELECT * FROM net")
def net_penalty_yards(t: Tables) -> DataFrame:
    pens = F.col("pens")
    return penalty_plays(t).select(
        "match_id", "num", X.net_penalty_yards(pens).alias("net_yards"), X.play_stands(pens).alias("stands")
    )


# Kinds whose lines hold a fumble or a lateral.
_SPECIAL = "(kind IN (16, 17))"


@query(
    "T-6 T-7 T-8 T-12 T-13 PF-16",
    _NET_SQL.replace(views("plays"), views("plays", "players"), 1)
    + f""", e AS (SELECT p.match_id, p.num, kind, {_EFF} AS d, {_TYPE} AS k, togo, down, pl.position AS pos, pl.team AS lt, sc.team AS st,
        NOT {_SPECIAL} AND coalesce(stands, true) AS counts, CASE WHEN NOT {_SPECIAL} THEN net_yards END AS penalty_yards
      FROM plays p LEFT JOIN players pl ON pl.num = p.na LEFT JOIN players sc ON sc.num = CASE kind WHEN 18 THEN p.nc WHEN 19 THEN p.nb END
        LEFT JOIN net ON net.match_id = p.match_id AND net.num = p.num)
    SELECT match_id, num, k AS play_type, penalty_yards, """
    + ", ".join(f"CASE WHEN counts THEN {v} END AS {k}" for k, v in _ATTR_SQL.items()) + " FROM e",
)
def play_attributes(t: Tables) -> DataFrame:
    """All attributes of every play on its effective text, as its flags allow."""
    text, kind = X.effective_text(F.col("detail")), X.play_type(F.col("detail"), has_roles())
    flags = X.play_flags(F.col("detail"), has_roles())
    p = with_penalties(t.plays).select(
        "match_id", "num", "togo", "down", "na", kind.alias("play_type"), text.alias("text"), flags["is_block"].alias("is_block"),
        *[v.alias(k) for k, v in X.dispatch(flags, F.col("pens")).items()], scorer_num(text).alias("scored_by"),
    )
    lead = t.players.select(F.col("num").alias("na"), "position", F.col("team").alias("lead_team"))
    # A play without a scorer looks up its leading actor, so that no key is null.
    p = p.join(lead, "na", "left").withColumn("at", F.coalesce("scored_by", "na"))
    side = t.players.select(F.col("num").alias("at"), F.col("team").alias("at_team"))
    p = p.join(side, "at", "left")
    by_offence = F.when(F.col("scored_by").isNotNull(), F.col("at_team") == F.col("lead_team"))
    attrs = X.attributes(
        F.col("text"), F.col("play_type"), F.col("position"), F.col("togo"), F.col("down"), F.col("is_block"), by_offence
    )
    return p.select("match_id", "num", "play_type", "penalty_yards", *[F.when(F.col("counts"), v).alias(k) for k, v in attrs.items()])


def scorer_num(text: Column) -> Column:
    """Number of the actor that ends closest before the word touchdown."""
    return X.named_scorer(text, F.array(*[F.struct(F.col(x).alias("name"), F.col(f"n{x}").alias("id")) for x in "abc"]))


@query(
    "T-9",
    views("plays", "players") + """, td AS (SELECT match_id, num, na, CASE kind WHEN 2 THEN nc WHEN 4 THEN na WHEN 18 THEN nc WHEN 19 THEN nb END AS who FROM plays WHERE contains(detail, 'touchdown'))
    SELECT match_id, td.num, s.p_id AS scorer, (s.team = l.team)::INT AS offensive FROM td JOIN players s ON s.num = who JOIN players l ON l.num = na""",
)
def touchdown_scorers(t: Tables) -> DataFrame:
    """Entity that ends closest before the word; offensive where its team is the leading actor's."""
    td = t.plays.filter(F.contains("detail", F.lit("touchdown"))).select("match_id", "num", "na", scorer_num(F.col("detail")).alias("who"))
    by = t.players.select(F.col("num").alias("who"), F.col("p_id").alias("scorer"), "team")
    lead = t.players.select(F.col("num").alias("na"), F.col("team").alias("ball"))
    return td.join(by, "who").join(lead, "na").select(
        "match_id", "num", "scorer", (F.col("team") == F.col("ball")).cast("int").alias("offensive")
    )


@query(
    "T-12",
    P + r""" SELECT match_id, num, trim(regexp_extract(detail, '^(.*?)[A-Z]{3} challenged', 1)) AS original, trim(split_part(detail, 'overturned.', 2)) AS replacement,
      regexp_extract(detail, '([A-Z]{3}) challenged', 1) AS side, contains(detail, 'overturned') AS overturned FROM plays WHERE contains(detail, 'challenged')""",
)
def challenges(t: Tables) -> DataFrame:
    c = t.plays.select("match_id", "num", X.challenge(F.col("detail")).alias("c")).filter("c IS NOT NULL")
    return c.select("match_id", "num", "c.original", "c.replacement", "c.side", "c.overturned")


@query("T-14", _PEN_ROWS + " SELECT type, count(*) AS n FROM parsed GROUP BY 1")
def penalty_dictionary(t: Tables) -> DataFrame:
    rows = penalty_plays(t).select(F.explode("pens").alias("p"))
    return rows.groupBy(F.col("p.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "T-15 J-1",
    views("plays", "players") + """, e AS (SELECT match_id, num, unnest(string_split(roles, ',')) AS role, unnest([na, nb, nc]) AS actor FROM plays)
    SELECT e.match_id, e.num, role, p_id, team FROM e JOIN players ON players.num = actor WHERE role <> 'NONE'""",
)
def entity_rows(t: Tables) -> DataFrame:
    """Role columns with delimited ids to one row per entity with its team."""
    r = F.split("roles", ",")
    p = t.plays.select("match_id", "num", F.explode(F.arrays_zip(r.alias("role"), F.array("na", "nb", "nc").alias("actor"))).alias("e"))
    p = p.select("match_id", "num", F.col("e.role").alias("role"), F.col("e.actor").alias("actor")).filter("role <> 'NONE'")
    dim = t.players.select(F.col("num").alias("actor"), "p_id", "team")
    return p.join(dim, "actor").select("match_id", "num", "role", "p_id", "team")


@query(
    "T-16 J-21",
    views("plays", "players") + """ SELECT DISTINCT match_id, na AS player, CASE WHEN team % 32 = home THEN home WHEN team % 32 = away THEN away WHEN contains(roles, 'PASSER') OR contains(roles, 'RUSHER') THEN home ELSE away END AS side
      FROM plays JOIN players ON players.num = na""",
)
def player_match_teams(t: Tables) -> DataFrame:
    """Roster team where it plays in the match, else by role: attackers have the ball."""
    dim = t.players.select(F.col("num").alias("na"), (F.col("team") % 32).alias("team"))
    known = F.get(F.array_intersect(F.array("team"), F.array("home", "away")), F.lit(0))
    by_role = F.when(roles("PASSER") | roles("RUSHER"), F.col("home")).otherwise(F.col("away"))
    return t.plays.join(dim, "na").select("match_id", F.col("na").alias("player"), F.coalesce(known, by_role).alias("side")).distinct()


@query(
    "T-17 PF-10",
    P + """, v AS (SELECT match_id, home, num % 2 AS side, TRY_CAST(CASE WHEN kind = 12 THEN 'Overtime' ELSE (hundredths / 100.0)::DOUBLE::VARCHAR END AS DOUBLE) AS epa FROM plays)
    SELECT match_id, round(avg(epa) FILTER (side = 0), 6) AS home_epa, round(avg(epa) FILTER (side = 1), 6) AS away_epa, count(*) FILTER (epa IS NULL) AS skipped FROM v GROUP BY 1""",
)
def play_value_table(t: Tables) -> DataFrame:
    """Value per match and side from a text column that also holds markers."""
    raw = F.when(F.col("kind") == 12, F.lit("Overtime")).otherwise((F.col("hundredths") / 100.0).cast("string"))
    v = t.plays.select("match_id", (F.col("num") % 2).alias("side"), raw.try_cast("double").alias("epa"))
    return v.groupBy("match_id").agg(
        F.round(F.avg(F.when(F.col("side") == 0, F.col("epa"))), 6).alias("home_epa"),
        F.round(F.avg(F.when(F.col("side") == 1, F.col("epa"))), 6).alias("away_epa"),
        F.count_if(F.col("epa").isNull()).alias("skipped"),
    )


@query(
    "T-18 J-19",
    views("plays", "players") + """ SELECT p.match_id, p.num, replace(replace(replace(detail, a, '|' || x.p_id || '|'), b, '|' || y.p_id || '|'), c, '|' || z.p_id || '|') AS detail
      FROM plays p JOIN players x ON x.num = na JOIN players y ON y.num = nb JOIN players z ON z.num = nc""",
)
def names_as_tokens(t: Tables) -> DataFrame:
    p = with_ids(t)
    tokens = F.transform(F.array("ia", "ib", "ic"), lambda i: F.concat(F.lit("|"), i, F.lit("|")))
    return p.select("match_id", "num", X.substitute(F.col("detail"), F.array("a", "b", "c"), tokens).alias("detail"))


def with_ids(t: Tables) -> DataFrame:
    p = t.plays
    for x in "abc":
        p = p.join(t.players.select(F.col("num").alias(f"n{x}"), F.col("p_id").alias(f"i{x}")), f"n{x}")
    return p


@query(
    "J-19 T-3",
    views("plays", "players") + """ SELECT p.match_id, p.num, 'a' AS who, x.p_id AS found FROM plays p JOIN players x ON x.num = na WHERE contains(detail, a)
      UNION ALL SELECT p.match_id, p.num, 'b', y.p_id FROM plays p JOIN players y ON y.num = nb WHERE contains(detail, b) AND a <> b""",
)
def span_to_id_token(t: Tables) -> DataFrame:
    """Span of a name in one text to the token of the parallel id text."""
    p = with_ids(t)
    ids_text = X.substitute(F.col("detail"), F.array("a", "b", "c"), F.array("ia", "ib", "ic"))
    all_spans = F.flatten(F.transform(F.array_distinct(F.array("a", "b", "c")), lambda n: F.transform(X.spans(F.col("detail"), n), lambda s: F.struct(s["start"].alias("start"), n.alias("name")))))
    p = p.select("match_id", "num", "detail", "a", "b", ids_text.alias("ids_text"), all_spans.alias("spans"))
    who = F.array(F.struct(F.lit("a").alias("who"), F.col("a").alias("name")), F.struct(F.lit("b").alias("who"), F.when(F.col("a") != F.col("b"), F.col("b")).alias("name")))
    p = p.select("match_id", "num", "detail", "ids_text", "spans", F.inline(who)).filter(F.contains("detail", F.col("name")))
    start = F.instr("detail", F.col("name")) - 1
    return p.select("match_id", "num", "who", X.token_at_span(F.col("detail"), F.col("ids_text"), start, F.col("name"), F.col("spans")).alias("found"))


@query(
    "T-19",
    P + """, w AS (SELECT unnest(list_filter(string_split(lower(regexp_replace(detail, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM plays)
    SELECT CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'number' ELSE w END AS token, count(*) AS n FROM w GROUP BY 1""",
)
def token_counts(t: Tables) -> DataFrame:
    """Bag of words over all play lines after token normalisation."""
    words = t.plays.select(F.explode(X.normal_tokens(F.col("detail"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("T-20", P + r" SELECT match_id, num, length(detail)::INT AS line_length, regexp_matches(detail, '\(.*kick')::INT AS kick_in_brackets FROM plays")
def line_features(t: Tables) -> DataFrame:
    return t.plays.select("match_id", "num", F.length("detail").alias("line_length"), X.kick_in_parentheses(F.col("detail")).alias("kick_in_brackets"))


@query(
    "T-21 A-17",
    P + r""", k AS (SELECT unnest(regexp_extract_all(detail, ': ([^,\n]+)', 1)) AS k FROM plays WHERE contains(detail, 'Penalty'))
    SELECT trim(regexp_replace(k, '\(.*?\)', '', 'g')) AS keyword, count(*) AS n FROM k GROUP BY 1""",
)
def penalty_keywords(t: Tables) -> DataFrame:
    k = t.plays.filter(F.contains("detail", F.lit("Penalty"))).select(F.explode(X.penalty_keyword(F.col("detail"))).alias("keyword"))
    return k.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query(
    "T-22 J-15 IO-13",
    views("plays", "players") + f""", n AS (SELECT DISTINCT unnest({_NAMES}) AS name FROM plays)
    SELECT name FROM n WHERE name NOT IN (SELECT name FROM players) AND name NOT IN (SELECT s_name FROM supplier)""",
)
def names_in_no_dimension(t: Tables) -> DataFrame:
    """Data quality: extracted names missing in every dimension."""
    names = t.plays.select(F.explode(X.person_names(F.col("detail"))).alias("name"))
    return Q.missing_everywhere(names, "name", [t.players.select("name"), t.table("supplier").select(F.col("s_name").alias("name"))])


@query(
    "T-22",
    "SELECT source, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) < 200) AS short_rows, count(*) FILTER (quality IS NULL) AS quality_nulls FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
def short_texts(t: Tables) -> DataFrame:
    d = t.table("documents").join(t.table("labels").select("doc_id", "quality"), "doc_id", "left")
    return Q.text_summary(d, ["source"], "text", 200, ["quality"])


@query(
    "T-23 IO-3",
    P + """ SELECT match_id, num, row_number() OVER (PARTITION BY match_id ORDER BY num) AS new_num FROM plays WHERE kind NOT IN (12, 15)""",
)
def renumbered_plays(t: Tables) -> DataFrame:
    """Drop repeated header and opening rows, then renumber."""
    p = t.plays.filter(~F.col("kind").isin(12, 15)).select("match_id", "num")
    return chunked_scan(p, ["match_id"], num_chunk(), ["num"], [RowNumber("new_num")], levels=2)


@query(
    "T-24 R-9",
    """WITH d AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT embedding AS e FROM d WHERE vec_id = (SELECT min(vec_id) FROM d))
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS similarity FROM d, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20""",
)
def similar_vectors(t: Tables) -> DataFrame:
    """Top twenty by cosine against one target vector."""
    e = t.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    target = e.agg(F.min_by("v", "vec_id").alias("q")).scalar()

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    scored = e.withColumn("q", target)
    cos = F.try_divide(dot(F.col("v"), F.col("q")), F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    best = scored.select("vec_id", cos.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)
    return best.select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(
    "Q-13",
    P + """, c AS (SELECT match_id, num, home, away, kind, (kind IN (2, 6, 8))::INT AS turned, num % 2 AS receiver FROM plays),
    f AS (SELECT match_id, arg_min(receiver, num) FILTER (kind = 7) AS opening, min(num) FILTER (kind = 15) AS half FROM c GROUP BY 1),
    k AS (SELECT c.*, CASE WHEN kind = 7 THEN receiver WHEN num = half THEN 1 - coalesce(opening, 0) END AS mark FROM c JOIN f USING (match_id)),
    g AS (SELECT *, count(mark) OVER (PARTITION BY match_id ORDER BY num) AS drive FROM k),
    s AS (SELECT *, sum(turned) OVER (PARTITION BY match_id, drive ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turns,
             last_value(mark IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY num) AS start FROM g)
    SELECT match_id, num, CASE WHEN (coalesce(start, 0) + coalesce(turns, 0)) % 2 = 0 THEN home ELSE away END AS possession FROM s""",
)
def possession_by_turns(t: Tables) -> DataFrame:
    """Possession flips at every change and restarts at a kick-off (parity of a running count).

    The second half starts with the side that did not receive the opening kick-off;
    the derived plays have no clock, so their first coin-toss line opens it."""
    receiver, num = F.when(F.col("kind") == 7, F.col("num") % 2), F.col("num")
    plays = stored(t.plays.select("match_id", "num", "home", "away", "kind"))
    opening = plays.groupBy("match_id").agg(
        F.min_by(receiver, F.when(F.col("kind") == 7, num)).alias("opening"), F.min(F.when(F.col("kind") == 15, num)).alias("half")
    )
    p = plays.select(
        "match_id", "num", "home", "away", F.col("kind").isin(2, 6, 8).cast("int").alias("turned"), receiver.alias("receiver")
    ).join(opening, "match_id")
    p = p.withColumn("receiver", F.coalesce("receiver", F.when(num == F.col("half"), 1 - F.coalesce("opening", F.lit(0)))))
    p = chunked_scan(p, ["match_id"], num_chunk(), ["num"], [RunningSum("turns", "turned", inclusive=False)], levels=2)
    # Turns counted before the last mark are taken off again.
    p = p.withColumn("mark", F.when(F.col("receiver").isNotNull(), F.struct("receiver", F.coalesce("turns", F.lit(0)).alias("at"))))
    p = chunked_scan(p, ["match_id"], num_chunk(), ["num"], [Fill("last", "mark")], levels=2)
    since = F.coalesce("turns", F.lit(0)) - F.coalesce(F.col("last.at"), F.lit(0))
    flips = F.coalesce(F.col("last.receiver"), F.lit(0)) + since
    return p.select("match_id", "num", F.when(flips % 2 == 0, F.col("home")).otherwise(F.col("away")).alias("possession"))


@query(
    "Q-14 PF-12 SL-13",
    views("plays", "players") + """, l AS (SELECT p.match_id, p.num, CASE WHEN kind NOT IN (12, 15) AND players.position IN ('QB', 'RB', 'WR', 'TE') THEN players.team END AS team FROM plays p JOIN players ON players.num = na)
    SELECT match_id, num, last_value(team IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY num) AS possession FROM l""",
)
def possession_by_leader(t: Tables) -> DataFrame:
    """Team of the leading actor, filled forward inside the match only."""
    dim = t.players.select(F.col("num").alias("na"), "team", "position")
    ball = ~F.col("kind").isin(12, 15) & F.col("position").isin("QB", "RB", "WR", "TE")
    p = t.plays.join(dim, "na").select("match_id", "num", F.when(ball, F.col("team")).alias("team"))
    return chunked_scan(p, ["match_id"], num_chunk(), ["num"], [Fill("possession", "team")], levels=2).select("match_id", "num", "possession")
