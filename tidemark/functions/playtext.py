"""Play-text parsing as column expressions.

Nothing here runs Python per row: names, spans, play types, attributes and
penalties come from regular expressions and array functions inside the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Penalty names that look like person names.
PENALTY_NAMES = (
    "Defensive Holding",
    "Defensive Offside",
    "Defensive Pass Interference",
    "Delay of Game",
    "Encroachment",
    "Face Mask",
    "Fair Catch Interference",
    "False Start",
    "Free Kick",
    "Holding",
    "Illegal Block Above the Waist",
    "Illegal Contact",
    "Illegal Formation",
    "Illegal Motion",
    "Illegal Shift",
    "Illegal Use of Hands",
    "Ineligible Downfield Pass",
    "Intentional Grounding",
    "Neutral Zone Infraction",
    "Offensive Holding",
    "Offensive Pass Interference",
    "Offside",
    "Roughing the Passer",
    "Taunting",
    "Unnecessary Roughness",
    "Unsportsmanlike Conduct",
)

# A person name from its parts: given name or initials, a middle initial,
# particles, a last name with inner capitals, hyphens and apostrophes, a suffix
# (without its dot).  Two given names are taken before a hyphenated last name only,
# so that neighbouring names stay apart.
_GIVEN = r"(?:(?:[A-Z]\.){1,3}|[A-Z]{2,3}|'?[A-Z][a-z]*(?:['-](?:[A-Z][a-z]*|[a-z]+)|[A-Z][a-z]+)*'?)"
_DOUBLE = _GIVEN + r" [A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+"
_MIDDLE = r"(?: [A-Z]\.)?"
_PARTICLE = r"(?: (?:von|van|de|da|la|St\.|Van|Von|De|La|Le))*"
_LAST = r"(?: [A-Z]'?[A-Za-z]+(?:[-'][A-Za-z]+)*'?[a-z]*)"
_SUFFIX = r"(?: (?:Jr|Sr|III|II|IV)(?![A-Za-z]))?"
# Who calls a timeout is a team of two to four words, the last one may be a number's.
_CALLER = r"(?<=#[0-9] by )[A-Z][a-z]+(?: [A-Z0-9][A-Za-z0-9]+){1,3}"
NAME = f"(?<![A-Za-z])(?:{_CALLER}|{_DOUBLE}|{_GIVEN}{_MIDDLE}{_PARTICLE}{_LAST}){_SUFFIX}"
TEAM = r"\b[A-Z][a-z]+\s[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\b"
TEAM_WITH_NUMBER = r"[A-Z][a-z]+\s[A-Z][a-z]+\s[0-9]+[a-z]+"
# Fixed value: a city that stands before a number and is no team by itself.
CITY_ONLY = "San Francisco"
KICKOFF_TEAM = r"Football Team|[0-9]+[a-z]+|[A-Z][a-z]+"


def lower_penalties(text: Column) -> Column:
    """Penalty names in lower case, so that they are not taken for people."""
    out = text
    for name in sorted(PENALTY_NAMES, key=len, reverse=True):
        out = F.replace(out, F.lit(name), F.lit(name.lower()))
    return F.regexp_replace(out, r"\bPenalty\b", "penalty")


def person_names(text: Column) -> Column:
    """Distinct person names in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(lower_penalties(text), F.lit(f"({NAME})"), 1))


def team_names(text: Column) -> Column:
    """Two or three capitalised words, or two and a number with letters."""
    words = F.regexp_extract_all(text, F.lit(f"({TEAM})"), 1)
    numbered = F.regexp_extract_all(text, F.lit(f"({TEAM_WITH_NUMBER})"), 1)
    return F.array_distinct(F.concat(F.filter(words, lambda n: ~F.contains(n, F.lit(CITY_ONLY))), numbered))


def kickoff_teams(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({KICKOFF_TEAM})"), 1)
    return F.array_distinct(F.filter(found, lambda n: ~n.isin("Team", "Football")))


def _pieces(text: Column, name: Column) -> Column:
    return F.split(text, F.concat(F.lit(r"\Q"), name, F.lit(r"\E")), -1)


def spans(text: Column, name: Column) -> Column:
    """All ``(start, end)`` offsets (0-based, end exclusive) of ``name``."""
    parts = _pieces(text, name)
    found = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + F.length(name)).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["at"] + F.length(p)).alias("start"), (acc["at"] + F.length(p) + F.length(name)).alias("end"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(name != "", found)


def leading_name(text: Column, names: Column) -> Column:
    """The name that occurs first in the text."""
    places = F.filter(
        F.transform(names, lambda n: F.named_struct(F.lit("at"), F.instr(text, n), F.lit("name"), n)), lambda s: s["at"] > 0
    )
    return F.array_min(places)["name"]


def substitute(text: Column, names: Column, tokens: Column) -> Column:
    """Each name replaced by the token at the same place."""
    pairs = F.arrays_zip(names.alias("n"), tokens.alias("t"))
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p.getField("n"), p.getField("t")))


def play_type(text: Column, has: dict[str, Column]) -> Column:
    """Kind of play by precedence: a later rule beats an earlier one.

    ``has`` maps a role (``passer``, ``rusher``, ``punter``, ``kicker``) to
    whether the play names one.
    """

    def says(word: str) -> Column:
        return F.contains(text, F.lit(word))

    return (
        F.when(text.isNull(), F.lit(None))
        .when(says("coin toss"), "coin_toss")
        .when(says("Timeout"), "timeout")
        .when(has["kicker"] & says("field goal"), "field_goal")
        .when(has["kicker"] & says("extra point"), "extra_point")
        .when(has["kicker"] & says("kicks off"), "kickoff")
        .when(has["punter"], "punt")
        .when(has["rusher"], "run")
        .when(has["passer"] & says("kneels"), "kneel")
        .when(has["passer"] & says("sacked"), "sack")
        .when(has["passer"], "pass")
        .when(says("Penalty"), "penalty")
        .when(says("challenged"), "challenge")
    )


def play_flags(text: Column, has: dict[str, Column]) -> dict[str, Column]:
    known = text.isNotNull() & ~F.contains(text, F.lit("coin toss"))
    return {
        "is_fumble": known & has["fumbler"],
        "is_penalty": known & F.contains(text, F.lit("Penalty")),
        "is_challenge": known & F.contains(text, F.lit("challenged")),
        "is_block": known & has["blocker"],
        "contains_lateral": known & has["lateraler"],
    }


def number_after(text: Column, pattern: str) -> Column:
    """First number matched by ``pattern``'s group as an int, null when absent."""
    return F.regexp_extract(text, pattern, 1).try_cast("int")


FOR_YARDS = r"for (-?[0-9]+)"

# Run directions in the order in which they are tried.
RUN_DIRECTIONS = {
    "middle ": "m", "left end": "le", "right end": "re", "left tackle": "lt", "right tackle": "rt", "left guard": "lg", "right guard": "rg",
}


def run_direction(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for phrase, code in RUN_DIRECTIONS.items():
        out = out.when(F.contains(text, F.lit(phrase)), code)
    return out


def attributes(
    text: Column,
    kind: Column,
    rusher_positions: Column,
    togo: Column,
    down: Column,
    is_block: Column,
    by_offence: Column,
) -> dict[str, Column]:
    """Attributes of a play under its kind; null where the kind has none.

    ``by_offence``: whether the scorer's team has the ball (the kicking team on
    kick-offs and punts), null without a scorer.  It decides the side of a
    touchdown on kicks and blocks.
    """

    def says(word: str) -> Column:
        return F.contains(text, F.lit(word))

    def only(kinds: Sequence[str], value: Column) -> Column:
        return F.when(kind.isin(*kinds), value)

    gained = number_after(text, FOR_YARDS)
    returned = says("touchdown") & says("returned")
    scored = says("touchdown") & ~says("returned")
    by_passer = F.contains(rusher_positions, F.lit("QB"))
    by_scorer = F.coalesce(is_block | kind.isin("kickoff", "punt"), F.lit(False)) & says("touchdown")
    return {
        "pass_yards": only(["pass"], F.when(says("incomplete") | says("spiked") | says("no gain"), 0).otherwise(gained)),
        "completed": only(["pass"], gained.isNotNull() & ~says("intercepted")),
        "is_interception": only(["pass"], says("intercepted")),
        "is_spike": only(["pass"], says("spiked")),
        "rush_yards": only(["run"], gained),
        "run_direction": only(["run"], run_direction(text)),
        "is_qb_run": only(["run"], F.when(by_passer, True)),
        "is_wr_run": only(["run"], F.when(F.contains(rusher_positions, F.lit("WR")), True)),
        "is_sneak": only(["run"], F.when(by_passer & says("middle") & (togo <= 2) & (down >= 3), True)),
        "sack_yards": only(["sack"], gained),
        "is_off_touchdown": F.when(by_scorer, by_offence).otherwise(only(["pass", "run"], scored)),
        "is_def_touchdown": F.when(by_scorer, ~by_offence).otherwise(only(["pass", "run", "sack"], returned)),
        "kickoff_yards": only(["kickoff"], number_after(text, r"kicks off (-?[0-9]+)")),
        "punt_yards": only(["punt"], number_after(text, r"punts (-?[0-9]+)")),
        "return_yards": only(["kickoff", "punt"], gained),
        "is_touchback": only(["kickoff", "punt"], says("touchback")),
        "is_fair_catch": only(["punt"], says("fair catch")),
        "is_muffed": only(["punt"], says("muffed")),
        "is_good": F.when(kind == "field_goal", says("field goal good")).when(kind == "extra_point", says("extra point good")),
        "field_goal_yards": only(["field_goal"], number_after(text, r"(-?[0-9]+) yard")),
        "timeout_number": only(["timeout"], number_after(text, r"#([0-9])")),
        "timeout_team": only(["timeout"], F.regexp_extract(text, r" by (.+)$", 1)),
        "toss_winner": only(["coin_toss"], F.regexp_extract(text, r"^(\S+)", 1)),
        "toss_deferred": only(["coin_toss"], says("deferred")),
        "is_safety": F.when(kind.isNotNull() | is_block, says("safety")),
    }


def dispatch(flags: dict[str, Column], pens: Column) -> dict[str, Column]:
    """Whether the play's figures count, and its ``penalty_yards``, by its flags.

    A lateral or a fumble leaves nothing, penalties leave the play's figures only
    where the play stands besides them.
    """
    kept = ~(flags["contains_lateral"] | flags["is_fumble"])
    return {
        "counts": kept & F.when(flags["is_penalty"], play_stands(pens)).otherwise(True),
        "penalty_yards": F.when(kept & flags["is_penalty"], net_penalty_yards(pens)),
    }


def penalties(text: Column, togo: Column, next_togo: Column) -> Column:
    """Penalties of a line as ``array<struct<...>>`` in order of appearance."""
    dotted = F.regexp_replace(F.regexp_replace(text, r", Penalty", ". Penalty"), r"\) Penalty", "). Penalty")
    found = F.regexp_extract_all(dotted, F.lit(r"(Penalty.*?(?:\. |$))"), 1)
    against = F.coalesce(next_togo > togo, F.lit(False))

    def parse(p: Column) -> Column:
        yards = F.regexp_extract(p, r"([0-9]{1,2}) yards", 1).try_cast("int")
        return F.struct(
            F.trim(F.regexp_replace(F.regexp_extract(p, r": ([^,(]*)", 1), r"[.:]", "")).alias("type"),
            F.regexp_extract(p, r"(\S+):", 1).alias("penalizer"),
            F.coalesce(yards, F.when(F.contains(p, F.lit("1 yard")), 1), F.lit(0)).alias("yards"),
            F.contains(F.lower(p), F.lit("declined")).alias("declined"),
            F.contains(p, F.lit("(no play)")).alias("no_play"),
            (F.contains(p, F.lit("(offset)")) | F.contains(p, F.lit("(Offsetting)"))).alias("offset"),
            against.alias("against_possession"),
        )

    return F.filter(F.transform(found, parse), lambda p: F.length(p["type"]) > 0)


def _case(pens: Column) -> dict[str, Column]:
    return {
        "all_declined": F.forall(pens, lambda p: p["declined"]),
        "none_declined": ~F.exists(pens, lambda p: p["declined"]),
        "all_offset": F.forall(pens, lambda p: p["offset"]),
        "no_play": F.exists(pens, lambda p: p["no_play"]),
        "n": F.size(pens),
        "accepted": F.filter(pens, lambda p: ~p["declined"]),
        "sign": F.when(F.get(pens, F.lit(0))["against_possession"], -1).otherwise(1),
    }


def _sum(pens: Column) -> Column:
    return F.aggregate(pens, F.lit(0), lambda a, p: a + p["yards"])


def play_stands(pens: Column) -> Column:
    """Whether the play itself counts besides its penalties."""
    c = _case(pens)
    n, accepted = c["n"], F.size(c["accepted"])
    return (
        F.when(n == 0, True)
        .when(n == 1, c["all_declined"])
        .when(n.isin(2, 3) & c["all_declined"], True)
        .when(c["all_offset"] & n.isin(2, 3, 4, 6, 8), ~c["no_play"])
        .when(n == 3, ~c["no_play"] & accepted.isin(1, 2, 3))
        .when(n == 4, ~c["no_play"])
        .otherwise(False)
    )


def net_penalty_yards(pens: Column) -> Column:
    """Net yards by number of penalties (1, 2, 3, 4, 6, 8); null where none count."""
    c = _case(pens)
    n, sign, accepted = c["n"], c["sign"], F.size(c["accepted"])
    everything, kept = _sum(pens) * sign, _sum(c["accepted"])
    largest = F.array_max(F.transform(pens, lambda p: p["yards"])) * sign
    offset = F.when(~c["no_play"], everything)
    return (
        F.when(n == 1, F.when(~c["all_declined"], everything))
        .when(n.isin(2, 3) & c["all_declined"], F.lit(None))
        .when(n.isin(2, 3, 4, 6, 8) & c["all_offset"], offset)
        .when(n == 2, kept * sign)
        .when((n == 3) & c["no_play"], F.lit(None))
        .when((n == 3) & c["none_declined"], everything)
        .when((n == 3) & (accepted == 1), kept)
        .when((n == 3) & (accepted == 2), kept * sign)
        .when(n == 4, F.when(c["no_play"], largest).otherwise(everything))
    )


def challenge(text: Column) -> Column:
    """Challenged line as original play, ruling, replacement play, side and result."""
    pattern = r"^(.*?)((?:Replay Assistant|[A-Z]{3}) challenged.*?(?:overturned\.|upheld\.|$))(.*)$"
    original = F.trim(F.regexp_extract(text, pattern, 1))
    ruling = F.regexp_extract(text, pattern, 2)
    after = F.trim(F.regexp_extract(text, pattern, 3))
    overturned = F.contains(text, F.lit("overturned"))
    side = F.regexp_extract(ruling, r"\b([A-Z]{3}) challenged", 1)
    hit = F.contains(text, F.lit("challenged"))
    return F.when(
        hit,
        F.struct(
            F.when(original != "", original).alias("original"),
            ruling.alias("ruling"),
            F.when(after != "", after).alias("replacement"),
            F.when(side == "", "RA").otherwise(side).alias("side"),
            overturned.alias("overturned"),
        ),
    )


def effective_text(text: Column) -> Column:
    """The play that counts: the replacement of an overturned play, without its penalties."""
    c = challenge(text)
    play = F.when(c.isNull(), text).when(c["overturned"] & c["replacement"].isNotNull(), c["replacement"]).otherwise(c["original"])
    return F.rtrim(F.regexp_replace(F.coalesce(play, text), r"\.?\s*Penalty.*$", ""))


def scorer(text: Column, entities: Column) -> Column:
    """Id of the entity that ends closest before ``touchdown``.

    ``entities``: ``array<struct<p_id, start, end>>``.
    """
    at = F.instr(text, F.lit("touchdown")) - 1
    placed = F.transform(
        F.filter(entities, lambda e: e["end"] <= at), lambda e: F.struct((at - e["end"]).alias("gap"), e["p_id"].alias("p_id"))
    )
    return F.when(at >= 0, F.array_min(placed)["p_id"])


def named_scorer(text: Column, actors: Column) -> Column:
    """Id of the actor whose name ends closest before ``touchdown``.

    ``actors``: ``array<struct<name, id>>``.
    """
    head = F.substring_index(text, "touchdown", 1)
    placed = F.transform(
        F.filter(actors, lambda a: F.contains(head, a["name"])),
        lambda a: F.struct(F.length(F.call_function("substring_index", head, a["name"], F.lit(-1))).alias("gap"), a["id"].alias("id")),
    )
    return F.when(F.contains(text, F.lit("touchdown")), F.array_min(placed)["id"])


def parse_entities(cell: Column) -> Column:
    """``id:start:end|...`` to ``array<struct<p_id, start, end>>``."""
    return F.transform(
        F.split(cell, r"\|"),
        lambda e: F.struct(
            F.split_part(e, F.lit(":"), F.lit(1)).alias("p_id"),
            F.split_part(e, F.lit(":"), F.lit(2)).cast("int").alias("start"),
            F.split_part(e, F.lit(":"), F.lit(3)).cast("int").alias("end"),
        ),
    )


def token_at_span(text: Column, ids_text: Column, start: Column, name: Column, earlier: Column) -> Column:
    """Token of the parallel id text for a name at ``start``.

    In the id text a name is one token, so the token number is the number of
    blanks before the span less the blanks inside earlier names.
    """
    before = F.substring(text, F.lit(1), start)
    blanks = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    inner = F.aggregate(
        F.filter(earlier, lambda e: e["start"] < start),
        F.lit(0),
        lambda acc, e: acc + F.length(e["name"]) - F.length(F.replace(e["name"], F.lit(" "), F.lit(""))),
    )
    token = F.get(F.split(ids_text, " "), blanks - inner)
    return F.regexp_replace(token, r"^[(]+|[),.:]+$", "")


def normal_tokens(text: Column, positions: Column | None = None) -> Column:
    """Words in lower case, numbers as ``number``; ids as their position where a map is given."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    out = F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("number")).otherwise(w))
    if positions is None:
        return out
    return F.transform(out, lambda w: F.coalesce(F.try_element_at(positions, w), w))


def kick_in_parentheses(text: Column) -> Column:
    return text.rlike(r"\(.*kick").cast("int")


def penalty_keyword(text: Column) -> Column:
    """Words after a colon, up to a comma, without bracketed remarks."""
    raw = F.regexp_extract_all(text, F.lit(r": ([^,\n]+)"), 1)
    return F.transform(raw, lambda k: F.trim(F.regexp_replace(k, r"\(.*?\)", "")))
