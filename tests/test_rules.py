"""Golden tests of scalars, scoring, text, standings and ratings."""

import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods as P
from tidemark.functions import playtext as T
from tidemark.functions import scalars as S
from tidemark.functions import scoring as Z
from tidemark.operators import lineups as L
from tidemark.operators import lookups as J
from tidemark.operators import models as M
from tidemark.operators import ratings as R
from tidemark.operators import standings as St
from tidemark.operators.sides import sides
from tidemark.sources import files as Fi
from tidemark.sources import landed as La
from tidemark.streaming import incremental as I


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_scalars(spark):
    w = F.lit("65 degrees, relative humidity 40%, wind 8 mph")
    none = F.lit(None).cast("string")
    got = one(
        spark, S.record_ratio(F.lit("10-5-1")), S.record_ratio(none), S.first_word_code(F.lit("Field North")), S.weather(w), S.weather(none),
        S.weather(F.lit("70 degrees")), S.clock_seconds(none), S.clock_seconds(F.lit("2:05")), S.kickoff_bucket(F.lit("8:20pm")), S.kickoff_bucket(F.lit("9:30am")),
        S.percent_fraction(F.lit("45%")), P.period_of(F.lit("3 | 2011")), P.market_period(F.lit("23WK05")), P.next_label(F.lit("4 | 2020"), F.lit(True)),
        S.project_volume(F.lit(50.0), F.lit(0.5)), S.event_code(F.lit(7)), S.event_points(F.lit("td|two")), S.event_points(F.lit("td|nex")),
    )
    assert list(got) == [0.6875, 0.0, 484, "65|40|8", "Dome", "70|65|0", 180, 125, 2, 0, 0.45, 201103, "5 | 2023", "1 | 2021", 100.0, "td|ex", 8, 6]


def test_rounding_is_half_even(spark):
    assert list(one(spark, *[S.round_half_even(F.lit(x)) for x in (0.5, 1.5, 2.5)])) == [0, 2, 2]


def test_spreads(spark):
    home = S.signed_spread(F.lit(True), S.spread(F.lit("Some Team -3.5")))
    pick = S.signed_spread(F.lit(False), S.spread(F.lit("Pick")))
    got = one(spark, home, pick, S.favourite(F.lit("Oakland Raiders -3.0")), S.over_under_hit(F.lit("44.5 (over)"), F.lit(45)), S.spread_covered(F.lit(True), F.lit(3.5), F.lit(24), F.lit(20)))
    assert tuple(got[0]) == (-3.5, 3.5, 1) and tuple(got[1]) == (0, 0, 0) and list(got)[2:] == ["LasVegasRaiders", 1, 1]


def test_scoring(spark):
    d = spark.createDataFrame([(301, 2, 1, 25, 0, 0, 0, 0)], "passing_yards int, passing_touchdowns int, interceptions_thrown int, rush_yards int, rush_touchdowns int, receptions int, receiving_yards int, receiving_touchdowns int")
    assert d.select(Z.passer_points()).first()[0] == pytest.approx(24.54)
    d = spark.createDataFrame([(101, 1, 4, 40, 0)], "rush_yards int, rush_touchdowns int, receptions int, receiving_yards int, receiving_touchdowns int")
    assert d.select(Z.skill_points()).first()[0] == pytest.approx(27.1)
    wide = d.withColumn("rush_yards_per_attempt", F.lit(10.0))
    assert wide.select(Z.points_of(wide.columns)).first()[0] == pytest.approx(27.1)
    assert wide.select(Z.points_of(wide.columns, substring=True)).first()[0] == pytest.approx(28.1)


@pytest.mark.parametrize(
    "line, names",
    [
        # A suffix, a double given name, a particle, an apostrophe, inner capitals, initials.
        ("Nils Ormond IV right end for 7 yards", ["Nils Ormond IV"]),
        ("Pip Pip Ashdown-Reef left guard for 1 yards", ["Pip Pip Ashdown-Reef"]),
        ("Udo van Laar sacked by Q'Enzo Birch for -6 yards", ["Udo van Laar", "Q'Enzo Birch"]),
        ("LeVon McTavish-Dorn kneels for -1 yards", ["LeVon McTavish-Dorn"]),
        ("W.B. O'Hallow pass incomplete deep left intended for Yan-Li St. Amour", ["W.B. O'Hallow", "Yan-Li St. Amour"]),
        ("KZ Plum left tackle for 2 yards. Penalty on Odo von Trast: Defensive Holding, 5 yards (declined)", ["KZ Plum", "Odo von Trast"]),
        ("Ida F. Nook punts 41 yards, fair catch by Gus Penn Sr.. Penalty on Tam-O Rusk: Holding, 10 yards", ["Ida F. Nook", "Gus Penn Sr", "Tam-O Rusk"]),
        ("Timeout #2 by North Harbor Gulls", ["North Harbor Gulls"]),
        ("Timeout #1 by Port Vale 88ers", ["Port Vale 88ers"]),
        ("Timeout #3 by Lakeside Old Town Club", ["Lakeside Old Town Club"]),
        ("Timeout #1 by Harbor Gulls at 02:10", ["Harbor Gulls"]),
        ("Kiri-Ann Sable fumbles, recovered by Lo'ran Dey", ["Kiri-Ann Sable", "Lo'ran Dey"]),
        ("Ben Ode kicks off 58 yards, returned by Max DuVall for 20 yards (tackle by Jo Ury)", ["Ben Ode", "Max DuVall", "Jo Ury"]),
    ],
)
def test_person_names(spark, line, names):
    assert one(spark, T.person_names(F.lit(line)))[0] == names


GIVEN = ["Tom", "D'Or", "Ja'Ron", "CeeDee", "Ray-Ray", "J.K.", "AJ"]
LAST = ["Smith", "O'Neil", "McCarthy", "Fair-Bairn", "DeLong"]


def test_every_given_and_last_name_combine(spark):
    """Every combination is found as exactly one name."""
    all_names = [f"{g} {l}" for g in GIVEN for l in LAST]
    d = spark.createDataFrame([(n,) for n in all_names], "n string")
    bad = d.filter(F.to_json(T.person_names(F.concat("n", F.lit(" left tackle for 3 yards")))) != F.to_json(F.array("n"))).collect()
    assert bad == []


def test_spans_and_leading_name(spark):
    text = F.lit("Al Bo hands to Cy Do, Al Bo blocks")
    got = one(spark, T.spans(text, F.lit("Al Bo")), T.leading_name(text, F.array(*lit("Cy Do", "Al Bo"))))
    assert [tuple(x) for x in got[0]] == [(0, 5), (22, 27)] and got[1] == "Al Bo"


def roles(**on):
    keys = ("passer", "rusher", "punter", "kicker", "fumbler", "blocker", "lateraler")
    return {k: F.lit(bool(on.get(k))) for k in keys}


def test_play_types(spark):
    cases = [("X sacked by Y", {"passer": 1}, "sack"), ("X kneels", {"passer": 1}, "kneel"), ("X left end", {"passer": 1, "rusher": 1}, "run"), ("X extra point good", {"kicker": 1}, "extra_point"),
             ("Timeout #1 by T", {"passer": 1}, "timeout"), ("coin toss won", {"passer": 1}, "coin_toss"), ("Penalty on X: Offside", {}, "penalty"), ("ABC challenged it", {}, "challenge"), ("nothing", {}, None)]
    for line, on, want in cases:
        assert one(spark, T.play_type(F.lit(line), roles(**on)))[0] == want


def test_run_attributes(spark):
    a = T.attributes(F.lit("X left guard for 4 yards"), F.lit("run"), F.lit("QB"), F.lit(1), F.lit(3), F.lit(False), F.lit(None))
    got = one(spark, a["run_direction"], a["rush_yards"], a["is_qb_run"], a["is_sneak"], a["pass_yards"])
    assert list(got) == ["lg", 4, True, None, None]


def test_side_of_a_touchdown_on_kicks_and_blocks(spark):
    def side(line, kind, block, by):
        a = T.attributes(F.lit(line), F.lit(kind), F.lit(None).cast("string"), F.lit(1), F.lit(1), F.lit(block), F.lit(by).cast("boolean"))
        return tuple(one(spark, a["is_off_touchdown"], a["is_def_touchdown"]))

    assert side("A kicks off 60 yards, returned by B for 99 yards, touchdown", "kickoff", False, False) == (False, True)
    assert side("A punts 40 yards, muffed, recovered by C, touchdown", "punt", False, True) == (True, False)
    assert side("A 45 yard field goal no good blocked by B, touchdown", "field_goal", True, False) == (False, True)
    assert side("A 45 yard field goal good", "field_goal", False, None) == (None, None)
    assert side("A pass to B for 9 yards, touchdown", "pass", False, None) == (True, False)
    assert side("blocked by B, touchdown", None, True, False) == (False, True)


def test_every_combination_of_flags(spark):
    """A lateral or fumble leaves nothing, penalties decide about the rest."""
    names = ("is_fumble", "is_penalty", "is_challenge", "is_block", "contains_lateral")
    flags = spark.createDataFrame(list(product([True, False], repeat=5)), ", ".join(f"{n} boolean" for n in names))
    cols = {n: F.col(n) for n in names}
    for line, yards, stands in [("X runs. Penalty on A: Holding, 10 yards. ", -10, False), ("X runs. Penalty on A: Offside, 5 yards (declined). ", None, True)]:
        for r in flags.select("*", *[v.alias(k) for k, v in T.dispatch(cols, pens(line)).items()]).collect():
            kept = not (r.is_fumble or r.contains_lateral)
            assert r.counts == (kept and (stands or not r.is_penalty))
            assert r.penalty_yards == (yards if kept and r.is_penalty else None)


def test_named_scorer(spark):
    actors = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("id")) for i, n in enumerate(["Al Bo", "Al Bor", "Cy Do"])])
    lines = ["Al Bor passes to Al Bo for 9 yards, touchdown. Cy Do kicks", "Cy Do kneels", "Cy Do blocked, touchdown"]
    assert list(one(spark, *[T.named_scorer(F.lit(x), actors) for x in lines])) == [0, None, 2]


def pens(line, togo=5, nxt=15):
    return T.penalties(F.lit(line), F.lit(togo), F.lit(nxt))


def test_penalties(spark):
    p = one(spark, pens("X pass incomplete. Penalty on Y: Holding, 10 yards (no play)"))[0]
    assert len(p) == 1 and p[0].type == "Holding" and p[0].penalizer == "Y" and p[0].yards == 10 and p[0].no_play and not p[0].declined and p[0].against_possession


def test_penalty_case_table(spark):
    base = "X runs."
    acc, dec, off = " Penalty on A: Holding, 10 yards.", " Penalty on B: Offside, 5 yards (declined).", " Penalty on C: Taunting, 15 yards (offset)."
    cases = [
        (base + acc, -10, False), (base + dec, None, True), (base + dec + dec, None, True), (base + acc + acc, -20, False), (base + acc + dec, -10, False),
        (base + off + off, -30, True), (base + acc + acc + acc, -30, True), (base + acc + dec + dec, 10, True), (base + acc + acc + dec, -20, True),
        (base + acc + acc + acc + dec, -35, True), (base + off * 6, -90, True), (base + acc * 6, None, False),
    ]
    for line, yards, stands in cases:
        p = pens(line + " ")
        got = one(spark, T.net_penalty_yards(p), T.play_stands(p))
        assert tuple(got) == (yards, stands), line


def test_challenge(spark):
    line = "Q punts 44 yards. CIN challenged the kick touched ruling, and the original play was overturned. Q punts 40 yards"
    c = one(spark, T.challenge(F.lit(line)), T.effective_text(F.lit(line)))
    assert (c[0].original, c[0].replacement, c[0].side, c[0].overturned) == ("Q punts 44 yards.", "Q punts 40 yards", "CIN", True)
    assert c[1] == "Q punts 40 yards"


def test_scorer_and_span_token(spark):
    ents = T.parse_entities(F.lit("A1:0:5|B2:40:46"))
    assert one(spark, T.scorer(F.lit("Al Bo 45 yard field goal no good blocked Cy Dee, touchdown"), ents))[0] == "B2"
    earlier = F.array(F.struct(F.lit(0).alias("start"), F.lit("Al Bo").alias("name")))
    assert one(spark, T.token_at_span(F.lit("Al Bo to Cy Do."), F.lit("A1 to C2."), F.lit(9), F.lit("Cy Do"), earlier))[0] == "C2"


def matches(spark, data):
    return spark.createDataFrame(data, "match_id long, season long, week long, period long, home long, away long, home_points long, away_points long, winner long")


def test_rating_golden(spark):
    data = [(1, 2000, 1, 200001, 1, 2, 27, 20, 1), (2, 2000, 2, 200002, 1, 3, 17, 20, 3)]
    last = {(r.team, r.period): r.rating for r in R.pair_ratings(matches(spark, data)).collect()}
    # After the last period the season may go on: no pull yet.
    assert last[1, 200003] == pytest.approx(1502.725083, abs=1e-5) and last[3, 200003] == pytest.approx(1505.687682, abs=1e-5)
    m = matches(spark, [*data, (3, 2001, 1, 200101, 1, 2, 7, 3, 1)])
    got = {(r.team, r.period): r.rating for r in R.pair_ratings(m).collect()}
    assert got[1, 200001] == 1500 and got[1, 200002] == pytest.approx(1508.412765, abs=1e-5) and got[2, 200002] == pytest.approx(1491.587235, abs=1e-5)
    # A new season's first match finds the pulled ratings.
    assert got[2, 200101] == pytest.approx(1494.940427, abs=1e-5)
    assert got[1, 200101] == pytest.approx(0.75 * 1502.725083 + 0.25 * 1505, abs=1e-5)
    assert got[3, 200101] == pytest.approx(0.75 * 1505.687682 + 0.25 * 1505, abs=1e-5)


def test_ratings_resume_equals_full_run_and_coach_rule(spark):
    m = matches(spark, [(1, 2000, 1, 200001, 1, 2, 27, 20, 1), (4, 2000, 1, 200001, 3, 4, 7, 3, 3), (2, 2001, 1, 200101, 2, 1, 10, 3, 2), (3, 2001, 2, 200102, 1, 2, 9, 9, None)])
    full = {(r.team, r.period): r.rating for r in R.pair_ratings(m).collect()}
    stored = R.pair_ratings(m.filter("period < 200101"))
    again = {(r.team, r.period): r.rating for r in I.advance_ratings(stored, m).collect()}
    assert again.keys() == full.keys() and all(math.isclose(again[k], full[k], abs_tol=1e-9) for k in full)
    # A state that ends inside a season, and one with nothing new.
    early = R.pair_ratings(m.filter("period < 200102"))
    again = {(r.team, r.period): r.rating for r in I.advance_ratings(early, m).collect()}
    assert again.keys() == full.keys() and all(math.isclose(again[k], full[k], abs_tol=1e-9) for k in full)
    late = R.pair_ratings(m)
    assert sorted(map(tuple, I.advance_ratings(late, m).collect())) == sorted(map(tuple, late.collect()))
    assert R.pair_ratings(m.limit(0)).count() == 0
    holders = spark.createDataFrame([(1, 2001, 1), (2, 2001, 0)], "team long, season long, new_holder int")
    coach = {(r.team, r.period): r.rating for r in R.pair_ratings(m, holders=holders).collect()}
    assert coach[1, 200101] == 1500 and coach[2, 200101] == pytest.approx(1491.587235, abs=1e-5)


def test_player_rating_closed_form_equals_recursion(spark):
    data = [(1, 2000, 200001, 12.0), (1, 2000, 200002, 8.0), (1, 2002, 200201, 5.0), (1, 2002, 200203, 1.0), (1, 2003, 200301, 2.0)]
    gains = spark.createDataFrame(data, "player long, season long, period long, gain double")
    for elapsed in ("calendar", "played"):
        got = [r.rating for r in R.player_ratings(gains, elapsed=elapsed).orderBy("period").collect()]
        e, last, want = 100.0, None, []
        for _, season, _, g in data:
            if last is not None and season != last:
                for _ in range(season - last if elapsed == "calendar" else 1):
                    e = 100 + (e - 100) / 10
            e, last = e + g, season
            want.append(e)
        assert got == pytest.approx(want)


def test_schedule_strength_golden(spark):
    m = matches(spark, [(1, 2000, 1, 200001, 1, 2, 27, 20, 1)])
    s = sides(m, ["points"])
    d = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "team long, division long, conference long")
    out = St.with_schedule_strength(St.running_standings(s, d)).orderBy("team").collect()
    assert [(r.sos, r.sov, r.ratio) for r in out] == [(0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]


def test_win_ratio(spark):
    assert one(spark, St.win_ratio(*lit(1, 1, 1)))[0] == 0.5


def test_lineups(spark):
    d = spark.createDataFrame([("t", "1:QB|2:RB")], "team string, starters string")
    e = L.explode(d)
    assert [tuple(r) for r in e.orderBy("slot").collect()] == [("t", 1, "1", "QB"), ("t", 2, "2", "RB")]
    assert L.implode(e, ["team"]).first()["starters"] == "1:QB|2:RB"
    ids = spark.createDataFrame([("g", i) for i in (5, 2, 25, 2)], "k string, player long")
    assert [tuple(r) for r in L.paged_list(ids, ["k"], "player", page_rows=10).orderBy("page").collect()] == [("g", 0, "2|5"), ("g", 2, "25")]


def test_names_resolve_by_context_and_only_when_unique(spark):
    players = spark.createDataFrame([("p1", "Al Bo", 1), ("p2", "Al Bo", 2), ("p3", "Cy Do", 1), ("p4", "Cy Do", 1)], "p_id string, name string, team int")
    aka = spark.createDataFrame([("p2", "Ally Bo")], "p_id string, aka string")
    m = spark.createDataFrame([("Al Bo", 1), ("Al B. Bo", 2), ("Ally Bo", 2), ("Cy Do", 1)], "n string, team int")
    out = {(r.n, r.team): r.p_id for r in J.resolve_names(m, players, aka, "n", ["team"]).collect()}
    assert out == {("Al Bo", 1): "p1", ("Al B. Bo", 2): "p2", ("Ally Bo", 2): "p2", ("Cy Do", 1): None}


def test_sources(spark, tmp_path):
    assert Fi.normalise_header(["Quarter", "ABC", "XYZ", "EPB"]) == ["quarter", "away_points", "home_points", "epb"]
    pages = spark.createDataFrame([(1, '<a href="/t/aaa">A</a><a href="/m/1.htm">x</a><a href="/t/bbb">B</a><a href="/t/ccc">C</a>')], "page_id int, html string")
    assert [tuple(r) for r in La.schedule_rows(pages, ["page_id"]).collect()] == [(1, 0, "/t/aaa", "/m/1.htm", "/t/bbb")]
    assert pages.select(La.anchors_to_ids(F.lit('<td><a href="/players/B/BoAl01.htm">Al Bo</a> kneels</td>'))).first()[0] == "BoAl01 kneels"
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert Fi.materialize(spark, str(tmp_path / "t"), build).count() == 3
    assert calls == [1]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    for batch in (a, a, spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")):
        I.append_new(spark, path, batch, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "y"), (3, "w")]


def test_p_values_and_selection(spark):
    import random

    rnd = random.Random(5)
    data = [(float(x), rnd.random(), 1.0, 3.0 * x + rnd.random()) for x in range(200)]
    d = spark.createDataFrame(data, "x double, noise double, flat double, y double")
    p = M.p_values(d, ["x", "noise", "flat"], "y")
    assert p["x"] < 1e-6 and p["noise"] > 0.01 and p["flat"] == 1.0
    assert M.select_columns(d, ["x", "noise", "flat"], "y", 0.001) == ["x"]


def test_p_values_match_the_solver_and_survive_dependent_columns(spark):
    from pyspark.ml.regression import LinearRegression

    d = spark.range(200).select(
        (F.col("id") % 17).alias("a"), (F.xxhash64("id") % 13).alias("b"), (F.col("id") % 17 * 3 + F.xxhash64("id", F.lit(1)) % 40).alias("y")
    )
    want = LinearRegression(solver="normal").fit(M.assembled(d, ["a", "b"], "y").select("features", "label")).summary.pValues
    got = M.p_values(d, ["a", "b"], "y")
    assert math.isclose(got["a"], want[0], rel_tol=1e-6, abs_tol=1e-12) and math.isclose(got["b"], want[1], rel_tol=1e-6)
    # Won and lost: each is the other's complement, and both carry the effect.
    both = M.p_values(d.withColumn("c", 16 - F.col("a")), ["a", "c", "b"], "y")
    assert both["a"] < 1e-6 and math.isclose(both["a"], both["c"], rel_tol=1e-6, abs_tol=1e-12)


def test_models_per_group_on_several_columns(spark):
    rows = [(g, float(x), float(x * x), None, 1.0 + g * x + 2 * x * x) for g in (1, 2) for x in range(6)]
    d = spark.createDataFrame([(*r[:3], r[1] * 2, r[4]) for r in rows] + [(1, 7.0, 49.0, 14.0, None)], "g int, a double, b double, c double, y double")
    got = {r.g: r for r in M.grouped_planes(d, ["g"], ["a", "b"], "y").collect()}
    assert got[2].intercept == pytest.approx(1) and got[2].coefficients == pytest.approx([2, 2])
    # Dependent columns: the same fitted values, finite weights.
    assert M.impute_with_planes(d, ["g"], ["a", "c", "b"], "y").filter("a = 7").first().y == pytest.approx(1 + 7 + 98)


def test_append_reads_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    one_batch = spark.createDataFrame([(1, 1, 2020), (2, 1, 2020), (3, 1, 2021), (4, 1, None)], "k int, v int, season int")
    two = spark.createDataFrame([(2, 9, 2020), (5, 9, 2020), (4, 9, None), (6, 9, 2022)], "k int, v int, season int")
    I.append_new(spark, path, one_batch, ["k"], "season")
    # A broken file in a partition that the batch does not touch is never opened.
    for f in (tmp_path / "t" / "season=2021").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "t" / "season=2021").glob(".*.crc"):
        f.unlink()
    schema = "k int, v int, season int"
    I.append_new(spark, path, two, ["k"], "season")
    got = spark.read.schema(schema).parquet(path).filter("season IS NULL OR season <> 2021")
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, 1), (2, 1), (4, 1), (5, 9), (6, 9)]
