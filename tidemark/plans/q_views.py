"""Spines and shapes: the views themselves, side-relative rows, spines, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.testbed import Tables, views


@query("PF-1 PF-5 PF-25 A-1", views("matches") + " SELECT * FROM matches")
def match_view(t: Tables) -> DataFrame:
    return t.matches


@query("PF-3 PF-4 PF-25", views("sides") + " SELECT * FROM sides")
def side_rows(t: Tables) -> DataFrame:
    return t.sides


@query("F-28 A-13 PF-24", views("lineups") + " SELECT * FROM lineups")
def lineup_cells(t: Tables) -> DataFrame:
    return t.lineups


@query("T-18", views("plays") + " SELECT * FROM plays")
def play_lines(t: Tables) -> DataFrame:
    return t.plays


@query("F-27", views("players") + " SELECT * FROM players")
def player_dimension(t: Tables) -> DataFrame:
    return t.players
