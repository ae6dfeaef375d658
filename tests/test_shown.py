"""What is shown, against hand-computed rows."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from matchmill.operators import monitor, shown
from matchmill.sources import sinks

DAY = dt.date(2024, 5, 1)


def test_match_fields(spark):
    rows = [
        (1, "L", "", None, "", 0, 0.0, float("nan"), False, (1, 2), "x"),
        (2, None, "A", "B", "FT", 3, 1.08, 7.0, True, None, "x"),
    ]
    m = spark.createDataFrame(rows, "match_id int, league string, home_team_name string, away_team_name string, status string, minute_value int, importance double, home_elo double, lineup boolean, odds struct<home:int,away:int>, secret string")
    out = [json.loads(r[0]) for r in shown.match_fields(m).select(F.to_json(F.struct("*"))).collect()]
    assert out[0] == {"match_id": 1, "league": "L", "home_team_name": "Home", "away_team_name": "Away", "status": "NS", "minute_value": 0, "importance": 0.0, "odds": {"home": 1, "away": 2}}
    assert out[1] == {"match_id": 2, "home_team_name": "A", "away_team_name": "B", "status": "FT", "minute_value": 3, "importance": 1.08, "home_elo": 7.0, "lineup": True}
    assert shown.match_fields(m.limit(0)).count() == 0


def test_with_places(spark):
    """The last table that holds a team counts, a place of 0 is none, and a row without a team keeps its own."""
    m = spark.createDataFrame([(1, 10, 20, 5, 0), (2, 30, None, 7, 8), (3, 40, 10, 0, 1)], "match_id int, home_team_id int, away_team_id int, home_position int, away_position int")
    tables = spark.createDataFrame([(10, 0, 3), (10, 1, 9), (20, 0, 4), (40, 0, 0), (None, 1, 1)], "team_id int, ord int, position int")
    out = {r["match_id"]: (r["home_position"], r["away_position"]) for r in shown.with_places(m, tables).collect()}
    assert out == {1: (9, 4), 2: (7, 8), 3: (None, 9)}


def test_knockouts(spark):
    rows = [(1, DAY, "cup", None, None, "R1", "FT"), (2, DAY, None, True, None, "", "halted"), (3, DAY, None, False, "a · play-off druk", None, "LIVE"), (4, DAY, None, None, "topstrijd", "R1", "FT")]
    m = spark.createDataFrame(rows, "match_id int, match_date date, league_type string, active boolean, context string, round_label string, status string")
    out = [(r["match_id"], r["round_key"], r["status"], r["place"]) for r in shown.knockouts(m).orderBy("match_id").collect()]
    assert out == [(1, "R1", "FT", 1), (2, "Knock-out", "NS", 2), (3, "Knock-out", "LIVE", 3)]


def test_referee_profile(spark):
    rows = [(1, "R", None, None, None, 2.0, 0.5, 4.0, 0.0, 0.0, 0.5, 0.5), (2, "R", 4.8, 0.3, 12, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.0), (3, "", 4.8, 0.3, 12, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.0), (4, "R", None, None, 2, 9.0, 9.0, 9.0, 9.0, 1.0, 1.0, -3.0)]
    names = "match_id int, referee string, known_cards double, known_penalties double, known_games int, home_yellow_rate double, home_red_rate double, away_yellow_rate double, away_red_rate double, home_over25_rate double, away_over25_rate double, market_over_diff double"
    out = {r["match_id"]: (r["cards_trend"], r["penalty_rate"], r["strictness"], r["source"], r["known_games"]) for r in shown.referee_profile(spark.createDataFrame(rows, names)).collect()}
    assert out[1] == (3.45, 0.13, "gemiddeld", "estimate", 0)  # (2.9 + 4) / 2; 0.45 * 0.12 + 0.5 * 0.12 + 0.5 * 0.04
    assert out[2] == (4.8, 0.3, "streng", "history", 12) and out[3] == (None,) * 5
    assert out[4] == (25.2, 0.24, "streng", "history", 2)


def test_venue_edges(spark):
    rows = [(1, 2, 2.0, 1.0, 1, 1.5, 0.5, 0.22, "cup"), (2, 0, 9.0, 9.0, None, 9.0, 9.0, None, None), (3, 1, 0.0, 1.0, 1, 1.0, 1.0, 0.1, None)]
    names = "match_id int, home_split_games int, home_split_scored double, home_split_conceded double, away_split_games int, away_split_scored double, away_split_conceded double, away_travel_penalty double, league_type string"
    out = {r["match_id"]: (r["venue_edge"], r["travel_penalty"], r["travel_burden"]) for r in shown.venue_edges(spark.createDataFrame(rows, names)).collect()}
    assert out == {1: (2.0, 0.22, "cup trip"), 2: (0.0, 0.0, "none"), 3: (0.35, 0.1, "trip")}


def test_merged_absences(spark):
    kind = "struct<injured:int,suspended:int,doubts:int,rating:double,missing:array<string>,banned:array<string>,source:string>"
    rows = [
        (1, (2, 0, None, 6.5, ["a", "b", "a"], None, ""), (1, 3, 1, 9.0, ["b", "c", "d", "e", "f"], ["x", "x", "y"], "page")),
        (2, (2, 0, None, 6.5, ["a", "a"], None, "feed"), None), (3, None, (None, None, None, None, None, None, None)), (4, None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, base {kind}, extra {kind}").select("id", shown.merged_absences(F.col("base"), F.col("extra")).alias("x"))
    out = {r["id"]: r["x"] and tuple(r["x"]) for r in df.collect()}
    assert out[1] == (2, 3, 1, 6.5, ["a", "b", "c", "d", "e"], ["x", "y"], "page")
    assert out[2] == (2, 0, None, 6.5, ["a", "a"], None, "feed") and out[3] == (0, 0, 0, 0.0, [], [], "players") and out[4] is None


def test_key_signals(spark):
    names = "context string, active boolean, aggregate_score string, elo_diff double, rest_diff double, h2h_results int, h2h_home_wins int, h2h_draws int, h2h_away_wins int, lineups_confirmed boolean, league_reliability double, phase_reliability double, strictness string"
    rows = [("derby", True, "3-2", -80.0, 2.0, 3, 1, 0, 2, True, 0.5, 0.5, "streng"), ("", None, "1-1", 0.0, -0.5, 2, 1, 1, 0, False, 0.0, 0.745, "streng"), (None, True, "", None, -1.5, None, None, None, None, None, None, None, None)]
    out = [r[0] for r in spark.createDataFrame(rows, names).coalesce(1).select(shown.key_signals(spark.createDataFrame(rows, names))).collect()]
    assert out == [["derby", "aggregate 3-2", "rating -80", "rest +2d", "meetings 1-0-2"], ["league 0%", "phase 75%", "referee streng"], ["rest -1.5d"]]


def history(spark):
    rows = [
        (1, DAY, "A", "Ajax", "PSV", "2-1", "2-1 ", None, None, None), (2, DAY, "A", "Ajax", None, "1-1", "0-2", None, "", None), (3, DAY, None, "X", "Y", "0-1", "1-2", "Thuis", None, None),
        (4, DAY, "B", "X", "Ajax", "1-0", "2-0", None, None, False), (5, DAY, "B", "X", "Y", "?", "", None, None, None), (6, DAY, "B", "X", "Y", "3-0", "0-3", None, None, None),
    ]
    return shown.hydrated(spark.createDataFrame(rows, "match_id int, match_date date, league string, home_team string, away_team string, prediction string, actual_score string, predicted_outcome string, actual_outcome string, winner_correct boolean"))


def test_history(spark):
    h = history(spark).cache()
    out = {r["match_id"]: (r["predicted_outcome"], r["actual_outcome"], r["winner_correct"], r["was_correct"]) for r in h.collect()}
    assert out == {1: ("Thuis", "Thuis", True, True), 2: ("Gelijk", "Uit", False, False), 3: ("Thuis", "Uit", False, False), 4: ("Thuis", "Thuis", False, False), 5: (None, None, True, False), 6: ("Thuis", "Uit", False, False)}
    ids = lambda **kw: sorted(r[0] for r in h.filter(shown.kept_history(**kw)).select("match_id").collect())
    assert ids() == [1, 2, 3, 4, 5, 6] and ids(mode="score") == [1] and ids(mode="uitkomst") == [1, 5] and ids(mode="fout") == [2, 3, 4, 6]
    assert ids(mode="fout", league="B") == [4, 6] and ids(search="AJAX") == [1, 2, 4] and ids(search="ajax a") == [] and ids(search="y b") == [5, 6]


def test_page_by_league(spark):
    """A has half its scores right, B none but a third of its outcomes; a league without a name comes last."""
    page = lambda n, size: [(r["match_id"], r["league"], r["league_place"]) for r in shown.page_by_league(history(spark), shown.kept_history(), n, size).orderBy("league_place", "at").collect()]
    assert page(1, 80) == [(1, "A", 1), (2, "A", 1), (4, "B", 2), (5, "B", 2), (6, "B", 2), (3, "Onbekend", 3)]
    assert page(2, 4) == [(5, "B", 1), (6, "B", 1)] and page(3, 4) == []


def issues(spark):
    rows = [(DAY, 1, "k", "m", "low"), (DAY, 2, "k", "m", "high"), (DAY, 3, "j", "m", "high"), (DAY, 4, "k", "n", "medium"), (DAY + dt.timedelta(1), 5, "z", None, None)]
    return spark.createDataFrame(rows, "day date, ord int, key string, message string, severity string")


def test_proposals(spark):
    """The first of each key and message counts, with its severity; an unknown severity is low."""
    out = monitor.proposals(issues(spark), {"k": (("a", "b"), "why k")}, (("b", "c"), "other")).orderBy("day", "priority").collect()
    assert [(r["priority"], r["key"], r["message"], r["why"], r["places"], r["places_of_day"]) for r in out] == [
        (1, "j", "m", "other", ["b", "c"], 3), (2, "k", "n", "why k", ["a", "b"], 3), (3, "k", "m", "why k", ["a", "b"], 3), (1, "z", None, "other", ["b", "c"], 2),
    ]


def test_write_digest(spark, tmp_path):
    rows = [(DAY, dt.datetime(2024, 5, 1, 8), "k", 3, "m"), (DAY, dt.datetime(2024, 5, 1, 9), "j", 1, None), (DAY, dt.datetime(2024, 5, 1, 9), "j", 2, "n")]
    i = spark.createDataFrame(rows, "day date, ts timestamp, key string, severity_rank int, message string")
    sinks.write_digest(monitor.digest(i), monitor.digest_totals(i), str(tmp_path))
    found = spark.read.json(f"{tmp_path}/json").first()
    assert (found["issues"], found["runs"], [(x["place"], x["key"], x["severity"]) for x in found["findings"]]) == (3, 2, [(1, "j", 2), (2, "k", 3)])
    text = [line for f in sorted(os.listdir(tmp_path / "markdown")) if f.endswith(".txt") for line in (tmp_path / "markdown" / f).read_text().splitlines()]
    assert text[0] == "# Digest" and text[2:5] == ["- Runs: 2", "- Findings: 3", "- Kinds: 2"] and text[-2].startswith("- j (2x, severity 2)") and text[-1] == "- k (1x, severity 3): m"
    sinks.write_digest(monitor.digest(i.limit(0)), monitor.digest_totals(i.limit(0)), f"{tmp_path}/none")
    assert spark.read.text(f"{tmp_path}/none/markdown").count() == 7
