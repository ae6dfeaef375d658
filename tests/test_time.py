"""Joins on time and folds in order against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from matchmill.operators import asof, before, sequence

T0 = dt.datetime(2024, 1, 1)


def test_nearest_reading(spark):
    """Every side, with ties, repeated times, null keys and one key that holds most rows."""
    r = random.Random(4)
    place = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    time = lambda: T0 + dt.timedelta(seconds=r.randrange(0, 20 * 86400, 1800))
    rows = [(i, place(), time()) for i in range(300)] + [(900, "empty", T0)]
    readings = [(i, place(), time(), float(i)) for i in range(200)] + [(1000, "hot", None, 0.0)]
    left = spark.createDataFrame(rows, "match_id long, place string, at timestamp")
    right = spark.createDataFrame(readings, "id long, place string, ts timestamp, wind double").repartition(5)
    for within in (3600 * 5, 40 * 86400):
        for side in asof.SIDES:
            got = asof.nearest_reading(left, "at", right, "ts", ["place"], within, side, tie="id", block=6 * 3600).collect()
            assert len(got) == len(rows)
            for g in got:
                near = []
                for i, p, ts, wind in readings:
                    gap = (ts - g["at"]).total_seconds() if ts and p == g["place"] else None
                    if gap is not None and abs(gap) <= within and (side == "nearest" or (gap <= 0) == (side == "before")):
                        near.append((abs(gap), gap, i, wind))
                want = min(near, default=None)
                assert (g["reading"] and (g["reading"]["id"], g["reading"]["gap"], g["reading"]["wind"])) == (want and (want[2], want[1], want[3]))


def test_nearest_reading_grows_with_its_rows(spark):
    """No frame reaches forward, as such a frame is summed anew at every row, and a time is looked up once."""
    left = spark.range(9000).selectExpr("id", "1L AS place", "timestamp_seconds(id % 3 * 3600) AS at")
    right = spark.range(50).selectExpr("id AS r", "1L AS place", "timestamp_seconds(id * 100) AS ts")
    out = asof.nearest_reading(left, "at", right, "ts", ["place"], 86400, tie="r")
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "currentrow$()" in plan
    assert [tuple(r) for r in out.groupBy(F.unix_seconds("at"), "reading.r", "reading.gap").count().sort("r").collect()] == [(0, 0, 0.0, 3000), (3600, 36, 0.0, 3000), (7200, 49, -2300.0, 3000)]


def test_composed(spark):
    """A fold in parts equals the fold one by one, whatever the chunks, also for a key with most of the rows."""
    r = random.Random(5)
    rows = [(r.choice([1] * 8 + [2, 3]), r.randrange(1000), i, r.randrange(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "team_id long, day long, id long, v long").repartition(7)
    want = {}
    for k, _, _, v in sorted(rows):
        want[k] = max(0.6, min(3.0, 0.94 * want.get(k, 1.5) + 0.06 * v / 1.35))
    for chunk in (2, 7, 4096):
        out = sequence.composed(df, "team_id", ["day", "id"], {"m": sequence.smoothing(F.col("v"))}, chunk)
        got = {x["team_id"]: x["x"] for x in out.select("team_id", sequence.applied(F.col("m"), F.lit(1.5)).alias("x")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert sequence.composed(df.limit(0), "team_id", ["day", "id"], {"m": sequence.smoothing(F.col("v"))}).count() == 0


def test_before(spark):
    """Sums over earlier days, and over the last games before a day, against plain Python."""
    r = random.Random(6)
    rows = [(i, r.choice("aaab"), dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(25)), r.choice([None, 0, 1, 2, 3]), r.choice(["FT", "FT", "NS"])) for i in range(200)]
    df = spark.createDataFrame(rows, "match_id int, team string, day date, gf int, status string").repartition(5)
    got = {(x["team"], x["day"]): (x["n"], x["goals"]) for x in before.running_before(df, ["team"], "day", {"n": F.col("status") == "FT", "goals": F.col("gf")}).collect()}
    assert got == {(t, d): (sum(x[1] == t and x[2] < d and x[4] == "FT" for x in rows), sum(x[3] or 0 for x in rows if x[1] == t and x[2] < d)) for _, t, d, _, _ in rows}
    last = before.last_before(df, "team", "day", "match_id", F.col("status") == "FT", {"goals": F.col("gf"), "wins": F.col("gf") > 1}, 10).collect()
    assert len(last) == len(got)
    for x in last:
        games = sorted((g[2], g[0], g[3] or 0) for g in rows if g[1] == x["team"] and g[4] == "FT" and g[2] < x["day"])[-10:]
        assert (x["games"], x["goals"], x["wins"]) == (len(games), sum(g[2] for g in games), sum(g[2] > 1 for g in games))


def test_forecast_inputs(spark):
    """A side takes its own record at home or away, and nothing of the match's day or later."""
    from matchmill.operators import evaluate

    day = lambda n: dt.date(2024, 1, n)
    schema = "match_id int, match_date date, home_team_id int, away_team_id int, reviewed boolean, outcome_hit boolean, exact_hit boolean, goal_error int, home_bias int, away_bias int, predicted string, actual string, signals array<string>"
    rows = [
        (1, day(1), 1, 2, True, False, False, 3, 2, 1, "A", "H", ["open_lineups", "weather_risk"]),
        (2, day(2), 2, 1, True, True, True, 0, 0, 0, "H", "H", []),
        (3, day(3), 1, 2, True, False, False, 5, -4, 1, "H", "A", ["h2h_signal"]),
    ]
    got = {(x["team_id"], x["match_date"].day): x for x in evaluate.learning_before(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, 1]["games"] is None and got[1, 1]["hit_rate"] is None
    one = got[1, 3]
    assert (one["games"], one["hit_rate"], one["home_goal_bias"], one["away_goal_bias"], one["home_outcome_bias"], one["away_outcome_bias"], one["fragility"]) == (2, 0.5, 1.0, 0.0, 0.5, 0.0, 2)
    other = got[2, 3]
    assert (other["home_goal_bias"], other["away_goal_bias"], other["away_outcome_bias"]) == (0.0, 0.5, -0.5)
