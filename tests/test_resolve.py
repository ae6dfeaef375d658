"""Head-to-head from the feed, the previous leg and the history, by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchmill.operators import resolve
from matchmill.plans import upkeep  # noqa: F401  (it registers its queries)
from matchmill.plans.queries import QUERIES

DAY = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def met(n, home, away, score):
    h, a = map(int, score.split("-"))
    return DAY(n), home, away, score, home if h > a else away if h < a else None


def test_resolved(spark):
    """Each source alone, the leg added or already there, and the history merged without repeats."""
    leg = (DAY(400), 2, 1, "4-0", None)
    cases = [
        (1, [], None, []),
        (2, [], leg, []),
        (3, [met(1, 1, 2, "1-0"), met(2, 2, 1, "3-3"), met(3, 2, 1, "2-1")], leg, [met(9, 1, 2, "5-0")]),
        (4, [met(1, 1, 2, "1-0"), met(2, 2, 1, "4-0"), met(3, 2, 1, "2-2")], leg, []),
        (5, [met(5, 1, 2, "1-0")], None, [met(1, 1, 2, "0-2"), met(5, 1, 2, "1-0"), met(9, 2, 1, "0-0")]),
        (6, [], leg, [met(400, 2, 1, "4-0"), met(3, 1, 2, "2-0")]),
        (7, [], None, [met(i, 1, 2, "1-0") for i in range(5)]),
        (8, [], (DAY(1), 2, 1, "1-0", None), [(DAY(1), 2, 1, "1-0", 2)]),
    ]
    schema = f"match_id int, feed array<{resolve.MEETING}>, leg {resolve.MEETING}, history array<{resolve.MEETING}>"
    df = spark.createDataFrame(cases, schema).withColumns({"home_team_id": F.lit(1).cast("long"), "away_team_id": F.lit(2).cast("long")})
    got = {r["match_id"]: r for r in resolve.resolved(df).collect()}
    short = {i: (r["played"], r["home_wins"], r["draws"], r["away_wins"], r["same_competition"], r["balance"], r["status_h2h"]) for i, r in got.items()}
    assert short == {
        1: (0, 0, 0, 0, 0, 0.0, "empty"),
        2: (1, 0, 0, 0, 0, 0.0, "fallback"),
        3: (4, 1, 1, 1, 3, round((6 - 8) / 30 - 0.0001, 2), "loaded"),
        4: (3, 1, 1, 1, 3, round((6 - 7) / 21, 2), "loaded"),
        5: (3, 1, 1, 1, 4, round((-6 + 7) / 21, 2), "merged-historical-competition"),
        6: (2, 1, 1, 0, 2, 0.46, "merged-historical-competition"),
        7: (5, 5, 0, 0, 5, 1.0, "historical-competition"),
        8: (1, 0, 1, 0, 1, 0.0, "merged-historical-competition"),
    }
    assert [m["score"] for m in got[5]["results"]] == ["0-2", "1-0", "0-0"]


def test_last_meetings(spark):
    """A pair's last n earlier meetings, oldest first; those of the day itself don't count."""
    one = F.struct(F.col("match_date").alias("day"), F.lit(1).cast("long").alias("home"), F.lit(2).cast("long").alias("away"), F.col("match_id").cast("string").alias("score"), F.lit(None).cast("long").alias("winner"))
    played = spark.createDataFrame([(1, 2, DAY(i // 2), i) for i in range(20)] + [(3, 4, DAY(0), 99)], "a int, b int, match_date date, match_id int").withColumn("meeting", one)
    asked = spark.createDataFrame([(1, 2, DAY(5), 500), (1, 2, DAY(0), 501), (1, 2, DAY(90), 502), (3, 4, DAY(1), 503), (5, 6, DAY(1), 504)], "a int, b int, match_date date, match_id int")
    got = {r["match_id"]: [m["score"] for m in r["x"]] for r in resolve.last_meetings(asked, played, 3, "x").collect()}
    assert got == {500: ["7", "8", "9"], 501: [], 502: ["17", "18", "19"], 503: ["99"], 504: []}


def test_one_pass_by_pair(spark):
    """Lists and the last leg of a pair with more rows than a window keeps at hand, of small ones, and of matches without a
    day or a score, against plain Python."""
    r = random.Random(8)
    teams = lambda hot: r.choice([(1, 2), (2, 1)] if hot else [(3, 4), (4, 3), (5, 6), (7, 8)])
    day = lambda: None if r.random() < 0.02 else DAY(r.randrange(1500))
    rows = [(i, day(), *teams(i < 6000), r.choice(["FT", "FT", "NS", "LIVE"]), *r.choice([(1, 0), (2, 2), (0, 3), (None, None)]), r.randrange(8)) for i in range(6300)]
    m = spark.createDataFrame(rows, "match_id long, match_date date, home_team_id long, away_team_id long, status string, home_goals long, away_goals long, n_lines long").repartition(5)
    x = resolve.with_last_leg(resolve.by_pair(m, "home_team_id", "home_goals", "away_goals", "n_lines"), F.col("match_id"))
    got = resolve.with_last(x, F.col("match_id"), {"feed": (F.col("n_lines") >= 4, 8), "history": (F.lit(True), 5)}).collect()
    pairs = {}
    for i, d, h, a, status, goals, _, n in rows:
        if status == "FT" and goals is not None and d:
            pairs.setdefault(frozenset((h, a)), []).append((d, i, n))
    want = {}
    for i, d, h, a, status, _, _, _ in rows:
        if status != "FT":
            met = sorted(p for p in pairs.get(frozenset((h, a)), []) if d and p[0] < d)
            legs = [(p[0], -p[1]) for p in pairs.get(frozenset((h, a)), []) if d and p[0] <= d]
            want[i] = ([p[1] for p in met if p[2] >= 4][-8:], [p[1] for p in met][-5:], -max(legs)[1] if legs else None)
    assert {g["match_id"]: (g["feed"], g["history"], g["leg"]) for g in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["q_head_to_head", "q_previous_leg_played"])
def test_meetings_read_each_table_once(spark, name):
    """Orders, customers, nations, regions and lines are read once each, whatever is found for a match, and a pair's rows are
    brought together once."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 5 and plan.count("RepartitionByExpression") == 1
