"""Referee look-up against a plain one, and the rules of features, goals and duels on small fixtures."""

import itertools
import math
import random

from pyspark.sql import functions as F

from matchmill.operators import archive, duels, features, goals, reads


def plain_variants(name):
    words = name.split()
    core = [w for w in words if w not in archive.LEFT_OUT] or words
    out = [name, " ".join(core), words[-1]]
    if len(words) >= 2:
        out += [f"{words[0]} {words[-1]}", f"{words[0][0]} {words[-1]}", f"{words[0][0]}.{words[-1]}", " ".join(words[-2:])]
    if len(words) >= 3:
        out += [f"{words[0]} {words[1]} {words[-1]}", f"{words[0][0]} {words[1][0]} {words[-1]}"]
    if len(core) >= 2:
        out += [f"{core[0]} {core[-1]}", f"{core[0][0]} {core[-1]}", " ".join(core[-2:])]
    if len(core) >= 3:
        out += [" ".join(core[-3:]), f"{core[0][0]} {core[1][0]} {core[-1]}"]
    return list(dict.fromkeys(out))


def plain_lookup(league, name, rows):
    """rows: (league, ord, referee, matches), all names normalised already."""
    own = {}
    for _, o, ref, _ in sorted(r for r in rows if r[0] == league):
        own.setdefault(ref, (o, ref))
    every = {}
    for _, o, ref, m in rows:
        if ref not in every or (m, -o) > every[ref][1]:
            every[ref] = ((o, ref), (m, -o))
    tables = [own, {k: v[0] for k, v in every.items()}]
    aliases = []
    for t in tables:
        a = {}
        for o, ref in sorted(t.values()):
            for v in plain_variants(ref):
                a.setdefault(v, ref)
        aliases.append(a)
    for t, a in zip(tables, aliases):
        if name in a or name in t:
            return a.get(name, name)
    for v in plain_variants(name):
        for a in aliases:
            if v in a:
                return a[v]
    for t in tables:
        for _, ref in sorted(t.values()):
            if ref in name or name in ref or ref.split()[-1] == name.split()[-1] or set(plain_variants(ref)) & set(plain_variants(name)):
                return ref
    return None


def test_referees_like_a_plain_lookup(spark):
    rng = random.Random(3)
    words = ["jan", "de", "bo", "ek", "van", "olm", "mike", "dean", "a"]
    names = [" ".join(w) for n in (1, 2, 3) for w in itertools.product(words, repeat=n)]
    rows = [(f"L{rng.randrange(3)}", i, rng.choice(names), rng.randrange(4)) for i in range(14)]
    asked = [(i, f"L{rng.randrange(4)}", n) for i, n in enumerate(rng.sample(names, 150) + ["zz", "zjanz", "olmo ekdean"])]
    got = archive.find_referees(spark.createDataFrame([*asked, (999, "L0", None)], "id int, league string, name string"), "id", "league", "name", spark.createDataFrame(rows, "league string, ord int, referee string, matches int"))
    found = {r["id"]: r["referee"] for r in got.collect()}
    assert {i: found.get(i) for i, _, _ in asked} == {i: plain_lookup(lg, n, rows) for i, lg, n in asked}
    assert 999 not in found


def test_features_without_inputs(spark):
    df = spark.range(1)
    names = features.feature_columns(df)
    assert len(names) == 54 and set(features.LINEAR) <= set(names)
    r = features.features(df).first()["features"]
    assert (r["home_avg_scored"], r["away_over25_away"], r["club_elo_diff"], r["home_lineup_continuity"]) == (1.35, 0.45, 0.0, 0.49)
    x = goals.expected_goals(df).first()
    assert abs(x["home_xg"] - 1.35 * 1.11) < 1e-12 and abs(x["away_xg"] - 1.35) < 1e-12
    assert abs(df.select(goals.confidence_falls(df)).first()[0] - (0.015 + 0.012 + 0.015)) < 1e-12


def test_duels(spark):
    rows = spark.createDataFrame([("Feyenoord", "AFC Ajax", "nl", "nl"), ("Sporting A", "Sporting B", "pt", "pt"), ("Sporting A", "Sporting B", "pt", "es"), (None, None, None, None)], "h string, a string, x string, y string")
    assert [r[0] for r in rows.select(duels.rivalry(F.col("h"), F.col("a"), F.col("x"), F.col("y"))).collect()] == ["rivaliteit", "streekduel", None, None]
    zones = spark.createDataFrame([("relegation", "ucl", True), (None, None, False)], "h string, a string, two boolean")
    assert [r[0] for r in zones.select(duels.context(F.col("h"), F.col("a"), F.col("two"), F.lit(False), F.lit(None).cast("string"))).collect()] == ["degradatiedruk · topstrijd · tweeluik", None]
    legs = spark.createDataFrame([(2, 3, 1, 1, 0, 0), (1, 0, 2, 1, None, None), (None, None, None, 1, 1, 1)], "leg_home_id int, leg_home_goals int, leg_away_goals int, home_team_id int, home_goals int, away_goals int")
    assert [(r["active"], r["aggregate_score"], r["leader"]) for r in duels.two_legs(legs).collect()] == [(True, "1-3", "away"), (True, "0-2", "away"), (False, "1-1", None)]
    assert [r["aggregate_score"] for r in duels.updated_legs(duels.two_legs(legs), F.lit(2), F.lit(1)).collect()] == ["3-4", "2-3", "1-1"]


def test_client_forecast_near_ties(spark):
    """Where a rate near 3 makes two and three goals tie but for rounding, the likeliest score is that of products from left
    to right. The rows are ones where Spark's powers and exponentials round as the C library's do."""
    rows = [(0.5 + i * 0.01, 1.0, 1.0, 0.45) for i in (0, 1, 2, 4, 6, 7, 9, 12, 13, 16, 18, 21)]
    df = spark.createDataFrame(rows, "home_attack double, away_attack double, away_defence double, home_defence double")
    df = df.withColumns({f"{s}_{n}": v for s in ("home", "away") for n, v in (("form", F.lit("")), ("elo", F.lit(1500.0)))})
    for r in reads.client_forecast(df).select("home_xg", "away_xg", "best_score").collect():
        x, y = r["home_xg"], r["away_xg"]
        cells = [((math.pow(x, h) * math.exp(-x) / math.factorial(h) * math.pow(y, a) * math.exp(-y) / math.factorial(a)), -(7 * h + a)) for h in range(7) for a in range(7)]
        at = -max(cells)[1]
        assert r["best_score"] == f"{at // 7}-{at % 7}" and at % 7 == 3, (x, y)
