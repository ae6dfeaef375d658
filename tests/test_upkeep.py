"""Retention, caches, compaction and the rebuild of reviews by changed days."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from matchmill.operators import model, upkeep

NOW = dt.datetime(2024, 5, 10, 12)


def test_pruned_caches(spark):
    r = random.Random(3)
    names = list(upkeep.CACHES)
    rows = [(names[0] if r.random() < 0.6 else r.choice(names), f"k{i}", NOW - dt.timedelta(minutes=r.randrange(0, 6000, 30)) if i % 97 else None) for i in range(6000)] + [("other", "x", NOW)]
    got = {(x["cache"], x["key"]) for x in upkeep.pruned_caches(spark.createDataFrame(rows, "cache string, key string, updated timestamp").repartition(5), F.lit(NOW)).collect()}
    want = set()
    for name, (hours, most) in upkeep.CACHES.items():
        young = sorted((-(t.timestamp()), k) for c, k, t in rows if c == name and t and NOW - t <= dt.timedelta(hours=hours))
        want |= {(name, k) for _, k in young[:most]}
    assert got == want and sum(c == names[0] for c, _ in got) > 100
    plan = upkeep.pruned_caches(spark.createDataFrame(rows, "cache string, key string, updated timestamp"), F.lit(NOW))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_compacted_store(spark):
    day = lambda n: NOW.date() + dt.timedelta(days=n)
    scores = {f"{i}-0": 0.05 + (i % 3) * 0.01 for i in range(14)}
    rows = [(n, day(n), list(scores.items()), "why", {"active": True, "secret": 1.0}) for n in (-13, -12, -1, 0, 1, 2, 4, 5)]
    p = spark.createDataFrame(rows, "match_id int, match_date date, score_map array<struct<key:string,value:double>>, analysis string, ensemble struct<active:boolean,secret:double>")
    p = p.withColumn("score_map", F.map_from_entries("score_map"))
    reviews = spark.createDataFrame([(i, i // 2) for i in range(2600)], "match_id int, created_at int")
    ratings = spark.createDataFrame([("a", NOW - dt.timedelta(hours=25)), ("b", NOW - dt.timedelta(hours=24))], "name string, updated timestamp")
    store = upkeep.compacted_store({"predictions": p, "matches": p.select("match_id", "match_date"), "reviews": reviews, "ratings": ratings}, F.lit(NOW.date()), F.lit(NOW))
    kept = {x["match_id"]: x for x in store["predictions"].collect()}
    assert sorted(kept) == [-12, -1, 0, 1, 2, 4] == sorted(x["match_id"] for x in store["matches"].collect())
    assert all((x["analysis"], x["ensemble"]["secret"], x["ensemble"]["active"]) == (("why", 1.0, True) if n in (0, 1) else (None, None, True)) for n, x in kept.items())
    want = sorted(scores.items(), key=lambda e: -e[1])[:10]
    ordered = store["predictions"].filter("match_id = 0").select(F.map_entries("score_map").alias("e")).first()["e"]
    assert [(e["key"], e["value"]) for e in ordered] == want
    ids = {x["match_id"] for x in store["reviews"].collect()}
    assert len(ids) == 2500 and ids == set(range(100, 2600)) and [x["name"] for x in store["ratings"].collect()] == ["b"]
    assert "features" not in store["predictions"].columns


def test_largest(spark):
    one = lambda m, n: spark.createDataFrame([(m,)], "m map<string,double>").select(F.map_entries(model.largest(F.col("m"), n)).alias("e")).first()["e"]
    assert [e["key"] for e in one({"a": 1.0, "b": 3.0, "c": 3.0, "d": 0.5}, 3)] == ["b", "c", "a"] and one({}, 3) == [] and one(None, 3) is None


def test_rebuild(spark, tmp_path):
    """Only changed days are written again, and the result is that of a full rebuild."""
    r = random.Random(9)
    rows = [(i, dt.date(2024, 1, 1 + i % 6), r.choice("xyz"), r.randrange(4), r.randrange(4)) for i in range(300)]
    schema = "match_id int, match_date date, label string, goals int, guess int"
    calls = []

    def review(m):
        calls.append(sorted({x["match_date"] for x in m.collect()}))
        return m.select("match_id", "match_date", "label", (F.col("goals") > 1).eqNullSafe(F.col("guess") > 1).alias("outcome_hit"), (F.col("goals") == F.col("guess")).alias("exact_hit"), F.abs(F.col("goals") - F.col("guess")).alias("goal_error"))

    def files(name):
        found = {}
        for top, _, names in os.walk(tmp_path / "s" / name):
            found |= {os.path.join(top, n): os.stat(os.path.join(top, n)).st_mtime_ns for n in names if n.startswith("part-")}
        return found

    def same_as_full(m, label):
        full = upkeep.Store(spark, str(tmp_path / label), ("label",))
        full.rebuild(m, review)
        plain = lambda df: sorted(map(tuple, df.collect()))
        assert plain(full.reliability("label")) == plain(store.reliability("label"))

    store = upkeep.Store(spark, str(tmp_path / "s"), ("label",))
    first = spark.createDataFrame(rows, schema)
    assert len(store.rebuild(first, review)) == 6 and store.rebuild(first.repartition(7), review) == []
    before = files("reviews")
    changed = [(i, d, x, g + 1 if i == 8 else g, p) for i, d, x, g, p in rows] + [(1000, dt.date(2024, 1, 9), "x", 1, 1)]
    again = spark.createDataFrame(changed, schema)
    days = [dt.date(2024, 1, 3), dt.date(2024, 1, 9)]
    assert store.rebuild(again, review) == days and calls[-1] == days
    after = files("reviews")
    assert {f for f in before if before[f] == after.get(f)} == {f for f in before if "match_date=2024-01-03" not in f}
    same_as_full(again, "full")
    gone = again.filter("match_date <> '2024-01-01'")
    assert store.rebuild(gone, review) == [] and store.table("reviews").filter("match_date = '2024-01-01'").count() == 50
    repeated = again.unionByName(again.filter("match_id = 0"))
    assert store.rebuild(repeated, review) == [dt.date(2024, 1, 1)]
    same_as_full(repeated, "repeated")
