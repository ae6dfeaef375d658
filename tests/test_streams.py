"""Streams over files against the same rows as a whole."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchmill.operators import serving
from matchmill.operators.upkeep import CACHES
from matchmill.streaming import caches

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def stream(spark, path, schema, batches):
    """A stream that gives one batch of rows after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def collected(df, tmp_path, mode="append"):
    seen = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None
    return seen


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    caches.use_rocks(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_expiring(spark, tmp_path, rocks):
    """Values expire by their cache's hours, newer ones put that off, older and late ones change nothing."""
    row = lambda cache, key, hours, value: (cache, key, T0 + hours * HOUR, value)
    batches = [
        [row("teamInjuries", "a", 0, "a0"), row("teamInjuries", "b", 0, "b0"), row("h2hCache", "a", 0, "h0"), row("unknown", "a", 0, "u")],
        [row("teamInjuries", "a", 3, "a3"), row("teamInjuries", "a", 2.9, "older")],
        [row("weatherCache", "z", 8, "z8")],
        [row("teamInjuries", "b", 2, "late")],
        [row("weatherCache", "w", 30, "z30")],
        [row("weatherCache", "y", 31, "y31")],
    ]
    read = stream(spark, f"{tmp_path}/in", "cache string, key string, updated timestamp, value string", batches)
    got = [(r["cache"], r["key"], r["value"], r["live"]) for r in collected(caches.expiring(read()), tmp_path)]
    alive = lambda v: [g for g in got if g[2] == v and g[3]]
    gone = lambda v: [g for g in got if g[2] == v and not g[3]]
    assert all(len(alive(v)) == 1 for v in ("a0", "a3", "b0", "h0", "z8", "z30", "y31"))
    assert not alive("older") and not alive("late") and not alive("u")
    assert len(gone("a3")) == len(gone("b0")) == len(gone("z8")) == 1 and not gone("a0") and not gone("h0") and not gone("z30")
    assert got.index(gone("b0")[0]) < got.index(alive("z30")[0]) and CACHES["teamInjuries"][0] == 4


def test_live_overlay(spark, tmp_path):
    """A stream of matches and one of feed rows, repeated and late ones among them, come to what the tables come to."""
    r = random.Random(2)
    at = lambda h: T0 + h * HOUR
    matches = [(i, at(i // 4), "NS", "0-0") for i in range(40)]
    feed = [(i, at(i // 4) + dt.timedelta(minutes=30 * k), "LIVE", f"{k}-0") for i in range(0, 40, 2) for k in range(1, 4)]
    feed += [(i + 1000, at(i // 4), "LIVE", "9-9") for i in range(20)]
    feed = sorted([*feed, *feed[::3]], key=lambda f: (f[1] + dt.timedelta(minutes=r.randrange(0, 60)), f))
    end = [(-1, at(60), "NS", "0-0")], [(-2, at(60), "LIVE", "0-0")]
    m = stream(spark, f"{tmp_path}/m", "match_id long, kickoff timestamp, status string, score string", [matches[:20], matches[20:], end[0], [(-3, at(61), "NS", "0-0")]])
    f = stream(spark, f"{tmp_path}/f", "match_id long, seen timestamp, status string, score string", [feed[i : i + 25] for i in range(0, len(feed), 25)] + [end[1], [(-4, at(61), "LIVE", "0-0")]])
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = collected(caches.live_overlay(m(), f(), ["status", "score"]), tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = spark.createDataFrame(got, "match_id long, kickoff timestamp, status string, score string, seen timestamp")
    newest = caches.newest_overlay(rows).filter("match_id >= 0")
    whole_feed = spark.createDataFrame(feed, "match_id long, seen timestamp, status string, score string")
    last = whole_feed.groupBy("match_id").agg(F.max_by(F.struct("status", "score"), "seen").alias("x")).select("match_id", "x.*")
    want = serving.overlaid(spark.createDataFrame(matches, "match_id long, kickoff timestamp, status string, score string"), last, ["status", "score"])
    plain = lambda df: sorted((x["match_id"], x["kickoff"], x["status"], x["score"]) for x in df.collect())
    assert plain(newest) == plain(want) and not [g for g in got if g["match_id"] >= 1000]
    assert len([g for g in got if g["match_id"] == 1]) == 1 and len([g for g in got if g["match_id"] == 0]) == 3
