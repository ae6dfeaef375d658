"""Scalar rules, look-ups, sources, sinks and streams on small fixtures."""

import json

from pyspark.sql import functions as F

from matchmill.functions import semantics as S
from matchmill.operators import classify, lookups, model, monitor, sequence, serving
from matchmill.plans.bridge import matches
from matchmill.sources import readers, sinks
from matchmill.streaming import live


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_numbers(spark):
    rows = spark.createDataFrame([("1,85",), ("",), (None,), ("x",), (" 2.5 ",), ("1,2,3",)], "x string")
    assert [r[0] for r in rows.select(S.to_number(F.col("x"))).collect()] == [1.85, 0.0, 0.0, None, 2.5, None]
    assert [r[0] for r in rows.select(S.to_number(F.col("x"), strict=True)).collect()][1:3] == [None, None]
    assert one(spark, S.half_up(F.col("x")), x=-1.5) == -1
    assert [one(spark, S.falsy_or(F.col("x"), 0.5), x=v) for v in (0.0, 2.0, float("nan"))] == [0.5, 2.0, 0.5]


def test_to_fixed(spark):
    """A million doubles to nought to four digits as exact decimal arithmetic gives them."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    r = random.Random(7)
    values = [1.45, 0.145, 1.005, 0.125, 2.5, -2.5, -0.125, 8.345, 1e-9, 0.0, -0.004, 1e15 + 0.3, 4503599627370497.5, 1e22, 123456789.125]
    values += [r.uniform(-100, 100) for _ in range(500_000)] + [r.randrange(-(10**6), 10**6) / r.choice((8, 16, 40, 200, 1000, 3)) for _ in range(500_000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(S.to_fixed(F.col("x"), d).alias(f"d{d}") for d in range(5)))
    for x, *got in rows.toPandas().itertuples(index=False, name=None):
        for d, g in enumerate(got):
            assert g == float(Decimal(x).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP)), (x, d, g)
    assert one(spark, S.to_fixed(F.col("x"), 1), x=1.45) == 1.4 and one(spark, S.to_fixed(F.col("x"), 1), x=None) is None


def test_scores_and_minutes(spark):
    rows = spark.createDataFrame([("2-1",), (" 3 - 0 ",), ("-",), ("x-1",), ("21",), (None,), ("1-2-3",)], "x string")
    assert [tuple(r) for r in rows.select(*S.parse_score(F.col("x"))).collect()] == [(2, 1), (3, 0), (0, 0), (None, None), (None, None), (None, None), (1, 2)]
    cases = [(None, None, "45+2", None), (None, None, "HT", "90 + 5"), (67, None, "1st half", None), (0, None, "12'", None), (None, 3, "none", None), (None, None, None, None)]
    rows = spark.createDataFrame(cases, "c int, e int, a string, b string").coalesce(1)
    got = [tuple(r[0]) for r in rows.select(S.minute_state(F.col("c"), F.col("e"), F.col("a"), F.col("b"))).collect()]
    assert got == [(45, 2), (90, 5), (67, None), (None, None), (None, 3), (None, None)]


def test_live(spark):
    """By status or minute, in both variants; a finished match with a minute is live and finished."""
    rows = spark.createDataFrame([("live", None, None), ("FT", "90'", 90), ("NS", "", 0), ("NS", None, None), ("FT", "FT", None)], "status string, minute string, value int").coalesce(1)
    both = [serving.live(F.col("minute"), F.col("value"), p) for p in (False, True)]
    assert [tuple(r) for r in rows.select(*both, serving.live()).collect()] == [(True, True, True), (True, True, False), (False, True, False), (False, False, False), (True, True, False)]
    assert rows.filter(serving.live(F.col("minute"), F.col("value")) & serving.finished()).count() == 2


def test_names_and_days(spark):
    assert one(spark, S.normalize_name(F.col("x")), x="  Málaga-CF Ærø ß ") == "malaga cf r"
    assert one(spark, S.possible_names(F.col("x")), x="FC Porto") == ["fc porto", "porto"]
    assert one(spark, S.pair_key(F.col("x"), F.col("y")), x="B", y="a") == "a__b"
    days = spark.createDataFrame([("3/2/71",), ("03/02/20",), ("2024-05-06T10:00",), ("?",)], "x string")
    assert [str(r[0]) for r in days.select(S.parse_day(F.col("x"))).collect()] == ["1971-02-03", "2020-02-03", "2024-05-06", "None"]
    minutes = spark.createDataFrame([("45+2'",), ("HT",), ("90",), ("x",)], "x string")
    assert [r[0] for r in minutes.select(S.minute_value(F.col("x"))).collect()] == [47, 45, 90, None]


def test_lookups(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, o int")
    assert sorted(lookups.latest_per_key(a, ["k"], "o").select("k", "v").collect()) == [(1, "y"), (2, "z")]
    assert lookups.keyed_upsert(a, a.filter("k = 2").withColumn("v", F.lit("n")), ["k"]).filter("v = 'n'").count() == 1
    table = spark.createDataFrame([("porto", 1.0), ("fc porto", 2.0)], "name string, elo double")
    got = lookups.priority_lookup(spark.createDataFrame([(7, "FC Porto"), (8, "?")], "id int, n string"), S.possible_names(F.col("n")), table, "name", "elo", "id")
    assert sorted((r["id"], r["elo"]) for r in got.collect()) == [(7, 2.0), (8, None)]


def test_model(spark):
    r = model.score_grid(spark.createDataFrame([(1.4, 1.1)], "home_xg double, away_xg double")).first()
    assert abs(r["home_prob"] + r["draw_prob"] + r["away_prob"] - 1) < 1e-12 and r["best_score"] == "1-1"
    assert one(spark, F.array(*model.normalize_odds(F.col("x"), F.col("x"), F.col("x"))), x=1.0) == [0.33, 0.34, 0.33]


def test_elo_conserves_points(spark):
    e = sequence.elo(matches(spark, "/root/testdata/sf0.001")).groupBy("league").agg(F.avg("elo")).collect()
    assert all(abs(r[1] - sequence.START_ELO) < 1e-6 for r in e)


def test_classes(spark):
    rows = spark.createDataFrame([("Germany", "2. Bundesliga"), ("x", "Frauen Cup")], "c string, n string")
    assert [r[0] and r[0]["label"] for r in rows.select(classify.league_of(F.col("c"), F.col("n"))).collect()] == ["Germany - Bundesliga", None]
    assert [r[0] and r[0]["label"] for r in rows.select(classify.league_of(F.col("c"), F.col("n"), longest=True)).collect()] == ["Germany - 2. Bundesliga", None]
    assert [r[0] for r in rows.select(classify.excluded(F.col("c"), F.col("n"))).collect()] == [False, True]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,HomeTeam,Note\n01/02/24, Ajax ,"a ""b"", c"\n\n')
    r = readers.season_csv(spark, [str(tmp_path / "a.csv")], ["Date", "HomeTeam", "Note", "Referee"]).collect()
    assert [tuple(x) for x in r] == [("01/02/24", "Ajax", 'a "b", c', None)]
    event = {"id": "1", "startTimestamp": 5, "homeTeam": {"id": "2", "name": "A"}}
    for i, shape in enumerate(([event, event], {"events": [event]}, {"data": [event]})):
        (tmp_path / f"{i}.json").write_text(json.dumps(shape))
        assert [x["homeTeam"]["name"] for x in readers.fixtures(spark, str(tmp_path / f"{i}.json")).collect()] == ["A"]
    a = spark.createDataFrame([("d1", 1)], "match_date string, v int")
    b = spark.createDataFrame([("d1", 2), ("d2", 3)], "match_date string, v int")
    assert sorted(readers.fallback_chain([a, b]).collect()) == [("d1", 1), ("d2", 3)]
    assert readers.read_or_default(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "match_date string, v int")
    sinks.write_days(df, str(tmp_path / "t"))
    sinks.write_days(df.filter("v = 2").withColumn("v", F.lit(5)), str(tmp_path / "t"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 5]


def test_serving_and_monitor(spark):
    local = spark.createDataFrame([(1, 5, "l"), (2, 1, "l")], "match_id int, ts int, v string")
    server = spark.createDataFrame([(1, 5, "s"), (2, 2, "s"), (3, 1, "s")], "match_id int, ts int, v string")
    assert sorted((r["match_id"], r["v"]) for r in serving.newest_history(local, server).collect()) == [(1, "l"), (2, "s"), (3, "s")]
    issues = spark.createDataFrame([("a", "m", 1, 1), ("a", "m", 2, 3), ("b", "n", 3, 2)], "key string, message string, ord int, severity_rank int")
    assert [(r["key"], r["priority"]) for r in monitor.proposal(issues).orderBy("priority").collect()] == [("b", 1), ("a", 2)]


def test_streams(spark, tmp_path):
    source = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-02 10:00:00")], "id int, event_type string, ts string")
    source.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = live.day_counts(stream()).writeStream.outputMode("update").format("memory").queryName("day_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r["day"]), r["n"]) for r in spark.table("day_counts").collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
    kept: list = []
    merge = live.merging(lambda: kept[-1] if kept else None, lambda df: kept.append(df.sparkSession.createDataFrame(df.collect(), df.schema)), ["id"], "ts")
    q = stream().writeStream.foreachBatch(merge).start()
    q.processAllAvailable()
    q.stop()
    assert kept[-1].count() == 2
    q = live.once_per_key(stream(), "id").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
