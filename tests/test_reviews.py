"""Reviews, learning, reliability, phases, zones and checks against hand-computed rows."""

from datetime import date

from pyspark.sql import functions as F

from matchmill.operators import classify, evaluate, model, monitor
from matchmill.plans import forecast

MATCHES = """match_id long, status string, label string, phase string, home_team_id long, away_team_id long, home_goals long, away_goals long, pred_home_goals long, pred_away_goals long,
 home_prob double, draw_prob double, away_prob double, elo_diff double, lineups_confirmed boolean, weather_risk string, rest_diff double, h2h_results long, market_over_diff double, agreement double"""


def reviewed(spark):
    rows = [
        (1, "FT", "Europe - Cup", "cup", 10, 20, 2, 1, 1, 0, 0.5, 0.3, 0.2, 0.0, True, "low", 0.0, 0, 0.0, 0.9),
        (2, "FT", "A", "league", 10, 20, 0, 3, 2, 1, 0.4, 0.2, 0.4, 90.0, False, "high", -2.0, 3, 0.45, 0.4),
        (3, "FT", "A", "league", 20, 10, 1, 1, 1, 1, 0.2, 0.5, 0.3, 300.0, False, None, 5.0, 9, 1.0, 0.1),
        (4, "NS", "A", "league", 10, 20, None, None, 1, 1, 0.2, 0.5, 0.3, 0.0, True, None, 0.0, 0, 0.0, 0.5),
        (5, "FT", "A", "league", 10, 20, 1, 0, None, None, None, None, None, 0.0, True, None, 0.0, 0, 0.0, 0.5),
    ]
    return evaluate.reviews(spark.createDataFrame(rows, MATCHES)).cache()


def test_prediction_without_goals(spark):
    """One with probabilities counts as 0-0, as the surveyed rule takes missing goals as none; without any there is no review."""
    rows = [(i, "FT", "A", "league", 10, 20, 1, 0, None, g, p, 0.5, 0.3, 0.0, True, None, 0.0, 0, 0.0, 0.5) for i, g, p in ((1, None, 0.2), (2, 2, None))]
    out = {r["match_id"]: r for r in evaluate.reviews(spark.createDataFrame(rows, MATCHES)).collect()}
    assert (out[1]["predicted"], out[1]["actual"], out[1]["goal_error"], out[1]["home_bias"]) == ("D", "H", 1, 1)
    assert (out[2]["predicted"], out[2]["goal_error"], out[2]["away_bias"]) == ("A", 3, -2)


def test_reviews(spark):
    out = {r["match_id"]: r for r in reviewed(spark).collect()}
    assert sorted(out) == [1, 2, 3]
    assert [out[1][c] for c in ("actual", "predicted", "likeliest", "outcome_hit", "exact_hit", "goal_error", "goal_bias", "signals")] == ["H", "H", "H", True, False, 2, 2, []]
    assert [out[2][c] for c in ("actual", "predicted", "likeliest", "probability_hit", "goal_error", "goal_bias", "home_bias", "away_bias")] == ["A", "H", "H", False, 4, 0, -2, 2]
    assert out[2]["signals"] == list(evaluate.SIGNALS)
    assert out[3]["exact_hit"] and out[3]["signals"] == []


def test_learning_and_reliability(spark):
    r = reviewed(spark)
    got = {x["team_id"]: x for x in evaluate.team_learning(r).collect()}
    ten = got[10]
    assert (ten["games"], ten["outcome_hits"], ten["exact_hits"], ten["hit_rate"], ten["avg_goal_error"]) == (3, 2, 1, 0.67, 2.0)
    assert (ten["home_goal_bias"], ten["away_goal_bias"], ten["over_home"], ten["home_outcome_bias"], ten["open_lineup_misses"]) == (-0.33, 0.0, 1, -0.33, 1)
    assert got[20]["under_away"] == 1 and got[20]["away_outcome_bias"] == 0.33
    by = {x["label"]: x for x in evaluate.reliability(r, "label").collect()}
    assert (by["A"]["hit_rate"], by["A"]["exact_rate"], by["A"]["avg_goal_error"], by["A"]["reliability"]) == (0.5, 0.5, 2.0, 0.5)
    assert by["Europe - Cup"]["reliability"] == 0.7  # 0.68 + 0.05 = 0.73, times 0.96
    d = evaluate.diagnostics(r).first()
    assert (d["reviews"], d["exact_rate"], d["hit_rate"], d["probability_rate"], d["avg_goal_error"]) == (3, 0.333, 0.667, 0.667, 2.0)
    assert evaluate.diagnostics(r.limit(0)).first()["reviews"] == 0


def test_phases(spark):
    rows = [("Europe - World Cup Qualification", "", "", "league", False), ("A", "Semifinal", "", "", False), ("A", "", "tweeluik", "", False), ("Europe - International Friendly", None, None, None, None), ("Europe - UEFA Nations League", "", "", "", False), ("A", "", "", "cup", False), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "l string, r string, s string, t string, two boolean")
    got = [r[0] for r in df.select(classify.phase(F.col("l"), F.col("r"), F.col("s"), F.col("t"), F.col("two"))).collect()]
    assert got == ["qualification", "cup", "two-leg-knockout", "friendly", "interland", "cup", "league"]


def test_zones(spark):
    df = spark.createDataFrame([("England - Premier League", 20), ("England - Championship", 24), ("Netherlands - Eerste Divisie", 20), ("Netherlands - Eredivisie", 18), ("X", 2), ("X", 0)], "l string, n int")
    got = [[(z["zone"], z["low"], z["high"]) for z in r[0]] for r in df.select(classify.zones(F.col("l"), F.col("n"))).collect()]
    assert got[0] == [("ucl", 1, 4), ("europe", 5, 6), ("relegation", 18, 20)] and got[1][2] == ("relegation", 22, 24)
    assert got[2] == [("promotion", 1, 2), ("period", 3, 8)] and got[3][1] == ("playoffs", 4, 8)
    assert got[4] == [("top", 1, 2), ("bottom", 1, 2)] and got[5] == [("top", 1, 4), ("bottom", 1, 1)]


def test_checks(spark):
    schema = "match_date date, status string, minute int, period string, h2h_played long, has_market boolean, book_signals int, referee_matches long, kickoff_day date"
    rows = [("LIVE", None, None, 0, True, 0, None, "2026-01-01"), ("LIVE", None, "Half Time", 0, True, 0, 0, "2026-01-02"), ("LIVE", 7, None, 0, True, 0, 0, "2026-01-01")]
    day = spark.createDataFrame([("2026-01-01", *r) for r in rows], schema.replace(" date", " string")).withColumns({c: F.col(c).cast("date") for c in ("match_date", "kickoff_day")})
    store = lambda age, n: monitor.day_counts(day).withColumns({"age_minutes": F.lit(age).cast("long"), "standings": F.lit(n), "cup_sheets": F.lit(n), "phases": F.lit(n)})
    got = {r["key"]: r["count"] for r in monitor.data_checks(store(91, 0)).collect()}
    assert got == {"worker_stale": 91, "live_minute_missing": 1, "h2h_empty": 3, "cupsheets_empty": 1, "phase_reliability_empty": 1, "bookmaker_signals_missing": 3, "historical_referee_unmatched": 3, "standings_empty": 1, "dashboard_wrong_day": 1}
    assert "worker_last_run_missing" in {r["key"] for r in monitor.data_checks(store(None, 1)).collect()}
    empty = monitor.day_counts(day.limit(0)).withColumns({"age_minutes": F.lit(3), "standings": F.lit(1), "cup_sheets": F.lit(1), "phases": F.lit(1)})
    assert [r["key"] for r in monitor.data_checks(empty).collect()] == ["today_matches_empty"]


def test_risk(spark):
    df = spark.createDataFrame([(0.4, 0.5, "high", False, 4, 0.2, 0.0), (0.7, 0.9, "low", True, 0, 0.0, 0.4), (0.5, 0.7, "medium", True, None, None, None)], "c double, a double, w string, l boolean, i int, t double, k double")
    assert [r[0] for r in df.select(model.risk(*(F.col(c) for c in "cawlitk"))).collect()] == ["hoog", "laag", "middel"]


def test_advice_joins_its_records_once(spark):
    """Coverage, rates and signals are read from one written table, not joined anew for each."""
    from matchmill.plans.queries import QUERIES

    files = QUERIES["q_advice"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_forecast_reads_written_tables(spark):
    """The assembled forecast reads lines and orders once, in the tables that it writes, and takes one row a side and one a match."""
    x = forecast.assembled(spark, "/root/testdata/sf0.001")
    assert not [f for f in x.inputFiles() if "lineitem" in f or "orders" in f]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 8


def test_forecast_moves_records_narrow(spark):
    """Of what is looked up for a match only the home side's row goes through a shuffle with it: the away side's is joined last."""
    x = forecast.assembled(spark, "/root/testdata/sf0.001")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = forecast.forecast(x)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "home_books" in plan and "Exchange hashpartitioning(match_id" not in plan


def test_league_days(spark):
    """A league without a name keeps what is known of the match's phase."""
    cells = "match_id long, match_date date, label string, phase string, league string, reviewed boolean, outcome_hit boolean, exact_hit boolean, goal_error long"
    k = spark.createDataFrame([(1, date(2024, 1, 1), "A", "cup", "a", True, True, False, 1), (2, date(2024, 1, 2), None, "cup", None, True, True, True, 0), (3, date(2024, 1, 2), "A", "league", "a", False, False, False, 0)], cells)
    prices = spark.createDataFrame([(1, 3, 2)], "match_id long, n long, c long")
    got = {r["of_league"]: r for r in forecast._league_days(k, prices).filter("of_match_date = '2024-01-02'").collect()}
    assert len(got) == 2 and got[None]["league_reliability"] is None and got[None]["phase_reliability"] == 0.76 and got["a"]["phase_reliability"] is None
    assert got["a"]["league_reliability"] == 0.76 and got["a"]["closing_coverage"] == 1.0
