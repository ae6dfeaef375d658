"""Match-shaped relations from the order tables: one order is a match, its lines are goals, cards and odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmill.functions.semantics import outcome


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str, scores: bool = True, lines: bool = False) -> DataFrame:
    """One row per order. Lines are summed before the join, as they have no key; an order without lines has no score. Without
    `scores` the lines are not read, and what they tell is left out; with `lines` their number is there as well, as n_lines."""
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, 1).otherwise(0)).cast("long")
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flag("R").alias("home_goals"), flag("A").alias("away_goals"), flag("N").alias("cards"), F.min("l_suppkey").alias("referee_id"), F.count(F.lit(1)).alias("n_lines"))
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    both = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    if scores:
        both = both.join(per, both["o_orderkey"] == per["l_orderkey"], "left")
    team = F.col("n_nationkey").cast("long") * 100
    return both.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("match_date"), F.col("n_name").alias("league"), F.col("r_name").alias("region"),
        (team + F.col("o_custkey") % 20).alias("home_team_id"), (team + (F.col("o_custkey") % 20 + 1 + F.col("o_orderkey") % 19) % 20).alias("away_team_id"),
        F.when(F.col("o_orderstatus") == "F", "FT").when(F.col("o_orderstatus") == "P", "LIVE").otherwise("NS").alias("status"),
        *(("home_goals", "away_goals", "cards", "referee_id") if scores else ()), *(("n_lines",) if scores and lines else ()),
        (F.floor("o_totalprice").cast("long") % 4).alias("pred_home_goals"), (F.col("o_orderkey") % 3).alias("pred_away_goals"),
    )


def team_rows(m: DataFrame) -> DataFrame:
    """Two rows per match, one for each side."""
    side = lambda s, t, o, gf, ga: F.struct(F.lit(s).alias("side"), F.col(t).alias("team_id"), F.col(o).alias("opponent_id"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    both = F.array(side("home", "home_team_id", "away_team_id", "home_goals", "away_goals"), side("away", "away_team_id", "home_team_id", "away_goals", "home_goals"))
    return m.select("match_id", "match_date", "league", "status", F.explode(both).alias("t")).select("match_id", "match_date", "league", "status", "t.*")


def odds(spark: SparkSession, sf_dir: str, m: DataFrame) -> DataFrame:
    """One row per line: a bookmaker's prices of a match, opening or closing."""
    line = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), (F.col("l_suppkey") % 8).alias("book"), (F.lit(1) + F.col("l_quantity") / 10).alias("home_odd"),
        (F.lit(1) + (F.col("l_partkey") % 50) / F.lit(10.0)).alias("draw_odd"), (F.lit(1) + (F.col("l_orderkey") % 40) / F.lit(10.0)).alias("away_odd"),
        (F.col("l_linestatus") == "F").alias("closing"),
    )
    return line.join(m.select("match_id", "league", "home_team_id", "away_team_id", outcome(F.col("home_goals"), F.col("away_goals")).alias("outcome")), "match_id")


#: Inputs of the model as expressions over a match; zeros and nulls are among them.
INPUTS = {
    "home_avg_scored": "match_id % 9 / 4", "away_avg_scored": "match_id % 7 / 3", "home_avg_conceded": "match_id % 5 / 2", "away_avg_conceded": "match_id % 8 / 4", "home_split_games": "match_id % 4", "away_split_games": "match_id % 3",
    "home_split_scored": "match_id % 11 / 5", "home_split_conceded": "match_id % 6 / 4", "away_split_scored": "match_id % 10 / 5", "away_split_conceded": "match_id % 13 / 6", "home_split_over25": "match_id % 5 / 5", "away_split_over25": "match_id % 6 / 6",
    "home_wins": "match_id % 6", "home_draws": "match_id % 3", "home_games": "match_id % 5 * 4", "away_wins": "match_id % 7", "away_draws": "match_id % 4", "away_games": "match_id % 6 * 3", "home_rest_days": "CASE WHEN match_id % 5 > 0 THEN match_id % 12 / 2 END", "away_rest_days": "match_id % 9 / 2",
    "home_club_elo": "match_id % 4 * 500 + home_team_id % 20", "away_club_elo": "match_id % 3 * 700 + away_team_id % 20", "home_injuries": "match_id % 5", "away_injuries": "match_id % 7", "weather_risk": "CASE match_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END", "lineups_confirmed": "match_id % 3 = 0",
    "home_starters": "match_id % 12", "away_starters": "match_id % 13", "home_rating": "match_id % 9 / 1", "away_rating": "match_id % 8 / 1", "home_keeper_rating": "match_id % 8 / 1", "away_keeper_rating": "match_id % 7 / 1", "home_country": "region", "away_country": "CASE WHEN match_id % 2 = 0 THEN region WHEN match_id % 3 = 0 THEN league END", "league_type": "CASE WHEN match_id % 5 = 0 THEN 'cup' END",
    "h2h_played": "match_id % 6", "h2h_home_wins": "match_id % 4", "h2h_away_wins": "match_id % 3", "match_importance": "CASE WHEN match_id % 3 = 0 THEN 27 / 25 END", "home_btts_rate": "match_id % 5 / 5", "away_btts_rate": "match_id % 4 / 4", "home_yellow_rate": "match_id % 9 / 3", "away_yellow_rate": "match_id % 8 / 3", "home_red_rate": "match_id % 4 / 8", "away_red_rate": "match_id % 5 / 8",
    "home_avg_corners": "match_id % 9 / 1", "away_avg_corners": "match_id % 7 / 1", "home_set_piece": "match_id % 9 / 2", "away_set_piece": "match_id % 5 / 2", "home_shots_on": "match_id % 7 / 1", "away_shots_on": "match_id % 6 / 1", "home_learning_outcome_hit": "match_id % 5 / 4", "away_learning_outcome_hit": "match_id % 3 / 2", "home_learning_goal_bias": "match_id % 7 / 4 - 1", "away_learning_goal_bias": "match_id % 5 / 4 - 1",
    "home_learning_outcome_bias": "match_id % 9 / 4 - 1", "away_learning_outcome_bias": "match_id % 8 / 4 - 1", "home_learning_reviews": "match_id % 11", "away_learning_reviews": "match_id % 7", "home_learning_exact": "match_id % 5 / 8", "away_learning_exact": "match_id % 6 / 8", "learning_reliability": "match_id % 8 / 8", "home_market_implied": "match_id % 3 / 2", "away_market_implied": "match_id % 4 / 2", "home_market_actual": "match_id % 5 / 2", "away_market_actual": "match_id % 6 / 2",
    "home_market_over": "match_id % 9 / 8 - 1 / 2", "away_market_over": "match_id % 11 / 8 - 1 / 2", "home_market_games": "match_id % 20", "away_market_games": "match_id % 15", "closing_coverage": "match_id % 5 / 4", "league_reliability": "CASE WHEN match_id % 4 > 0 THEN match_id % 9 / 8 END", "league_avg_goal_error": "match_id % 9 / 4", "phase_reliability": "CASE WHEN match_id % 3 > 0 THEN match_id % 7 / 8 END", "phase_avg_goal_error": "match_id % 8 / 4",
    "referee_cards_trend": "match_id % 6 / 1", "referee_penalty_rate": "match_id % 4 / 16", "home_fragility": "match_id % 5", "away_fragility": "match_id % 3",
}


def inputs(m: DataFrame) -> DataFrame:
    """Matches with INPUTS, the results of three meetings and two bookmakers' records."""
    number = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    book = lambda name, a, b: F.struct(F.lit(name).alias("book"), number(f"match_id % {a} / 8 - 1 / 2").alias("home_over"), number(f"match_id % {b} / 8 - 1 / 2").alias("away_over"), number("match_id % 10").alias("home_games"), number("match_id % 13").alias("away_games"), number("match_id % 3 / 2").alias("home_coverage"), number("match_id % 4 / 3").alias("away_coverage"))
    books = F.when(F.col("match_id") % 7 == 0, F.array().cast("array<struct<book:string,home_over:double,away_over:double,home_games:double,away_games:double,home_coverage:double,away_coverage:double>>")).otherwise(F.array(book("a", 9, 10), book("b", 12, 7)))
    return m.select("match_id", *(F.expr(e).alias(k) for k, e in INPUTS.items()), F.expr("array(match_id % 3 - 1, match_id % 2, 1 - match_id % 3)").alias("h2h_results"), books.alias("books"))


INPUT_SQL = "x AS (SELECT match_id, " + ", ".join(f"{e} AS {k}" for k, e in INPUTS.items()) + " FROM m)"

MATCH_SQL = """
m AS (
  SELECT o.o_orderkey AS match_id, CAST(o.o_orderdate AS DATE) AS match_date, n.n_name AS league, r.r_name AS region,
         CAST(n.n_nationkey AS BIGINT) * 100 + o.o_custkey % 20 AS home_team_id,
         CAST(n.n_nationkey AS BIGINT) * 100 + (o.o_custkey % 20 + 1 + o.o_orderkey % 19) % 20 AS away_team_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'FT' WHEN 'P' THEN 'LIVE' ELSE 'NS' END AS status,
         ln.home_goals, ln.away_goals, ln.cards, ln.referee_id,
         CAST(FLOOR(o.o_totalprice) AS BIGINT) % 4 AS pred_home_goals, o.o_orderkey % 3 AS pred_away_goals
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS home_goals, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS away_goals,
                    CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS cards, min(l_suppkey) AS referee_id FROM lineitem GROUP BY l_orderkey) ln ON ln.l_orderkey = o.o_orderkey),
t AS (
  SELECT match_id, match_date, league, status, 'home' AS side, home_team_id AS team_id, away_team_id AS opponent_id, home_goals AS gf, away_goals AS ga FROM m
  UNION ALL SELECT match_id, match_date, league, status, 'away', away_team_id, home_team_id, away_goals, home_goals FROM m),
o AS (
  SELECT l_orderkey AS match_id, l_suppkey % 8 AS book, 1 + l_quantity / 10 AS home_odd, 1 + (l_partkey % 50) / 10.0::DOUBLE AS draw_odd,
         1 + (l_orderkey % 40) / 10.0::DOUBLE AS away_odd, l_linestatus = 'F' AS closing, league, home_team_id, away_team_id,
         CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' WHEN home_goals = away_goals THEN 'D' END AS outcome
  FROM lineitem JOIN m ON m.match_id = l_orderkey)"""
