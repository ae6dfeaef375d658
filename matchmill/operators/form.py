"""Team form, splits, tables, head-to-head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchmill.functions.semantics import half_up, to_fixed
from matchmill.operators.before import last_before
from matchmill.operators.lookups import last_n_per_key


def mark(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, F.lit("W")).when(gf < ga, F.lit("L")).when(gf == ga, F.lit("D"))


def recent(t: DataFrame, n: int = 10) -> DataFrame:
    """Last n finished games of each team, newest first."""
    return last_n_per_key(t.filter("status = 'FT'"), ["team_id"], n, "match_date", "match_id")


def team_form(t: DataFrame, n: int = 10) -> DataFrame:
    """Rates over the last n finished games. Overall rates divide by all games, goals by those with a score."""
    r = recent(t, n).withColumn("mark", mark(F.col("gf"), F.col("ga")))
    marks = F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct(F.col("rank"), "mark"))))
    share = lambda c: half_up(F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1)), 4)
    return r.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("games"), half_up(F.avg("gf"), 4).alias("avg_scored"), half_up(F.avg("ga"), 4).alias("avg_conceded"),
        share((F.col("gf") > 0) & (F.col("ga") > 0)).alias("btts_rate"), share(F.col("gf") + F.col("ga") >= 2).alias("over15_rate"), share(F.col("gf") + F.col("ga") >= 3).alias("over25_rate"),
        share(F.col("ga") == 0).alias("clean_sheet_rate"), share(F.col("gf") == 0).alias("blank_rate"),
        F.array_join(F.transform(marks, lambda x: x["mark"]), "").alias("form"),
    )


def splits(t: DataFrame) -> DataFrame:
    """Home and away averages over scored finished games, and the stronger side by a quarter of a goal."""
    avg = lambda side: F.coalesce(F.avg(F.when(F.col("side") == side, F.col("gf"))), F.lit(1.35))
    g = t.filter("status = 'FT'").groupBy("team_id").agg(half_up(avg("home"), 4).alias("home_avg"), half_up(avg("away"), 4).alias("away_avg"))
    side = F.when(F.col("home_avg") > F.col("away_avg") + 0.25, "home").when(F.col("away_avg") > F.col("home_avg") + 0.25, "away").otherwise("balanced")
    return g.withColumn("strongest_side", side)


def rest_days(t: DataFrame, at: str = "match_date", *keep: str) -> DataFrame:
    """Days since the team's match before, to a tenth; null where none is, or not before. `keep` are further columns of `t`."""
    by = Window.partitionBy("team_id").orderBy(at, "match_id")
    seconds = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(by).cast("timestamp"))
    return t.select("team_id", "match_id", *keep, F.when(seconds > 0, to_fixed(seconds / 86400, 1)).alias("rest_days"))


def standings(t: DataFrame) -> DataFrame:
    """League tables from finished games: points, goal difference, goals, then team."""
    g = t.filter("status = 'FT' AND gf IS NOT NULL").groupBy("league", "team_id").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("gf") > F.col("ga")).alias("wins"), F.count_if(F.col("gf") == F.col("ga")).alias("draws"), F.count_if(F.col("gf") < F.col("ga")).alias("losses"),
        F.sum("gf").cast("long").alias("gf"), F.sum("ga").cast("long").alias("ga"),
    )
    g = g.withColumn("points", F.col("wins") * 3 + F.col("draws"))
    order = Window.partitionBy("league").orderBy(F.desc("points"), (F.col("gf") - F.col("ga")).desc(), F.desc("gf"), "team_id")
    return g.withColumn("position", F.row_number().over(order))


def importance(position: Column, teams: Column) -> Column:
    """Games of the top three and of the relegation zone weigh more."""
    return F.when(position <= 3, F.lit(1.08)).when(position >= F.greatest(teams - 2, F.lit(1)), F.lit(1.08)).when(position <= 6, F.lit(1.03)).otherwise(F.lit(1.0))


def match_importance(home: Column, away: Column, teams: Column) -> Column:
    """The larger weight of both sides; 1 where a place isn't known."""
    known = (F.coalesce(home, F.lit(0)) > 0) & (F.coalesce(away, F.lit(0)) > 0) & (F.coalesce(teams, F.lit(0)) > 0)
    return F.when(known, F.greatest(importance(home, teams), importance(away, teams))).otherwise(F.lit(1.0))


def meetings(m: DataFrame, n: int = 8) -> DataFrame:
    """Last n finished meetings of each pair of teams, whoever was at home."""
    pair = m.filter("status = 'FT' AND home_goals IS NOT NULL").withColumns({"team_a": F.least("home_team_id", "away_team_id"), "team_b": F.greatest("home_team_id", "away_team_id")})
    return last_n_per_key(pair, ["team_a", "team_b"], n, "match_date", "match_id")


def meeting_balance(m: DataFrame, n: int = 5) -> DataFrame:
    """Weighted balance of the smaller team id over the last n meetings; weights 0.6 + 0.1 i, i from the oldest."""
    r = meetings(m, n)
    r = r.withColumn("old", F.count(F.lit(1)).over(Window.partitionBy("team_a", "team_b")) - F.col("rank"))
    w = 6 + F.col("old")
    diff = F.when(F.col("home_team_id") == F.col("team_a"), F.col("home_goals") - F.col("away_goals")).otherwise(F.col("away_goals") - F.col("home_goals"))
    return r.groupBy("team_a", "team_b").agg(F.count(F.lit(1)).alias("played"), half_up(F.sum(w * F.signum(diff).cast("long")) / F.sum(w), 2).alias("balance"))


def previous_leg(m: DataFrame, days: int = 160) -> DataFrame:
    """For each match the pair's last meeting before it, within so many days: a bounded as-of look-up as one window."""
    by = Window.partitionBy(F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")).orderBy("match_date", "match_id")
    p = m.withColumns({"leg_id": F.lag("match_id").over(by), "leg_date": F.lag("match_date").over(by)})
    return p.filter(F.datediff("match_date", "leg_date") <= days).select("match_id", "leg_id", F.datediff("match_date", "leg_date").alias("gap"))


def profile(t: DataFrame, n: int = 10) -> DataFrame:
    """Rates over a team's last n finished games, which all divide by the games, and the averages at home and away, which
    divide by the scored games there or are the defaults without any; `t` has yellow and red cards."""
    r = recent(t, n)
    games = F.count(F.lit(1))
    of = lambda c: to_fixed(F.coalesce(c, F.lit(0)) / games, 2)
    gf, ga = F.col("gf"), F.col("ga")

    def side(s: str) -> list[Column]:
        here = (F.col("side") == s) & gf.isNotNull()
        k = F.count_if(here)
        mean = lambda c, default: F.when(k > 0, to_fixed(F.coalesce(c, F.lit(0)) / k, 2)).otherwise(F.lit(default))
        return [
            k.alias(f"{s}_games"), mean(F.sum(F.when(here, gf)), 1.35).alias(f"{s}_scored"), mean(F.sum(F.when(here, ga)), 1.35).alias(f"{s}_conceded"), mean(F.count_if(here & (gf + ga > 2)), 0.45).alias(f"{s}_over25"),
        ]

    out = r.groupBy("team_id").agg(
        games.alias("games"), F.count_if(gf > ga).alias("wins"), F.count_if(gf == ga).alias("draws"), F.count_if(gf < ga).alias("losses"), of(F.sum(gf)).alias("avg_scored"), of(F.sum(ga)).alias("avg_conceded"),
        of(F.count_if((gf > 0) & (ga > 0))).alias("btts_rate"), of(F.count_if(gf + ga > 1)).alias("over15_rate"), of(F.count_if(gf + ga > 2)).alias("over25_rate"), of(F.count_if(ga == 0)).alias("clean_sheet_rate"),
        of(F.count_if(gf == 0)).alias("blank_rate"), of(F.sum("yellow")).alias("yellow_rate"), of(F.sum("red")).alias("red_rate"), *side("home"), *side("away"),
    )
    best = F.when(F.col("home_scored") > F.col("away_scored") + 0.25, "home").when(F.col("away_scored") > F.col("home_scored") + 0.25, "away").otherwise("balanced")
    return out.withColumn("strongest_side", best)


#: What a team's form before a day is made of, besides its number of games.
COUNTED = ("wins", "draws", "gf", "ga", "btts", "yellow", "red", *(f"{s}_{k}" for s in ("home", "away") for k in ("n", "gf", "ga", "over25")))


def profile_before(t: DataFrame, n: int = 10, day: str = "match_date") -> DataFrame:
    """As profile(), for each day on which a team plays, over its last n finished games of earlier days; null without any."""
    gf, ga = F.col("gf"), F.col("ga")
    here = lambda s: (F.col("side") == s) & gf.isNotNull()
    measures = {"wins": gf > ga, "draws": gf == ga, "gf": gf, "ga": ga, "btts": (gf > 0) & (ga > 0), "yellow": F.col("yellow"), "red": F.col("red")}
    for s in ("home", "away"):
        measures |= {f"{s}_n": here(s), f"{s}_gf": F.when(here(s), gf), f"{s}_ga": F.when(here(s), ga), f"{s}_over25": here(s) & (gf + ga > 2)}
    sums = last_before(t, "team_id", day, "match_id", F.col("status") == "FT", measures, n)
    games = F.when(F.col("games") > 0, F.col("games"))
    out = [games.alias("games"), *(F.when(F.col("games") > 0, F.col(c)).alias(c) for c in ("wins", "draws"))]
    out += [to_fixed(F.col(c) / games, 2).alias(k) for k, c in (("avg_scored", "gf"), ("avg_conceded", "ga"), ("btts_rate", "btts"), ("yellow_rate", "yellow"), ("red_rate", "red"))]
    for s in ("home", "away"):
        k = F.when(F.col(f"{s}_n") > 0, F.col(f"{s}_n"))
        out += [F.when(F.col("games") > 0, F.col(f"{s}_n")).alias(f"{s}_games")]
        out += [F.when(F.col("games") > 0, F.coalesce(to_fixed(F.col(f"{s}_{c}") / k, 2), F.lit(default))).alias(f"{s}_{name}") for name, c, default in (("scored", "gf", 1.35), ("conceded", "ga", 1.35), ("over25", "over25", 0.45))]
    return sums.select("team_id", day, *out)


def recent_matches(t: DataFrame, n: int = 5) -> DataFrame:
    """A team's last n finished games; one without a score has none and counts as a draw, both sides having the same."""
    result = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf").eqNullSafe(F.col("ga")), "D").otherwise("L")
    score = F.when(F.col("gf").isNotNull() & F.col("ga").isNotNull(), F.concat_ws("-", "gf", "ga"))
    return recent(t, n).select("team_id", "rank", "match_id", "opponent_id", F.when(F.col("side") == "home", "H").otherwise("A").alias("venue"), score.alias("score"), result.alias("result"))


def meeting_form(m: DataFrame, n: int = 5) -> DataFrame:
    """Results of the last n meetings as the smaller team id saw them, newest first."""
    diff = F.when(F.col("home_team_id") == F.col("team_a"), F.col("home_goals") - F.col("away_goals")).otherwise(F.col("away_goals") - F.col("home_goals"))
    r = meetings(m, n).withColumn("mark", F.when(diff > 0, "W").when(diff < 0, "L").otherwise("D"))
    return r.groupBy("team_a", "team_b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "mark"))), lambda x: x["mark"]), "").alias("form"))
