"""Parameterised reads: days, statuses, best bets, histories, cup sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchmill.operators.classify import round_weight


def on_days(m: DataFrame, day: str, days: int = 1) -> DataFrame:
    """Matches around a day: floor(days / 2) before and after, so an even number gives one more."""
    half = max(1, min(7, days)) // 2
    d = F.lit(day).cast("date")
    return m.filter(F.col("match_date").between(F.date_sub(d, half), F.date_add(d, half)))


def live(minute: Column | None = None, value: Column | None = None, present: bool = False) -> Column:
    """Whether a match is under way: by its status, or by a minute or its value that is neither empty nor 0, or, as the
    service takes it (`present`), one that is there at all. A finished match that still has a minute is both."""
    out = F.coalesce(F.upper("status") == "LIVE", F.lit(False))
    if minute is not None:
        out |= minute.isNotNull() if present else F.coalesce(minute != "", F.lit(False))
    if value is not None:
        out |= value.isNotNull() if present else F.coalesce(value != 0, F.lit(False))
    return out


def finished() -> Column:
    return (F.col("status") == "FT") | F.contains(F.upper(F.col("status")), F.lit("FINISH"))


def with_status(m: DataFrame, want: str, favourites: list[int] | None = None) -> DataFrame:
    """alle, live, gepland, gespeeld or favorieten."""
    if want == "favorieten":
        return m.filter(F.col("home_team_id").isin(favourites or []) | F.col("away_team_id").isin(favourites or []))
    return m.filter({"alle": F.lit(True), "live": live(), "gepland": ~live() & ~finished(), "gespeeld": finished()}[want])


def league_rank(order: tuple[str, ...]) -> Column:
    """Place of the league in an explicit order; leagues outside it come after."""
    return F.coalesce(*(F.when(F.col("league") == n, F.lit(i)) for i, n in enumerate(order)), F.lit(999))


def best_bets(p: DataFrame, k: int = 5) -> DataFrame:
    """Upcoming matches with the highest confidence, or largest probability where there is none."""
    sure = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, F.greatest("home_prob", "draw_prob", "away_prob")).otherwise(F.col("confidence"))
    return p.filter("status = 'NS'").withColumn("sure", sure).orderBy(F.desc("sure"), "match_id").limit(k)


def merged(m: DataFrame, p: DataFrame, both: list[str]) -> DataFrame:
    """Full outer merge on match_id; a match's field wins where it isn't null."""
    right = p.select("match_id", *(F.col(c).alias(f"p_{c}") for c in both), *[c for c in p.columns if c not in (*both, "match_id")])
    out = m.join(right, "match_id", "full_outer")
    return out.withColumns({c: F.coalesce(c, f"p_{c}") for c in both}).drop(*(f"p_{c}" for c in both))


def overlaid(m: DataFrame, feed: DataFrame, fields: list[str]) -> DataFrame:
    """Today's matches with a live feed's fields on top; feed rows without a match are dropped."""
    new = feed.select("match_id", *(F.col(c).alias(f"new_{c}") for c in fields))
    return m.join(new, "match_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).drop(*(f"new_{c}" for c in fields))


def newest_history(local: DataFrame, server: DataFrame) -> DataFrame:
    """Union by match, the newest kept, the local row of equals."""
    both = server.withColumn("src", F.lit(0)).unionByName(local.withColumn("src", F.lit(1)))
    from matchmill.operators.lookups import latest_per_key

    return latest_per_key(both, ["match_id"], "ts", "src").drop("src")


def retained(m: DataFrame, day: str, back: int = 12, forward: int = 4) -> DataFrame:
    """Matches of the days that a store keeps around `day`."""
    d = F.lit(day).cast("date")
    return m.filter(F.col("match_date").between(F.date_sub(d, back), F.date_add(d, forward)))


def history_by_league(r: DataFrame) -> DataFrame:
    """Per league (rows without one and the unknown one are left out) its reviews and how many were right, by score, by outcome, by the likeliest outcome; most reviews first."""
    g = r.groupBy(F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("Onbekend")).alias("league"))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_hit").alias("exact"), F.count_if("outcome_hit").alias("outcome"), F.count_if("probability_hit").alias("top_chance"))
    out = out.withColumns({f"{c}_percent": F.floor(F.col(c) / F.col("n") * 100 + 0.5) for c in ("exact", "outcome", "top_chance")})
    return out.filter("league <> 'Onbekend'").orderBy(F.desc("n"), F.desc("outcome_percent"), "league")


def history_page(r: DataFrame, keep: Column, page: int, size: int) -> DataFrame:
    """A page of the filtered reviews, the newest first; pages count from 1."""
    return r.filter(keep).orderBy(F.desc("match_date"), "match_id").offset((page - 1) * size).limit(size)


def iso_weeks(m: DataFrame) -> DataFrame:
    """Matches per ISO week, and whether its number is even."""
    week, year = F.weekofyear("match_date"), F.expr("extract(YEAROFWEEK FROM match_date)").cast("long")
    return m.groupBy(year.alias("year"), week.cast("long").alias("week")).agg(F.count(F.lit(1)).alias("n")).withColumn("even", F.col("week") % 2 == 0)


def cup_sheets(m: DataFrame) -> DataFrame:
    """Cup matches by round in the order of kick-off: who is out, and the sibling whose winner waits for this one's.

    Neighbours 0 and 1, 2 and 3 and so on of a round are siblings, so one look ahead or back gives them."""
    by = Window.partitionBy("label", "round_label").orderBy("match_date", "match_id")
    at = F.row_number().over(by) - 1
    loser = F.when(F.col("home_goals") > F.col("away_goals"), F.col("away_team_id")).when(F.col("home_goals") < F.col("away_goals"), F.col("home_team_id"))
    sibling = F.when(at % 2 == 0, F.lead("match_id").over(by)).otherwise(F.lag("match_id").over(by))
    out = m.withColumns({"at": at, "loser": loser, "sibling": sibling, "weight": round_weight(F.col("round_label"))})
    return out.select("label", "round_label", "weight", "at", "match_id", "loser", "sibling")


def next_rounds(m: DataFrame) -> DataFrame:
    """The rounds of each cup by weight, and the round after each."""
    rounds = m.select("label", "round_label", round_weight(F.col("round_label")).alias("weight")).distinct()
    return rounds.withColumn("next_round", F.lead("round_label").over(Window.partitionBy("label").orderBy("weight", "round_label")))
