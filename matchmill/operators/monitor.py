"""Data quality rules, findings and their digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK = {"high": 3, "medium": 2, "low": 1}
#: Minutes after which the store counts as stale.
STALE = 90


def day_counts(today: DataFrame, *by: str) -> DataFrame:
    """Counts over the matches of a day (one row, or one for each of `by`). Read are status, minute, period, h2h_played,
    has_market, book_signals, referee_matches and kickoff_day beside the day itself in match_date."""
    live = F.upper(F.coalesce("status", F.lit(""))) == "LIVE"
    half = F.contains(F.lower(F.coalesce("period", F.lit(""))), F.lit("half time"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return today.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(live).alias("live"), F.count_if(live & none("minute") & ~half).alias("live_without_minute"), F.count_if(none("h2h_played")).alias("h2h_missing"),
        F.count_if(F.coalesce(F.col("has_market"), F.lit(False)) & (F.coalesce("book_signals", F.lit(0)) <= 0)).alias("without_books"), F.count_if(~none("referee_matches")).alias("known_referees"),
        F.count_if(F.col("kickoff_day") != F.col("match_date")).alias("wrong_day"),
    )


def data_checks(counts: DataFrame, *by: str) -> DataFrame:
    """(by, ord, key, severity, count) of the rules that a store breaks, in their order, from day_counts() rows that also
    hold age_minutes (null: it never ran), standings, cup_sheets and phases."""
    n = F.col("matches")
    rules = (
        ("worker_last_run_missing", "high", F.col("age_minutes").isNull(), F.lit(1)), ("worker_stale", "high", F.col("age_minutes") > STALE, F.col("age_minutes")),
        ("today_matches_empty", "medium", n == 0, F.lit(1)), ("live_minute_missing", "high", F.col("live_without_minute") > 0, F.col("live_without_minute")),
        ("h2h_empty", "medium", (n > 0) & (F.col("h2h_missing") == n), n), ("cupsheets_empty", "medium", F.col("cup_sheets") == 0, F.lit(1)), ("phase_reliability_empty", "medium", F.col("phases") == 0, F.lit(1)),
        ("bookmaker_signals_missing", "medium", (n > 0) & (F.col("without_books") == n), n), ("historical_referee_unmatched", "low", (n > 0) & (F.col("known_referees") == 0), n),
        ("standings_empty", "high", F.col("standings") == 0, F.lit(1)), ("dashboard_wrong_day", "high", F.col("wrong_day") > 0, F.col("wrong_day")),
    )
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit(s).alias("severity"), c.cast("long").alias("count"), F.coalesce(w, F.lit(False)).alias("on")) for i, (k, s, w, c) in enumerate(rules)))
    return counts.select(*by, F.explode(rows).alias("r")).filter("r.on").select(*by, "r.ord", "r.key", "r.severity", "r.count")


def distinct_issues(issues: DataFrame) -> DataFrame:
    """The first of each key and message, by `ord`."""
    by = Window.partitionBy("key", "message").orderBy("ord")
    return issues.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


def first_of_day(issues: DataFrame) -> DataFrame:
    """A day's report: of each key the first issue of that day's runs."""
    rest = [c for c in issues.columns if c not in ("day", "key", "ts")]
    return issues.groupBy("day", "key").agg(F.min_by(F.struct(*rest), F.struct("ts", *rest)).alias("i"), F.count(F.lit(1)).alias("times")).select("day", "key", "i.*", "times")


def digest(issues: DataFrame, days: int = 14, top: int = 8) -> DataFrame:
    """Issues (day, ts, key, severity_rank, message) of the trailing days: count, highest severity, first message; the
    most frequent keys first."""
    end = issues.agg(F.max("day").alias("end"))
    window = issues.crossJoin(F.broadcast(end)).filter(F.col("day") >= F.date_sub("end", days - 1))  # one row
    g = window.groupBy("key").agg(F.count(F.lit(1)).alias("issues"), F.max("severity_rank").alias("severity"), F.min_by("message", F.struct("ts", "message")).alias("sample"))
    return g.orderBy(F.desc("issues"), "key").limit(top)


def digest_totals(issues: DataFrame, days: int = 14, top: int = 8) -> DataFrame:
    """One row over the trailing days: days and runs seen, issues, kinds among the `top` listed, the last run."""
    end = issues.agg(F.max("day").alias("end"))
    window = issues.crossJoin(F.broadcast(end)).filter(F.col("day") >= F.date_sub("end", days - 1))  # one row
    return window.agg(F.count_distinct("day").alias("days"), F.count_distinct("ts").alias("runs"), F.count(F.lit(1)).alias("issues"), F.least(F.lit(top), F.count_distinct("key")).cast("long").alias("kinds"), F.max("ts").alias("last_run"))


def proposal(findings: DataFrame) -> DataFrame:
    """Distinct issues of a day ordered by severity, numbered from 1, with the files that they touch. One day's issues."""
    one = distinct_issues(findings)
    order = Window.orderBy(F.desc("severity_rank"), "ord")
    return one.withColumn("priority", F.row_number().over(order))


def proposals(findings: DataFrame, advice: dict[str, tuple[tuple[str, ...], str]], other: tuple[tuple[str, ...], str]) -> DataFrame:
    """Per day its issues (day, ord, key, message, severity), of each key and message the first, by severity and then as they
    came, with what to look at and why (`advice` by key, else `other`), and how many things the whole day names."""
    first = findings.groupBy("day", "key", "message").agg(F.min(F.struct("ord", "severity")).alias("i")).select("day", "key", "message", "i.*")
    names = lambda x: F.array(*(F.lit(n) for n in x))
    places, why = names(other[0]), F.lit(other[1])
    for key, (at, reason) in advice.items():
        places, why = F.when(F.col("key") == key, names(at)).otherwise(places), F.when(F.col("key") == key, reason).otherwise(why)
    weight = F.lit(RANK["low"])
    for name in ("medium", "high"):
        weight = F.when(F.col("severity") == name, RANK[name]).otherwise(weight)
    day = Window.partitionBy("day")
    out = first.withColumns({"places": places, "why": why, "priority": F.row_number().over(day.orderBy(weight.desc(), "ord", "key", "message"))})
    keys = out.groupBy("day", "key").agg(F.any_value("places").alias("places"))
    named = keys.select("day", F.explode("places").alias("place")).groupBy("day").agg(F.count_distinct("place").alias("places_of_day"))
    return out.join(named, "day")
