"""Coverage of a day's sources and the advice that follows from it and from the reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import half_up


def coverage(day: DataFrame, books: Column, referee: Column, meetings: Column) -> DataFrame:
    """One row: matches, how many lack books or meetings, and the shares that have books, a known referee, meetings."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    share = lambda c: half_up(F.count_if(c) / n, 2)
    return day.agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(F.coalesce(~books, F.lit(True))).alias("no_books"), F.count_if(F.coalesce(~meetings, F.lit(True))).alias("no_meetings"),
        share(books).alias("book_coverage"), share(referee).alias("referee_coverage"), share(meetings).alias("h2h_coverage"),
    )


def diagnostics(reviews: DataFrame) -> DataFrame:
    """One row over all reviews: their number, hit rates, and each signal's count as a map."""
    signals = reviews.select(F.explode("signals").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("signals"))
    rates = reviews.agg(F.count(F.lit(1)).alias("reviews"), F.avg(F.when(F.col("exact_hit"), 1.0).otherwise(0.0)).alias("exact"), F.avg(F.when(F.col("outcome_hit"), 1.0).otherwise(0.0)).alias("outcome"))
    return rates.withColumn("k", F.lit(1)).join(signals.withColumn("k", F.lit(1)), "k").drop("k")  # a row each


def recommendations(cover: DataFrame, found: DataFrame, key_signals: tuple[str, ...] = ()) -> DataFrame:
    """(ord, topic, figure, priority) of the rules that apply, from one row of coverage() and one of diagnostics()."""
    percent = lambda x: F.floor(F.coalesce(x, F.lit(0.0)) * 100 + 0.5).cast("long")
    exact = F.coalesce("exact", F.lit(0.0))
    top = F.array_max(F.transform(F.map_entries("signals"), lambda e: e["value"]))
    rules: list[tuple[str, Column, Column, Column]] = [
        ("fill_meetings", F.col("no_meetings") > 0, F.col("no_meetings"), F.lit("medium")), ("widen_books", F.col("no_books") > 0, F.col("no_books"), F.lit("medium")),
        *((f"thin_{c}", F.col(c) < bound, percent(F.col(c)), F.lit("medium")) for c, bound in (("book_coverage", 0.7), ("referee_coverage", 0.65), ("h2h_coverage", 0.75))),
        ("calibration", F.lit(True), percent(exact), F.when(exact < 0.14, "high").otherwise("low")), ("top_signal", top.isNotNull(), top, F.when(top >= 8, "high").otherwise("medium")),
        *((f"signal_{s}", F.col("signals")[s].isNotNull(), F.col("signals")[s], F.when(F.col("signals")[s] >= 5, "high").otherwise("medium")) for s in key_signals),
    ]
    one = cover.withColumn("k", F.lit(1)).join(found.withColumn("k", F.lit(1)), "k")
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(t).alias("topic"), figure.cast("long").alias("figure"), p.alias("priority"), when.alias("on")) for i, (t, when, figure, p) in enumerate(rules)))
    return one.select(F.explode(rows).alias("r")).filter("r.on").select("r.ord", "r.topic", "r.figure", "r.priority")
