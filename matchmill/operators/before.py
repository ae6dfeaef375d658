"""What was known before a match's day: sums over earlier days, and sums over a team's last games before the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A condition as 0 or 1, a number as itself; null as 0."""
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def running_before(rows: DataFrame, keys: list[str], day: str, measures: dict[str, Column]) -> DataFrame:
    """(keys, day, measures): for each day on which a key has rows the sums over its rows of earlier days. A day's rows are
    summed before they are put in order, so a key's window has one row a day, however many rows it has."""
    days = rows.groupBy(*keys, day).agg(*(F.sum(number(c)).alias(n) for n, c in measures.items()))
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*keys, day, *(F.coalesce(F.sum(n).over(earlier), F.lit(0).cast("long")).alias(n) for n in measures))


def last_before(rows: DataFrame, key: str, day: str, order: str, counts: Column, measures: dict[str, Column], n: int = 10) -> DataFrame:
    """(key, day, games, measures): sums over the last n rows of the key before the day for which `counts` holds. They are
    the sums of all of them less those up to the n-th last, which is looked up by its number."""
    mine = {"games": counts} | {name: F.when(counts, number(c)) for name, c in measures.items()}
    all_ = running_before(rows, [key], day, mine)
    inclusive = Window.partitionBy(key).orderBy(day, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = rows.filter(counts)
    upto = some.select(F.col(key).alias("of_"), *(F.sum(number(c)).over(inclusive).alias(f"{name}_") for name, c in mine.items()))
    out = all_.join(upto, (F.col(key) == F.col("of_")) & (F.col("games") - n == F.col("games_")), "left")
    return out.select(key, day, *(F.coalesce(F.col(name) - F.col(f"{name}_"), F.col(name)).alias(name) for name in mine))
