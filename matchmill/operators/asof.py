"""Joins on time: each row with the nearest reading of another table, before it, after it or on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("before", "after", "nearest")


def nearest_reading(df: DataFrame, at: str, readings: DataFrame, time: str, keys: list[str], within: int, side: str = "nearest", tie: str | None = None, block: int = 86400) -> DataFrame:
    """`df` with `reading`, a struct of the reading's other columns and its `gap` in seconds (negative: before); null where
    there is none within that many seconds. A reading at the same time counts as before; of two that are equally far the
    earlier is taken, and of readings at one time the first by `tie`.

    No pairs are made: each time that a key asks for is looked up once; these times and the readings are united and sorted
    by time, forwards and backwards, and the last reading is carried along. A frame that reaches forward would be summed
    anew at every row. A key's time is cut into blocks of `block` seconds, each a group of its own, so no key has to fit into one task; what
    comes from other blocks is carried over a table of one row per key and block."""
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}")
    instant = lambda c: F.col(c).cast("timestamp")
    of = lambda c: F.expr(f"unix_micros(CAST(`{c}` AS TIMESTAMP)) div {block * 1_000_000}L")
    rest = [c for c in readings.columns if c not in (*keys, time)]
    one = F.min_by(F.struct(*rest), F.col(tie)) if tie else F.any_value(F.struct(*rest))
    each = readings.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(one.alias("r_")).withColumn("block_", of(time))
    point = F.struct(F.unix_micros(instant(time)).alias("t"), F.col("r_"))
    each = each.select(*keys, "block_", F.col(time).alias("time_"), point.alias("point_"))
    rows = df.select(*keys, at).distinct().withColumns({"block_": of(at), "time_": instant(at), "mine_": F.lit(1)})
    both = rows.unionByName(each.withColumn("mine_", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy(*keys, "block_").orderBy("time_", "mine_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = Window.partitionBy(*keys, "block_").orderBy(F.desc("time_"), F.desc("mine_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({"back_": F.last("point_", True).over(past), "ahead_": F.last("point_", True).over(future)}).filter("mine_ = 1")
    ends = each.groupBy(*keys, "block_").agg(F.min("point_.t").alias("low_"), F.min_by("point_", "time_").alias("first_"), F.max_by("point_", "time_").alias("last_"))
    ends = ends.unionByName(rows.select(*keys, "block_"), allowMissingColumns=True).groupBy(*keys, "block_").agg(F.first("first_", True).alias("first_"), F.first("last_", True).alias("last_"))
    earlier, later = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("block_"), F.desc("block_")))
    carried = ends.select(*keys, "block_", F.last("last_", True).over(earlier).alias("earlier_"), F.last("first_", True).over(later).alias("later_"))
    same = [seen[k].eqNullSafe(carried[k]) for k in (*keys, "block_")]
    out = seen.join(carried, [F.expr("true"), *same][1:], "left")
    now = F.unix_micros("time_")
    back, ahead = F.coalesce("back_", "earlier_"), F.coalesce("ahead_", "later_")
    gap = lambda p: F.abs(p["t"] - now)
    near = {"before": back, "after": ahead, "nearest": F.when(ahead.isNull() | (gap(back) <= gap(ahead)), back).otherwise(ahead)}[side]
    out = out.select(*(seen[c].alias(f"asked_{i}_") for i, c in enumerate((*keys, at))), near.alias("near_"), now.alias("now_"))
    asked = [df[c].eqNullSafe(out[f"asked_{i}_"]) for i, c in enumerate((*keys, at))]
    out = df.join(out, asked, "left")
    reading = F.struct(*(F.col(f"near_.r_.{c}").alias(c) for c in rest), ((F.col("near_.t") - F.col("now_")) / 1_000_000).alias("gap"))
    return out.withColumn("reading", F.when(F.abs(F.col("near_.t") - F.col("now_")) <= within * 1_000_000, reading)).select(*df.columns, "reading")
