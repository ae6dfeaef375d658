"""Keyed operators: latest, last n, upsert, priority, range, nearest, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by `order`; a pre-aggregated maximum, so no key is sorted in one task."""
    best = F.max(F.struct(*order, F.struct(*[c for c in df.columns if c not in keys and c not in order]).alias("rest"))).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *(f"best.{c}" for c in order), "best.rest.*")


def last_n_per_key(df: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The last n rows of each key with `rank`, 1 for the last."""
    by = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def priority_lookup(df: DataFrame, names: Column, table: DataFrame, key: str, value: str, id: str) -> DataFrame:
    """`df` with the value of the first of its names that `table` has."""
    tried = df.select(id, F.posexplode(names).alias("at", key)).join(table, key)
    hit = tried.groupBy(id).agg(F.min(F.struct("at", value)).alias("hit")).select(id, F.col(f"hit.{value}").alias(value))
    return df.join(hit, id, "left")


def range_lookup(df: DataFrame, at: str, ranges: DataFrame, low: str, high: str, order: str, keys: list[str], id: str) -> DataFrame:
    """`df` with the first of its key's ranges that holds `at`; the ranges of a key are few."""
    right = ranges.select(*keys, low, high, order, *[c for c in ranges.columns if c not in (*keys, low, high, order)])
    hit = df.select(id, at, *keys).join(right, keys).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    rest = [c for c in ranges.columns if c not in (*keys, low, high, order)]
    first = hit.groupBy(id).agg(F.min(F.struct(order, *rest)).alias("hit")).select(id, *(f"hit.{c}" for c in rest))
    return df.join(first, id, "left")


def nearest(points: Column, at: Column, time: str) -> Column:
    """The element of an array of structs whose time is nearest; the first of equals."""
    return F.array_min(F.transform(points, lambda p, i: F.struct(F.abs(p[time] - at).alias("gap"), i.alias("at"), p.alias("point"))))["point"]


def expire(df: DataFrame, updated: str, now: Column, ttl_seconds: int, most: int, *tie: str) -> DataFrame:
    """Rows no older than the limit, and of these the newest `most`; of equally new ones those first by `tie`."""
    young = df.filter(F.unix_timestamp(now) - F.unix_timestamp(F.col(updated).cast("timestamp")) <= ttl_seconds)
    return young.orderBy(F.col(updated).desc(), *tie).limit(most)
