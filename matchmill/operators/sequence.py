"""Folds over time: streaks, smoothed attack and defence, Elo."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

K, START_ELO, START_RATE = 22.0, 1500.0, 1.5


def best_streak(df: DataFrame, keys: list[str], hit: Column, *order: str) -> DataFrame:
    """Longest run of hits of each key in order: misses cut the rows into islands."""
    by = Window.partitionBy(*keys).orderBy(*order)
    islands = df.select(*keys, *order, hit.alias("hit")).withColumn("island", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(by))
    runs = islands.groupBy(*keys, "island").agg(F.count_if("hit").alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").cast("long").alias("best_streak"))


#: Rows whose maps one task composes at a time.
CHUNK = 4096
MAP = "struct<a:double,b:double,low:double,high:double>"


def smoothing(value: Column, alpha: float = 0.06, unit: float = 1.35, low: float = 0.6, high: float = 3.0) -> Column:
    """The step x -> (1 - alpha) x + alpha value / unit within bounds, as a map of four numbers."""
    return F.struct(F.lit(1 - alpha).alias("a"), (value * alpha / unit).cast("double").alias("b"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def after(f: Column, g: Column) -> Column:
    """The map that takes f first and then g. Maps x -> min(high, max(low, a x + b)) with a > 0 stay of that form."""
    bound = lambda x: F.greatest(g["low"], F.least(g["high"], g["a"] * x + g["b"]))
    return F.struct((f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), bound(f["low"]).alias("low"), bound(f["high"]).alias("high"))


def applied(f: Column, x: Column) -> Column:
    return F.greatest(f["low"], F.least(f["high"], f["a"] * x + f["b"]))


def _next(name: str) -> Callable[[Column, Column], Column]:
    return lambda f, row: after(f, row[name])


def composed(df: DataFrame, key: str, order: list[str], maps: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """(key, maps): the maps of each key's rows, one after the other in `order`, as one map. As composing is associative, rows
    are dealt out by ranges, chunks of them are composed in parallel, then chunks of chunks, and the few that are left per
    range of rows; a key of any size is spread over the tasks, and what a task holds is bounded."""
    none = F.expr(f"cast(struct(1.0D, 0.0D, -double('infinity'), double('infinity')) as {MAP})")
    rows = df.select(key, *order, *(m.alias(n) for n, m in maps.items())).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = rows.select(key, F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("at"), *maps)
    for by in ([key, "run", "part"], [key, "run", "part"], [key]):
        held = rows.withColumn("part", F.expr(f"at div {chunk}L")) if "part" in by else rows
        ordered = held.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", *maps))).alias("rows"))
        whole = {n: F.aggregate("rows", none, _next(n)) for n in maps}
        rows = ordered.select(key, *([F.col("run"), F.col("part").alias("at")] if "part" in by else []), *(m.alias(n) for n, m in whole.items()))
    return rows


def folded(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, Any], None], rows: Callable[[Any, Any], list[tuple]]) -> DataFrame:
    """Folds the rows of each key in `order`: they come sorted, batch after batch, and only the state of the key at hand is
    kept, never its rows. start() gives a state, step(state, row) changes it, rows(key, state) gives what it comes to."""
    at, kind = df.columns.index(key), df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[at] != now:
                    out += rows(now, state) if state is not None else []
                    now, state = row[at], start()
                step(state, row)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in out], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows(now, state)], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def rates(t: DataFrame) -> DataFrame:
    """(team_id, attack, defence) after all scored games of a team: smoothed goals for and against."""
    scored = t.filter("gf IS NOT NULL AND ga IS NOT NULL")
    out = composed(scored, "team_id", ["match_date", "match_id"], {"attack": smoothing(F.col("gf")), "defence": smoothing(F.col("ga"))})
    return out.select("team_id", *(applied(F.col(c), F.lit(START_RATE)).alias(c) for c in ("attack", "defence")))


def elo(m: DataFrame) -> DataFrame:
    """(league, team_id, elo, played) after all scored matches. Teams meet inside a league, so leagues are independent;
    a league's matches are folded in order with its teams' ratings as the only state. The fold of one league can't be
    split, as each match depends on the ones before it."""

    def step(state: dict[int, list[float]], row: tuple) -> None:
        home, away, hg, ag = row[3:7]
        h, a = (state.setdefault(t, [START_ELO, 0]) for t in (home, away))
        shift = K * ((1.0 if hg > ag else 0.0 if hg < ag else 0.5) - 1 / (1 + 10 ** ((a[0] - h[0]) / 400)))
        h[0], a[0] = h[0] + shift, a[0] - shift
        for x in (h, a):
            x[1] += 1

    scored = m.filter("home_goals IS NOT NULL").select("league", "match_date", "match_id", "home_team_id", "away_team_id", "home_goals", "away_goals")
    result = lambda key, state: [(key, team, x[0], x[1]) for team, x in state.items()]
    return folded(scored, "league", ["match_date", "match_id"], "league string, team_id long, elo double, played long", dict, step, result)
