"""Caches as keyed state with a time to live, and live scores over today's matches, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from matchmill.operators.lookups import latest_per_key
from matchmill.operators.upkeep import CACHES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "cache string, key string, updated timestamp, value string, live boolean"


class Expiring(StatefulProcessor):
    """The newest value of each (cache, key). It expires when the watermark passes the hours that its cache allows; a newer
    value puts that off, an older one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        newest = held
        for part in rows:
            at = part["updated"].astype("datetime64[us]").astype("int64")
            for t, value in zip(at.tolist(), part["value"].tolist()):
                if newest is None or t > newest[0]:
                    newest = (t, value)
        if newest is None or newest == held:
            return
        until = lambda entry: entry[0] // 1000 + CACHES[key[0]][0] * 3_600_000
        if held is not None:
            self.handle.deleteTimer(until(held))
        self.entry.update(newest)
        self.handle.registerTimer(until(newest))
        yield self._row(key, newest, True)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        entry = self.entry.get()
        self.entry.clear()
        yield self._row(key, entry, False)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, entry: tuple, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"cache": [key[0]], "key": [key[1]], "updated": [pd.Timestamp(entry[0], unit="us")], "value": [entry[1]], "live": [live]})


def expiring(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (cache, key, updated, value) as a stream of changes: each newer value as it comes, and each value again,
    no longer live, once it has expired. Rows that the watermark has passed and caches without limits are dropped. Needs
    the RocksDB state store, which `use_rocks` sets."""
    known = entries.filter(F.col("cache").isin(list(CACHES))).withColumn("updated", F.col("updated").cast("timestamp")).withWatermark("updated", late)
    keyed = known.select("cache", "key", "updated", "value").groupBy("cache", "key")
    return keyed.transformWithStateInPandas(statefulProcessor=Expiring(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def live_overlay(matches: DataFrame, feed: DataFrame, fields: list[str], late: str = "2 hours", lasting: str = "3 hours") -> DataFrame:
    """Streams of today's matches (match_id, kickoff, ...) and of a live feed (match_id, seen, ...): each match with each of
    its feed rows that is seen until `lasting` after the kick-off, and once without any if none came before the watermark.
    Feed rows without a match are dropped. State of both sides goes when the watermark has passed it."""
    m = matches.withColumn("kickoff", F.col("kickoff").cast("timestamp")).withWatermark("kickoff", late)
    new = feed.select(F.col("match_id").alias("of"), F.col("seen").cast("timestamp").alias("seen"), *(F.col(c).alias(f"new_{c}") for c in fields)).withWatermark("seen", late)
    new = new.dropDuplicatesWithinWatermark(["of", "seen"])
    near = (F.col("match_id") == F.col("of")) & (F.col("seen") >= F.col("kickoff")) & (F.col("seen") <= F.col("kickoff") + F.expr(f"INTERVAL {lasting}"))
    out = m.join(new, near, "left_outer")
    return out.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else c for c in matches.columns), "seen")


def newest_overlay(rows: DataFrame) -> DataFrame:
    """Of what `live_overlay` gave, the row of each match that was seen last."""
    seen = rows.withColumn("seen", F.coalesce("seen", F.timestamp_seconds(F.lit(0))))
    return latest_per_key(seen, ["match_id"], "seen").drop("seen")
