"""Live updates as streams: newest state per match, day counts with late data, once-per-match learning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchmill.operators.lookups import latest_per_key

LATE = "12 days"


def day_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per day and kind; a day closes when the watermark passes it."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", LATE)
    return timed.groupBy(F.window("at", "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), kind, "n")


def once_per_key(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", LATE).dropDuplicatesWithinWatermark([key])


def merging(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], keys: list[str], *order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row of each key of the table and the batch. Replaying a batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        old = read()
        write(latest_per_key(batch if old is None else old.unionByName(batch), keys, *order))

    return merge
