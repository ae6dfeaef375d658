"""Upkeep of the store: what is kept for how long, what predictions keep when they are past, and reviews by changed days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchmill.functions.semantics import to_fixed
from matchmill.operators.model import largest

#: For how many hours an entry of each cache is good, and how many entries the cache keeps.
CACHES = {
    "teamStats": (6, 600),
    "teamInjuries": (4, 600),
    "teamSeasonStats": (12, 600),
    "eventCache": (12, 300),
    "marketProfiles": (24, 64),
    "h2hCache": (72, 500),
    "weatherCache": (6, 220),
}
#: Hours after which the ratings' snapshot is dropped as a whole; days kept before and after the reference
#: day; reviews kept; scores that a stored prediction keeps.
RATINGS_HOURS, DAYS_BACK, DAYS_FORWARD, REVIEWS, SCORES_KEPT = 24, 12, 4, 2500, 10
#: What is left of the ensemble's description once a prediction is past.
ENSEMBLE_KEPT = ("active", "base_model", "blend_model", "blend_weight_base", "blend_weight_heuristic", "agreement", "base_probabilities", "heuristic_probabilities")


def _limit(cache: Column, at: int) -> Column:
    return F.element_at(F.create_map(*(x for name, limit in CACHES.items() for x in (F.lit(name), F.lit(limit[at])))), cache)


def pruned_caches(entries: DataFrame, now: Column) -> DataFrame:
    """Of (cache, key, updated, ...) the entries that are young enough, and of these the newest of each cache, by key among
    equals. An entry without a time is as old as can be. The largest limit is a plain number, so that each task passes on
    no more rows of a cache than that before they meet."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("updated", F.timestamp_seconds(F.lit(0))))
    young = entries.filter(age <= _limit(F.col("cache"), 0) * 3600)
    newest = Window.partitionBy("cache").orderBy(F.desc("updated"), "key")
    most = max(n for _, n in CACHES.values())
    ranked = young.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= most)
    return ranked.filter(F.col("rank") <= _limit(F.col("cache"), 1)).drop("rank")


def retained(df: DataFrame, day: str, reference: Column) -> DataFrame:
    return df.filter(F.col(day).between(F.date_sub(reference, DAYS_BACK), F.date_add(reference, DAYS_FORWARD)))


def compacted_predictions(p: DataFrame, reference: Column, day: str = "match_date") -> DataFrame:
    """Predictions as the store keeps them: the largest scores, and of days other than the reference day and the next one
    neither features nor analysis, and the ensemble without its details. Columns that aren't there are passed over."""
    past = ~((F.col(day) == reference) | (F.col(day) == F.date_add(reference, 1)))
    out = p.withColumn("score_map", largest(F.col("score_map"), SCORES_KEPT)) if "score_map" in p.columns else p
    for c in ("features", "analysis"):
        if c in p.columns:
            out = out.withColumn(c, F.when(~past, F.col(c)))
    if "ensemble" in p.columns:
        fields = p.schema["ensemble"].dataType.names
        short = F.struct(*((F.col(f"ensemble.{f}") if f in ENSEMBLE_KEPT else F.lit(None).cast(p.schema["ensemble"].dataType[f].dataType)).alias(f) for f in fields))
        out = out.withColumn("ensemble", F.when(past & F.col("ensemble").isNotNull(), short).otherwise(F.col("ensemble")))
    return out


def compacted_store(store: dict[str, DataFrame], reference: Column, now: Column) -> dict[str, DataFrame]:
    """The store's tables as they are kept: `matches`, `predictions` and `knockout` of the retained days (a day that has
    matches decides for all three), `reviews` the newest, `caches` pruned, `ratings` dropped as a whole once stale."""
    out = dict(store)
    for name in ("matches", "predictions", "knockout"):
        if name in store:
            out[name] = retained(store[name], "match_date", reference)
    if "predictions" in out:
        out["predictions"] = compacted_predictions(out["predictions"], reference)
    if "reviews" in store:
        out["reviews"] = store["reviews"].orderBy(F.desc("created_at"), "match_id").limit(REVIEWS)
    if "caches" in store:
        out["caches"] = pruned_caches(store["caches"], now)
    if "ratings" in store:
        out["ratings"] = store["ratings"].filter(F.unix_timestamp(now) - F.unix_timestamp("updated") <= RATINGS_HOURS * 3600)
    return out


# --- reviews by changed days


def day_digests(df: DataFrame, day: str = "match_date") -> DataFrame:
    """(day, rows, digest): a digest of each day's rows that doesn't depend on their order and counts repeats."""
    whole = F.to_json(F.struct(*sorted(df.columns)))  # fields that are null are left out, so they differ from all others
    each = F.xxhash64(whole)
    halves = F.struct(F.sum(F.shiftright(each, 32)).alias("high"), F.sum(each.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("rows"), halves.alias("digest"))


def changed_days(old: DataFrame, new: DataFrame, day: str = "match_date") -> DataFrame:
    """Days whose digests differ, and days that only one side has, with whether the new side has them."""
    a, b = (x.select(F.col(day), F.struct("rows", "digest").alias(name)) for x, name in ((old, "was"), (new, "now")))
    return a.join(b, day, "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select(day, F.col("now").isNotNull().alias("present"))


#: Counts and sums of a day's reviews; those of several days add up, and rates come from the sums.
SUMS = ("matches", "outcome_hits", "exact_hits", "goal_error")


def day_sums(reviews: DataFrame, key: str, day: str = "match_date") -> DataFrame:
    """One row per day and key with SUMS."""
    return reviews.groupBy(day, key).agg(
        F.count(F.lit(1)).alias("matches"), F.count_if("outcome_hit").alias("outcome_hits"), F.count_if("exact_hit").alias("exact_hits"), F.sum("goal_error").cast("long").alias("goal_error"),
    )


def rates(sums: DataFrame, key: str) -> DataFrame:
    """Reliability figures of all days from the sums of single days."""
    total = sums.groupBy(key).agg(*(F.sum(c).alias(c) for c in SUMS))
    n = F.col("matches")
    return total.select(key, "matches", to_fixed(F.col("outcome_hits") / n, 2).alias("hit_rate"), to_fixed(F.col("exact_hits") / n, 2).alias("exact_rate"), to_fixed(F.col("goal_error") / n, 2).alias("avg_goal_error"))


class Store:
    """Reviews and their sums as tables partitioned by day, kept up by the days that changed."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("label", "phase"), day: str = "match_date"):
        self.spark, self.path, self.keys, self.day = spark, path.rstrip("/"), keys, day

    def table(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def _write(self, df: DataFrame, name: str) -> None:
        rows = df.repartition(self.day) if self.day in df.columns else df
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day).parquet(f"{self.path}/{name}")

    def rebuild(self, matches: DataFrame, review: Callable[[DataFrame], DataFrame]) -> list:
        """Reviews the days whose matches changed since the last call, and only these: `review` maps matches to reviews.
        Gives the days that were written. Reviews of days that the matches no longer have stay, as a store that has let
        old matches go keeps what they taught. A day's digest is written last, so a call that broke off is made up for."""
        now = day_digests(matches, self.day)
        old = self.table("digests")
        days = changed_days(old, now, self.day).filter("present") if old is not None else now.select(self.day)
        days = [r[0] for r in days.orderBy(self.day).collect()]  # one value per changed day
        if days:
            some = review(matches.filter(F.col(self.day).isin(days)))
            self._write(some, "reviews")
            fresh = self.table("reviews").filter(F.col(self.day).isin(days))
            for key in self.keys:
                self._write(day_sums(fresh, key, self.day), f"sums-{key}")
            self._write(now.filter(F.col(self.day).isin(days)), "digests")
        return days

    def reliability(self, key: str) -> DataFrame:
        return rates(self.table(f"sums-{key}"), key)

