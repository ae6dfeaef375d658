"""Writing: day-partitioned tables, training exports, findings, digests, API envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str, day: str = "match_date") -> None:
    """Only the days in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def training_rows(features: DataFrame, names: list[str], label: str) -> DataFrame:
    """Labelled rows with the configured features, zero where one is missing."""
    have = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in features.columns else F.lit(0.0).alias(n) for n in names]
    return features.filter(F.col(label).isNotNull()).select("match_id", "league", *have, label)


def export_training(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").csv(f"{path}/csv", header=True, quote='"', escape='"')


def append_findings(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("day").parquet(path)


def envelope(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())))


def digest_lines(top: DataFrame, totals: DataFrame) -> DataFrame:
    """(at, line) of a digest in Markdown, from monitor.digest() and monitor.digest_totals(), which are a few rows."""
    head = totals.select(F.explode(F.array(
        F.lit("# Digest"), F.lit(""), F.concat(F.lit("- Runs: "), F.col("runs")), F.concat(F.lit("- Findings: "), F.col("issues")),
        F.concat(F.lit("- Kinds: "), F.col("kinds")), F.lit(""), F.lit("## Findings"),
    )).alias("line"))
    head = head.withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy(F.desc("issues"), "key"))
    text = F.concat(F.lit("- "), F.col("key"), F.lit(" ("), F.col("issues"), F.lit("x, severity "), F.col("severity"), F.lit("): "), F.coalesce("sample", F.lit("")))
    return head.select("at", "line").unionByName(top.select((place + 100).cast("long").alias("at"), text.alias("line")))


def write_digest(top: DataFrame, totals: DataFrame, path: str) -> None:
    """The digest as JSON, its findings inside its totals, and as Markdown."""
    order = ("place", "key", "issues", "severity", "sample")
    found = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("issues"), "key"))).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("findings"))
    totals.crossJoin(F.broadcast(found)).coalesce(1).write.mode("overwrite").json(f"{path}/json")  # a row each
    digest_lines(top, totals).coalesce(1).sortWithinPartitions("at").select("line").write.mode("overwrite").text(f"{path}/markdown")
