"""Reading what the pipelines take in: season tables, nested feeds, rating snapshots, odds of unknown nesting, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmill.functions.semantics import possible_names

EVENT = "id string, startTimestamp long, homeTeam struct<id:string,name:string>, awayTeam struct<id:string,name:string>, tournament struct<name:string,category:struct<name:string>>, status struct<type:string>, homeScore struct<current:int>, awayScore struct<current:int>"


def season_csv(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Season tables: all strings, trimmed, quotes doubled, columns by header; missing ones are null."""
    parts = [spark.read.csv(p, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE") for p in paths]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.select(*(F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in columns))


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Scheduled events of files that hold a list, or one under `events` or `data`."""
    raw = spark.read.text(path, wholetext=True)
    events = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.coalesce(F.get_json_object("value", "$.events"), F.get_json_object("value", "$.data")))
    return raw.select(F.explode(F.from_json(events, f"array<struct<{_nested(EVENT)}>>")).alias("e")).select("e.*").dropDuplicates(["id"])


def _nested(ddl: str) -> str:
    depth, out, start = 0, [], 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


def fallback_chain(sources: list[DataFrame], day: str = "match_date") -> DataFrame:
    """Each later source only for whole days that no earlier one has."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(day).distinct(), day, "left_anti"), allowMissingColumns=True)
    return out


def rating_snapshot(df: DataFrame, club: str, rating: str, row: str) -> DataFrame:
    """(name, elo) for every variant of each club's name; the last row that has it wins."""
    each = df.select(F.explode(possible_names(F.col(club))).alias("name"), F.col(rating).cast("double").alias("elo"), row)
    return each.groupBy("name").agg(F.max_by("elo", row).alias("elo"))


def live_statistics(blocks: Column) -> Column:
    """Statistics nested in blocks and groups as one map from name to (home, away); the last of equal names wins."""
    items = F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(b["groups"], lambda g: g["statisticsItems"]))))
    name = lambda i: F.regexp_replace(F.lower(i["name"]), r"\s+", "_")
    return F.aggregate(items, F.expr("cast(map() as map<string,struct<home:string,away:string>>)"), lambda m, i: F.map_concat(F.map_filter(m, lambda k, v: k != name(i)), F.create_map(name(i), F.struct(i["home"].cast("string").alias("home"), i["away"].cast("string").alias("away")))))


def lineup(players: Column) -> Column:
    """Starters, mean rating of rated starters, whether the line-up is complete."""
    start = F.filter(players, lambda p: ~F.coalesce(p["substitute"], F.lit(False)))
    rated = F.filter(start, lambda p: p["rating"] > 0)
    mean = F.when(F.size(rated) > 0, F.aggregate(rated, F.lit(0.0), lambda s, p: s + p["rating"]) / F.size(rated))
    return F.struct(F.size(start).alias("starters"), mean.alias("avg_rating"), (F.size(start) >= 10).alias("confirmed"))


def injuries(players: Column, names: int = 4) -> Column:
    """Injured players: how many, the rating that is missing, the first names."""
    out = F.filter(players, lambda p: F.coalesce(p["player"]["injured"], F.lit(False)) | F.lower(F.coalesce(p["status"], F.lit(""))).contains("doubt"))
    impact = F.aggregate(out, F.lit(0.0), lambda s, p: s + F.greatest(F.lit(0.0), F.coalesce(p["player"]["rating"], F.lit(0.0)) - 6))
    return F.struct(F.size(out).alias("count"), impact.alias("impact"), F.slice(F.transform(out, lambda p: p["player"]["name"]), 1, names).alias("names"))


def availability(pages: DataFrame, html: str = "html") -> DataFrame:
    """Counts of words about absences in pages."""
    low = F.lower(F.col(html))
    return pages.withColumns({"injured": F.regexp_count(low, F.lit("injur")), "suspended": F.regexp_count(low, F.lit("suspen")), "doubtful": F.regexp_count(low, F.lit("doubt"))})


def read_or_default(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, or an empty one where the path can't be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
