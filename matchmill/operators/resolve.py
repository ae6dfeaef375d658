"""Head-to-head of coming matches from several sources: the feed's meetings, the previous leg, the league's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchmill.operators.features import recent_balance

#: Meetings that the feed, the history and a merged list keep, and from how many on no history is added.
FEED, HISTORY, MERGED, ENOUGH = 8, 5, 8, 3
MEETING = "struct<day:date,home:bigint,away:bigint,score:string,winner:bigint>"


def meeting(day: Column, home: Column, away: Column, home_goals: Column, away_goals: Column) -> Column:
    winner = F.when(home_goals > away_goals, home).when(home_goals < away_goals, away)
    return F.struct(day.cast("date").alias("day"), home.cast("long").alias("home"), away.cast("long").alias("away"), F.concat_ws("-", home_goals, away_goals).alias("score"), winner.cast("long").alias("winner"))


def by_pair(m: DataFrame, *keep: str) -> DataFrame:
    """Matches by pair of teams (a, b) in the order of time, shuffled and sorted once, with the columns of `keep`. Those to
    come or under way ask for what the pair has played, and stand before the played ones of their day; of these only those
    with a score and a day count."""
    pair = {"a": F.least("home_team_id", "away_team_id"), "b": F.greatest("home_team_id", "away_team_id"), "asks": F.col("status") != "FT"}
    rows = m.withColumns(pair).filter("asks OR (status = 'FT' AND home_goals IS NOT NULL AND match_date IS NOT NULL)")
    return _in_time(rows.select("a", "b", "match_date", "asks", "match_id", *keep))


def _in_time(rows: DataFrame) -> DataFrame:
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "match_date", F.desc("asks"), "match_id")


def with_last_leg(rows: DataFrame, leg: Column) -> DataFrame:
    """`rows` of `by_pair` with `leg` of the pair's last day with a played match, up to the row's own day; of that day's
    matches the first. One maximum is carried along a pair."""
    so_far = Window.partitionBy("a", "b").orderBy("match_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.when(~F.col("asks"), F.struct(F.col("match_date"), -F.col("match_id")))
    return rows.withColumn("leg", F.max_by(leg, place).over(so_far))


def with_last(rows: DataFrame, meeting: Column, lists: dict[str, tuple[Column, int]]) -> DataFrame:
    """Those of `by_pair` that ask, with an array for each of `lists` (name: which meetings, n): the pair's last n of these
    meetings on earlier days, oldest first. In the order of `by_pair` all played matches before one that asks are of
    earlier days, so each meeting is read at its place back; nothing is joined, and a row costs n whatever the pair played."""
    x = rows.withColumns({f"{name}_": F.when(~F.col("asks") & which, meeting) for name, (which, _) in lists.items()})
    back = lambda name, i: F.expr(f"lag({name}_, {i}) IGNORE NULLS OVER (PARTITION BY a, b ORDER BY match_date, asks DESC, match_id)")
    x = x.select(*rows.columns, *(back(name, i).alias(f"{name}_{i}") for name, (_, n) in lists.items() for i in range(n, 0, -1))).filter("asks")
    return x.select(*rows.columns, *(F.array_compact(F.array(*(f"{name}_{i}" for i in range(n, 0, -1)))).alias(name) for name, (_, n) in lists.items()))


def last_meetings(asked: DataFrame, played: DataFrame, n: int, name: str) -> DataFrame:
    """`asked` (match_id, a, b, match_date, ...) with the array `name` of the pair's last n of `played` (a, b, match_date,
    match_id, meeting) on earlier days, oldest first."""
    done = played.filter("match_date IS NOT NULL").select("a", "b", "match_date", "match_id", "meeting", F.lit(False).alias("asks"))
    rows = asked.withColumn("asks", F.lit(True)).unionByName(done, allowMissingColumns=True)
    return with_last(_in_time(rows), F.col("meeting"), {name: (F.lit(True), n)}).drop("asks", "meeting")


def merged(first: Column, more: Column, n: int = MERGED) -> Column:
    """The last n by day of two arrays of meetings; of the same meeting the earlier entry, of one day in the order given."""
    placed = F.transform(F.concat(first, more), lambda m, i: F.struct(m["day"].alias("day"), i.alias("at"), m.alias("m")))
    same = lambda x, y: (x["m"]["day"] == y["m"]["day"]) & (x["m"]["home"] == y["m"]["home"]) & (x["m"]["away"] == y["m"]["away"]) & (x["m"]["score"] == y["m"]["score"])
    kept = F.filter(placed, lambda x: ~F.exists(placed, lambda y: same(x, y) & (y["at"] < x["at"])))
    ordered = F.transform(F.array_sort(kept), lambda x: x["m"])
    return F.slice(ordered, F.greatest(F.size(ordered) - (n - 1), F.lit(1)), F.lit(n))


def resolved(df: DataFrame) -> DataFrame:
    """`df` (home_team_id, away_team_id, feed, leg, history; `leg` a meeting without winner or null) with played, home_wins,
    draws, away_wins, same_competition, balance, results and status.

    The feed's meetings count. Without any the previous leg stands alone, else it is added unless its score stands somewhere
    in them (in a day as well, as they are searched as text). With fewer than ENOUGH meetings the history is merged in,
    and all are counted anew; the leg, which has no winner, counts as a draw then."""
    home, away = F.col("home_team_id"), F.col("away_team_id")
    of = lambda c, w: F.size(F.filter(c, lambda m: m["winner"] == w))
    drawn = lambda c: F.size(F.filter(c, lambda m: m["winner"].isNull()))
    none, has_leg = F.size("feed") == 0, F.col("leg").isNotNull()
    text = F.array_join(F.transform("feed", lambda m: F.concat_ws(",", m["day"].cast("string"), m["score"])), ";")
    added = has_leg & (none | ~F.contains(text, F.col("leg.score")))
    x = df.withColumns({"one": F.when(added, F.concat("feed", F.array("leg"))).otherwise(F.col("feed")), "state": F.when(~none, "loaded").when(has_leg, "fallback").otherwise("empty")})
    late = (F.size("one") < ENOUGH) & (F.size("history") > 0)
    x = x.withColumns({"late": late, "results": F.when(late, merged(F.col("one"), F.col("history"))).otherwise(F.col("one"))})
    count = lambda f, w=None: F.when(F.col("late"), f("results", w) if w is not None else f("results")).otherwise(F.when(none, F.lit(0)).otherwise(f("feed", w) if w is not None else f("feed")))
    signs = F.transform("results", lambda m: F.when(m["winner"] == home, 1).when(m["winner"] == away, -1).otherwise(0))
    return x.withColumns({
        "played": F.size("results"), "home_wins": count(of, home), "draws": count(drawn), "away_wins": count(of, away), "same_competition": F.size("feed") + F.when(F.col("late"), F.size("history")).otherwise(0),
        "balance": recent_balance(signs, True), "status_h2h": F.when(~F.col("late"), F.col("state")).when(F.size("one") > 0, "merged-historical-competition").otherwise("historical-competition"),
    }).drop("one", "state", "late")
