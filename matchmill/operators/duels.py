"""Two legs, merged meetings, rivalries, and the context and summaries of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchmill.functions.semantics import half_up, normalize_name
from matchmill.operators.features import RATING, or_else, points_per_game, reader, split

KNOCKOUT = "round|play|quarter|semi|final|knockout|qualif"

#: Names of rivals.
RIVALS = (("ajax", "feyenoord"), ("ajax", "psv"), ("feyenoord", "psv"), ("arsenal", "tottenham"), ("liverpool", "everton"), ("manchester united", "manchester city"), ("barcelona", "real madrid"), ("inter", "milan"), ("lazio", "roma"), ("celtic", "rangers"))


def leader(home: Column, away: Column) -> Column:
    return F.when(home > away, "home").when(away > home, "away")


def two_legs(df: DataFrame, round_label: Column | None = None) -> DataFrame:
    """`df` with both legs' totals from the current home team's view and who leads, from leg_home_id, leg_home_goals,
    leg_away_goals (null without a first leg), home_team_id and the current home_goals, away_goals (null: 0). A pair is
    active if there is a first leg or the round is a knock-out."""
    leg = F.col("leg_home_id").isNotNull()
    knockout = F.coalesce(F.lower(round_label).rlike(KNOCKOUT), F.lit(False)) if round_label is not None else F.lit(False)
    turned = F.col("leg_home_id") != F.col("home_team_id")
    first = lambda a, b: F.when(leg, F.when(turned, F.col(b)).otherwise(F.col(a))).otherwise(0)
    now_home, now_away = (F.coalesce(c, F.lit(0)) for c in ("home_goals", "away_goals"))
    home, away = first("leg_home_goals", "leg_away_goals") + now_home, first("leg_away_goals", "leg_home_goals") + now_away
    return df.withColumns({
        "active": leg | knockout, "home_aggregate": home.cast("long"), "away_aggregate": away.cast("long"), "aggregate_score": F.concat_ws("-", home.cast("long"), away.cast("long")), "leader": leader(home, away),
        "counted_home": now_home.cast("long"), "counted_away": now_away.cast("long"),
    })


def updated_legs(df: DataFrame, home_goals: Column, away_goals: Column) -> DataFrame:
    """two_legs() rows under a new score: the goals counted before go, the new ones come. A null score changes nothing."""
    known = F.col("active") & home_goals.isNotNull() & away_goals.isNotNull()
    h = F.when(known, F.col("home_aggregate") - F.col("counted_home") + home_goals).otherwise(F.col("home_aggregate"))
    a = F.when(known, F.col("away_aggregate") - F.col("counted_away") + away_goals).otherwise(F.col("away_aggregate"))
    return df.withColumns({"home_aggregate": h, "away_aggregate": a, "aggregate_score": F.concat_ws("-", h, a), "leader": leader(h, a), "counted_home": F.when(known, home_goals).otherwise(F.col("counted_home")), "counted_away": F.when(known, away_goals).otherwise(F.col("counted_away"))})


def merged_meetings(lists: list[DataFrame], key: str, n: int = 8) -> DataFrame:
    """The last n different meetings (key, day, home, away, score) of several lists, earlier lists first: one array per key.
    The repeats go in a pre-aggregated minimum, and only the last n of a key are gathered."""
    every = lists[0].withColumn("from", F.lit(0))
    for i, more in enumerate(lists[1:], 1):
        every = every.unionByName(more.withColumn("from", F.lit(i)), allowMissingColumns=True)
    same = [key, "day", "home", "away", "score"]
    rest = [c for c in every.columns if c not in (*same, "from")]
    first = every.groupBy(*same).agg(F.min(F.struct("from", *rest)).alias("x")).select(*same, *(F.col(f"x.{c}") for c in rest))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in ("day", "home", "away", "score"))))
    last = first.withColumn("rank", rank).filter(F.col("rank") <= n)
    return last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("day", "home", "away", "score", *rest))).alias("meetings"))


def rivalry(home: Column, away: Column, home_country: Column, away_country: Column) -> Column:
    """`rivaliteit` for known rivals, `streekduel` for teams of one country whose names start with the same word."""
    h, a = normalize_name(home), normalize_name(away)
    rivals = F.lit(False)
    for x, y in RIVALS:
        rivals |= (F.contains(h, F.lit(x)) & F.contains(a, F.lit(y))) | (F.contains(h, F.lit(y)) & F.contains(a, F.lit(x)))
    word = lambda n: F.substring_index(n, " ", 1)
    near = (home_country == away_country) & (home_country != "") & (word(h) != "") & (word(h) == word(a))
    return F.when(rivals, "rivaliteit").when(near, "streekduel")


def context(home_zone: Column, away_zone: Column, two_legged: Column, cup: Column, rivals: Column) -> Column:
    """What is at stake, joined by a middle dot; null if nothing is."""
    either = lambda *z: F.coalesce(home_zone.isin(*z), F.lit(False)) | F.coalesce(away_zone.isin(*z), F.lit(False))
    notes = F.array(F.when(either("relegation"), "degradatiedruk"), F.when(either("ucl", "promotion", "champions"), "topstrijd"), F.when(either("playoffs", "period"), "play-off druk"), F.when(two_legged, "tweeluik"), F.when(cup, "knock-out"), rivals)
    joined = F.array_join(F.filter(notes, lambda n: n.isNotNull()), " · ")
    return F.when(joined != "", joined)


def team_profile(df: DataFrame) -> DataFrame:
    """`df` (one row a team) with rates of points, attack, consistency, set pieces, discipline and fatigue."""
    g = reader(df)
    scored, conceded, games = or_else(g("avg_scored"), 1.35), or_else(g("avg_conceded"), 1.35), or_else(g("games"), 0.0)
    trend = half_up(scored - conceded, 2)
    return df.withColumns({
        "points_per_game": points_per_game(g("wins"), g("draws"), g("games")), "attack_trend": trend,
        "consistency": F.when(games == 0, 0.5).otherwise(half_up((or_else(g("wins"), 0.0) + or_else(g("draws"), 0.0) * 0.5) / F.greatest(games, F.lit(1.0)), 2)),
        "set_piece": half_up(or_else(g("avg_corners"), 4.5) * 0.45 + or_else(g("shots_on"), 4.0) * 0.35 + F.greatest(F.lit(0.0), trend) * 0.2, 2),
        "discipline": half_up(or_else(g("yellow_rate"), 0.0) + or_else(g("red_rate"), 0.0) * 1.7, 2),
        "fatigue": half_up(F.greatest(F.lit(0.0), 5 - games * 0.1) + F.greatest(F.lit(0.0), or_else(g("injuries"), 0.0) * 0.12), 2),
    })


def first_of(rules: list[tuple[str, Column]], n: int = 3) -> Column:
    """Names of the first n rules that hold."""
    return F.slice(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules)), lambda k: k.isNotNull()), 1, n)


def summaries(df: DataFrame) -> DataFrame:
    """team_profile() rows with up to three strengths and risks, in a fixed order."""
    g = reader(df)
    n = lambda k: or_else(g(k), 0.0)
    strong = [("hoog puntenritme", n("points_per_game") >= 1.9), ("positieve aanvalstrend", n("attack_trend") >= 0.45), ("sterke verdedigende split", n("clean_sheet_rate") >= 0.35), ("sterk in standaardsituaties", n("set_piece") >= 3.8), ("hoog cornersvolume", n("avg_corners") >= 5.2)]
    weak = [("laag puntenritme", n("points_per_game") <= 1.1), ("negatieve vormtrend", n("attack_trend") <= -0.2), ("regelmatig moeite met scoren", n("blank_rate") >= 0.35), ("meerdere afwezigen", n("injuries") >= 3), ("hoog kaartenritme", n("yellow_rate") >= 2.4), ("vermoeidheidsrisico", n("fatigue") >= 1.2)]
    return df.withColumns({"strengths": first_of(strong), "risks": first_of(weak)})


def edges(df: DataFrame) -> DataFrame:
    """`df` with line-up impact, tactical mismatch and form shift of the two sides, and what each amounts to."""
    g = reader(df)
    num = lambda k: or_else(g(k), 0.0)
    rating = half_up(or_else(g("home_rating"), RATING) - or_else(g("away_rating"), RATING), 2)
    keeper = half_up(num("home_keeper_rating") - num("away_keeper_rating"), 2)
    gain = lambda sign: F.greatest(F.lit(0.0), rating * sign) * 0.08 + F.greatest(F.lit(0.0), keeper * sign) * 0.04
    home_impact = half_up(num("home_injuries") * 0.12 - gain(1), 2)
    away_impact = half_up(num("away_injuries") * 0.12 + gain(-1), 2)  # the away side's gain counts upwards here
    s = lambda side, what: split(g, side, what)
    home_score, away_score = half_up(s("home", "scored") + s("away", "conceded"), 2), half_up(s("away", "scored") + s("home", "conceded"), 2)
    shift = lambda side: half_up(or_else(g(f"{side}_avg_scored"), 1.35) - s(side, "scored"), 2)
    home_shift, away_shift = shift("home"), shift("away")
    return df.withColumns({
        "home_impact": home_impact, "away_impact": away_impact, "lineup_edge": F.when(home_impact + 0.12 < away_impact, "home").when(away_impact + 0.12 < home_impact, "away").otherwise("neutral"),
        "home_tactical": home_score, "away_tactical": away_score, "tactical_edge": F.when(home_score > away_score + 0.35, "home").when(away_score > home_score + 0.35, "away").otherwise("balanced"),
        "home_shift": home_shift, "away_shift": away_shift, "form_edge": F.when((F.abs(home_shift) < 0.15) & (F.abs(away_shift) < 0.15), "stable").when(home_shift > away_shift, "home").otherwise("away"),
    })


def form_modifier(form: Column) -> Column:
    """Mean over a form string: W 1.2, D 1, anything else 0.8; 1 without form."""
    points = F.aggregate(F.split(form, ""), F.lit(0.0), lambda s, c: s + F.when(c == "W", 1.2).when(c == "D", 1.0).when(c == "", 0.0).otherwise(0.8))
    return F.when(F.coalesce(F.length(form), F.lit(0)) > 0, points / F.length(form)).otherwise(1.0)


def bias_shift(reviews: DataFrame, n: int = 80, least: int = 10) -> DataFrame:
    """One row: half the mean goal error of the newest n reviews, within bounds; 0 for fewer than `least`."""
    last = reviews.orderBy(F.desc("match_date"), F.desc("match_id")).limit(n)
    mean = F.greatest(F.lit(-0.25), F.least(F.lit(0.25), F.avg("goal_bias")))
    return last.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, mean * 0.5).otherwise(0.0).alias("shift"))
