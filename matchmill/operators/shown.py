"""What a match, a day and the history show: fields with defaults, places, knock-outs, edges, absences, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchmill.functions.semantics import falsy_or, parse_score, to_fixed
from matchmill.operators.features import or_else, reader, split

#: Fields that are always there, what stands for an empty one, those that 0 and an empty text count for, and
#: those that need a value.
ALWAYS = ("match_id", "match_date", "kickoff", "league")
DEFAULTS = {"home_team_id": "", "away_team_id": "", "home_team_name": "Home", "away_team_name": "Away", "home_logo": "", "away_logo": "", "status": "NS"}
PRESENT = (
    "minute_value", "period", "extra_time", "live_updated_at", "home_club_elo", "away_club_elo", "home_position", "away_position",
    "importance", "round_label", "home_rest", "away_rest",
)
FILLED = (
    "score", "minute", "home_form", "away_form", "home_elo", "away_elo", "context", "h2h", "h2h_status", "aggregate", "home_season", "away_season",
    "home_recent", "away_recent", "home_injuries", "away_injuries", "lineup", "weather", "venue", "home_goal_timing", "away_goal_timing", "live_stats",
    "home_profile", "away_profile", "referee", "edges", "learning", "calibration", "review", "features", "ensemble", "odds", "market_movement", "coverage",
)

#: How strict a referee is, from that many cards a game on.
STRICT = ((4.8, "streng"), (3.2, "gemiddeld"))
LENIENT = "laat doorspelen"
UNKNOWN = "Onbekend"


def filled(df: DataFrame, name: str) -> Column:
    """The field where it holds something: a number other than 0 and NaN, a text that isn't empty, true, or any nested value."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.StringType, T.BooleanType)):
        return falsy_or(F.col(name), F.lit(None).cast(kind))
    return F.col(name)


def match_fields(m: DataFrame) -> DataFrame:
    """The fields of `m` that a match shows, in a fixed order; what is omitted is null, so `to_json` of the row leaves it out.
    A field with a default never is null. Unknown columns aren't shown."""
    default = {n: F.coalesce(filled(m, n).cast("string"), F.lit(d)) for n, d in DEFAULTS.items() if n in m.columns}
    plain = {n: F.col(n) for n in (*ALWAYS, *PRESENT) if n in m.columns}
    some = {n: filled(m, n) for n in FILLED if n in m.columns}
    every = default | plain | some
    return m.select(*(every[n].alias(n) for n in (*ALWAYS, *DEFAULTS, *PRESENT, *FILLED) if n in every))


def with_places(m: DataFrame, tables: DataFrame) -> DataFrame:
    """`m` with each side's place: that in the last table (by `ord`) that holds the team, else the match's own; 0 is none.
    `tables` (team_id, ord, position) shrinks to a row a team before the joins."""
    last = tables.filter("team_id IS NOT NULL").groupBy("team_id").agg(F.max_by("position", "ord").alias("listed"))
    none = lambda c: F.nullif(F.col(c), F.lit(0))
    for side in ("home", "away"):
        m = m.join(last.select(F.col("team_id").alias(f"{side}_team_id"), "listed"), f"{side}_team_id", "left")
        m = m.withColumn(f"{side}_position", F.coalesce(none("listed"), none(f"{side}_position"))).drop("listed")
    return m


def knockouts(m: DataFrame, *order: str) -> DataFrame:
    """A day's knock-out matches and their place in that day: those of a cup, those with an active aggregate, and those whose
    context names a play-off. Rows without a round go under `Knock-out`; all but running and finished ones are to come."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = yes(F.col("league_type") == "cup") | yes(F.col("active")) | yes(F.contains(F.col("context"), F.lit("play-off")))
    place = F.row_number().over(Window.partitionBy("match_date").orderBy(*order, "match_id"))
    state = F.when(F.col("status").isin("LIVE", "FT"), F.col("status")).otherwise("NS")
    return m.filter(out).withColumns({"round_key": falsy_or(F.col("round_label"), "Knock-out"), "status": state, "place": place})


def referee_profile(df: DataFrame) -> DataFrame:
    """`df` with cards_trend, penalty_rate, strictness, source and known_games of the match's referee: from the referee's own
    games (known_cards, known_penalties, known_games) where there are any, else estimated from the cards and goals of both
    teams and what the market got wrong. Null without a referee."""
    g = reader(df)
    cards = lambda s: or_else(g(f"{s}_yellow_rate"), 0.0) + or_else(g(f"{s}_red_rate"), 0.0) * 1.8
    goals = lambda s: or_else(g(f"{s}_over25_rate"), 0.45) * 0.12
    trend = F.coalesce(g("known_cards"), to_fixed((cards("home") + cards("away")) / 2, 2))
    misread = F.greatest(F.lit(0.0), or_else(g("market_over_diff"), 0.0))
    penalties = F.coalesce(g("known_penalties"), to_fixed(goals("home") + goals("away") + misread * 0.04, 2))
    strictness = F.lit(LENIENT)
    for least, name in reversed(STRICT):
        strictness = F.when(trend >= least, name).otherwise(strictness)
    known = F.col("known_games").isNotNull()
    there = falsy_or(F.col("referee"), F.lit(None).cast("string")).isNotNull()
    out = {
        "cards_trend": trend, "penalty_rate": penalties, "strictness": strictness, "known_games": F.coalesce("known_games", F.lit(0)),
        "source": F.when(known, "history").otherwise("estimate"),
    }
    return df.withColumns({k: F.when(there, c) for k, c in out.items()})


def venue_edges(df: DataFrame) -> DataFrame:
    """`df` with the two sides' scoring at their venue against the other's conceding there, and what the trip costs."""
    g = reader(df)
    s = lambda side, what: split(g, side, what)
    edge = to_fixed(s("home", "scored") - s("away", "conceded") + (s("away", "scored") - s("home", "conceded")), 2)
    trip = or_else(g("away_travel_penalty"), 0.0)
    burden = F.when(trip <= 0, "none").when(F.col("league_type") == "cup", "cup trip").otherwise("trip")
    return df.withColumns({"venue_edge": edge, "travel_penalty": trip, "travel_burden": burden})


def merged_absences(base: Column, extra: Column) -> Column:
    """Absences of two sources in one struct: the larger counts, the names of both without repeats, the base's rating, and
    the source of the second where it names one. Without a second source the first stays as it is."""
    most = lambda f: F.greatest(F.coalesce(base[f], F.lit(0)), F.coalesce(extra[f], F.lit(0)))
    none = F.array().cast("array<string>")
    names = lambda f, n: F.slice(F.array_distinct(F.concat(F.coalesce(base[f], none), F.coalesce(extra[f], none))), 1, n)
    text = lambda c: falsy_or(c, F.lit(None).cast("string"))
    both = F.struct(
        *(most(f).alias(f) for f in ("injured", "suspended", "doubts")), F.coalesce(base["rating"], F.lit(0.0)).alias("rating"),
        names("missing", 5).alias("missing"), names("banned", 4).alias("banned"), F.coalesce(text(extra["source"]), text(base["source"]), F.lit("players")).alias("source"),
    )
    return F.when(extra.isNull(), base).otherwise(both)


def key_signals(df: DataFrame, n: int = 5) -> Column:
    """The first n of what stands out in a match, in a fixed order: its context, the aggregate, the gaps in rating and rest,
    meetings from three on, line-ups, how reliable its league and phase are, and the referee."""
    has = lambda c, text: F.when(falsy_or(F.col(c), F.lit(None)).isNotNull(), text)
    number = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    percent = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("string")
    rest = F.concat(F.lit("rest "), F.when(F.col("rest_diff") > 0, "+").otherwise(""), number("rest_diff"), F.lit("d"))
    meetings = F.concat(F.lit("meetings "), F.concat_ws("-", "h2h_home_wins", "h2h_draws", "h2h_away_wins"))
    signals = F.array(
        has("context", F.col("context")), F.when(F.col("active"), has("aggregate_score", F.concat(F.lit("aggregate "), F.col("aggregate_score")))),
        has("elo_diff", F.concat(F.lit("rating "), number("elo_diff"))), F.when(F.abs("rest_diff") >= 1, rest), F.when(F.col("h2h_results") >= 3, meetings),
        F.when(F.col("lineups_confirmed"), F.lit("line-ups")), F.concat(F.lit("league "), percent("league_reliability"), F.lit("%")),
        F.concat(F.lit("phase "), percent("phase_reliability"), F.lit("%")), has("strictness", F.concat(F.lit("referee "), F.col("strictness"))),
    )
    return F.slice(F.filter(signals, lambda s: s.isNotNull()), 1, n)


def _side(score: Column) -> Column:
    home, away = parse_score(score)
    return F.when(home > away, "Thuis").when(away > home, "Uit").when(home == away, "Gelijk")


def hydrated(h: DataFrame) -> DataFrame:
    """History rows whose missing outcomes are derived from their scores, as texts like `2-1`. A score is right if both texts
    are equal once trimmed; whether the outcome is right is kept where it is known, and two unknown outcomes are equal."""
    text = lambda c: falsy_or(F.col(c), F.lit(None).cast("string"))
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = h.withColumns({"predicted_outcome": F.coalesce(text("predicted_outcome"), _side(F.col("prediction"))), "actual_outcome": F.coalesce(text("actual_outcome"), _side(F.col("actual_score")))})
    same = F.col("predicted_outcome").eqNullSafe(F.col("actual_outcome"))
    return out.withColumns({"winner_correct": F.coalesce("winner_correct", same), "was_correct": trimmed("prediction") == trimmed("actual_score")})


def kept_history(mode: str = "alle", league: str | None = None, search: str | None = None) -> Column:
    """Which history rows to show: alle, score (the score was right), uitkomst (the outcome was), fout (neither); of one league,
    and with a text in the names of the teams or the league, whatever its case."""
    right, won = (F.coalesce(F.col(c), F.lit(False)) for c in ("was_correct", "winner_correct"))
    keep = {"alle": F.lit(True), "score": right, "uitkomst": won, "fout": ~right & ~won}[mode]
    if league:
        keep &= F.coalesce(F.col("league") == league, F.lit(False))
    if search:
        names = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("home_team", "away_team", "league")))
        keep &= F.contains(F.lower(names), F.lit(search.lower()))
    return keep


def page_by_league(h: DataFrame, keep: Column, page: int, size: int = 80) -> DataFrame:
    """Page `page` (from 1) of the kept rows, the newest first, its leagues in the order of their rates of right scores, then
    outcomes, over the whole history; a league of no name counts as Onbekend, whose rates are 0. Equal leagues come in the
    order of their first row on the page."""
    named = h.withColumn("league", falsy_or(F.col("league"), UNKNOWN))
    rate = lambda c: F.floor(F.count_if(c) / F.count(F.lit(1)) * 100 + 0.5)
    rates = named.filter(F.col("league") != UNKNOWN).groupBy("league").agg(rate("was_correct").alias("exact_percent"), rate("winner_correct").alias("outcome_percent"))
    shown = named.filter(keep).orderBy(F.desc("match_date"), "match_id").offset((page - 1) * size).limit(size)
    shown = shown.withColumn("at", F.row_number().over(Window.orderBy(F.desc("match_date"), "match_id")))  # one page
    shown = shown.join(rates, "league", "left").fillna(0, ["exact_percent", "outcome_percent"]).withColumn("first", F.min("at").over(Window.partitionBy("league")))
    order = Window.orderBy(F.desc("exact_percent"), F.desc("outcome_percent"), "first")
    return shown.withColumn("league_place", F.dense_rank().over(order)).drop("first")
