"""Expected goals: a base from scoring and conceding, then factors that each input moves within bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import clamp, half_up
from matchmill.operators.features import RATING, or_else, reader, split

MEAN_GOALS, HOME_FACTOR, LOWEST, HIGHEST = 1.35, 1.11, 0.22, 3.8

SIGNALS = "array<struct<book:string,diff:double,strength:double,lean:string>>"


def lean(diff: Column, bound: float) -> Column:
    return F.when(diff >= bound, "home").when(diff <= -bound, "away").otherwise("neutral")


def book_signals(books: Column, coverage: Column) -> Column:
    """Per bookmaker how far it misjudged the two sides. `books`: array of (book, home_over, away_over, home_games,
    away_games, home_coverage, away_coverage); `coverage` stands for a book's missing one."""

    def one(b: Column) -> Column:
        diff = half_up(or_else(b["home_over"], 0.0) - or_else(b["away_over"], 0.0), 2)
        games = or_else(b["home_games"], 0.0) + or_else(b["away_games"], 0.0)
        of = lambda c: F.when(or_else(c, 0.0) == 0, or_else(coverage, 0.0)).otherwise(c.cast("double"))
        covered = half_up((of(b["home_coverage"]) + of(b["away_coverage"])) / 2, 2)
        strength = half_up(F.least(games / 18, F.lit(1.0)) * 0.58 + F.least(covered, F.lit(1.0)) * 0.42, 2)
        return F.struct(b["book"].cast("string").alias("book"), diff.alias("diff"), strength.alias("strength"), lean(diff, 0.3).alias("lean"))

    return F.transform(books, one)


def total(signals: Column, of) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda s, x: s + of(x))


def weighted_diff(signals: Column) -> Column:
    """Mean difference of the books, weighed by strength but by 0.1 at least; null for none."""
    weight = lambda s: F.greatest(or_else(s["strength"], 0.0), F.lit(0.1))
    return F.when(F.size(signals) > 0, total(signals, lambda s: or_else(s["diff"], 0.0) * weight(s)) / total(signals, weight))


def calibration(df: DataFrame) -> DataFrame:
    """`df` with market_diff, market_strength, market_lean, book_agreement from the sides' market columns and `book_signals`.
    Without either side's history (market_games) the strength is a fixed one and the first book leans."""
    g, signals = reader(df), F.coalesce(F.col("book_signals"), F.array().cast(SIGNALS))
    n = F.size(signals)
    diff = half_up(or_else(g("home_market_over"), 0.0) - or_else(g("away_market_over"), 0.0), 2)
    sample = F.least((or_else(g("home_market_games"), 0.0) + or_else(g("away_market_games"), 0.0)) / 26, F.lit(1.0))
    mean = F.when(n > 0, total(signals, lambda s: s["strength"]) / n).otherwise(0.0)
    known = g("home_market_games").isNotNull() | g("away_market_games").isNotNull()
    strength = half_up(sample * 0.42 + F.least(or_else(g("closing_coverage"), 0.0), F.lit(1.0)) * 0.23 + mean * 0.35, 2)
    lone = F.coalesce(F.get(signals, F.lit(0))["lean"], F.lit("neutral"))
    leaning = F.size(F.filter(signals, lambda s: s["lean"].isin("home", "away")))
    return df.withColumns({
        "market_diff": F.when(known, diff).otherwise(0.0), "market_strength": F.when(known, strength).when(n > 0, 0.26).otherwise(0.0),
        "market_lean": F.when(known, lean(F.coalesce(weighted_diff(signals), diff), 0.35)).otherwise(lone), "book_agreement": F.when(n > 0, half_up(leaning / n, 2)).otherwise(0.0),
    })


def expected_goals(df: DataFrame) -> DataFrame:
    """`df` with home_xg and away_xg."""
    g = reader(df)
    num = lambda k: or_else(g(k), 0.0)
    gap = lambda k: num(f"home_{k}") - num(f"away_{k}")
    steps: list[tuple[Column, Column, Column]] = []

    def push(when: Column, shift: Column, low: float, high: float) -> None:
        """The home side gains what the away side loses."""
        steps.append((when, clamp(1 + shift, low, high), clamp(1 - shift, low, high)))

    both = lambda when, factor: steps.append((when, factor, factor))
    attack = lambda side: clamp(or_else(g(f"{side}_avg_scored"), MEAN_GOALS) / MEAN_GOALS, 0.7, 1.6)
    leak = lambda side: clamp(split(g, side, "conceded") / MEAN_GOALS, 0.75, 1.5)
    shots, mean = [num(f"{s}_shots_on") for s in ("home", "away")], (num("home_shots_on") + num("away_shots_on")) / 2
    reviews = num("home_learning_reviews") + num("away_learning_reviews")
    trust, signals = num("learning_reliability"), F.col("book_signals") if "book_signals" in df.columns else F.array().cast(SIGNALS)

    push((num("home_club_elo") > 0) & (num("away_club_elo") > 0), gap("club_elo") / 1600, 0.9, 1.14)
    steps.append(((shots[0] != 0) & (shots[1] != 0), *(clamp(s / mean, 0.88, 1.14) for s in shots)))
    push(g("home_rest_days").isNotNull() & g("away_rest_days").isNotNull(), gap("rest_days") * 0.012, 0.93, 1.08)
    for level, factor in (("medium", 0.97), ("high", 0.93)):
        both(g("weather_risk").cast("string") == level, F.lit(factor))
    hurt = [clamp(1 - num(f"{s}_injuries") * 0.025, 0.85, 1.0) for s in ("home", "away")]
    steps.append((F.lit(True), *hurt))
    push(g("lineups_confirmed").cast("boolean"), (or_else(g("home_rating"), RATING) - or_else(g("away_rating"), RATING)) * 0.02, 0.94, 1.08)
    push(num("h2h_played") >= 3, (num("h2h_home_wins") - num("h2h_away_wins")) / F.greatest(num("h2h_played"), F.lit(1.0)) * 0.05, 0.92, 1.08)
    both(num("match_importance") > 1, clamp(num("match_importance"), 1.0, 1.08))
    push(trust != 0, clamp(gap("learning_outcome_bias") * (0.045 + F.least(reviews / 18, F.lit(1.0)) * 0.03), -0.1, 0.1), 0.94, 1.08)
    push(reviews >= 8, clamp(gap("learning_exact") * 0.035, -0.04, 0.04), 0.97, 1.05)
    push(num("market_diff") != 0, clamp(num("market_diff") * F.when(num("market_strength") >= 0.7, 0.04).otherwise(0.025), -0.08, 0.08), 0.95, 1.06)
    push(F.size(signals) > 0, clamp(weighted_diff(signals) * F.when(num("book_agreement") >= 0.7, 0.032).otherwise(0.018), -0.06, 0.06), 0.955, 1.07)
    both(g("league_reliability") < 0.45, F.lit(0.98))
    both(g("phase_reliability") < 0.45, F.lit(0.985))
    both(num("referee_penalty_rate") >= 0.12, F.lit(1.02))

    h, a = MEAN_GOALS * HOME_FACTOR * attack("home") * leak("away"), MEAN_GOALS * attack("away") * leak("home")
    for when, fh, fa in steps:
        h, a = h * F.when(when, fh).otherwise(1.0), a * F.when(when, fa).otherwise(1.0)
    return df.withColumns({"home_xg": clamp(h, LOWEST, HIGHEST), "away_xg": clamp(a, LOWEST, HIGHEST)})


#: Below each bound, how much confidence falls; the first bound that holds counts.
FALLS = {"learning_reliability": ((0.44, 0.07), (0.55, 0.03)), "league_reliability": ((0.4, 0.05), (0.52, 0.02)), "phase_reliability": ((0.4, 0.04), (0.52, 0.015)), "book_agreement": ((0.45, 0.018), (0.62, 0.008)), "closing_coverage": ((0.2, 0.012), (0.4, 0.005))}


def confidence_falls(df: DataFrame) -> Column:
    """The sum of what lowers confidence. Without reviews or reliabilities nothing falls; without books it falls by 0.015."""
    g = reader(df)

    def fall(name: str, x: Column) -> Column:
        (low, most), (mid, some) = FALLS[name]
        return F.when(x < low, most).when(x < mid, some).otherwise(0.0)

    trust = or_else(g("learning_reliability"), 0.0)
    books = F.size(F.col("book_signals")) if "book_signals" in df.columns else F.lit(0)
    out = F.when(trust == 0, 0.0).otherwise(fall("learning_reliability", trust))
    out += fall("league_reliability", g("league_reliability")) + fall("phase_reliability", g("phase_reliability"))
    out += F.when(books > 0, fall("book_agreement", or_else(g("book_agreement"), 0.0))).otherwise(0.015) + fall("closing_coverage", or_else(g("closing_coverage"), 0.0))
    fragile = or_else(g("home_fragility"), 0.0) + or_else(g("away_fragility"), 0.0) >= 4
    return out + F.when(fragile, 0.02).otherwise(0.0) + F.when(g("lineups_confirmed").cast("boolean"), 0.0).otherwise(0.015)
