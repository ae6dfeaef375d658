"""Forecasts: score grid, blend with a heuristic, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import clamp, half_up, low_score_factor, poisson, to_fixed

GOALS = range(7)
#: The scores whose probability is corrected.
LOW = ((0, 0), (0, 1), (1, 0), (1, 1))


def score_grid(df: DataFrame, home: str = "home_xg", away: str = "away_xg", rho: float = -0.13, whole: bool = True, scores: bool = False) -> DataFrame:
    """`df` with win, draw and loss probabilities made to add up to one (unless not `whole`), over and both-score probabilities as they are,
    and the likeliest score (first in order of home, then away goals). With `scores` also the map of scores that aren't
    unlikely, before anything is made to add up.

    The 7 + 7 rates and the sums of the away side's first and last ones are columns of their own. A total is then one
    product a row of the grid, and what the four lowest scores are corrected by is added; so the generated code stays
    small enough to be compiled, and no row is multiplied."""
    x, y = F.col(home), F.col(away)
    out = df.withColumns({f"p_{s}{k}": poisson(c, k) for s, c in (("h", x), ("a", y)) for k in GOALS})
    of = lambda s, k: F.col(f"p_{s}{k}")
    plus = lambda parts: sum(parts[1:], parts[0])
    out = out.withColumns({
        **{f"p_upto{k}": plus([of("a", a) for a in GOALS if a <= k]) for k in GOALS}, **{f"p_from{k}": plus([of("a", a) for a in GOALS if a >= k]) for k in GOALS},
        **{f"p_low{h}{a}": of("h", h) * of("a", a) * low_score_factor(h, a, x, y, rho) for h, a in LOW},
    })
    low = lambda h, a: F.col(f"p_low{h}{a}") - of("h", h) * of("a", a)  # noqa: E731  (what the correction adds)
    more = lambda n: plus([of("h", h) * F.col(f"p_from{max(0, n - h)}") for h in GOALS])
    top = lambda s, least: F.greatest(*(of(s, k) for k in GOALS if k >= least))
    rest = top("a", 2)
    # products round alike, so the largest product is that of the largest factors
    rows = [F.greatest(F.col(f"p_low{h}0"), F.col(f"p_low{h}1"), of("h", h) * rest) for h in (0, 1)] + [of("h", h) * F.greatest(rest, of("a", 0), of("a", 1)) for h in GOALS[2:]]
    out = out.withColumns({
        "w": plus([of("h", h) * F.col(f"p_upto{h - 1}") for h in GOALS[1:]]) + low(1, 0), "d": plus([of("h", k) * of("a", k) for k in GOALS]) + low(0, 0) + low(1, 1),
        "l": plus([of("h", h) * F.col(f"p_from{h + 1}") for h in GOALS[:-1]]) + low(0, 1), "over15": more(2) + low(1, 1), "over25": more(3), "over35": more(4),
        "btts": top_sum("h") * F.col("p_from1") + low(1, 1), **{f"p_row{h}": r for h, r in enumerate(rows)},
    })
    out = out.withColumn("best_prob", F.greatest(*(f"p_row{h}" for h in GOALS)))
    best = F.col("best_prob")
    out = out.withColumn("p_home", F.coalesce(*(F.when(F.col(f"p_row{h}") == best, h) for h in GOALS)))
    rate = F.coalesce(*(F.when(F.col("p_home") == h, of("h", h)) for h in GOALS))
    at = lambda a: F.when(F.col("p_home") == 0, F.col(f"p_low0{a}")).when(F.col("p_home") == 1, F.col(f"p_low1{a}")).otherwise(rate * of("a", a)) if a < 2 else rate * of("a", a)
    score = F.concat_ws("-", F.col("p_home").cast("string"), F.coalesce(*(F.when(at(a) == best, str(a)) for a in GOALS)))
    all_ = F.col("w") + F.col("d") + F.col("l") if whole else F.lit(1.0)
    out = out.withColumns({"home_prob": F.col("w") / all_, "draw_prob": F.col("d") / all_, "away_prob": F.col("l") / all_, "best_score": F.when(best.isNotNull(), score)})
    if scores:
        out = out.withColumn("score_map", score_map({(h, a): F.col(f"p_low{h}{a}") if (h, a) in LOW else of("h", h) * of("a", a) for h in GOALS for a in GOALS}))
    helpers = [c for c in out.columns if c.startswith("p_") and c not in df.columns]
    return out.drop("w", "d", "l", *helpers)


def top_sum(side: str) -> Column:
    """The probability that a side scores."""
    return sum((F.col(f"p_{side}{k}") for k in GOALS[2:]), F.col(f"p_{side}1"))


def largest(scores: Column, n: int) -> Column:
    """The n entries of a map with the largest values, in that order; of equals those that come first in the map."""
    placed = F.transform(F.map_entries(scores), lambda e, i: F.struct((-e["value"]).alias("less"), i.alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.transform(F.slice(F.array_sort(placed), 1, n), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def score_map(cells: dict[tuple[int, int], Column], least: float = 0.01, digits: int = 4) -> Column:
    """Scores whose probability is above `least`, in order of home, then away goals, with rounded probabilities."""
    each = F.array(*(F.struct(F.lit(f"{h}-{a}").alias("key"), p.alias("value")) for (h, a), p in cells.items()))
    kept = F.filter(each, lambda e: e["value"] > least)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), to_fixed(e["value"], digits).alias("value"))))


def normalize_odds(home: Column, draw: Column, away: Column) -> list[Column]:
    """Probabilities of prices, the bookmaker's margin removed; a fixed split where there are no prices."""
    inverse = [F.when(o > 1.01, 1 / o).otherwise(F.lit(0.0)) for o in (home, draw, away)]
    total = inverse[0] + inverse[1] + inverse[2]
    return [F.when(total > 0, half_up(p / total, 4)).otherwise(F.lit(d)) for p, d in zip(inverse, (0.33, 0.34, 0.33))]


def softmax(scores: list[Column]) -> list[Column]:
    e = [F.exp(s) for s in scores]
    total = sum(e[1:], e[0])
    return [half_up(x / total, 4) for x in e]


def blend(model: list[Column], other: list[Column], weight: float = 0.78) -> list[Column]:
    mixed = [a * weight + b * (1 - weight) for a, b in zip(model, other)]
    total = mixed[0] + mixed[1] + mixed[2]
    return [half_up(x / total, 4) for x in mixed]


def agreement(model: list[Column], other: list[Column]) -> Column:
    gap = sum((F.abs(a - b) for a, b in zip(model, other)), F.lit(0.0)) / 3
    return half_up(F.greatest(F.lit(0.0), 1 - 4 * gap), 3)


def confidence(best_prob: Column, penalties: Column) -> Column:
    return clamp(F.least(F.lit(0.93), 3.5 * best_prob + 0.24) - penalties, 0.24, 0.93)


def risk(confidence: Column, agreement: Column, weather: Column, lineups: Column, injuries: Column, travel: Column, keeper_diff: Column) -> Column:
    """laag, middel or hoog by points for what makes a forecast unsafe; a clear keeper edge takes one off."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    one = lambda c: F.when(c, 1).otherwise(0)
    points = (
        F.when(confidence < 0.48, 2).when(confidence < 0.6, 1).otherwise(0) + F.when(agreement < 0.65, 2).when(agreement < 0.78, 1).otherwise(0)
        + F.when(weather == "high", 2).when(weather == "medium", 1).otherwise(0) + one(~F.coalesce(lineups, F.lit(False))) + one(zero(injuries) >= 4) + one(zero(travel) >= 0.2) - one(F.abs(zero(keeper_diff)) >= 0.35)
    )
    return F.when(points >= 5, F.lit("hoog")).when(points >= 3, F.lit("middel")).otherwise(F.lit("laag"))


def value_flag(prob: Column, odd: Column) -> Column:
    """Whether the model sees at least 4 points more than the price; null without a price."""
    return F.when(odd > 1.01, half_up(prob - 1 / odd, 4) >= 0.04)
