"""The feature row of a match and the heuristic's linear scores over it.

Inputs are flat columns, `home_` and `away_` ones for the sides; an input that a table doesn't have counts as null.
Features come as one struct of doubles, so a wide row is one column until an export unfolds it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import clamp, falsy_or, half_up, normalize_name
from matchmill.operators.model import softmax

#: Features that pass an input on, and what stands for a null or zero input.
PASSED = {
    "avg_scored": 1.35, "avg_conceded": 1.35, "btts_rate": 0.5, "yellow_rate": 0.0, "avg_corners": 0.0, "injuries": 0.0, "learning_outcome_hit": 0.5, "learning_goal_bias": 0.0,
}
SHARED = {"match_importance": 1.0, "market_strength": 0.0, "league_reliability": 0.5, "league_avg_goal_error": 2.0, "phase_reliability": 0.5, "phase_avg_goal_error": 2.0, "referee_cards_trend": 0.0, "referee_penalty_rate": 0.0}
#: What a split without games counts as, and the weight of a red card against a yellow one.
SPLIT = {"scored": 1.35, "conceded": 1.35, "over25": 0.45}
RED_WEIGHT, RATING = 1.8, 6.8

#: Weight of each feature in the home and the away score.
LINEAR = {
    "ppg_diff": (0.22, -0.22), "club_elo_diff": (0.001, -0.001), "rest_diff": (0.08, -0.08), "home_home_split_scored": (0.16, 0.0), "away_away_split_conceded": (-0.16, 0.0), "away_away_split_scored": (0.0, 0.16), "home_home_split_conceded": (0.0, -0.16),
    "set_piece_diff": (0.04, -0.04), "home_avg_corners": (0.015, -0.015), "away_avg_corners": (-0.015, 0.015), "lineups_avg_rating_diff": (0.05, -0.05), "keeper_rating_diff": (0.035, -0.035), "home_lineup_continuity": (0.16, -0.16), "away_lineup_continuity": (-0.16, 0.16),
    "away_travel_penalty": (0.18, -0.18), "home_injuries": (-0.05, 0.0), "away_injuries": (0.0, -0.05), "home_cards_rate": (-0.015, 0.0), "away_cards_rate": (0.0, -0.015), "h2h_balance": (0.08, -0.08), "h2h_recent_5_balance": (0.2, -0.2),
    "learning_outcome_bias_diff": (0.16, -0.16), "home_learning_goal_bias": (0.05, 0.0), "away_learning_goal_bias": (0.0, 0.05), "home_market_implied_ppg": (0.12, -0.12), "away_market_implied_ppg": (-0.12, 0.12), "market_overperformance_diff": (0.1, -0.1),
}


def reader(df: DataFrame) -> Callable[[str], Column]:
    """Input columns by name; null for those that `df` doesn't have."""
    return lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")


def or_else(x: Column, default: float) -> Column:
    return falsy_or(x.cast("double"), default)


def split(get: Callable[[str], Column], side: str, what: str) -> Column:
    """The side's own split where it has games, else the fixed value."""
    return F.when(get(f"{side}_split_games") > 0, or_else(get(f"{side}_split_{what}"), SPLIT[what])).otherwise(SPLIT[what])


def points_per_game(wins: Column, draws: Column, games: Column) -> Column:
    played = or_else(games, 0.0)
    return F.when(played == 0, 0.0).otherwise(half_up((or_else(wins, 0.0) * 3 + or_else(draws, 0.0)) / played, 2))


def cards_rate(yellow: Column, red: Column) -> Column:
    return half_up(or_else(yellow, 0.0) + or_else(red, 0.0) * RED_WEIGHT, 2)


def continuity(starters: Column, rating: Column, injured: Column) -> Column:
    """How settled a line-up is, from 0 to 1."""
    n = or_else(starters, 0.0)
    settled = F.when(n == 0, 0.55).otherwise(F.least(F.lit(1.0), n / 11))
    return half_up(F.greatest(F.lit(0.0), settled * 0.6 + clamp((or_else(rating, RATING) - 6) / 2, 0.0, 1.0) * 0.4 - or_else(injured, 0.0) * 0.07), 2)


def travel(home_country: Column, away_country: Column, league_type: Column) -> Column:
    h, a = (normalize_name(c.cast("string")) for c in (home_country, away_country))
    return F.when((h == "") | (a == "") | (h == a), 0.0).when(league_type.cast("string") == "cup", 0.22).otherwise(0.1)


def difference(a: Column, b: Column, digits: int = 2) -> Column:
    return half_up(or_else(a, 0.0) - or_else(b, 0.0), digits)


def recent_balance(results: Column, weighted: bool, n: int = 5) -> Column:
    """Balance of the last n of an array of 1, 0, -1 (oldest first), later ones weighing more if weighted; 0 for none."""
    last = F.slice(results, F.greatest(F.size(results) - (n - 1), F.lit(1)), F.lit(n))
    weights = F.transform(last, lambda _, i: i + 6 if weighted else F.lit(1))
    total = F.aggregate(weights, F.lit(0), lambda s, w: s + w)
    score = F.aggregate(F.zip_with(last, weights, lambda r, w: r.cast("int") * w), F.lit(0), lambda s, x: s + x)
    return F.when(F.coalesce(F.size(results), F.lit(0)) > 0, half_up(score / total, 2)).otherwise(0.0)


def feature_columns(df: DataFrame) -> dict[str, Column]:
    g = reader(df)
    f: dict[str, Column] = {}
    for side in ("home", "away"):
        f |= {f"{side}_{k}": or_else(g(f"{side}_{k}"), d) for k, d in PASSED.items()}
        f |= {f"{side}_{side}_split_{k}": split(g, side, k) for k in ("scored", "conceded")}
        f |= {
            f"{side}_over25_{side}": split(g, side, "over25"), f"{side}_ppg": points_per_game(*(g(f"{side}_{k}") for k in ("wins", "draws", "games"))),
            f"{side}_rest_days": F.coalesce(g(f"{side}_rest_days").cast("double"), F.lit(0.0)), f"{side}_cards_rate": cards_rate(g(f"{side}_yellow_rate"), g(f"{side}_red_rate")),
            f"{side}_market_implied_ppg": or_else(falsy_or(g(f"{side}_market_implied").cast("double"), g(f"{side}_market_actual").cast("double")), 1.25),
            f"{side}_lineup_continuity": continuity(g(f"{side}_starters"), g(f"{side}_rating"), g(f"{side}_injuries")),
        }
    f |= {k: or_else(g(k), d) for k, d in SHARED.items()}
    both = lambda k, digits=2: difference(g(f"home_{k}"), g(f"away_{k}"), digits)
    played = or_else(g("h2h_played"), 0.0)
    results = g("h2h_results").cast("array<int>") if "h2h_results" in df.columns else F.array().cast("array<int>")
    f |= {
        "ppg_diff": half_up(f["home_ppg"] - f["away_ppg"], 2), "rest_diff": half_up(f["home_rest_days"] - f["away_rest_days"], 2), "club_elo_diff": both("club_elo", 0), "set_piece_diff": both("set_piece"),
        "weather_risk": F.when(g("weather_risk").cast("string") == "high", 2.0).when(g("weather_risk").cast("string") == "medium", 1.0).otherwise(0.0), "lineups_confirmed": F.when(g("lineups_confirmed").cast("boolean"), 1.0).otherwise(0.0),
        "h2h_balance": F.when(played >= 1, half_up((or_else(g("h2h_home_wins"), 0.0) - or_else(g("h2h_away_wins"), 0.0)) / F.greatest(played, F.lit(1.0)), 2)).otherwise(0.0),
        "h2h_recent_5_balance": recent_balance(results, True), "recent_h2h_balance": recent_balance(results, False),
        "learning_outcome_bias_diff": both("learning_outcome_bias"), "market_overperformance_diff": both("market_over"), "lineups_avg_rating_diff": both("rating"), "keeper_rating_diff": both("keeper_rating"),
        "away_travel_penalty": travel(g("home_country"), g("away_country"), g("league_type")),
    }
    return {k: f[k].cast("double") for k in sorted(f)}


def features(df: DataFrame) -> DataFrame:
    """`df` with the struct `features`."""
    return df.withColumn("features", F.struct(*(c.alias(k) for k, c in feature_columns(df).items())))


def scores(f: Callable[[str], Column]) -> list[Column]:
    """Home, draw and away scores: linear terms, then terms that count only beyond a bound."""
    beyond = lambda x, weight: F.greatest(F.lit(0.0), x) * weight
    market = f("market_overperformance_diff") * 0.1 * F.greatest(f("market_strength"), F.lit(0.35))
    shared = (f("league_reliability") - 0.5) * 0.08 + (f("phase_reliability") - 0.5) * 0.08 - beyond(f("referee_cards_trend") - 2.8, 0.02) - beyond(f("phase_avg_goal_error") - 1.5, 0.03)
    home, away = (sum((f(k) * w[i] for k, w in LINEAR.items() if w[i]), shared) for i in (0, 1))
    draw = beyond(0.12 - f("referee_penalty_rate") * 0.08, 1.0) + beyond(0.25 - F.abs(f("ppg_diff")) * 0.06, 1.0) + beyond(0.18 - F.abs(f("club_elo_diff")) / 1000, 1.0)
    return [home + market, draw, away - market]


def heuristic(df: DataFrame) -> DataFrame:
    """`df` (with `features`) with heuristic_home, heuristic_draw and heuristic_away."""
    p = softmax(scores(lambda k: F.col(f"features.{k}")))
    return df.withColumns(dict(zip(("heuristic_home", "heuristic_draw", "heuristic_away"), p)))
