"""Forecasts against results: reviews, learning, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import outcome, to_fixed
from matchmill.operators.before import number, running_before

SIGNALS = ("clubelo_misread", "open_lineups", "weather_risk", "rest_gap", "h2h_signal", "market_misread", "low_model_agreement")


def likeliest(home: Column, draw: Column, away: Column) -> Column:
    """The outcome by probability; the home side wins ties, then the away side."""
    h, d, a = (F.coalesce(x, F.lit(0.0)) for x in (home, draw, away))
    return F.when((h >= d) & (h >= a), "H").when((a >= d) & (a >= h), "A").otherwise("D")


def reviews(m: DataFrame) -> DataFrame:
    """One row per finished match with a score and a prediction; one with probabilities but no goals counts as 0-0. Biases are what came less
    what was predicted; the signals name what may have misled a wrong outcome. Read are the goals, the prediction's goals
    and probabilities, and elo_diff, lineups_confirmed, weather_risk, rest_diff, h2h_results, market_over_diff and
    agreement; rows that lack one of these seven get no signals column."""
    return judged(m).filter("reviewed").drop("reviewed")


def judged(m: DataFrame) -> DataFrame:
    """All matches with the columns of a review and whether they have one (`reviewed`)."""
    h, a, ph, pa = (F.col(c) for c in ("home_goals", "away_goals", "pred_home_goals", "pred_away_goals"))
    predicted = ph.isNotNull() | pa.isNotNull() | F.col("home_prob").isNotNull() | F.col("draw_prob").isNotNull() | F.col("away_prob").isNotNull()
    out = m.withColumns({"pred_home_goals": F.coalesce(ph, F.lit(0)), "pred_away_goals": F.coalesce(pa, F.lit(0)), "reviewed": F.coalesce((F.upper("status") == "FT") & h.isNotNull() & a.isNotNull() & predicted, F.lit(False))})
    out = out.withColumns({"actual": outcome(h, a), "predicted": outcome(ph, pa), "likeliest": likeliest(F.col("home_prob"), F.col("draw_prob"), F.col("away_prob"))})
    out = out.withColumns({
        "outcome_hit": F.col("actual") == F.col("predicted"), "probability_hit": F.col("actual") == F.col("likeliest"), "exact_hit": (h == ph) & (a == pa),
        "goal_error": F.abs(h - ph) + F.abs(a - pa), "goal_bias": h + a - ph - pa, "home_bias": h - ph, "away_bias": a - pa,
    })
    if not {"elo_diff", "lineups_confirmed", "weather_risk", "rest_diff", "h2h_results", "market_over_diff", "agreement"} <= set(m.columns):
        return out
    num = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0.0)))
    rules = (
        num("elo_diff") >= 80, ~F.coalesce(F.col("lineups_confirmed"), F.lit(False)), F.col("weather_risk") == "high", num("rest_diff") >= 2,
        F.col("h2h_results") >= 3, num("market_over_diff") >= 0.45, F.coalesce(F.col("agreement"), F.lit(0.0)) < 0.45,
    )
    signals = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in zip(SIGNALS, rules))), lambda s: s.isNotNull())
    return out.withColumn("signals", F.when(F.col("outcome_hit"), F.array().cast("array<string>")).otherwise(signals))


def rate(hits: Column, n: Column, digits: int = 2) -> Column:
    return to_fixed(hits / n, digits)


def reliability(r: DataFrame, key: str) -> DataFrame:
    """Per key (rows without one are left out) the rates of right outcomes and scores and the mean goal error, rounded,
    and a score from the rounded ones; leagues of `Europe -` count a little less."""
    g = r.filter(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").groupBy(key).agg(F.count(F.lit(1)).alias("matches"), F.count_if("outcome_hit").alias("o"), F.count_if("exact_hit").alias("x"), F.sum("goal_error").alias("e"))
    return _reliable(g, key)


def _reliable(g: DataFrame, key: str, *more: str) -> DataFrame:
    n = F.when(F.col("matches") > 0, F.col("matches"))
    g = g.select(key, *more, "matches", rate(F.col("o"), n).alias("hit_rate"), rate(F.col("x"), n).alias("exact_rate"), rate(F.col("e"), n).alias("avg_goal_error"))
    score = to_fixed(F.col("hit_rate") * 0.68 + F.col("exact_rate") * 0.22 + F.greatest(F.lit(0.0), 1 - F.col("avg_goal_error") / 4) * 0.1, 2)
    return g.withColumn("reliability", F.when(F.startswith(F.col(key), F.lit("Europe -")), to_fixed(score * 0.96, 2)).otherwise(score))


def team_learning(r: DataFrame) -> DataFrame:
    """Per team over both sides: reviews, hits and rates, biases at home and away, how often each side was over- or
    undervalued, and misses with a signal. Rates divide by all reviews of the team, as do one side's biases."""
    wrong = lambda o: (F.col("predicted") == o) & (F.col("actual") != o)
    missed = lambda o: (F.col("predicted") != o) & (F.col("actual") == o)
    has = lambda s: F.array_contains("signals", s)
    zero = F.lit(0).cast("long")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")

    def side(name: str, o: str) -> Column:
        home = o == "H"
        bias, over, under = F.col(f"{name}_bias").cast("long"), one(wrong(o)), one(missed(o))
        return F.struct(
            F.col(f"{name}_team_id").alias("team_id"), (bias if home else zero).alias("home_bias"), (zero if home else bias).alias("away_bias"),
            (over if home else zero).alias("over_home"), (zero if home else over).alias("over_away"), (under if home else zero).alias("under_home"), (zero if home else under).alias("under_away"),
        )

    rows = r.select("outcome_hit", "exact_hit", "goal_error", *(has(s).alias(s) for s in ("open_lineups", "weather_risk", "h2h_signal")), F.explode(F.array(side("home", "H"), side("away", "A"))).alias("s"))
    total = lambda c: F.sum(c).cast("long")
    g = rows.groupBy("s.team_id").agg(
        F.count(F.lit(1)).alias("games"), F.count_if("outcome_hit").alias("outcome_hits"), F.count_if("exact_hit").alias("exact_hits"), total("goal_error").alias("goal_error"),
        *(total(f"s.{c}").alias(c) for c in ("home_bias", "away_bias", "over_home", "over_away", "under_home", "under_away")),
        F.count_if("open_lineups").alias("open_lineup_misses"), F.count_if("weather_risk").alias("weather_misses"), F.count_if("h2h_signal").alias("h2h_misses"),
    )
    n = F.col("games")
    return g.select(
        "team_id", "games", "outcome_hits", "exact_hits", rate(F.col("outcome_hits"), n).alias("hit_rate"), rate(F.col("exact_hits"), n).alias("exact_rate"), rate(F.col("goal_error"), n).alias("avg_goal_error"),
        rate(F.col("home_bias"), n).alias("home_goal_bias"), rate(F.col("away_bias"), n).alias("away_goal_bias"),
        rate(F.col("under_home") - F.col("over_home"), n).alias("home_outcome_bias"), rate(F.col("under_away") - F.col("over_away"), n).alias("away_outcome_bias"),
        "over_home", "over_away", "under_home", "under_away", "open_lineup_misses", "weather_misses", "h2h_misses",
    )


def reliability_before(j: DataFrame, key: str, day: str = "match_date") -> DataFrame:
    """As reliability(), for each day on which a key has matches, from the reviews of earlier days; null without any."""
    held = lambda c: F.when(F.col("reviewed"), number(F.col(c)))
    sums = running_before(j, [key], day, {"matches": F.col("reviewed"), "o": held("outcome_hit"), "x": held("exact_hit"), "e": held("goal_error")})
    return _reliable(sums, key, day)


def learning_before(j: DataFrame, day: str = "match_date") -> DataFrame:
    """(team_id, day, games, rates, biases, fragility): what the reviews of earlier days say of a team; null without any. Each
    side's biases divide by all reviews of the team; fragility counts misses with open line-ups, weather or meetings."""

    def side(name: str, o: str) -> DataFrame:
        held = lambda c: F.when(F.col("reviewed"), number(c))
        missed = number((F.col("predicted") != o) & (F.col("actual") == o)) - number((F.col("predicted") == o) & (F.col("actual") != o))
        fragile = sum((number(F.array_contains("signals", s)) for s in ("open_lineups", "weather_risk", "h2h_signal")), F.lit(0))
        own = {"goal_bias": F.col(f"{name}_bias"), "outcome_bias": missed}
        other = "away" if name == "home" else "home"
        return j.select(
            F.col(f"{name}_team_id").alias("team_id"), day, number(F.col("reviewed")).alias("games"), held(F.col("outcome_hit")).alias("outcome_hits"), held(F.col("exact_hit")).alias("exact_hits"), held(fragile).alias("fragility"),
            *(held(c).alias(f"{name}_{k}") for k, c in own.items()), *(F.lit(0).cast("long").alias(f"{other}_{k}") for k in own),
        )

    names = ("games", "outcome_hits", "exact_hits", "fragility", *(f"{s}_{k}" for s in ("home", "away") for k in ("goal_bias", "outcome_bias")))
    sums = running_before(side("home", "H").unionByName(side("away", "A")), ["team_id"], day, {n: F.col(n) for n in names})
    n = F.when(F.col("games") > 0, F.col("games"))
    rates = {"hit_rate": "outcome_hits", "exact_rate": "exact_hits"} | {f"{s}_{k}": f"{s}_{k}" for s in ("home", "away") for k in ("goal_bias", "outcome_bias")}
    return sums.select("team_id", day, n.alias("games"), "fragility", *(rate(F.col(c), n).alias(k) for k, c in rates.items()))


def diagnostics(r: DataFrame) -> DataFrame:
    """One row: reviews, the rates of right scores, outcomes and likeliest outcomes, the mean goal error."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return r.agg(
        F.count(F.lit(1)).alias("reviews"), rate(F.count_if("exact_hit"), n, 3).alias("exact_rate"), rate(F.count_if("outcome_hit"), n, 3).alias("hit_rate"),
        rate(F.count_if("probability_hit"), n, 3).alias("probability_rate"), rate(F.coalesce(F.sum("goal_error"), F.lit(0)), n).alias("avg_goal_error"),
    )


def phase_breakdown(r: DataFrame) -> DataFrame:
    g = r.groupBy(F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.count(F.lit(1)).alias("matches"), F.count_if("exact_hit").alias("exact_hits"), F.count_if("outcome_hit").alias("outcome_hits"))
    return g.withColumns({"exact_rate": rate(F.col("exact_hits"), F.col("matches")), "hit_rate": rate(F.col("outcome_hits"), F.col("matches"))})


def top_signals(r: DataFrame, n: int = 6) -> DataFrame:
    return r.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signal").limit(n)


def history(r: DataFrame) -> DataFrame:
    """Reviews as the history shows them."""
    name = lambda c: F.when(F.col(c) == "H", "Thuis").when(F.col(c) == "A", "Uit").when(F.col(c) == "D", "Gelijk").otherwise(F.col(c))
    return r.select(
        "match_id", F.concat_ws("-", "pred_home_goals", "pred_away_goals").alias("prediction"), F.concat_ws("-", "home_goals", "away_goals").alias("actual_score"), F.col("exact_hit").alias("was_correct"),
        F.col("goal_error").alias("error_margin"), "league", F.col("outcome_hit").alias("winner_correct"), name("predicted").alias("predicted_outcome"), name("actual").alias("actual_outcome"),
        F.col("probability_hit").alias("top_chance_correct"), F.col("phase").alias("phase_bucket"), "confidence",
    )


def newest(r: DataFrame, n: int = 2500) -> DataFrame:
    """The reviews that are kept, the newest first; ties by match."""
    return r.orderBy(F.desc("match_date"), F.desc("match_id")).limit(n)
