"""What the reads of the service add to stored rows: odds, tips, importance, kick-offs, seasons, covered leagues, and the
forecast that a client makes by itself."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import falsy_or, local_day, poisson, to_fixed
from matchmill.operators.duels import form_modifier
from matchmill.operators.model import GOALS, score_grid

#: League labels that the season tables cover, and their codes there.
CODES = {
    "England - Premier League": "E0", "England - Championship": "E1", "Scotland - Premiership": "SC0", "Scotland - Championship": "SC1", "Netherlands - Eredivisie": "N1", "Netherlands - Eerste Divisie": "N2",
    "Germany - Bundesliga": "D1", "Germany - 2. Bundesliga": "D2", "Spain - LaLiga": "SP1", "Spain - LaLiga2": "SP2", "Spain - LaLiga 2": "SP2", "Italy - Serie A": "I1", "Italy - Serie B": "I2",
    "France - Ligue 1": "F1", "France - Ligue 2": "F2", "Portugal - Liga Portugal": "P1", "Portugal - Liga Portugal 2": "P2", "Belgium - Pro League": "B1", "Belgium - Challenger Pro League": "B2",
    "Turkey - Super Lig": "T1", "Greece - Super League": "G1", "Austria - Bundesliga": "AUT", "Switzerland - Super League": "SWZ", "Denmark - Superliga": "DNK", "Sweden - Allsvenskan": "SWE",
    "Norway - Eliteserien": "NOR", "Poland - Ekstraklasa": "POL",
}


def implied_odds(prob: Column) -> Column:
    """The fair price of a probability; null from 0.01 down."""
    return F.when(prob > 0.01, to_fixed(1 / prob, 2))


def tip(home: Column, away: Column, over25: Column) -> Column:
    at_least = lambda x, bound: F.coalesce(x, F.lit(0.0)) >= bound
    return F.when(at_least(home, 0.55), "home").when(at_least(away, 0.55), "away").when(at_least(over25, 0.62), "over25").otherwise("btts")


def shown_importance(importance: Column, home_position: Column, away_position: Column) -> Column:
    """Whether a match counts as important: by its figure, or by a side in the first three or from 16 on."""
    edge = lambda p: F.coalesce(p.between(1, 3) | (p >= 16), F.lit(False))
    return (falsy_or(importance, 1.0) > 1.02) | edge(home_position) | edge(away_position)


def predictions_read(p: DataFrame, m: DataFrame, reviews: DataFrame) -> DataFrame:
    """Predictions with derived odds and a tip, their match's fields where they have none, and the match's review."""
    odds = {f"{s}_derived": implied_odds(F.col(f"{s}_prob")) for s in ("home", "draw", "away")}
    left = p.withColumns({**odds, "tip": tip(F.col("home_prob"), F.col("away_prob"), F.col("over25"))})
    out = left.join(m.select("match_id", "weather_risk", "home_rest", "away_rest", "importance", "home_position", "away_position"), "match_id", "left")
    out = out.withColumn("important", shown_importance(F.col("importance"), F.col("home_position"), F.col("away_position")))
    return out.join(reviews.select("match_id", "actual", "outcome_hit", "exact_hit"), "match_id", "left")


def season_code(day: Column) -> Column:
    """Two digits of the year in which a season starts, in July, and two of the next."""
    start = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(start), two(start + 1))


def season_label(day: Column) -> Column:
    start = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def kickoff(day: Column, time: Column) -> Column:
    """The instant, as a UTC timestamp without zone, of a day and hh:mm two hours ahead of UTC; 15:00 for other text,
    null for a time that no clock shows."""
    h, m = (F.regexp_extract(F.trim(F.coalesce(time, F.lit(""))), r"^(\d{1,2}):(\d{2})$", i) for i in (1, 2))
    hour = F.when(h == "", F.lit(15)).otherwise(F.try_to_number(h, F.lit("99")).cast("int"))
    minute = F.when(m == "", F.lit(0)).otherwise(F.try_to_number(m, F.lit("99")).cast("int"))
    at = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour - 2, minute)
    return F.when((hour < 24) & (minute < 60), at)


def on_day(day: Column, kickoff_utc: Column, want: Column) -> Column:
    """Whether a match belongs to a day: by its date, or by the local day of its kick-off."""
    return F.coalesce(day == want, F.lit(False)) | F.coalesce(local_day(kickoff_utc) == want, F.lit(False))


def short_league(league: Column) -> Column:
    return F.substring_index(league, " - ", 2)


def covered_leagues(m: DataFrame, label: str = "label") -> DataFrame:
    """(label, code, family) of the labels that the season tables cover; a family is the codes of the same country. The
    codes are a fixed list, so the join is with a constant table."""
    codes = m.sparkSession.createDataFrame(list(CODES.items()), f"{label} string, code string").withColumn("country", F.split_part(label, F.lit(" - "), F.lit(1)))
    family = codes.groupBy("country").agg(F.array_join(F.array_sort(F.collect_set("code")), " ").alias("family"))
    return m.select(label).distinct().join(F.broadcast(codes), label).join(F.broadcast(family), "country").select(label, "code", "family")


def client_forecast(df: DataFrame) -> DataFrame:
    """The forecast of a client from both sides' attack, defence, form string and Elo: independent goals, totals as they
    are over the scores up to 6-6."""
    mod = {s: form_modifier(F.col(f"{s}_form")) for s in ("home", "away")}
    out = df.withColumns({
        "home_mod": mod["home"], "away_mod": mod["away"],
        "home_xg": F.lit(1.35) * (F.col("home_attack") / F.col("away_defence")) * 1.18 * mod["home"], "away_xg": F.lit(1.35) * (F.col("away_attack") / F.col("home_defence")) * mod["away"],
    })
    out = _likeliest(score_grid(out, rho=0.0, whole=False))
    sure = F.col("best_prob") * 2.5 + F.abs(F.col("home_elo") - F.col("away_elo")) / 3500 + F.abs(F.col("home_mod") - F.col("away_mod")) / 5
    return out.withColumn("confidence", F.least(F.lit(0.98), sure)).drop("home_mod", "away_mod")


def _likeliest(df: DataFrame) -> DataFrame:
    """`df` with best_prob and best_score by each score's probability as it is multiplied and divided from left to right, so
    that scores that tie but for rounding come in the order that the rounded values have."""
    x, y = F.col("home_xg"), F.col("away_xg")
    out = df.withColumns({**{f"c_home{k}": poisson(x, k) for k in GOALS}, **{f"c_power{k}": F.pow(y, F.lit(float(k))) for k in GOALS}, "c_none": F.exp(-y)})
    cells = [F.col(f"c_home{h}") * F.col(f"c_power{a}") * F.col("c_none") / float(factorial(a)) for h in GOALS for a in GOALS]
    out = out.withColumn("c_cells", F.array(*cells)).withColumn("best_prob", F.array_max("c_cells"))
    at = (F.array_position("c_cells", F.col("best_prob")) - 1).cast("int")
    n = len(GOALS)
    return out.withColumn("best_score", F.concat(F.floor(at / n).cast("string"), F.lit("-"), (at % n).cast("string"))).drop("c_cells", "c_none", *(f"c_{w}{k}" for w in ("home", "power") for k in GOALS))
