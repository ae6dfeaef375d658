"""Registered queries of the service's reads, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmill.functions.semantics import half_up
from matchmill.operators import evaluate, form, reads
from matchmill.plans.bridge import matches, team_rows
from matchmill.plans.queries import R4, _m, _query
from matchmill.plans.records import REVIEWS, R, X, records


def _read(spark: SparkSession, d: str) -> DataFrame:
    k = records(spark, d)
    p = k.select("match_id", "home_prob", "draw_prob", "away_prob", (F.col("match_id") % 100 / 100).alias("over25"))
    return reads.predictions_read(p, k, evaluate.reviews(k))


DERIVED = ", ".join(f"CASE WHEN k.{s}_prob > 0.01 THEN {X(f'1 / k.{s}_prob')} END AS {s}_derived" for s in ("home", "draw", "away"))
EDGE = "coalesce({0} BETWEEN 1 AND 3 OR {0} >= 16, FALSE)"
_query(
    "q_predictions_read",
    f"""WITH {REVIEWS} SELECT k.match_id, k.home_prob, k.draw_prob, k.away_prob, (k.match_id % 100) / 100::DOUBLE AS over25, {DERIVED},
  CASE WHEN k.home_prob >= 0.55 THEN 'home' WHEN k.away_prob >= 0.55 THEN 'away' WHEN k.match_id % 100 >= 62 THEN 'over25' ELSE 'btts' END AS tip,
  k.weather_risk, k.home_rest, k.away_rest, k.importance, k.home_position, k.away_position, k.importance > 1.02 OR {EDGE.format('k.home_position')} OR {EDGE.format('k.away_position')} AS important,
  r.actual, r.outcome_hit, r.exact_hit FROM k LEFT JOIN r ON r.match_id = k.match_id""",
)(_read)

TIME = "CASE WHEN match_id % 4 > 0 THEN (match_id % 24) || ':' || lpad({0}, 2, '0') END"


def _schedule(m: DataFrame) -> DataFrame:
    m = m.withColumn("at", reads.kickoff(F.col("match_date"), F.expr(TIME.format("CAST(match_id % 60 AS STRING)"))))
    return m.select(
        "match_id", F.col("at").cast("string").alias("kickoff"), reads.season_code(F.col("match_date")).alias("season_code"), reads.season_label(F.col("match_date")).alias("season"),
        reads.on_day(F.col("match_date"), F.col("at"), F.date_sub("match_date", 1)).alias("day_before"), reads.short_league(F.concat_ws(" - ", "region", "league", F.lit("x"))).alias("short_league"),
    )


START = "year(match_date) - (month(match_date) < 7)::INT"
_query(
    "q_schedule",
    f"""WITH s AS (SELECT match_id, match_date, region, league, {START} AS y, match_date::TIMESTAMP + to_hours((CASE WHEN match_id % 4 > 0 THEN match_id % 24 ELSE 15 END - 2)::INT) + to_minutes((CASE WHEN match_id % 4 > 0 THEN match_id % 60 ELSE 0 END)::INT) AS ko FROM m)
SELECT match_id, strftime(ko, '%Y-%m-%d %H:%M:%S') AS kickoff, lpad((y % 100)::VARCHAR, 2, '0') || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS season_code, y || '-' || (y + 1) AS season,
  (ko AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Amsterdam')::DATE = match_date - 1 AS day_before, region || ' - ' || league AS short_league FROM s""",
)(_m(_schedule))

LABELS = (*reads.CODES, "England - FA Cup", "Europe - Friendly")
_LABEL_SQL = "CASE match_id % {} {} END".format(len(LABELS), " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LABELS)))
_CODE_SQL = ", ".join(f"('{n}', '{c}')" for n, c in reads.CODES.items())
_query(
    "q_covered_leagues",
    f"""WITH c(label, code) AS (VALUES {_CODE_SQL}), f AS (SELECT split_part(label, ' - ', 1) AS country, string_agg(DISTINCT code, ' ' ORDER BY code) AS family FROM c GROUP BY 1),
l AS (SELECT DISTINCT {_LABEL_SQL} AS label FROM m) SELECT label, code, family FROM l JOIN c USING (label) JOIN f ON f.country = split_part(label, ' - ', 1)""",
)(_m(lambda m: reads.covered_leagues(m.select(F.expr(_LABEL_SQL).alias("label")))))


def _client(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    team = form.team_form(team_rows(m)).select("team_id", F.greatest("avg_scored", F.lit(0.2)).alias("attack"), F.greatest("avg_conceded", F.lit(0.2)).alias("defence"), "form", (F.lit(1400.0) + F.col("team_id") % 20 * 10).alias("elo"))
    for side in ("home", "away"):
        m = m.join(team.select(F.col("team_id").alias(f"{side}_team_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("attack", "defence", "form", "elo"))), f"{side}_team_id")
    rounded = ("home_xg", "away_xg", "home_prob", "draw_prob", "away_prob", "confidence")
    return reads.client_forecast(m).select("match_id", *(half_up(F.col(c), 6).alias(c) for c in rounded), "best_score")


_MOD = "CASE WHEN len(form) > 0 THEN list_sum(list_transform(string_split(form, ''), lambda c: CASE c WHEN 'W' THEN 1.2 WHEN 'D' THEN 1.0 ELSE 0.8 END::DOUBLE)) / len(form) ELSE 1 END::DOUBLE"
_query(
    "q_client_forecast",
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rank FROM t WHERE status = 'FT'),
u AS (SELECT team_id, greatest({R4.format('avg(gf)')}, 0.2)::DOUBLE AS attack, greatest({R4.format('avg(ga)')}, 0.2)::DOUBLE AS defence, 1400.0::DOUBLE + team_id % 20 * 10 AS elo,
  coalesce(string_agg(CASE WHEN gf > ga THEN 'W' WHEN gf < ga THEN 'L' WHEN gf = ga THEN 'D' END, '' ORDER BY rank) FILTER (rank <= 5), '') AS form FROM g WHERE rank <= 10 GROUP BY team_id),
v AS (SELECT *, {_MOD} AS modifier FROM u),
x AS (SELECT match_id, 1.35::DOUBLE * (a.attack / b.defence) * 1.18::DOUBLE * a.modifier AS lh, 1.35::DOUBLE * (b.attack / a.defence) * b.modifier AS la, abs(a.elo - b.elo) / 3500 + abs(a.modifier - b.modifier) / 5 AS extra
  FROM m JOIN v a ON a.team_id = home_team_id JOIN v b ON b.team_id = away_team_id),
c AS (SELECT x.*, h, w.a, pow(lh, h) * exp(-lh) / factorial(h::INT)::DOUBLE * pow(la, w.a) * exp(-la) / factorial(w.a::INT)::DOUBLE AS p FROM x, range(7) z(h), range(7) w(a))
SELECT match_id, {R('any_value(lh)', 6)} AS home_xg, {R('any_value(la)', 6)} AS away_xg, {R('sum(p) FILTER (h > a)', 6)} AS home_prob, {R('sum(p) FILTER (h = a)', 6)} AS draw_prob, {R('sum(p) FILTER (h < a)', 6)} AS away_prob,
  {R('least(0.98::DOUBLE, 2.5::DOUBLE * max(p) + any_value(extra))', 6)} AS confidence, arg_max(h || '-' || a, (p, -(7 * h + a))) AS best_score FROM c GROUP BY match_id""",
)(_client)
