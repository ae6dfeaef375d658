"""Registered queries over match records: reviews, learning, reliability, checks, tables, prices, referees, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchmill.functions import semantics as S
from matchmill.operators import advice, classify, duels, evaluate, form, lookups, market, monitor, sequence, serving
from matchmill.plans.bridge import MATCH_SQL, matches, odds, read, team_rows
from matchmill.plans.queries import ORACLE, QUERIES, _m, _o, _query, _t
from matchmill.plans.records import PARTS, RECORD_SQL, REVIEWS, R, X, learned_sql, records, reliable_sql, reviewed
from matchmill.sources.settled import settled


def _k(f, *parts: str):
    return lambda spark, d: f(records(spark, d, parts))


def _r(f, parts: tuple[str, ...] = PARTS):
    return lambda spark, d: f(reviewed(spark, d, parts))


# reviews and what is learned from them

REVIEW_COLUMNS = ("match_id", "label", "phase", "actual", "predicted", "likeliest", "outcome_hit", "probability_hit", "exact_hit", "goal_error", "goal_bias", "home_bias", "away_bias", "confidence")
_query("q_reviews", f"WITH {REVIEWS} SELECT {', '.join(REVIEW_COLUMNS)}, array_to_string(signals, ' ') AS signals FROM r")(_r(lambda r: r.select(*REVIEW_COLUMNS, F.array_join("signals", " ").alias("signals"))))
_query("q_league_reliability", f"WITH {REVIEWS} {reliable_sql('label')}")(_r(lambda r: evaluate.reliability(r, "label"), ()))
_query("q_phase_reliability", f"WITH {REVIEWS} {reliable_sql('phase')}")(_r(lambda r: evaluate.reliability(r, "phase"), ("meetings",)))
_query("q_team_learning", f"WITH {REVIEWS} {learned_sql()}")(_r(evaluate.team_learning))
_query("q_failure_signals_top6", f"WITH {REVIEWS} SELECT signal, count(*) AS n FROM (SELECT unnest(signals) AS signal FROM r) GROUP BY signal ORDER BY n DESC, signal LIMIT 6")(_r(evaluate.top_signals))
DIAGNOSED = f"count(*) AS reviews, {X('count(*) FILTER (exact_hit) / count(*)', 3)} AS exact_rate, {X('count(*) FILTER (outcome_hit) / count(*)', 3)} AS hit_rate, {X('count(*) FILTER (probability_hit) / count(*)', 3)} AS probability_rate, {X('sum(goal_error) / count(*)')} AS avg_goal_error"
_query("q_feature_diagnostics", f"WITH {REVIEWS} SELECT {DIAGNOSED} FROM r")(_r(evaluate.diagnostics, ()))
_query("q_phase_breakdown", f"WITH {REVIEWS} SELECT phase, count(*) AS matches, count(*) FILTER (exact_hit) AS exact_hits, count(*) FILTER (outcome_hit) AS outcome_hits, {X('count(*) FILTER (exact_hit) / count(*)')} AS exact_rate, {X('count(*) FILTER (outcome_hit) / count(*)')} AS hit_rate FROM r GROUP BY phase")(_r(evaluate.phase_breakdown, ("meetings",)))
_query("q_bias_shift", f"WITH {REVIEWS}, l AS (SELECT * FROM r ORDER BY match_date DESC, match_id DESC LIMIT 80) SELECT count(*) AS n, CASE WHEN count(*) >= 10 THEN greatest(-0.25, least(0.25, avg(goal_bias))) * 0.5 ELSE 0 END::DOUBLE AS shift FROM l")(_r(duels.bias_shift, ()))
_query("q_reviews_kept", f"WITH {REVIEWS} SELECT match_id FROM r ORDER BY match_date DESC, match_id DESC LIMIT 2500")(_r(lambda r: evaluate.newest(r).select("match_id"), ()))

# history

NAMED = "CASE {0} WHEN 'H' THEN 'Thuis' WHEN 'A' THEN 'Uit' ELSE 'Gelijk' END"
_query(
    "q_history",
    f"""WITH {REVIEWS} SELECT match_id, pred_home_goals || '-' || pred_away_goals AS prediction, home_goals || '-' || away_goals AS actual_score, exact_hit AS was_correct, goal_error AS error_margin, label AS league, outcome_hit AS winner_correct,
  {NAMED.format('predicted')} AS predicted_outcome, {NAMED.format('actual')} AS actual_outcome, probability_hit AS top_chance_correct, phase AS phase_bucket, confidence FROM r""",
)(_r(lambda r: evaluate.history(r.drop("league").withColumnRenamed("label", "league")), ("meetings",)))
BY_LEAGUE = "count(*) AS n, count(*) FILTER (exact_hit) AS exact, count(*) FILTER (outcome_hit) AS outcome, count(*) FILTER (probability_hit) AS top_chance"
PERCENT = "CAST(floor({} / n * 100 + 0.5) AS BIGINT) AS {}_percent"
_query("q_history_by_league", f"WITH {REVIEWS}, g AS (SELECT coalesce(nullif(label, ''), 'Onbekend') AS league, {BY_LEAGUE} FROM r GROUP BY 1) SELECT *, {', '.join(PERCENT.format(c, c) for c in ('exact', 'outcome', 'top_chance'))} FROM g WHERE league <> 'Onbekend' ORDER BY n DESC, outcome_percent DESC, league")(
    _r(lambda r: serving.history_by_league(r), ())
)
_query("q_history_filter_page", f"WITH {REVIEWS} SELECT match_id, label, predicted FROM r WHERE NOT exact_hit AND contains(lower(label), 'nat') ORDER BY match_date DESC, match_id LIMIT 80 OFFSET 80")(
    _r(lambda r: serving.history_page(r.filter("NOT exact_hit"), F.contains(F.lower("label"), F.lit("nat")), 2, 80).select("match_id", "label", "predicted"), ())
)

# advice over a day's sources and the reviews


#: What advice reads of a record; no place in a table is among it.
READ = (
    "status", "n_lines", "referee_id", "h2h_results", "home_goals", "away_goals", "pred_home_goals", "pred_away_goals", "home_prob", "draw_prob", "away_prob",
    "elo_diff", "lineups_confirmed", "weather_risk", "rest_diff", "market_over_diff", "agreement",
)


def _advice(spark: SparkSession, d: str) -> DataFrame:
    k = settled(records(spark, d, tuple(p for p in PARTS if p != "table")).select(*READ), "advice-records")  # read for coverage, rates and signals
    cover = advice.coverage(k.filter("status = 'NS'"), F.coalesce(F.col("n_lines"), F.lit(0)) > 1, F.col("referee_id").isNotNull(), F.col("h2h_results") > 0)
    return advice.recommendations(cover, advice.diagnostics(evaluate.reviews(k)), ("open_lineups", "weather_risk", "absent"))


_query(
    "q_advice",
    f"""WITH {REVIEWS}, c AS (SELECT count(*) AS n, count(*) FILTER (coalesce(n_lines, 0) <= 1) AS nb, count(*) FILTER (h2h_results = 0) AS nm, {R('count(*) FILTER (n_lines > 1) / greatest(count(*), 1)')} AS b, {R('count(referee_id) / greatest(count(*), 1)')} AS e, {R('count(*) FILTER (h2h_results > 0) / greatest(count(*), 1)')} AS h FROM k WHERE status = 'NS'),
n AS (SELECT s, count(*) AS n FROM (SELECT unnest(signals) AS s FROM r) GROUP BY s), d AS (SELECT avg(exact_hit::INT) AS exact FROM r)
SELECT ord::INT AS ord, topic, figure::BIGINT AS figure, priority FROM (
  SELECT 0 AS ord, 'fill_meetings' AS topic, nm AS figure, 'medium' AS priority FROM c WHERE nm > 0 UNION ALL SELECT 1, 'widen_books', nb, 'medium' FROM c WHERE nb > 0
  UNION ALL SELECT 2, 'thin_book_coverage', floor(b * 100 + 0.5), 'medium' FROM c WHERE b < 0.7 UNION ALL SELECT 3, 'thin_referee_coverage', floor(e * 100 + 0.5), 'medium' FROM c WHERE e < 0.65 UNION ALL SELECT 4, 'thin_h2h_coverage', floor(h * 100 + 0.5), 'medium' FROM c WHERE h < 0.75
  UNION ALL SELECT 5, 'calibration', floor(exact * 100 + 0.5), CASE WHEN exact < 0.14 THEN 'high' ELSE 'low' END FROM d
  UNION ALL SELECT 6, 'top_signal', max(n), CASE WHEN max(n) >= 8 THEN 'high' ELSE 'medium' END FROM n HAVING max(n) IS NOT NULL
  UNION ALL SELECT CASE s WHEN 'open_lineups' THEN 7 ELSE 8 END, 'signal_' || s, n, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END FROM n WHERE s IN ('open_lineups', 'weather_risk'))""",
)(_advice)

# data checks, for every day of the table


def _days(spark: SparkSession, d: str) -> DataFrame:
    k = records(spark, d, ("lines", "meetings"))
    known = k.filter("referee_id IS NOT NULL AND status = 'FT'").groupBy(F.col("referee_id")).agg(F.count(F.lit(1)).alias("referee_matches"))
    day = k.join(known, "referee_id", "left").withColumns({
        "minute": F.when(F.col("match_id") % 4 != 0, F.col("match_id") % 90 + 1), "period": F.when(F.col("match_id") % 8 == 0, "Half Time"), "h2h_played": F.col("h2h_results"), "has_market": F.col("n_lines").isNotNull(),
        "book_signals": F.coalesce("n_lines", F.lit(0)) - 1, "kickoff_day": F.when(F.col("match_id") % 50 == 0, F.date_add("match_date", 1)).otherwise(F.col("match_date")),
    })
    store = k.groupBy("match_date").agg(F.count_distinct(F.when(F.col("status") == "FT", F.col("league"))).alias("standings"), F.count_if(F.col("league_type") == "cup").alias("cup_sheets"), F.count_distinct(F.when(F.col("status") == "FT", F.col("phase"))).alias("phases"))
    age = F.when(F.dayofyear("match_date") % 9 != 0, F.dayofyear("match_date") % 120)
    return monitor.data_checks(monitor.day_counts(day, "match_date").join(store, "match_date").withColumn("age_minutes", age), "match_date").withColumn("match_date", F.col("match_date").cast("string"))


_query(
    "q_dq_rules",
    f"""WITH {RECORD_SQL}, kn AS (SELECT referee_id, count(*) AS games FROM k WHERE referee_id IS NOT NULL AND status = 'FT' GROUP BY referee_id),
g AS (SELECT match_date, count(*) AS n, count(*) FILTER (status = 'LIVE' AND k.match_id % 4 = 0 AND k.match_id % 8 <> 0) AS no_minute, count(*) FILTER (h2h_results = 0) AS no_h2h, count(*) FILTER (n_lines IS NOT NULL AND n_lines <= 1) AS no_books,
  count(*) FILTER (games > 0) AS refs, count(*) FILTER (k.match_id % 50 = 0) AS wrong, count(DISTINCT league) FILTER (status = 'FT') AS tables, count(*) FILTER (league_type = 'cup') AS cups, count(DISTINCT phase) FILTER (status = 'FT') AS phases,
  CASE WHEN dayofyear(match_date) % 9 <> 0 THEN dayofyear(match_date) % 120 END AS age
  FROM (SELECT *, CASE WHEN match_id % 23 < 2 THEN 'cup' END AS league_type FROM k) k LEFT JOIN kn USING (referee_id) GROUP BY match_date)
SELECT match_date::VARCHAR AS match_date, ord::INT AS ord, key, severity, c::BIGINT AS count FROM (
  SELECT match_date, 0 AS ord, 'worker_last_run_missing' AS key, 'high' AS severity, 1 AS c FROM g WHERE age IS NULL UNION ALL SELECT match_date, 1, 'worker_stale', 'high', age FROM g WHERE age > 90
  UNION ALL SELECT match_date, 3, 'live_minute_missing', 'high', no_minute FROM g WHERE no_minute > 0 UNION ALL SELECT match_date, 4, 'h2h_empty', 'medium', n FROM g WHERE no_h2h = n
  UNION ALL SELECT match_date, 5, 'cupsheets_empty', 'medium', 1 FROM g WHERE cups = 0 UNION ALL SELECT match_date, 6, 'phase_reliability_empty', 'medium', 1 FROM g WHERE phases = 0
  UNION ALL SELECT match_date, 7, 'bookmaker_signals_missing', 'medium', n FROM g WHERE no_books = n UNION ALL SELECT match_date, 8, 'historical_referee_unmatched', 'low', n FROM g WHERE refs = 0
  UNION ALL SELECT match_date, 9, 'standings_empty', 'high', 1 FROM g WHERE tables = 0 UNION ALL SELECT match_date, 10, 'dashboard_wrong_day', 'high', wrong FROM g WHERE wrong > 0)""",
)(_days)


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("key"), (F.col("user_id") % 3 + 1).alias("severity_rank"), F.concat_ws(" ", "event_type", (F.col("event_id") % 4).cast("string")).alias("message"))


ISSUE_SQL = "i AS (SELECT ts::DATE AS day, date_trunc('hour', ts) AS ts, event_type AS key, user_id % 3 + 1 AS severity_rank, event_type || ' ' || (event_id % 4) AS message FROM events)"
_query("q_day_report", f"WITH {ISSUE_SQL} SELECT day::VARCHAR AS day, key, arg_min((severity_rank, message), (ts, severity_rank, message))[1]::BIGINT AS severity_rank, arg_min((severity_rank, message), (ts, severity_rank, message))[2] AS message, count(*) AS times FROM i GROUP BY day, key", bridge=False)(
    lambda spark, d: monitor.first_of_day(_issues(spark, d)).withColumn("day", F.col("day").cast("string"))
)
_query("q_digest_totals", f"WITH {ISSUE_SQL}, w AS (SELECT * FROM i WHERE day >= (SELECT max(day) FROM i) - 13) SELECT count(DISTINCT day) AS days, count(DISTINCT ts) AS runs, count(*) AS issues, least(8, count(DISTINCT key)) AS kinds, max(ts)::VARCHAR AS last_run FROM w", bridge=False)(
    lambda spark, d: monitor.digest_totals(_issues(spark, d)).withColumn("last_run", F.col("last_run").cast("string"))
)

# leagues, internationals, zones, weights

CASES = ("1e", "2e")
NAMES = {0: ("England", "Premier League"), 1: ("Germany", "2. Bundesliga"), 2: ("Spain", "LaLiga2"), 3: ("Netherlands", "KNVB Beker"), 4: ("Portugal", "Liga Portugal 2"), 5: ("World", "UEFA Champions League"), 6: ("Belgium", "Challenger Pro League"), 7: ("Brazil", "Serie A"), 8: ("Italy", "Serie B"), 9: ("France", "Ligue 2"), 10: ("England", "Championship"), 11: ("Netherlands", "Eerste Divisie")}


def _named(n: int) -> tuple[F.Column, F.Column]:
    country = name = F.when(F.lit(False), F.lit(""))
    for i, (c, x) in NAMES.items():
        country, name = country.when(F.col("match_id") % n == i, c), name.when(F.col("match_id") % n == i, x)
    return country, name


NAME_SQL = ", ".join(f"CASE match_id % {len(NAMES)} {' '.join(f"WHEN {i} THEN '{v[at]}'" for i, v in NAMES.items())} END AS {c}" for at, c in enumerate(("country", "name")))
LEAGUE_SQL = " ".join(f"WHEN contains(lower(country), '{c}') AND contains(lower(name), '{n}') THEN '{{}}'" for c, n, _, _ in classify.LEAGUES)
_query("q_classify_league", f"SELECT match_id, CASE {LEAGUE_SQL.format(*(x[2] for x in classify.LEAGUES))} END AS label, CASE {LEAGUE_SQL.format(*(x[3] for x in classify.LEAGUES))} END AS type FROM (SELECT match_id, {NAME_SQL} FROM m)")(
    _m(lambda m: m.select("match_id", classify.league_of(*_named(len(NAMES))).alias("l")).select("match_id", "l.label", "l.type"))
)
CUPS = ("FIFA World Cup Qualification, UEFA", "World Championship Qual. CONMEBOL", "European Championship Qualification", "UEFA Nations League A", "European Championship", "International Friendly Games", "Club Friendly Games", "UEFA Nations League U21", "Copa America")
COUNTRIES = ("Netherlands", "Brazil", "Türkiye", "Faroe Islands", "Argentina", "")
_query(
    "q_classify_international",
    f"""WITH s AS (SELECT match_id, [{', '.join(f"'{c}'" for c in CUPS)}][match_id % {len(CUPS)} + 1] AS t, [{', '.join(f"'{c}'" for c in COUNTRIES)}][match_id % 6 + 1] AS hc, [{', '.join(f"'{c}'" for c in COUNTRIES)}][match_id % 5 + 1] AS ac, CASE WHEN match_id % 4 = 0 THEN 'Europe' ELSE 'World' END AS cat FROM m),
e AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS n, hc IN ('Netherlands', 'Faroe Islands') OR ac IN ('Netherlands', 'Faroe Islands') AS eu FROM s)
SELECT match_id, CASE WHEN contains(n, 'u21') THEN NULL WHEN (contains(n, 'world championship qual') OR contains(n, 'world cup qual')) AND (cat = 'Europe' OR eu OR contains(n, 'uefa')) THEN 'Europe - World Cup Qualification'
  WHEN contains(n, 'european championship') AND contains(n, 'qualification') AND (cat = 'Europe' OR eu) THEN 'Europe - Euro Qualification' WHEN contains(n, 'uefa nations league') THEN 'Europe - UEFA Nations League'
  WHEN contains(n, 'european championship') AND NOT contains(n, 'qualification') AND (cat = 'Europe' OR eu) THEN 'Europe - European Championship'
  WHEN (contains(n, 'friendly games') OR contains(n, 'international friendly')) AND NOT contains(n, 'club') AND eu THEN 'Europe - International Friendly' END AS label FROM e""",
)(
    _m(lambda m: m.select("match_id", classify.international(*(F.element_at(F.array(*map(F.lit, x)), (F.col("match_id") % n + 1).cast("int")) if x else F.when(F.col("match_id") % 4 == 0, "Europe").otherwise("World") for x, n in ((CUPS, len(CUPS)), (None, 0), (COUNTRIES, 6), (COUNTRIES, 5)))).alias("l")).select("match_id", "l.label"))
)
TABLE_SQL = """g AS (SELECT league, team_id, count(*) FILTER (gf > ga) * 3 + count(*) FILTER (gf = ga) AS points, sum(gf) - sum(ga) AS gd, sum(gf) AS gf FROM t WHERE status = 'FT' AND gf IS NOT NULL GROUP BY league, team_id),
s AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY points DESC, gd DESC, gf DESC, team_id) AS position, count(*) OVER (PARTITION BY league) AS n FROM g),
l AS (SELECT *, CASE substr(league, 8)::INT % 5 WHEN 0 THEN 'England - Premier League' WHEN 1 THEN 'England - Championship' WHEN 2 THEN 'Netherlands - Eerste Divisie' WHEN 3 THEN 'Netherlands - Eredivisie' ELSE 'Elsewhere' END AS label FROM s)"""


def _zoned(t: DataFrame) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("England - Premier League", "England - Championship", "Netherlands - Eerste Divisie", "Netherlands - Eredivisie", "Elsewhere"))), (F.substring("league", 8, 9).cast("int") % 5 + 1))
    s = form.standings(t).withColumn("label", label)
    z = s.groupBy("league", "label").agg(F.count(F.lit(1)).alias("teams")).select("league", F.explode(classify.zones(F.col("label"), F.col("teams"))).alias("z")).select("league", "z.*")
    return lookups.range_lookup(s, "position", z, "low", "high", "ord", ["league"], "team_id").select("league", "team_id", "position", "zone")


_query(
    "q_standing_zones",
    f"""WITH {TABLE_SQL} SELECT league, team_id, position,
  CASE WHEN label LIKE '%Premier League' THEN CASE WHEN position <= 4 THEN 'ucl' WHEN position <= 6 THEN 'europe' WHEN position >= greatest(n - 2, 1) THEN 'relegation' END
       WHEN label LIKE '%Championship' THEN CASE WHEN position <= 2 THEN 'promotion' WHEN position <= 6 THEN 'playoffs' WHEN position >= greatest(n - 2, 1) THEN 'relegation' END
       WHEN label LIKE '%Eerste Divisie' THEN CASE WHEN position <= 2 THEN 'promotion' WHEN position BETWEEN 3 AND 8 THEN 'period' END
       WHEN label LIKE '%Eredivisie' THEN CASE WHEN position <= 3 THEN 'ucl' WHEN position <= 8 THEN 'playoffs' WHEN position >= greatest(n - 2, 1) THEN 'relegation' END
       ELSE CASE WHEN position <= least(4, n) THEN 'top' WHEN position >= greatest(n - 2, 1) THEN 'bottom' END END AS zone FROM l""",
)(_t(_zoned))
_query("q_match_importance", f"WITH {RECORD_SQL} SELECT match_id, importance FROM k")(_k(lambda k: k.select("match_id", "importance"), "table"))
_query("q_rest_days", "SELECT team_id, match_id, CASE WHEN gap > 0 THEN gap::DOUBLE END AS rest_days FROM (SELECT team_id, match_id, match_date - lag(match_date) OVER (PARTITION BY team_id ORDER BY match_date, match_id) AS gap FROM t)")(_t(form.rest_days))
_query("q_weather_risk", f"WITH {RECORD_SQL} SELECT match_id, weather_risk FROM k")(_k(lambda k: k.select("match_id", "weather_risk"), "weather"))
_query("q_retained_days", "SELECT match_id FROM m WHERE match_date BETWEEN DATE '1998-03-03' - 12 AND DATE '1998-03-03' + 4")(_m(lambda m: serving.retained(m, "1998-03-03").select("match_id")))

# form with cards, recent games, prices, referees

FORM_SQL = f"""{RECORD_SQL},
tc AS (SELECT match_id, match_date, league, status, 'home' AS side, home_team_id AS team_id, away_team_id AS opponent_id, home_goals AS gf, away_goals AS ga, coalesce(home_yellow, 0) AS yellow, coalesce(home_red, 0) AS red FROM k
  UNION ALL SELECT match_id, match_date, league, status, 'away', away_team_id, home_team_id, away_goals, home_goals, coalesce(away_yellow, 0), coalesce(away_red, 0) FROM k),
l10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rank FROM tc WHERE status = 'FT') WHERE rank <= 10),
fo AS (SELECT team_id, count(*) AS games, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, count(*) FILTER (gf < ga) AS losses,
  {", ".join(f"{X(e + ' / count(*)')} AS {n}" for n, e in (("avg_scored", "coalesce(sum(gf), 0)"), ("avg_conceded", "coalesce(sum(ga), 0)"), ("btts_rate", "count(*) FILTER (gf > 0 AND ga > 0)"), ("over15_rate", "count(*) FILTER (gf + ga > 1)"), ("over25_rate", "count(*) FILTER (gf + ga > 2)"), ("clean_sheet_rate", "count(*) FILTER (ga = 0)"), ("blank_rate", "count(*) FILTER (gf = 0)"), ("yellow_rate", "sum(yellow)"), ("red_rate", "sum(red)")))},
  {", ".join(f"count(*) FILTER (side = '{s}' AND gf IS NOT NULL) AS {s}_games, " + ", ".join(f"CASE WHEN count(*) FILTER (side = '{s}' AND gf IS NOT NULL) > 0 THEN {X(e.format(s) + f' / count(*) FILTER (side = {chr(39)}{s}{chr(39)} AND gf IS NOT NULL)')} ELSE {z} END::DOUBLE AS {s}_{n}" for n, e, z in (("scored", "sum(gf) FILTER (side = '{}')", "1.35"), ("conceded", "sum(ga) FILTER (side = '{}')", "1.35"), ("over25", "count(*) FILTER (side = '{}' AND gf + ga > 2)", "0.45"))) for s in ("home", "away"))}
  FROM l10 GROUP BY team_id),
fs AS (SELECT *, CASE WHEN home_scored > away_scored + 0.25 THEN 'home' WHEN away_scored > home_scored + 0.25 THEN 'away' ELSE 'balanced' END AS strongest_side FROM fo)"""


def card_rows(k: DataFrame) -> DataFrame:
    """team_rows() with yellow and red cards of the side, in the same pass."""
    rows = k.select("match_id", "match_date", "league", "status", F.explode(F.array(*(F.struct(
        F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id"), F.col(f"{o}_team_id").alias("opponent_id"), F.col(f"{s}_goals").alias("gf"), F.col(f"{o}_goals").alias("ga"),
        F.coalesce(f"{s}_yellow", F.lit(0)).alias("yellow"), F.coalesce(f"{s}_red", F.lit(0)).alias("red"),
    ) for s, o in (("home", "away"), ("away", "home"))))).alias("t"))
    return rows.select("match_id", "match_date", "league", "status", "t.*")


FORM_COLUMNS = ("team_id", "games", "wins", "draws", "losses", "avg_scored", "avg_conceded", "btts_rate", "over15_rate", "over25_rate", "clean_sheet_rate", "blank_rate", "yellow_rate", "red_rate", *(f"{s}_{n}" for s in ("home", "away") for n in ("games", "scored", "conceded", "over25")), "strongest_side")
_query("q_form_profile", f"WITH {FORM_SQL} SELECT {', '.join(FORM_COLUMNS)} FROM fs")(_k(lambda k: form.profile(card_rows(k)).select(*FORM_COLUMNS), "lines"))
_query("q_recent5", f"WITH {FORM_SQL} SELECT team_id, rank::INT AS rank, match_id, opponent_id, CASE side WHEN 'home' THEN 'H' ELSE 'A' END AS venue, gf || '-' || ga AS score, CASE WHEN gf > ga THEN 'W' WHEN gf IS NOT DISTINCT FROM ga THEN 'D' ELSE 'L' END AS result FROM l10 WHERE rank <= 5")(_t(form.recent_matches))
_query("q_recent_form_balance", f"WITH p AS (SELECT *, least(home_team_id, away_team_id) AS team_a, greatest(home_team_id, away_team_id) AS team_b FROM m WHERE status = 'FT' AND home_goals IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY team_a, team_b ORDER BY match_date DESC, match_id DESC) AS rank FROM p) SELECT team_a, team_b, string_agg(CASE WHEN home_goals = away_goals THEN 'D' WHEN (home_goals > away_goals) = (home_team_id = team_a) THEN 'W' ELSE 'L' END, '' ORDER BY rank) AS form FROM k WHERE rank <= 5 GROUP BY team_a, team_b")(_m(form.meeting_form))
VALID_SQL = "home_odd > 1.01 AND draw_odd > 1.01 AND away_odd > 1.01"
_query("q_odds_pick_closing", f"SELECT match_id, b[3] AS book, b[1] = 0 AS closing, b[4] AS home_odd, b[5] AS draw_odd, b[6] AS away_odd FROM (SELECT match_id, min([(NOT closing)::INT::DOUBLE, list_position([3, 1, 6, 0, 7, 2, 5, 4], book)::DOUBLE, book, home_odd, draw_odd, away_odd]) AS b FROM o WHERE {VALID_SQL} GROUP BY match_id)")(
    _o(lambda o: market.picked_odds(o, (3, 1, 6, 0, 7, 2, 5, 4)).withColumn("book", F.col("book").cast("double")))
)
_query("q_market_league_meta", f"WITH c AS (SELECT league, match_id, count(*) AS n, count(*) FILTER (closing) AS c FROM o WHERE {VALID_SQL} AND outcome IS NOT NULL GROUP BY league, match_id) SELECT league, sum(n)::BIGINT AS valid_rows, count(*) AS matches, count(*) FILTER (c >= 2) AS covered, {R('count(*) FILTER (c >= 2) / count(*)')} AS closing_coverage FROM c GROUP BY league")(_o(market.league_meta))
SIDED = ", ".join(f"count(*) FILTER (side = '{s}') AS {s}_games, " + ", ".join(f"{R(f'coalesce(sum({c}) FILTER (side = {chr(39)}{s}{chr(39)}), 0) / {by} / greatest(count(*) FILTER (side = {chr(39)}{s}{chr(39)}), 1)', 3)} AS {s}_{n}" for c, by, n in (("won", 1, "actual"), ("promised", 10000, "implied"))) for s in ("home", "away"))
_query(
    "q_market_sides",
    f"WITH {RECORD_SQL}, si AS (SELECT league, 'home' AS side, home_team_id AS team_id, CAST(round((3 * ph + pd) * 10000) AS BIGINT) AS promised, CASE outcome WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS won FROM op UNION ALL SELECT league, 'away', away_team_id, CAST(round((3 * pa + pd) * 10000) AS BIGINT), CASE outcome WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM op) SELECT league, team_id, {SIDED} FROM si GROUP BY league, team_id",
)(_o(market.side_profile))
_query(
    "q_current_signals",
    f"""WITH b AS (SELECT match_id, book, min([home_odd, draw_odd, away_odd]) AS x FROM o WHERE {VALID_SQL} GROUP BY match_id, book), n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY book) AS n FROM b),
p AS (SELECT match_id, book, {R('1 / x[1] / (1 / x[1] + 1 / x[2] + 1 / x[3])', 4)} AS h, {R('1 / x[2] / (1 / x[1] + 1 / x[2] + 1 / x[3])', 4)} AS d, {R('1 / x[3] / (1 / x[1] + 1 / x[2] + 1 / x[3])', 4)} AS a FROM n WHERE n <= 8),
e AS (SELECT match_id, book, {X('h - a')} AS diff, {X('greatest(h, d, a) * 0.9::DOUBLE')} AS strength, CASE WHEN h >= a AND h >= d THEN 'home' WHEN a >= d THEN 'away' ELSE 'neutral' END AS lean FROM p)
SELECT *, {X("avg((lean <> 'neutral')::INT) OVER (PARTITION BY match_id)")} AS agreement FROM e""",
)(_o(market.current_signals))
_query(
    "q_referee_profile",
    f"""WITH {RECORD_SQL}, g AS (SELECT referee_id, count(*) AS games, {R('sum(home_yellow + away_yellow) / count(*)')} AS avg_yellow, {R('sum(home_red + away_red) / count(*)')} AS avg_red, {R('sum(home_yellow + away_yellow + (home_red + away_red) * 2) / count(*)')} AS avg_cards, {X('sum(penalties) / count(penalties)')} AS penalty_rate FROM k WHERE referee_id IS NOT NULL GROUP BY referee_id)
SELECT g.*, CASE WHEN avg_cards >= 4.8 THEN 'streng' WHEN avg_cards >= 3.2 THEN 'gemiddeld' ELSE 'laat doorspelen' END AS strictness, s_name AS referee FROM g LEFT JOIN supplier ON s_suppkey = referee_id""",
)(lambda spark, d: market.referees(records(spark, d, ("lines",)), read(spark, d, "supplier")))

# folds and nearest values, without gathering a key's rows

_query("q_ewma_rates")(lambda spark, d: sequence.rates(team_rows(matches(spark, d))).select("team_id", F.round("attack", 6).alias("attack"), F.round("defence", 6).alias("defence")))
FOLD_SQL = "round(list_reduce(list_prepend(1.5::DOUBLE, {}), lambda x, v: greatest(0.6, least(3.0, 0.94 * x + 0.06 * v / 1.35))), 6)"
ORACLE["q_ewma_rates"] = f"WITH {MATCH_SQL}, g AS (SELECT team_id, list(gf::DOUBLE ORDER BY match_date, match_id) AS f, list(ga::DOUBLE ORDER BY match_date, match_id) AS c FROM t WHERE gf IS NOT NULL AND ga IS NOT NULL GROUP BY team_id) SELECT team_id, {FOLD_SQL.format('f')} AS attack, {FOLD_SQL.format('c')} AS defence FROM g"
_query("q_nearest_hour", "SELECT user_id, arg_min((hour(ts) * 60 + minute(ts))::BIGINT, (abs(hour(ts) * 60 + minute(ts) - 900), ts, event_id)) AS nearest FROM events GROUP BY user_id", bridge=False)(
    lambda spark, d: read(spark, d, "events").withColumn("at", (F.hour("ts") * 60 + F.minute("ts")).cast("long")).groupBy("user_id").agg(F.min_by("at", F.struct(F.abs(F.col("at") - 900), "ts", "event_id")).alias("nearest"))
)
_query("q_iso_weeks", "SELECT isoyear(match_date) AS year, week(match_date) AS week, week(match_date) % 2 = 0 AS even, count(*) AS n FROM m GROUP BY 1, 2")(_m(serving.iso_weeks))

# merged feeds, meetings, cups

_query("q_merge_full_outer", "SELECT match_id, CASE WHEN match_id % 3 <> 0 THEN league ELSE region END AS league FROM m")(
    _m(lambda m: serving.merged(m.filter("match_id % 3 <> 0").select("match_id", "league"), m.filter("match_id % 2 = 0 OR match_id % 3 = 0").select("match_id", F.col("region").alias("league")), ["league"]))
)
MET = "SELECT DISTINCT least(home_team_id, away_team_id) || '_' || greatest(home_team_id, away_team_id) AS pair, match_date AS day, home_team_id AS home, away_team_id AS away, home_goals || '-' || away_goals AS score FROM m WHERE home_goals IS NOT NULL"


def _met(m: DataFrame) -> DataFrame:
    one = m.filter("home_goals IS NOT NULL").select(F.concat_ws("_", F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")).alias("pair"), F.col("match_date").alias("day"), F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.concat_ws("-", "home_goals", "away_goals").alias("score"), "match_id")
    lists = [one.filter(c).drop("match_id") for c in ("match_id % 3 <> 0", "match_id % 2 = 0 OR match_id % 3 = 0")]
    return duels.merged_meetings(lists, "pair").select("pair", F.array_join(F.transform("meetings", lambda x: x["score"]), " ").alias("scores"))


_query("q_merged_meetings", f"WITH u AS ({MET}), n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY day DESC, home DESC, away DESC, score DESC) AS n FROM u) SELECT pair, string_agg(score, ' ' ORDER BY n DESC) AS scores FROM n WHERE n <= 8 GROUP BY pair")(_m(_met))
_query(
    "q_cup_sheets",
    f"""WITH {RECORD_SQL}, c AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(round_label, '')), 'final') THEN 90 WHEN lower(round_label) LIKE '%round of 16%' THEN 60 ELSE 10 END AS weight FROM k WHERE match_id % 23 < 2 OR round_label IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY label, round_label ORDER BY match_date, match_id) - 1 AS at, count(*) OVER (PARTITION BY label, round_label) AS n FROM c)
SELECT i.label, i.round_label, i.weight::INT AS weight, i.at::INT AS at, i.match_id, CASE WHEN i.home_goals > i.away_goals THEN i.away_team_id WHEN i.home_goals < i.away_goals THEN i.home_team_id END AS loser, j.match_id AS sibling
FROM i LEFT JOIN i j ON j.label = i.label AND j.round_label = i.round_label AND j.at = i.at + CASE WHEN i.at % 2 = 0 THEN 1 ELSE -1 END""",
)(_k(lambda k: serving.cup_sheets(k.filter("league_type = 'cup' OR round_label IS NOT NULL"))))
_query("q_next_round", f"WITH {RECORD_SQL}, w AS (SELECT DISTINCT label, round_label, CASE WHEN contains(lower(round_label), 'final') THEN 90 WHEN contains(lower(round_label), 'round of 16') THEN 60 ELSE 10 END AS weight FROM k WHERE round_label IS NOT NULL) SELECT label, round_label, weight::INT AS weight, lead(round_label) OVER (PARTITION BY label ORDER BY weight, round_label) AS next_round FROM w")(
    _k(lambda k: serving.next_rounds(k.filter("round_label IS NOT NULL")))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per league: reviews, hit rates, goal error and reliability; the ten most reliable."""
    return evaluate.reliability(reviewed(spark, sf_dir, ()), "label").orderBy(F.desc("reliability"), "label").limit(10)


QUERIES["q_flagship"] = flagship
ORACLE["q_flagship"] = f"WITH {MATCH_SQL}, {REVIEWS} {reliable_sql('label')} ORDER BY reliability DESC, label LIMIT 10"
