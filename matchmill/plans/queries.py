"""The registered queries over the bridge relations, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchmill.functions import semantics as S
from matchmill.operators import classify, form, lookups, market, model, monitor, sequence, serving
from matchmill.plans.bridge import MATCH_SQL, matches, odds, read, team_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None, bridge: bool = True):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH {MATCH_SQL}\n{sql}" if bridge and not sql.lstrip().startswith("WITH") else (f"WITH {MATCH_SQL},\n{sql.lstrip()[5:]}" if bridge else sql)
        return f

    return put


def _m(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(matches(spark, d))


def _t(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(team_rows(matches(spark, d)))


def _o(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(odds(spark, d, matches(spark, d)))


R4 = "floor(({}) * 10000 + 0.5) / 10000"
OUT = "CASE WHEN {0} > {1} THEN 'H' WHEN {0} < {1} THEN 'A' WHEN {0} = {1} THEN 'D' END"

_query("q_day_matches", "SELECT match_id, league, status FROM m WHERE match_date = DATE '1998-03-03'")(_m(lambda m: serving.on_days(m, "1998-03-03").select("match_id", "league", "status")))
_query("q_multiday_matches", "SELECT match_id, CAST(match_date AS VARCHAR) AS match_date FROM m WHERE match_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-05'")(_m(lambda m: serving.on_days(m, "1998-03-03", 4).select("match_id", F.col("match_date").cast("string").alias("match_date"))))
_query("q_status_counts", "SELECT league, count(*) AS total, count(*) FILTER (status = 'LIVE') AS live, count(*) FILTER (status = 'NS') AS planned, count(*) FILTER (status = 'FT') AS played FROM m GROUP BY league")(
    _m(lambda m: m.groupBy("league").agg(F.count(F.lit(1)).alias("total"), F.count_if(serving.live()).alias("live"), F.count_if(~serving.live() & ~serving.finished()).alias("planned"), F.count_if(serving.finished()).alias("played")))
)
_query("q_custom_sort_topk", "SELECT match_id, league FROM m WHERE status = 'NS' ORDER BY CASE league WHEN 'NATION_7' THEN 0 WHEN 'NATION_3' THEN 1 ELSE 999 END, league, match_id LIMIT 50")(
    _m(lambda m: serving.with_status(m, "gepland").orderBy(serving.league_rank(("NATION_7", "NATION_3")), "league", "match_id").limit(50).select("match_id", "league"))
)
_query("q_favorites_or_semi", "SELECT match_id FROM m WHERE home_team_id IN (101, 205, 1501) OR away_team_id IN (101, 205, 1501)")(_m(lambda m: serving.with_status(m, "favorieten", [101, 205, 1501]).select("match_id")))
_query("q_excluded_cascade_anti", "SELECT team_id, count(*) AS games FROM t WHERE team_id NOT IN (SELECT team_id FROM t WHERE gf >= 6) GROUP BY team_id")(
    _t(lambda t: classify.without_excluded({"t": t}, t.filter("gf >= 6").select("team_id").distinct())["t"].groupBy("team_id").agg(F.count(F.lit(1)).alias("games")))
)
_query("q_team_recent10", "SELECT team_id, match_id, rank FROM (SELECT team_id, match_id, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rank FROM t WHERE status = 'FT') WHERE rank <= 10")(_t(lambda t: form.recent(t).select("team_id", "match_id", "rank")))
_query(
    "q_team_form",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rank FROM t WHERE status = 'FT')
SELECT team_id, count(*) AS games, {R4.format("avg(gf)")} AS avg_scored, {R4.format("avg(ga)")} AS avg_conceded, {R4.format("count(*) FILTER (gf > 0 AND ga > 0) / count(*)")} AS btts_rate,
  {R4.format("count(*) FILTER (gf + ga >= 2) / count(*)")} AS over15_rate, {R4.format("count(*) FILTER (gf + ga >= 3) / count(*)")} AS over25_rate, {R4.format("count(*) FILTER (ga = 0) / count(*)")} AS clean_sheet_rate,
  {R4.format("count(*) FILTER (gf = 0) / count(*)")} AS blank_rate, coalesce(string_agg(CASE WHEN gf > ga THEN 'W' WHEN gf < ga THEN 'L' WHEN gf = ga THEN 'D' END, '' ORDER BY rank) FILTER (rank <= 5), '') AS form
FROM r WHERE rank <= 10 GROUP BY team_id""",
)(_t(form.team_form))
_query(
    "q_team_splits",
    f"""WITH g AS (SELECT team_id, {R4.format("coalesce(avg(gf) FILTER (side = 'home'), 1.35)")} AS home_avg, {R4.format("coalesce(avg(gf) FILTER (side = 'away'), 1.35)")} AS away_avg FROM t WHERE status = 'FT' GROUP BY team_id)
SELECT *, CASE WHEN home_avg > away_avg + 0.25 THEN 'home' WHEN away_avg > home_avg + 0.25 THEN 'away' ELSE 'balanced' END AS strongest_side FROM g""",
)(_t(form.splits))
STANDINGS = """g AS (
  SELECT league, team_id, count(*) AS games, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, count(*) FILTER (gf < ga) AS losses, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga
  FROM t WHERE status = 'FT' AND gf IS NOT NULL GROUP BY league, team_id),
s AS (SELECT *, wins * 3 + draws AS points, row_number() OVER (PARTITION BY league ORDER BY wins * 3 + draws DESC, gf - ga DESC, gf DESC, team_id) AS position FROM g)"""
_query("q_standings", f"WITH {STANDINGS} SELECT * FROM s")(_t(form.standings))




MEET = """WITH p AS (SELECT *, least(home_team_id, away_team_id) AS team_a, greatest(home_team_id, away_team_id) AS team_b FROM m WHERE status = 'FT' AND home_goals IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY team_a, team_b ORDER BY match_date DESC, match_id DESC) AS rank FROM p)"""
_query("q_h2h_pairs_last8", f"{MEET} SELECT team_a, team_b, match_id, rank FROM k WHERE rank <= 8")(_m(lambda m: form.meetings(m).select("team_a", "team_b", "match_id", "rank")))
_query(
    "q_h2h_weighted_balance",
    f"""{MEET}, w AS (SELECT *, 6 + count(*) OVER (PARTITION BY team_a, team_b) - rank AS w, sign(CASE WHEN home_team_id = team_a THEN home_goals - away_goals ELSE away_goals - home_goals END) AS d FROM k WHERE rank <= 5)
SELECT team_a, team_b, count(*) AS played, floor(sum(w * d) / sum(w) * 100 + 0.5) / 100 AS balance FROM w GROUP BY team_a, team_b""",
)(_m(form.meeting_balance))
_query("q_prev_leg_asof", "WITH p AS (SELECT match_id, match_date, lag(match_id) OVER w AS leg_id, match_date - lag(match_date) OVER w AS gap FROM m WINDOW w AS (PARTITION BY least(home_team_id, away_team_id), greatest(home_team_id, away_team_id) ORDER BY match_date, match_id)) SELECT match_id, leg_id, gap FROM p WHERE gap <= 160")(_m(form.previous_leg))
PRICED = f"""WITH i AS (SELECT *, CASE WHEN home_odd > 1.01 THEN 1 / home_odd ELSE 0 END AS ih, CASE WHEN draw_odd > 1.01 THEN 1 / draw_odd ELSE 0 END AS id, CASE WHEN away_odd > 1.01 THEN 1 / away_odd ELSE 0 END AS ia FROM o),
x AS (SELECT *, {R4.format("ih / (ih + id + ia)")} AS p_home, {R4.format("id / (ih + id + ia)")} AS p_draw, {R4.format("ia / (ih + id + ia)")} AS p_away FROM i WHERE ih + id + ia > 0),
v AS (SELECT * FROM x WHERE home_odd > 1.01 AND draw_odd > 1.01 AND away_odd > 1.01 AND outcome IS NOT NULL),
s AS (SELECT league, book, closing, home_team_id AS team_id, CAST(round((3 * p_home + p_draw) * 10000) AS BIGINT) AS promised, CASE outcome WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS won FROM v
  UNION ALL SELECT league, book, closing, away_team_id, CAST(round((3 * p_away + p_draw) * 10000) AS BIGINT), CASE outcome WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM v)"""
PROFILE = "count(*) AS games, count(*) FILTER (closing) AS closing_rows, CAST(sum(won) AS BIGINT) AS points, floor((sum(won) / count(*) - sum(promised) / 10000 / count(*)) * 1000 + 0.5) / 1000 AS overperformance"
_query("q_implied_probs", f"{PRICED} SELECT league, closing, count(*) AS n, CAST(sum(round(p_home * 10000)) AS BIGINT) AS home_units, CAST(sum(round(p_away * 10000)) AS BIGINT) AS away_units FROM x GROUP BY league, closing")(
    _o(lambda o: market.implied(o.filter("home_odd > 1.01 OR draw_odd > 1.01 OR away_odd > 1.01")).groupBy("league", "closing").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("p_home") * 10000)).cast("long").alias("home_units"), F.sum(F.round(F.col("p_away") * 10000)).cast("long").alias("away_units")))
)
_query("q_market_team_profile", f"{PRICED} SELECT league, team_id, {PROFILE} FROM s GROUP BY league, team_id")(_o(market.team_profile))
_query("q_market_book_profile", f"{PRICED} SELECT league, book, team_id, {PROFILE} FROM s GROUP BY league, book, team_id")(_o(lambda o: market.team_profile(o, "book")))

RATES = lambda m: m.filter("pred_home_goals IS NOT NULL").withColumns({"home_xg": F.lit(0.6) + F.col("pred_home_goals") * 0.5, "away_xg": F.lit(0.5) + F.col("pred_away_goals") * 0.45})
GRID = """WITH x AS (SELECT DISTINCT pred_home_goals AS ph, pred_away_goals AS pa, (0.6 + pred_home_goals * 0.5)::DOUBLE AS lh, (0.5 + pred_away_goals * 0.45)::DOUBLE AS la FROM m),
c AS (SELECT x.*, h, a, pow(lh, h) * exp(-lh) / (factorial(h::INT))::DOUBLE * pow(la, a) * exp(-la) / (factorial(a::INT))::DOUBLE *
  CASE WHEN h = 0 AND a = 0 THEN 1 + 0.13 * lh * la WHEN h = 0 AND a = 1 THEN 1 - 0.13 * lh WHEN h = 1 AND a = 0 THEN 1 - 0.13 * la WHEN h = 1 AND a = 1 THEN 1.13 ELSE 1 END AS p FROM x, range(7) u(h), range(7) v(a)),
b AS (SELECT ph, pa, sum(p) FILTER (h > a) AS w, sum(p) FILTER (h = a) AS d, sum(p) FILTER (h < a) AS l, round(sum(p) FILTER (h + a > 2), 6) AS over25, round(sum(p) FILTER (h > 0 AND a > 0), 6) AS btts, arg_max(h || '-' || a, (p, -(7 * h + a))) AS best_score FROM c GROUP BY ph, pa)"""
_query("q_poisson_grid", f"{GRID} SELECT match_id, round(w / (w + d + l), 6) AS home_prob, round(d / (w + d + l), 6) AS draw_prob, round(l / (w + d + l), 6) AS away_prob, over25, btts, best_score FROM m JOIN b ON ph = pred_home_goals AND pa = pred_away_goals")(
    _m(lambda m: model.score_grid(RATES(m)).select("match_id", *(F.round(c, 6).alias(c) for c in ("home_prob", "draw_prob", "away_prob", "over25", "btts")), "best_score"))
)




_query("q_best_streak", "WITH i AS (SELECT user_id, event_type <> 'error' AS hit, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, g, count(*) FILTER (hit) AS n FROM i GROUP BY user_id, g) SELECT user_id, max(n) AS best_streak FROM r GROUP BY user_id", bridge=False)(
    lambda spark, d: sequence.best_streak(read(spark, d, "events"), ["user_id"], F.col("event_type") != "error", "ts", "event_id")
)
_query("q_latest_per_key", "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", bridge=False)(
    lambda spark, d: lookups.latest_per_key(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").drop("event_id")
)
_query("q_keyed_upsert", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events", bridge=False)(
    lambda spark, d: lookups.keyed_upsert(read(spark, d, "events").select("event_id", "value"), read(spark, d, "events").filter("event_id % 3 = 0").select("event_id", (F.col("value") + 1).alias("value")), ["event_id"])
)
_query("q_ttl_prune_cap", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 5 DAY FROM events) ORDER BY ts DESC, event_id LIMIT 300", bridge=False)(
    lambda spark, d: _pruned(read(spark, d, "events"))
)


def _pruned(e: DataFrame) -> DataFrame:
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))
    return lookups.expire(e.join(F.broadcast(now)), "ts", F.col("now"), 5 * 86400, 300, "event_id").select("event_id", "user_id")


_query("q_elo")(_m(sequence.elo))
_query("q_source_coverage", f"SELECT status, {R4.format('count(referee_id) / count(*)')} AS referee, {R4.format('count(home_goals) / count(*)')} AS scored FROM m GROUP BY status")(
    _m(lambda m: m.groupBy("status").agg(S.half_up(F.count("referee_id") / F.count(F.lit(1)), 4).alias("referee"), S.half_up(F.count("home_goals") / F.count(F.lit(1)), 4).alias("scored")))
)
ISSUES = "SELECT ts::DATE AS day, ts, event_type AS key, (user_id % 3 + 1)::BIGINT AS severity_rank, event_type || ' ' || (event_id % 4) AS message FROM events"
_query("q_digest_14d", f"WITH i AS ({ISSUES}) SELECT key, count(*) AS issues, max(severity_rank) AS severity, arg_min(message, (ts, message)) AS sample FROM i WHERE day >= (SELECT max(day) FROM i) - 13 GROUP BY key ORDER BY issues DESC, key LIMIT 8", bridge=False)(
    lambda spark, d: monitor.digest(read(spark, d, "events").select(F.to_date("ts").alias("day"), "ts", F.col("event_type").alias("key"), (F.col("user_id") % 3 + 1).alias("severity_rank"), F.concat_ws(" ", "event_type", (F.col("event_id") % 4).cast("string")).alias("message")))
)
_query("q_json_props", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events", bridge=False)(lambda spark, d: read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
_query("q_amsterdam_day", "SELECT CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Amsterdam' AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1", bridge=False)(lambda spark, d: read(spark, d, "events").groupBy(S.local_day(F.col("ts")).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")))
_query("q_live_minute_label", "WITH x AS (SELECT event_id, (user_id % 90)::INT + (event_id % 12)::INT AS m FROM events) SELECT event_id, CASE WHEN m >= 90 THEN '90+' ELSE m || '''' END AS label FROM x", bridge=False)(
    lambda spark, d: read(spark, d, "events").select("event_id", S.live_label(S.minute_value(F.concat((F.col("user_id") % 90).cast("string"), F.lit("'"))), F.col("event_id") % 12).alias("label"))
)
_query("q_normalize_name", f"SELECT doc_id, md5(trim(regexp_replace(translate(lower(coalesce(text, '')), '{S.ACCENTED}', '{S.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))) AS name_md5 FROM documents", bridge=False)(lambda spark, d: read(spark, d, "documents").select("doc_id", F.md5(S.normalize_name(F.col("text"))).alias("name_md5")))
_query("q_youth_filter", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in (*classify.WOMEN, *classify.YOUTH)), bridge=False)(lambda spark, d: read(spark, d, "documents").filter(classify.excluded(F.col("text"))).select("doc_id"))
_query("q_html_regex_counts", "SELECT page_id, len(regexp_extract_all(lower(html), 'href')) AS links, len(regexp_extract_all(lower(html), '<p>')) AS paragraphs FROM pages", bridge=False)(
    lambda spark, d: read(spark, d, "pages").select("page_id", F.regexp_count(F.lower("html"), F.lit("href")).alias("links"), F.regexp_count(F.lower("html"), F.lit("<p>")).alias("paragraphs"))
)
_query("q_value_flags", "SELECT count(*) FILTER (v) AS flagged, count(*) FILTER (NOT v) AS fair, count(*) FILTER (v IS NULL) AS unpriced FROM (SELECT CASE WHEN home_odd > 1.01 THEN floor((0.45 - 1 / home_odd) * 10000 + 0.5) / 10000 >= 0.04 END AS v FROM o)")(
    _o(lambda o: o.select(model.value_flag(F.lit(0.45), F.col("home_odd")).alias("v")).agg(F.count_if("v").alias("flagged"), F.count_if(~F.col("v")).alias("fair"), F.count_if(F.col("v").isNull()).alias("unpriced")))
)
_query("q_live_overlay", "SELECT match_id, CASE WHEN match_id % 5 = 0 THEN 'FT' ELSE status END AS status FROM m")(
    _m(lambda m: serving.overlaid(m.select("match_id", "status"), m.filter("match_id % 5 = 0").select("match_id", F.lit("FT").alias("status")), ["status"]))
)




