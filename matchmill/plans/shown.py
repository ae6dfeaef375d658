"""Registered queries of what matches, days and histories show, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmill.operators import features, form, market, monitor, shown
from matchmill.plans.bridge import INPUT_SQL, inputs, matches, read, team_rows
from matchmill.plans.queries import _m, _query
from matchmill.plans.records import RECORD_SQL, R, X, line_facts, meetings_before, records

# --- fields and places

_FACTS = "sum((l_discount >= 0.09)::INT)::BIGINT AS home_injuries, count(*) AS n_lines"
#: Fields of this plan over a match and its lines; empty, zero and null ones are among them.
SHOWN = {
    "home_team_name": "CASE WHEN match_id % 7 > 0 THEN concat('T', home_team_id) ELSE '' END", "away_team_name": "CASE WHEN match_id % 5 > 0 THEN concat('T', away_team_id) END",
    "status": "CASE WHEN match_id % 11 > 0 THEN status ELSE '' END", "score": "CASE WHEN status = 'FT' THEN home_goals || '-' || away_goals ELSE '' END",
    "minute_value": "CASE WHEN status = 'LIVE' THEN match_id % 4 END", "home_elo": "match_id % 3 * 700", "importance": "CASE WHEN match_id % 2 = 0 THEN match_id % 4 END",
    "home_injuries": "home_injuries", "lineup": "n_lines >= 4",
}


def _fields(spark: SparkSession, d: str) -> DataFrame:
    k = matches(spark, d).join(line_facts(spark, d).select("match_id", "home_injuries", "n_lines"), "match_id", "left")
    return shown.match_fields(k.select("match_id", "league", *(F.expr(e).alias(n) for n, e in SHOWN.items())))


_query(
    "q_match_fields",
    f"""WITH f AS (SELECT l_orderkey AS match_id, {_FACTS} FROM lineitem GROUP BY 1),
x AS (SELECT match_id, league, {", ".join(f"{e} AS {n}" for n, e in SHOWN.items())} FROM m LEFT JOIN f USING (match_id))
SELECT match_id, league, coalesce(nullif(home_team_name, ''), 'Home') AS home_team_name, coalesce(nullif(away_team_name, ''), 'Away') AS away_team_name, coalesce(nullif(status, ''), 'NS') AS status,
  minute_value, importance, nullif(score, '') AS score, nullif(home_elo, 0) AS home_elo, nullif(home_injuries, 0) AS home_injuries, CASE WHEN lineup THEN TRUE END AS lineup FROM x""",
)(_fields)


def _placed(m: DataFrame) -> DataFrame:
    """Places in the league's table or, for European teams, in that of the whole region, which comes last."""
    region = m.filter("region = 'EUROPE'").withColumn("league", F.col("region"))
    tables = [form.standings(team_rows(x)).select("team_id", F.lit(i).alias("ord"), "position") for i, x in enumerate((m.filter("match_date < '1997-01-01'"), region))]
    own = m.select("match_id", "home_team_id", "away_team_id", (F.col("match_id") % 5).alias("home_position"), (F.col("match_id") % 3).alias("away_position"))
    return shown.with_places(own, tables[0].unionByName(tables[1])).select("match_id", "home_position", "away_position")


def _table_sql(league: str, rows: str) -> str:
    return f"""SELECT team_id, row_number() OVER (PARTITION BY league ORDER BY points DESC, gd DESC, gf DESC, team_id) AS position
  FROM (SELECT {league} AS league, team_id, count(*) FILTER (gf > ga) * 3 + count(*) FILTER (gf = ga) AS points, sum(gf) - sum(ga) AS gd, sum(gf) AS gf
    FROM t WHERE status = 'FT' AND gf IS NOT NULL AND {rows} GROUP BY 1, team_id)"""


_query(
    "q_match_places",
    f"""WITH a AS ({_table_sql("league", "match_date < DATE '1997-01-01'")}), b AS ({_table_sql("'EUROPE'", "match_id IN (SELECT match_id FROM m WHERE region = 'EUROPE')")}),
p AS (SELECT team_id, coalesce(b.position, a.position) AS position FROM a FULL JOIN b USING (team_id))
SELECT match_id, coalesce(h.position, nullif(match_id % 5, 0)) AS home_position, coalesce(w.position, nullif(match_id % 3, 0)) AS away_position
FROM m LEFT JOIN p h ON h.team_id = home_team_id LEFT JOIN p w ON w.team_id = away_team_id""",
)(_m(_placed))

# --- knock-outs

KNOCKOUT = {"league_type": "CASE WHEN match_id % 23 < 2 THEN 'cup' END", "context": "CASE WHEN match_id % 29 = 5 THEN 'topstrijd · play-off druk' END", "round_label": "CASE match_id % 23 WHEN 0 THEN 'Quarterfinals' WHEN 1 THEN '' END"}


def _knockouts(m: DataFrame) -> DataFrame:
    k = m.join(meetings_before(m).select("match_id", "leg_gap"), "match_id")
    k = k.withColumns({"active": F.col("leg_gap") <= 20, **{n: F.expr(e) for n, e in KNOCKOUT.items()}})
    return shown.knockouts(k).select("match_id", "league", "round_key", "status", "place")


_query(
    "q_knockouts",
    f"""WITH k AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in KNOCKOUT.items())},
  match_date - lag(match_date) OVER (PARTITION BY least(home_team_id, away_team_id), greatest(home_team_id, away_team_id) ORDER BY match_date, match_id) AS leg_gap FROM m)
SELECT match_id, league, coalesce(nullif(round_label, ''), 'Knock-out') AS round_key, CASE WHEN status IN ('LIVE', 'FT') THEN status ELSE 'NS' END AS status, row_number() OVER (PARTITION BY match_date ORDER BY match_id)::INT AS place
FROM k WHERE league_type = 'cup' OR leg_gap <= 20 OR contains(context, 'play-off')""",
)(_m(_knockouts))

# --- referees, venues, absences


def _referee(spark: SparkSession, d: str) -> DataFrame:
    """The record of referees with an even number; the others are estimated."""
    m = matches(spark, d)
    record = market.referees(m.join(line_facts(spark, d), "match_id", "left"), read(spark, d, "supplier")).filter("referee_id % 2 = 0")
    record = record.select("referee_id", F.col("avg_cards").alias("known_cards"), F.col("penalty_rate").alias("known_penalties"), F.col("games").alias("known_games"))
    x = inputs(m).withColumnsRenamed({"home_split_over25": "home_over25_rate", "away_split_over25": "away_over25_rate"})
    x = x.withColumn("market_over_diff", F.col("home_market_over") - F.col("away_market_over"))
    x = x.join(m.select("match_id", "referee_id", F.when(F.col("match_id") % 13 > 0, F.concat(F.lit("R"), "referee_id")).alias("referee")), "match_id")
    return shown.referee_profile(x.join(record, "referee_id", "left")).select("match_id", "cards_trend", "penalty_rate", "strictness", "source", "known_games")


_CARD = "count(*) FILTER (l_returnflag = 'N'"
_EITHER = "CASE WHEN there THEN {} END AS {}"
_query(
    "q_referee_edges",
    f"""WITH f AS (SELECT l_orderkey AS match_id, {_CARD} AND l_discount < 0.08) + 2 * {_CARD} AND l_discount >= 0.08) AS cards, {_CARD} AND l_tax >= 0.08) AS penalties FROM lineitem GROUP BY 1),
g AS (SELECT referee_id, count(*) AS games, {R("sum(f.cards) / count(*)")} AS avg_cards, {X("sum(penalties) / count(penalties)")} AS avg_penalties FROM m JOIN f USING (match_id) WHERE referee_id % 2 = 0 GROUP BY 1),
{INPUT_SQL},
e AS (SELECT match_id, match_id % 13 > 0 AND m.referee_id IS NOT NULL AS there, g.games,
    coalesce(avg_cards, {X("(home_yellow_rate + home_red_rate * 1.8::DOUBLE + (away_yellow_rate + away_red_rate * 1.8::DOUBLE)) / 2")}) AS cards_trend,
    coalesce(avg_penalties, {X("coalesce(nullif(home_split_over25, 0), 0.45)::DOUBLE * 0.12::DOUBLE + coalesce(nullif(away_split_over25, 0), 0.45)::DOUBLE * 0.12::DOUBLE + greatest(0, home_market_over - away_market_over) * 0.04::DOUBLE")}) AS penalty_rate
  FROM x JOIN m USING (match_id) LEFT JOIN g ON g.referee_id = m.referee_id)
SELECT match_id, {_EITHER.format("cards_trend", "cards_trend")}, {_EITHER.format("penalty_rate", "penalty_rate")},
  {_EITHER.format("CASE WHEN cards_trend >= 4.8 THEN 'streng' WHEN cards_trend >= 3.2 THEN 'gemiddeld' ELSE 'laat doorspelen' END", "strictness")},
  {_EITHER.format("CASE WHEN games IS NULL THEN 'estimate' ELSE 'history' END", "source")}, {_EITHER.format("coalesce(games, 0)", "known_games")} FROM e""",
)(_referee)


def _venue(m: DataFrame) -> DataFrame:
    x = inputs(m)
    x = x.withColumn("away_travel_penalty", features.travel(F.col("home_country"), F.col("away_country"), F.col("league_type")))
    return shown.venue_edges(x).select("match_id", "venue_edge", "travel_penalty", "travel_burden")


_SPLIT = "(CASE WHEN {0}_split_games > 0 THEN coalesce(nullif({0}_split_{1}, 0), 1.35) ELSE 1.35 END)::DOUBLE"
_query(
    "q_venue_edges",
    f"""WITH {INPUT_SQL}, y AS (SELECT *, CASE WHEN coalesce(home_country, '') IN ('', coalesce(away_country, '')) OR coalesce(away_country, '') = '' THEN 0 WHEN league_type = 'cup' THEN 0.22 ELSE 0.1 END::DOUBLE AS travel_penalty FROM x)
SELECT match_id, {X(f"{_SPLIT.format('home', 'scored')} - {_SPLIT.format('away', 'conceded')} + ({_SPLIT.format('away', 'scored')} - {_SPLIT.format('home', 'conceded')})")} AS venue_edge,
  travel_penalty, CASE WHEN travel_penalty <= 0 THEN 'none' WHEN league_type = 'cup' THEN 'cup trip' ELSE 'trip' END AS travel_burden FROM y""",
)(_m(_venue))


def _absences(spark: SparkSession, d: str) -> DataFrame:
    """Odd lines of an order as one source's absences, even ones as another's; an order has few lines."""
    line = read(spark, d, "lineitem").withColumns({"name": F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string")), "odd": F.col("l_linenumber") % 2 == 1})

    def source(own, name: str):
        n = lambda c: F.count_if(own & F.expr(c))
        names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(own & F.expr(c), F.struct("l_linenumber", "name")))), lambda x: x["name"])
        one = F.struct(
            n("l_discount >= 0.05").alias("injured"), n("l_tax >= 0.06").alias("suspended"), n("l_quantity < 10").alias("doubts"), F.round(F.sum(F.when(own, F.col("l_quantity").cast("double"))), 2).alias("rating"),
            names("TRUE").alias("missing"), names("l_tax >= 0.06").alias("banned"), F.lit(name).alias("source"),
        )
        return F.when(F.count_if(own) > 0, one)

    both = line.groupBy(F.col("l_orderkey").alias("match_id")).agg(source(F.col("odd"), "feed").alias("base"), source(~F.col("odd"), "").alias("extra"))
    out = both.select("match_id", shown.merged_absences(F.col("base"), F.col("extra")).alias("a")).filter("a IS NOT NULL")
    return out.select("match_id", "a.injured", "a.suspended", "a.doubts", "a.rating", F.array_join("a.missing", " ").alias("missing"), F.array_join("a.banned", " ").alias("banned"), "a.source")


def _names_sql(column: str, where: str, n: int) -> str:
    """Names by their first place, odd lines before even ones; without an even line (nothing to merge) all as they are."""
    return f"""SELECT match_id, string_agg(name, ' ' ORDER BY pos) AS {column} FROM (
  SELECT match_id, name, pos, row_number() OVER (PARTITION BY match_id ORDER BY pos) AS place FROM (
    SELECT match_id, name, min(seq) AS pos FROM l WHERE {where} GROUP BY match_id, name, CASE WHEN evens = 0 THEN seq END))
  WHERE place <= {n} OR match_id IN (SELECT match_id FROM l WHERE evens = 0) GROUP BY match_id"""


_MOST = "greatest(count(*) FILTER (odd AND {0}), count(*) FILTER (NOT odd AND {0})) AS {1}"
_query(
    "q_absences",
    f"""WITH l AS (SELECT l_orderkey AS match_id, l_linenumber AS line, 'P' || (l_partkey % 5) AS name, l_linenumber % 2 = 1 AS odd, l_discount, l_tax, l_quantity, count(*) FILTER (l_linenumber % 2 = 0) OVER (PARTITION BY l_orderkey) AS evens,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2 DESC, l_linenumber, l_partkey % 5) AS seq FROM lineitem),
a AS ({_names_sql("missing", "TRUE", 5)}), b AS ({_names_sql("banned", "l_tax >= 0.06", 4)}),
c AS (SELECT match_id, {_MOST.format("l_discount >= 0.05", "injured")}, {_MOST.format("l_tax >= 0.06", "suspended")}, {_MOST.format("l_quantity < 10", "doubts")}, coalesce(round(sum(l_quantity::DOUBLE) FILTER (odd), 2), 0) AS rating,
  CASE WHEN count(*) FILTER (odd) > 0 THEN 'feed' ELSE 'players' END AS source FROM l GROUP BY match_id)
SELECT c.*, coalesce(missing, '') AS missing, coalesce(banned, '') AS banned FROM c LEFT JOIN a ON a.match_id = c.match_id LEFT JOIN b ON b.match_id = c.match_id""",
    bridge=False,
)(_absences)

# --- signals

SIGNALLED = {
    "context": "CASE WHEN match_id % 4 = 0 THEN 'topstrijd' ELSE '' END", "active": "two_legs", "aggregate_score": "CASE WHEN match_id % 3 > 0 THEN '2-1' END", "h2h_draws": "h2h_results - h2h_home_wins - h2h_away_wins",
    "league_reliability": "CASE WHEN match_id % 5 > 0 THEN match_id % 9 / 8 END", "phase_reliability": "CASE WHEN match_id % 3 > 0 THEN match_id % 7 / 8 END", "strictness": "CASE WHEN match_id % 2 = 0 THEN 'streng' END",
}


def _signals(spark: SparkSession, d: str) -> DataFrame:
    k = records(spark, d, ("lines", "meetings", "ratings", "rest")).withColumns({n: F.expr(e) for n, e in SIGNALLED.items()})
    return k.select("match_id", F.array_join(shown.key_signals(k), "; ").alias("signals"))


_PER = "floor({} * 100 + 0.5)::BIGINT"
_query(
    "q_key_signals",
    f"""WITH {RECORD_SQL}, s AS (SELECT * EXCLUDE (h2h_results), h2h_results, {", ".join(f"{e} AS {n}" for n, e in SIGNALLED.items())} FROM k)
SELECT match_id, array_to_string(list_filter([nullif(context, ''), CASE WHEN active AND aggregate_score <> '' THEN 'aggregate ' || aggregate_score END, CASE WHEN elo_diff <> 0 THEN 'rating ' || elo_diff::BIGINT END,
    CASE WHEN abs(rest_diff) >= 1 THEN 'rest ' || CASE WHEN rest_diff > 0 THEN '+' ELSE '' END || rest_diff::BIGINT || 'd' END, CASE WHEN h2h_results >= 3 THEN 'meetings ' || h2h_home_wins || '-' || h2h_draws || '-' || h2h_away_wins END,
    CASE WHEN lineups_confirmed THEN 'line-ups' END, 'league ' || {_PER.format("league_reliability")} || '%', 'phase ' || {_PER.format("phase_reliability")} || '%', 'referee ' || strictness], lambda x: x IS NOT NULL)[1:5], '; ') AS signals FROM s""",
)(_signals)

# --- history

PLAYED = {
    "prediction": "concat(' ', pred_home_goals, '-', pred_away_goals)", "actual_score": "concat(home_goals, '-', away_goals)", "league": "CASE WHEN match_id % 17 > 0 THEN league ELSE '' END",
    "home_team": "concat('T', home_team_id)", "away_team": "concat('T', away_team_id)", "predicted_outcome": "CASE WHEN match_id % 9 = 0 THEN 'Thuis' END", "actual_outcome": "CASE WHEN match_id % 4 = 0 THEN '' END",
    "winner_correct": "CASE WHEN match_id % 6 = 0 THEN match_id % 12 = 0 END",
}


def _played(m: DataFrame) -> DataFrame:
    done = m.filter("status = 'FT' AND home_goals IS NOT NULL")
    return shown.hydrated(done.select("match_id", "match_date", *(F.expr(e).alias(n) for n, e in PLAYED.items())))


_SIDE = "CASE WHEN {0} > {1} THEN 'Thuis' WHEN {0} < {1} THEN 'Uit' ELSE 'Gelijk' END"
PLAYED_SQL = f"""h0 AS (SELECT match_id, match_date, {", ".join(f"{e} AS {n}" for n, e in PLAYED.items())}, {_SIDE.format("pred_home_goals", "pred_away_goals")} AS p, {_SIDE.format("home_goals", "away_goals")} AS a
  FROM m WHERE status = 'FT' AND home_goals IS NOT NULL),
h AS (SELECT * REPLACE (coalesce(predicted_outcome, p) AS predicted_outcome, a AS actual_outcome, coalesce(winner_correct, coalesce(predicted_outcome, p) = a) AS winner_correct), trim(prediction) = actual_score AS was_correct FROM h0)"""
_query("q_history_hydrated", f"WITH {PLAYED_SQL} SELECT match_id, predicted_outcome, actual_outcome, winner_correct, was_correct FROM h")(
    _m(lambda m: _played(m).select("match_id", "predicted_outcome", "actual_outcome", "winner_correct", "was_correct"))
)
MODES = {"alle": "TRUE", "score": "was_correct", "uitkomst": "winner_correct", "fout": "NOT was_correct AND NOT winner_correct"}
_query("q_history_modes", f"WITH {PLAYED_SQL} SELECT league, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in MODES.items())}, count(*) FILTER (contains(lower(home_team || ' ' || away_team || ' ' || league), 't10')) AS found FROM h GROUP BY league")(
    _m(lambda m: _played(m).groupBy("league").agg(*(F.count_if(shown.kept_history(n)).alias(n) for n in MODES), F.count_if(shown.kept_history(search="T10")).alias("found")))
)
_PERCENT = "floor(count(*) FILTER ({}) / count(*) * 100 + 0.5)::BIGINT AS {}"
_query(
    "q_history_page_by_league",
    f"""WITH {PLAYED_SQL}, n AS (SELECT * REPLACE (coalesce(nullif(league, ''), 'Onbekend') AS league) FROM h),
s AS (SELECT league, {_PERCENT.format("was_correct", "e")}, {_PERCENT.format("winner_correct", "o")} FROM n WHERE league <> 'Onbekend' GROUP BY league),
p AS (SELECT *, row_number() OVER (ORDER BY match_date DESC, match_id) AS pos FROM (SELECT * FROM n WHERE NOT was_correct AND NOT winner_correct ORDER BY match_date DESC, match_id LIMIT 80 OFFSET 80)),
f AS (SELECT p.*, coalesce(e, 0) AS exact_percent, coalesce(o, 0) AS outcome_percent, min(pos) OVER (PARTITION BY p.league) AS first FROM p LEFT JOIN s ON s.league = p.league)
SELECT match_id, league, pos::INT AS at, exact_percent, outcome_percent, dense_rank() OVER (ORDER BY exact_percent DESC, outcome_percent DESC, first)::INT AS league_place FROM f""",
)(_m(lambda m: shown.page_by_league(_played(m), shown.kept_history("fout"), 2).select("match_id", "league", "at", "exact_percent", "outcome_percent", "league_place")))

# --- a day's proposals

#: Fixed values of this plan: what to look at for a kind of event, and why.
ADVICE = {"error": (("feed", "store"), "The feed fails."), "click": (("cards", "feed"), "Cards lack what they link to.")}
OTHER = (("store",), "The store needs a look.")


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("user_id") % 3 + 1).cast("int"))
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_id").alias("ord"), F.col("event_type").alias("key"), F.concat_ws(" ", "event_type", (F.col("event_id") % 4).cast("string")).alias("message"), severity.alias("severity"))
    out = monitor.proposals(e, ADVICE, OTHER)
    return out.select(F.col("day").cast("string").alias("day"), "priority", "key", "message", "severity", "why", F.array_join("places", " ").alias("places"), "places_of_day")


_ON = lambda i: " ".join(f"WHEN '{k}' THEN '{v[1] if i else ' '.join(v[0])}'" for k, v in ADVICE.items())
_query(
    "q_review_proposals",
    f"""WITH e AS (SELECT ts::DATE AS day, event_id, event_type AS key, event_type || ' ' || (event_id % 4) AS message, user_id % 3 AS s FROM events),
f AS (SELECT day, key, message, min(event_id) AS ord, arg_min(s, event_id) AS s FROM e GROUP BY 1, 2, 3),
p AS (SELECT *, CASE key {_ON(0)} ELSE 'store' END AS places FROM f),
n AS (SELECT day, count(DISTINCT place) AS places_of_day FROM (SELECT day, unnest(string_split(places, ' ')) AS place FROM p) GROUP BY day)
SELECT p.day::VARCHAR AS day, row_number() OVER (PARTITION BY p.day ORDER BY s DESC, ord)::INT AS priority, key, message, CASE s WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
  CASE key {_ON(1)} ELSE '{OTHER[1]}' END AS why, places, places_of_day FROM p JOIN n ON n.day = p.day""",
    bridge=False,
)(_proposals)
