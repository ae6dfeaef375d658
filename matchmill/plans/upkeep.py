"""Queries of upkeep, joins on time, nested prices and score maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchmill.operators import asof, classify, model, named, resolve, serving, upkeep
from matchmill.plans.bridge import matches, read
from matchmill.plans.queries import GRID, RATES, _m, _query
from matchmill.plans.records import REVIEWS, R, X, reviewed
from matchmill.sources import nested

# --- caches and predictions as the store keeps them

#: Fixed values of this plan: the cache that an event's kind stands for.
KINDS = {"view": "teamStats", "click": "eventCache", "signup": "marketProfiles", "purchase": "h2hCache", "error": "weatherCache"}


def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """(cache, key, updated, event_id): the last event of each user and kind, as an entry of that kind's cache."""
    e = read(spark, d, "events")
    cache = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return last.select(cache.alias("cache"), F.col("user_id").cast("string").alias("key"), F.col("x.ts").cast("timestamp").alias("updated"), F.col("x.event_id").alias("event_id"))


def _now(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("now"))


_CASE = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in KINDS.items())
_HOURS = " ".join(f"WHEN '{c}' THEN {h}" for c, (h, _) in upkeep.CACHES.items())
_MOST = " ".join(f"WHEN '{c}' THEN {n}" for c, (_, n) in upkeep.CACHES.items())
_query(
    "q_compacted_caches",
    f"""SELECT cache, key, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cache ORDER BY updated DESC, key) AS rank FROM (
    SELECT CASE event_type {_CASE} END AS cache, CAST(user_id AS VARCHAR) AS key, max(ts) AS updated, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type)
  WHERE epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', updated)) <= (CASE cache {_HOURS} END) * 3600)
WHERE rank <= CASE cache {_MOST} END""",
    bridge=False,
)(lambda spark, d: upkeep.pruned_caches(cache_entries(spark, d).crossJoin(F.broadcast(_now(spark, d))), F.col("now")).select("cache", "key", "event_id"))  # one row


def scored(m: DataFrame) -> DataFrame:
    return model.score_grid(RATES(m), scores=True)


def _entries(df: DataFrame, *keep: str) -> DataFrame:
    """A row per entry of score_map, with its place in the map."""
    return df.select(*keep, F.posexplode(F.map_entries("score_map")).alias("place", "e")).select(*keep, "place", F.col("e.key").alias("score"), F.col("e.value").alias("probability"))


CELLS = f"{GRID}, e AS (SELECT ph, pa, h, a, h || '-' || a AS score, {X('p', 4)} AS probability FROM c WHERE p > 0.01)"
_query("q_score_map", f"{CELLS}, n AS (SELECT *, row_number() OVER (PARTITION BY ph, pa ORDER BY h, a) - 1 AS place FROM e) SELECT match_id, place::INT AS place, score, probability FROM m JOIN n ON ph = pred_home_goals AND pa = pred_away_goals")(
    _m(lambda m: _entries(scored(m), "match_id"))
)
LARGEST = f"{CELLS}, n AS (SELECT *, row_number() OVER (PARTITION BY ph, pa ORDER BY probability DESC, h, a) - 1 AS place FROM e)"
_query("q_top_scores", f"{LARGEST} SELECT match_id, place::INT AS place, score, probability FROM m JOIN n ON ph = pred_home_goals AND pa = pred_away_goals WHERE place < 6")(
    _m(lambda m: _entries(scored(m).withColumn("score_map", model.largest(F.col("score_map"), 6)), "match_id"))
)


def compacted(m: DataFrame, reference: str = "1998-03-03") -> DataFrame:
    """Predictions of the days around `reference` as the store keeps them."""
    day = F.lit(reference).cast("date")
    p = scored(m).select("match_id", "match_date", "score_map", F.struct(F.col("home_xg").alias("home_xg")).alias("features"), F.col("best_score").alias("analysis"), F.struct(F.lit(True).alias("active"), F.col("home_prob").alias("details")).alias("ensemble"))
    store = upkeep.compacted_store({"predictions": p}, day, F.lit(reference).cast("timestamp"))
    return store["predictions"]


_query(
    "q_compacted_predictions",
    f"""{LARGEST}, w AS (SELECT *, match_date BETWEEN DATE '1998-03-03' AND DATE '1998-03-04' AS fresh FROM m WHERE match_date BETWEEN DATE '1998-02-19' AND DATE '1998-03-07')
SELECT match_id, CASE WHEN fresh THEN b.best_score END AS analysis, CASE WHEN fresh THEN round(x.lh, 6) END AS home_xg, CASE WHEN fresh THEN round(b.w / (b.w + b.d + b.l), 6) END AS details,
       (SELECT string_agg(score || '=' || printf('%.4f', probability), ' ' ORDER BY place) FROM n WHERE n.ph = b.ph AND n.pa = b.pa AND place < 10) AS scores
FROM w JOIN b ON b.ph = pred_home_goals AND b.pa = pred_away_goals JOIN x ON x.ph = b.ph AND x.pa = b.pa""",
)(
    _m(lambda m: compacted(m).select(
        "match_id", "analysis", F.round("features.home_xg", 6).alias("home_xg"), F.round("ensemble.details", 6).alias("details"),
        F.array_join(F.transform(F.map_entries("score_map"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), " ").alias("scores"),
    ))
)

# --- reviews by day

_query(
    "q_reliability_by_days",
    f"WITH {REVIEWS} SELECT label, count(*) AS matches, {X('count(*) FILTER (outcome_hit) / count(*)')} AS hit_rate, {X('count(*) FILTER (exact_hit) / count(*)')} AS exact_rate, {X('sum(goal_error) / count(*)')} AS avg_goal_error FROM r GROUP BY label",
)(lambda spark, d: upkeep.rates(upkeep.day_sums(reviewed(spark, d, ()), "label"), "label"))

# --- joins on time

KICKOFF = "TIMESTAMP '2024-01-01' + INTERVAL (day(match_date) - 1) DAY + INTERVAL (match_id % 24) HOUR"


def kickoffs(m: DataFrame) -> DataFrame:
    """Matches with a kick-off in the month that the events cover, and the place that the events' users stand for."""
    at = F.timestamp_seconds(F.lit(1704067200) + (F.dayofmonth("match_date") - 1) * 86400 + F.col("match_id") % 24 * 3600)
    return m.select("match_id", at.alias("kickoff"), F.expr("home_team_id div 100").alias("place"), F.to_date(at).alias("day"))


def weather_at(spark: SparkSession, d: str) -> DataFrame:
    """Each match with the reading of its place and day that is nearest to its kick-off."""
    readings = read(spark, d, "events").select((F.col("user_id") % 25).alias("place"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("wind"))
    x = asof.nearest_reading(kickoffs(matches(spark, d, scores=False)), "kickoff", readings, "ts", ["place", "day"], 86400, tie="event_id")
    risk = F.when(F.col("reading").isNotNull(), classify.weather_risk(F.col("reading.wind"), F.lit(0.0)))
    return x.select("match_id", F.col("reading.event_id").alias("event_id"), F.round(F.col("reading.gap") * 1_000_000).cast("long").alias("gap_micros"), risk.alias("weather_risk"))


_query(
    "q_weather_at_kickoff",
    f"""WITH q AS (SELECT match_id, {KICKOFF} AS at, home_team_id // 100 AS place FROM m),
e AS (SELECT user_id % 25 AS place, ts, CAST(ts AS DATE) AS day, min(event_id) AS event_id, arg_min(value, event_id) AS wind FROM events GROUP BY 1, 2, 3),
b AS (SELECT q.match_id, epoch_us(e.ts) - epoch_us(q.at) AS gap, e.event_id, e.wind FROM q ASOF JOIN e ON e.place = q.place AND e.day = CAST(q.at AS DATE) AND e.ts <= q.at),
f AS (SELECT q.match_id, epoch_us(e.ts) - epoch_us(q.at) AS gap, e.event_id, e.wind FROM q ASOF JOIN e ON e.place = q.place AND e.day = CAST(q.at AS DATE) AND e.ts > q.at),
n AS (SELECT match_id, arg_min({{'gap': gap, 'id': event_id, 'wind': wind}}, (abs(gap), gap)) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM f) GROUP BY match_id)
SELECT q.match_id, x.id AS event_id, x.gap AS gap_micros, CASE WHEN x.wind >= 28 THEN 'high' WHEN x.wind >= 20 THEN 'medium' WHEN x.wind IS NOT NULL THEN 'low' END AS weather_risk
FROM q LEFT JOIN n ON n.match_id = q.match_id""",
)(weather_at)


def legs(m: DataFrame, within: int = 160) -> DataFrame:
    """(match_id, leg_id, leg_score, leg_gap): for each match to come or under way the last one of its two teams that is over,
    from the table of played matches, with the score as the present home side saw it."""
    rows = resolve.by_pair(m, "home_team_id", "home_goals", "away_goals")
    leg = F.struct(F.col("match_date").alias("day"), F.col("match_id").alias("leg_id"), F.col("home_team_id").alias("host"), "home_goals", "away_goals")
    x = resolve.with_last_leg(rows, leg).filter("asks").withColumn("leg_gap", F.datediff("match_date", "leg.day").cast("long")).filter(F.col("leg_gap") <= within)
    own = F.when(F.col("leg.host") == F.col("home_team_id"), F.concat_ws("-", "leg.home_goals", "leg.away_goals")).otherwise(F.concat_ws("-", "leg.away_goals", "leg.home_goals"))
    return x.select("match_id", "leg.leg_id", own.alias("leg_score"), "leg_gap")


_query(
    "q_previous_leg_played",
    """WITH p AS (SELECT *, least(home_team_id, away_team_id) AS a, greatest(home_team_id, away_team_id) AS b FROM m),
d AS (SELECT a, b, match_date, min(match_id) AS leg_id, arg_min({'host': home_team_id, 'h': home_goals, 'g': away_goals}, match_id) AS x FROM p WHERE status = 'FT' AND home_goals IS NOT NULL GROUP BY a, b, match_date)
SELECT o.match_id, d.leg_id, CASE WHEN x.host = o.home_team_id THEN x.h || '-' || x.g ELSE x.g || '-' || x.h END AS leg_score, o.match_date - d.match_date AS leg_gap
FROM p o ASOF JOIN d ON d.a = o.a AND d.b = o.b AND d.match_date <= o.match_date WHERE o.status <> 'FT' AND o.match_date - d.match_date <= 160""",
)(_m(legs))

# --- prices in nested documents


def _price_node(x: Column) -> Column:
    """A line of a match as a node of a feed."""
    n = x["l_linenumber"]
    one = lambda name, c, i: F.when(n % 3 == i, c).alias(name)
    home, draw, away = F.lit(1) + x["l_quantity"] / 10, F.lit(1) + (x["l_partkey"] % 50) / F.lit(10.0), F.lit(1) + (F.col("match_id") % 40) / F.lit(10.0)
    book = F.concat(F.lit("Book "), (x["l_suppkey"] % 8).cast("string"))
    return F.struct(
        F.when(n % 2 == 0, F.struct(book.alias("name"))).alias("bookmaker"), F.when(n % 2 == 1, book).alias("provider"),
        one("home", home, 0), one("homeOdds", home.cast("string"), 1), F.when(n % 3 == 2, F.struct(home.alias("value"))).alias("choice1"), one("drawOdds", draw, 0), one("draw", draw, 1), one("drawValue", draw, 2), away.alias("away"),
    )


def price_documents(spark: SparkSession, d: str) -> DataFrame:
    """(match_id, document): a match's lines as a feed would nest them, five levels deep, under differing names."""
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    per = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    groups = F.transform("lines", lambda x: F.struct(F.array(_price_node(x)).alias("choices")))
    return per.select("match_id", F.to_json(F.struct(F.struct(F.struct(groups.alias("groups")).alias("fullTime")).alias("markets"))).alias("document"))


_query(
    "q_nested_book_signals",
    f"""WITH l AS (SELECT l_orderkey AS match_id, 'Book ' || (l_suppkey % 8) AS bookmaker, 1 + l_quantity / 10 AS h, 1 + (l_partkey % 50) / 10.0::DOUBLE AS d, 1 + (l_orderkey % 40) / 10.0::DOUBLE AS a,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS n FROM lineitem),
f AS (SELECT * FROM l WHERE h > 1.01 AND d > 1.01 AND a > 1.01 QUALIFY row_number() OVER (PARTITION BY match_id, bookmaker ORDER BY n) = 1),
g AS (SELECT *, 1 / h + 1 / d + 1 / a AS s FROM f QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY n) <= 8),
p AS (SELECT match_id, bookmaker, {R('1 / h / s', 4)} AS h, {R('1 / d / s', 4)} AS d, {R('1 / a / s', 4)} AS a FROM g),
e AS (SELECT match_id, lower(bookmaker) AS book, bookmaker, {X('h - a')} AS diff, {X('greatest(h, d, a) * 0.9::DOUBLE')} AS strength, CASE WHEN h >= a AND h >= d THEN 'home' WHEN a >= d THEN 'away' ELSE 'neutral' END AS lean FROM p)
SELECT *, {X("avg((lean <> 'neutral')::INT) OVER (PARTITION BY match_id)")} AS agreement FROM e""",
    bridge=False,
)(lambda spark, d: nested.book_signals(nested.price_nodes(price_documents(spark, d), "document", "match_id")).withColumnRenamed("id", "match_id"))

# --- names in their order

_query(
    "q_names_in_order",
    """WITH w AS (SELECT DISTINCT source, regexp_replace(regexp_extract(coalesce(text, ''), '[^\x20\x09-\x0D]+'), '[^\\p{L}]', '', 'g') AS name FROM documents)
SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY icu_sort_key(name, 'und'), name)::INT AS place FROM w""",
    bridge=False,
)(lambda spark, d: named.placed(read(spark, d, "documents").select("source", F.regexp_replace(F.regexp_substr(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), r"[^\p{L}]", "").alias("name")).na.fill("", ["name"]).distinct(), "name", "source"))
_query(
    "q_live_by_league",
    "WITH g AS (SELECT league, count(*) AS n, array_to_string(list(match_id ORDER BY match_date, match_id), ' ') AS matches FROM m WHERE status = 'LIVE' GROUP BY league) SELECT *, row_number() OVER (ORDER BY icu_sort_key(league, 'und'))::INT AS place FROM g",
)(_m(lambda m: named.placed(named.groups(m.filter(serving.live()), "league", ["match_date"], "match_id").select("league", "n", F.array_join("items", " ").alias("matches")).withColumn("all", F.lit(0)), "league", "all").drop("all")))

# --- head-to-head from several sources


def head_to_head(spark: SparkSession, d: str, within: int = 160) -> DataFrame:
    """Matches to come or under way with their meetings: the feed's are those with four lines or more, the previous leg is
    that of `legs` on an earlier day, and the history has all that were played."""
    rows = resolve.by_pair(matches(spark, d, lines=True), "home_team_id", "away_team_id", "home_goals", "away_goals", "n_lines")
    one = resolve.meeting(*(F.col(c) for c in ("match_date", "home_team_id", "away_team_id", "home_goals", "away_goals")))
    x = resolve.with_last_leg(rows, one.withField("winner", F.lit(None).cast("long")))
    x = resolve.with_last(x, one, {"feed": (F.col("n_lines") >= 4, resolve.FEED), "history": (F.lit(True), resolve.HISTORY)})
    return resolve.resolved(x.withColumn("leg", F.when(F.datediff("match_date", "leg.day").between(1, within), F.col("leg"))))


_PAIRED = "least(home_team_id, away_team_id) AS a, greatest(home_team_id, away_team_id) AS b"
_LAST = """SELECT match_id, src, day, home, away, score, winner, id FROM (SELECT o.match_id, {1} AS src, p.day, p.home, p.away, p.score, p.winner, p.id, row_number() OVER (PARTITION BY o.match_id ORDER BY p.day DESC, p.id DESC) AS rn
  FROM ask o JOIN pl p ON p.a = o.a AND p.b = o.b AND p.day < o.match_date WHERE {2}) WHERE rn <= {0}"""
_query(
    "q_head_to_head",
    f"""WITH ask AS (SELECT match_id, match_date, home_team_id, away_team_id, {_PAIRED} FROM m WHERE status <> 'FT'),
nl AS (SELECT l_orderkey AS id, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
pl AS (SELECT match_id AS id, match_date AS day, home_team_id AS home, away_team_id AS away, home_goals || '-' || away_goals AS score, CASE WHEN home_goals > away_goals THEN home_team_id WHEN home_goals < away_goals THEN away_team_id END AS winner, n_lines, {_PAIRED}
  FROM m LEFT JOIN nl ON nl.id = match_id WHERE status = 'FT' AND home_goals IS NOT NULL),
fe AS ({_LAST.format(resolve.FEED, 0, 'p.n_lines >= 4')}),
hi AS ({_LAST.format(resolve.HISTORY, 2, 'true')}),
ld AS (SELECT o.match_id, max(p.day) AS day FROM ask o JOIN pl p ON p.a = o.a AND p.b = o.b AND p.day <= o.match_date GROUP BY o.match_id),
lg AS (SELECT o.match_id, 1 AS src, p.day, p.home, p.away, p.score, NULL::BIGINT AS winner, p.id FROM ask o JOIN ld ON ld.match_id = o.match_id JOIN pl p ON p.a = o.a AND p.b = o.b AND p.day = ld.day
  WHERE o.match_date - p.day BETWEEN 1 AND 160 QUALIFY row_number() OVER (PARTITION BY o.match_id ORDER BY p.id) = 1),
ft AS (SELECT match_id, count(*) AS n, string_agg(day::VARCHAR || ',' || score, ';' ORDER BY day, id) AS text FROM fe GROUP BY match_id),
la AS (SELECT lg.* FROM lg LEFT JOIN ft ON ft.match_id = lg.match_id WHERE ft.n IS NULL OR NOT contains(ft.text, lg.score)),
oe AS (SELECT * FROM fe UNION ALL SELECT * FROM la),
st AS (SELECT k.match_id, k.home_team_id, k.away_team_id, coalesce(ft.n, 0) AS feed, (SELECT count(*) FROM oe WHERE oe.match_id = k.match_id) AS n_one, (SELECT count(*) FROM hi WHERE hi.match_id = k.match_id) AS n_hist,
  EXISTS (SELECT 1 FROM lg WHERE lg.match_id = k.match_id) AS has_leg FROM ask k LEFT JOIN ft ON ft.match_id = k.match_id),
al AS (SELECT e.*, st.n_one < 3 AND st.n_hist > 0 AS late FROM oe e JOIN st ON st.match_id = e.match_id UNION ALL SELECT h.*, true FROM hi h JOIN st ON st.match_id = h.match_id WHERE st.n_one < 3 AND st.n_hist > 0),
di AS (SELECT * FROM al QUALIFY NOT late OR row_number() OVER (PARTITION BY match_id, day, home, away, score ORDER BY src, day, id) = 1),
po AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN late THEN day END, src, day, id) AS pos, count(*) OVER (PARTITION BY match_id) AS n FROM di),
re AS (SELECT * FROM po WHERE NOT late OR pos > n - 8),
sc AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pos DESC) AS back, count(*) OVER (PARTITION BY match_id) AS total FROM re),
ba AS (SELECT sc.match_id, sum((6 + least(total, 5) - back) * (CASE WHEN winner = home_team_id THEN 1 WHEN winner = away_team_id THEN -1 ELSE 0 END)) FILTER (back <= 5) AS s, sum(6 + least(total, 5) - back) FILTER (back <= 5) AS w,
  count(*) AS played, bool_or(late) AS late, count(*) FILTER ((late OR src = 0) AND winner = home_team_id) AS hw, count(*) FILTER ((late OR src = 0) AND winner IS NULL) AS dr, count(*) FILTER ((late OR src = 0) AND winner = away_team_id) AS aw,
  string_agg(score, ' ' ORDER BY pos) AS scores FROM sc JOIN st ON st.match_id = sc.match_id GROUP BY sc.match_id)
SELECT st.match_id, coalesce(played, 0)::INT AS played, coalesce(hw, 0)::INT AS home_wins, coalesce(dr, 0)::INT AS draws, coalesce(aw, 0)::INT AS away_wins, (feed + CASE WHEN late THEN n_hist ELSE 0 END)::INT AS same_competition,
  coalesce({R('s / w')}, 0)::DOUBLE AS balance, coalesce(scores, '') AS scores,
  CASE WHEN late THEN CASE WHEN n_one > 0 THEN 'merged-historical-competition' ELSE 'historical-competition' END WHEN feed > 0 THEN 'loaded' WHEN has_leg THEN 'fallback' ELSE 'empty' END AS status
FROM st LEFT JOIN ba ON ba.match_id = st.match_id""",
)(
    lambda spark, d: head_to_head(spark, d).select(
        "match_id", "played", "home_wins", "draws", "away_wins", "same_competition", "balance", F.array_join(F.transform("results", lambda r: r["score"]), " ").alias("scores"), F.col("status_h2h").alias("status"),
    )
)
