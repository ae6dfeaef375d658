"""Match records: each match with what the other tables say of both teams, its reviews, and what is learned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchmill.functions.semantics import half_up, to_fixed
from matchmill.operators import classify, evaluate, form, market
from matchmill.operators.before import running_before
from matchmill.plans.bridge import matches, odds, read, team_rows

#: Fixed values of this plan: labels of cup rounds by the number of a match.
ROUNDS = {0: "Quarterfinals", 1: "Semifinal", 2: "Qualification round 1", 3: "Round of 16"}


def line_facts(spark: SparkSession, d: str) -> DataFrame:
    """Per match the lines that stand for line-ups, absences, cards by side and penalties, in one pre-aggregated pass."""
    n = lambda c: F.count_if(F.expr(c))
    card = "l_returnflag = 'N' AND "
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), n("l_discount >= 0.09").alias("home_injuries"), n("l_tax >= 0.07").alias("away_injuries"),
        n(card + "l_linenumber % 2 = 1 AND l_discount < 0.08").alias("home_yellow"), n(card + "l_linenumber % 2 = 1 AND l_discount >= 0.08").alias("home_red"),
        n(card + "l_linenumber % 2 = 0 AND l_discount < 0.08").alias("away_yellow"), n(card + "l_linenumber % 2 = 0 AND l_discount >= 0.08").alias("away_red"),
        n(card + "l_tax >= 0.08").alias("penalties"),
    )


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(team_id, elo): a snapshot of club ratings, from the balances of a team's customers in whole cents."""
    c = read(spark, d, "customer").select((F.col("c_nationkey").cast("long") * 100 + F.col("c_custkey") % 20).alias("team_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return c.groupBy("team_id").agg(F.floor(F.sum("cents") / F.count(F.lit(1)) / 5000 + 1500.5).cast("double").alias("elo"))


def weather(spark: SparkSession, d: str) -> DataFrame:
    """(day, wind, rain, weather_risk) by day of the month, from the events."""
    e = read(spark, d, "events").groupBy(F.dayofmonth("ts").alias("day")).agg((F.sum(F.floor("value").cast("long")) % 40).cast("double").alias("wind"), (F.count_if(F.col("event_type") == "error") * 100 / F.count(F.lit(1))).alias("rain"))
    return e.withColumn("weather_risk", classify.weather_risk(F.col("wind"), F.col("rain")))


def meetings_before(m: DataFrame) -> DataFrame:
    """(match_id, h2h_results, wins_a, wins_b, recent, leg_gap): finished meetings of the pair before each match, their
    results among the last eight as the smaller team id saw them, and the days since the last one."""
    pair = [F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")]
    before = Window.partitionBy(*pair).orderBy("match_date", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*pair).orderBy("match_date", "match_id")
    done = (F.col("status") == "FT") & F.col("home_goals").isNotNull()
    diff = F.col("home_goals") - F.col("away_goals")
    of_a = F.when(F.col("home_team_id") == pair[0], diff).otherwise(-diff)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(before), F.lit(0)).cast("long")
    last = Window.partitionBy(*pair).orderBy("match_date", "match_id").rowsBetween(-8, -1)
    recent = F.collect_list(F.when(done, F.signum(of_a).cast("int"))).over(last)
    return m.select(
        "match_id", recent.alias("recent"), count(done).alias("h2h_results"), count(done & (of_a > 0)).alias("wins_a"), count(done & (of_a < 0)).alias("wins_b"), F.datediff("match_date", F.lag("match_date").over(order)).alias("leg_gap"),
    )


def both_sides(m: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
    """`m` with `columns` of a table with one row per team, for its home and its away team."""
    for side in ("home", "away"):
        m = m.join(table.select(F.col(key).alias(f"{side}_team_id"), *(F.col(c).alias(f"{side}_{c}") for c in columns)), f"{side}_team_id", "left")
    return m


def prices_before(m: DataFrame, prices: DataFrame, *books: bool) -> DataFrame:
    """(team_id, match_date, and market or, per book, books): each team's price record at home and away before the day, from
    match_prices()."""
    per = m.select("match_id", "match_date", "home_team_id", "away_team_id").join(prices, "match_id", "left")
    measures = lambda s: {n: c for b in books for n, c in market.side_measures(s, b).items()}
    side = lambda s: per.select(F.col(f"{s}_team_id").alias("team_id"), "match_date", *(c.alias(n) for n, c in measures(s).items()))
    state = running_before(side("home").unionByName(side("away")), ["team_id"], "match_date", {n: F.col(n) for n in measures("home")})
    return state.select("team_id", "match_date", *(F.struct(*market.side_measures("home", b)).alias("books" if b else "market") for b in books))


#: What records() can join.
PARTS = ("lines", "meetings", "weather", "ratings", "table", "prices", "rest")


def records(spark: SparkSession, d: str, parts: tuple[str, ...] = PARTS, m: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """Matches with ratings, rest, line-ups, absences, weather, meetings, places, market records and the prediction that
    was stored for them. Every look-up is a keyed join against one row per team, match or day; only the named parts are
    joined, as the optimizer can't tell that a left join on such keys keeps the rows, so doesn't drop it. What is joined by the
    match comes first, so rows move once for it. `m` are matches with line_facts() and `prices` those of prices_before(), where
    they are written already."""
    given, m = m is not None, matches(spark, d) if m is None else m
    k, sides = m, ("home", "away")
    if "lines" in parts:
        k = (k if given else k.join(line_facts(spark, d), "match_id", "left")).withColumn("lineups_confirmed", F.coalesce(F.col("n_lines") >= 4, F.lit(False)))
    if "meetings" in parts:
        at_home = F.col("home_team_id") == F.least("home_team_id", "away_team_id")
        wins = {f"h2h_{s}_wins": F.when(at_home, F.col(f"wins_{x}")).otherwise(F.col(f"wins_{y}")) for s, x, y in (("home", "a", "b"), ("away", "b", "a"))}
        k = k.join(meetings_before(m), "match_id").withColumns({**wins, "two_legs": F.coalesce(F.col("leg_gap") <= 20, F.lit(False))})
    if "rest" in parts:
        rest = form.rest_days(team_rows(m), "match_date", "side")
        k = k.join(rest.groupBy("match_id").agg(*(F.max(F.when(F.col("side") == s, F.col("rest_days"))).alias(f"{s}_rest") for s in sides)), "match_id", "left")
        k = k.withColumn("rest_diff", F.coalesce(F.col("home_rest") - F.col("away_rest"), F.lit(0.0)))
    if "weather" in parts:
        k = k.join(weather(spark, d).withColumnRenamed("day", "of"), F.dayofmonth("match_date") == F.col("of"), "left")
    if "ratings" in parts:
        k = both_sides(k, ratings(spark, d), "team_id", "elo").withColumn("elo_diff", F.col("home_elo") - F.col("away_elo"))
    if "table" in parts:
        table = form.standings(team_rows(m)).withColumn("teams", F.count(F.lit(1)).over(Window.partitionBy("league")))
        k = both_sides(k, table, "team_id", "position", "teams")
        k = k.withColumn("importance", form.match_importance(F.col("home_position"), F.col("away_position"), F.col("home_teams")))
    if "prices" in parts:
        prices = prices_before(m, market.match_prices(odds(spark, d, m)), False) if prices is None else prices
        for side in sides:
            k = k.join(prices.select(F.col("team_id").alias(f"{side}_team_id"), "match_date", F.col("market").alias(f"{side}_market")), [f"{side}_team_id", "match_date"], "left")
            actual, implied, over, games = market.side_record(f"{side}_market.", side)
            k = k.withColumns({f"{side}_market_actual": actual, f"{side}_market_implied": implied, f"{side}_market_over": over, f"{side}_market_games": games})
        k = k.withColumn("market_over_diff", half_up(F.coalesce("home_market_over", F.lit(0.0)) - F.coalesce("away_market_over", F.lit(0.0)), 2))
    weights = [F.lit(1) + F.col("pred_home_goals") * 2 + F.col("match_id") % 5, F.lit(3) + F.col("match_id") % 3, F.lit(1) + F.col("pred_away_goals") * 2 + F.col("match_id") % 4]
    whole = weights[0] + weights[1] + weights[2]
    label = F.when(F.col("region") == "EUROPE", F.concat(F.lit("Europe - "), F.col("league"))).otherwise(F.col("league"))
    rounds = F.when(F.lit(False), F.lit(""))
    for n, name in ROUNDS.items():
        rounds = rounds.when(F.col("match_id") % 23 == n, name)
    k = k.withColumns({
        **{f"{n}_prob": half_up(w / whole, 4) for n, w in zip(("home", "draw", "away"), weights)}, "agreement": (F.col("match_id") % 11) / 10,
        "label": label, "round_label": rounds, "league_type": F.when(F.col("match_id") % 23 < 2, "cup"),
    })
    k = k.withColumn("confidence", F.greatest("home_prob", "draw_prob", "away_prob"))
    if "meetings" not in parts:
        return k
    summary = F.when(F.col("two_legs"), "tweeluik").otherwise("")
    name = F.when(F.col("match_id") % 23 == 2, F.concat("label", F.lit(" qualification"))).otherwise(F.col("label"))
    return k.withColumn("phase", classify.phase(name, F.col("round_label"), summary, F.col("league_type"), F.col("two_legs")))


def R(x: str, digits: int = 2) -> str:
    return f"floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE"


def X(x: str, digits: int = 2) -> str:
    """By the exact value, whose digits printf gives; exact halves away from zero, where printf takes the even one."""
    n = f"({x})::DOUBLE"
    half = f"substr(printf('%.40f', abs({n})), -{40 - digits}) = '5{'0' * (39 - digits)}'"
    away = f"sign({n}) * (floor(abs({n}) * {10**digits}) + 1) / {10**digits}.0::DOUBLE"
    return f"(CASE WHEN {half} THEN {away} ELSE CAST(printf('%.{digits}f', {n}) AS DOUBLE) END + 0.0::DOUBLE)"


def over_sql(t: str, side: str, k: str = "", what: str = "over") -> str:
    """Points a game of a side in a row of `mp`: won (actual), promised (implied), or what was won over it."""
    n = f"{t}.{k}{side}_games"
    won, promised = f"{t}.{k}{side}_won / {n}", f"{t}.{k}{side}_promised / 10000 / {n}"
    return f"CASE WHEN {n} > 0 THEN {X({'over': f'{won} - {promised}', 'actual': won, 'implied': promised}[what])} END"


_UNITS = "CAST(round((3 * p{0} + pd) * 10000) AS BIGINT)"


def prices_sql(books: bool = False, name: str = "mp") -> str:
    """The CTE `name`: each team's price record before each of its days."""
    groups = {f"b{b}_": f"book = {b}" for b in market.BOOKS} if books else {"": "true"}
    names = [f"{k}{n}" for k in groups for n in ("home_games", "home_won", "home_promised", "away_games", "away_won", "away_promised", "closing")]
    per = ",\n    ".join(
        f"count(*) FILTER ({c}) AS {k}n, sum({_UNITS.format('h')}) FILTER ({c})::BIGINT AS {k}ph, sum({_UNITS.format('a')}) FILTER ({c})::BIGINT AS {k}pa, count(*) FILTER ({c} AND closing) AS {k}c" for k, c in groups.items()
    )

    def side(s: str, win: str) -> str:
        points = f"CASE outcome WHEN '{win}' THEN 3 WHEN 'D' THEN 1 ELSE 0 END"
        own = lambda x, t: f"coalesce({x}, 0)" if t == s else "0"
        each = [f"{own(x, t)} AS {k}{t}_{n}" for k in groups for t in ("home", "away") for n, x in (("games", f"{k}n"), ("won", f"{k}n * {points}"), ("promised", f"{k}p{t[0]}"))]
        return f"SELECT {s}_team_id AS team_id, match_date, {', '.join([*each, *(f'coalesce({k}c, 0) AS {k}closing' for k in groups)])}\n    FROM m LEFT JOIN {name}o o ON o.match_id = m.match_id"

    return f"""{name}o AS (SELECT match_id, any_value(outcome) AS outcome,
    {per} FROM op GROUP BY match_id),
{name}d AS (SELECT team_id, match_date, {", ".join(f"sum({n})::BIGINT AS {n}" for n in names)}
  FROM ({side("home", "H")}
    UNION ALL BY NAME {side("away", "A")}) GROUP BY team_id, match_date),
{name} AS (SELECT team_id, match_date, {", ".join(f"coalesce(sum({n}) OVER w, 0)::BIGINT AS {n}" for n in names)}
  FROM {name}d WINDOW w AS (PARTITION BY team_id ORDER BY match_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_CARD = "l_returnflag = 'N' AND "
_IMPLIED = ", ".join(f"CASE WHEN {c}_odd > 1.01 THEN 1 / {c}_odd ELSE 0 END AS i{c[0]}" for c in ("home", "draw", "away"))
_ROUND = " ".join(f"WHEN {n} THEN '{name}'" for n, name in ROUNDS.items())
_PAIR = "PARTITION BY least(home_team_id, away_team_id), greatest(home_team_id, away_team_id) ORDER BY match_date, match_id"
RECORD_SQL = f"""
lx AS (
  SELECT l_orderkey AS match_id, count(*) AS n_lines, count(*) FILTER (l_discount >= 0.09) AS home_injuries, count(*) FILTER (l_tax >= 0.07) AS away_injuries,
         count(*) FILTER ({_CARD} l_linenumber % 2 = 1 AND l_discount < 0.08) AS home_yellow, count(*) FILTER ({_CARD} l_linenumber % 2 = 1 AND l_discount >= 0.08) AS home_red,
         count(*) FILTER ({_CARD} l_linenumber % 2 = 0 AND l_discount < 0.08) AS away_yellow, count(*) FILTER ({_CARD} l_linenumber % 2 = 0 AND l_discount >= 0.08) AS away_red,
         count(*) FILTER ({_CARD} l_tax >= 0.08) AS penalties
  FROM lineitem GROUP BY l_orderkey),
el AS (SELECT CAST(c_nationkey AS BIGINT) * 100 + c_custkey % 20 AS team_id, floor(sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT / count(*) / 5000 + 1500.5::DOUBLE) AS elo FROM customer GROUP BY 1),
we AS (
  SELECT *, CASE WHEN wind >= 28 OR rain >= 70 THEN 'high' WHEN wind >= 20 OR rain >= 50 THEN 'medium' ELSE 'low' END AS weather_risk
  FROM (SELECT day(ts) AS day, (sum(CAST(floor(value) AS BIGINT))::BIGINT % 40)::DOUBLE AS wind, count(*) FILTER (event_type = 'error') * 100 / count(*) AS rain FROM events GROUP BY 1)),
re AS (SELECT team_id, match_id, CASE WHEN gap > 0 THEN gap::DOUBLE END AS rest
  FROM (SELECT team_id, match_id, match_date - lag(match_date) OVER (PARTITION BY team_id ORDER BY match_date, match_id) AS gap FROM t)),
hh AS (
  SELECT match_id, coalesce(sum(done::INT) OVER w, 0)::BIGINT AS h2h_results, coalesce(sum((done AND d > 0)::INT) OVER w, 0)::BIGINT AS wins_a, coalesce(sum((done AND d < 0)::INT) OVER w, 0)::BIGINT AS wins_b,
         match_date - lag(match_date) OVER ({_PAIR}) AS leg_gap, coalesce(list(sign(d)::INT) FILTER (done) OVER ({_PAIR} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS recent
  FROM (SELECT *, status = 'FT' AND home_goals IS NOT NULL AS done, CASE WHEN home_team_id < away_team_id THEN home_goals - away_goals ELSE away_goals - home_goals END AS d FROM m)
  WINDOW w AS ({_PAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ta AS (
  SELECT team_id, count(*) OVER (PARTITION BY league) AS teams, row_number() OVER (PARTITION BY league ORDER BY points DESC, gd DESC, gf DESC, team_id) AS position
  FROM (SELECT league, team_id, count(*) FILTER (gf > ga) * 3 + count(*) FILTER (gf = ga) AS points, sum(gf) - sum(ga) AS gd, sum(gf) AS gf FROM t WHERE status = 'FT' AND gf IS NOT NULL GROUP BY league, team_id)),
op AS (
  SELECT *, {R("ih / (ih + id + ia)", 4)} AS ph, {R("id / (ih + id + ia)", 4)} AS pd, {R("ia / (ih + id + ia)", 4)} AS pa
  FROM (SELECT *, {_IMPLIED} FROM o WHERE home_odd > 1.01 AND draw_odd > 1.01 AND away_odd > 1.01 AND outcome IS NOT NULL)),
{prices_sql()},
k0 AS (
  SELECT m.*, lx.* EXCLUDE (match_id), hh.* EXCLUDE (match_id), weather_risk, a.elo AS home_elo, b.elo AS away_elo, a.elo - b.elo AS elo_diff, coalesce(n_lines >= 4, false) AS lineups_confirmed,
         ra.rest AS home_rest, rb.rest AS away_rest, coalesce(ra.rest - rb.rest, 0) AS rest_diff, {over_sql("pa", "home")} AS home_market_over, {over_sql("pb", "away")} AS away_market_over,
         {over_sql("pa", "home", "", "actual")} AS home_market_actual, {over_sql("pb", "away", "", "actual")} AS away_market_actual,
         {over_sql("pa", "home", "", "implied")} AS home_market_implied, {over_sql("pb", "away", "", "implied")} AS away_market_implied,
         CASE WHEN pa.home_games + pa.away_games > 0 THEN pa.home_games END AS home_market_games, CASE WHEN pb.home_games + pb.away_games > 0 THEN pb.away_games END AS away_market_games,
         {R(f"coalesce({over_sql('pa', 'home')}, 0) - coalesce({over_sql('pb', 'away')}, 0)")} AS market_over_diff, ta.position AS home_position, tb.position AS away_position, ta.teams AS teams,
         CASE WHEN m.home_team_id < m.away_team_id THEN wins_a ELSE wins_b END AS h2h_home_wins, CASE WHEN m.home_team_id < m.away_team_id THEN wins_b ELSE wins_a END AS h2h_away_wins,
         1 + pred_home_goals * 2 + m.match_id % 5 AS w1, 3 + m.match_id % 3 AS w2, 1 + pred_away_goals * 2 + m.match_id % 4 AS w3, m.match_id % 11 / 10 AS agreement,
         CASE WHEN region = 'EUROPE' THEN 'Europe - ' || m.league ELSE m.league END AS label, CASE m.match_id % 23 {_ROUND} END AS round_label, coalesce(leg_gap <= 20, false) AS two_legs
  FROM m LEFT JOIN lx ON lx.match_id = m.match_id JOIN hh ON hh.match_id = m.match_id LEFT JOIN we ON we.day = day(match_date)
    LEFT JOIN el a ON a.team_id = home_team_id LEFT JOIN el b ON b.team_id = away_team_id LEFT JOIN mp pa ON pa.team_id = home_team_id AND pa.match_date = m.match_date
    LEFT JOIN mp pb ON pb.team_id = away_team_id AND pb.match_date = m.match_date
    LEFT JOIN ta ON ta.team_id = home_team_id LEFT JOIN ta tb ON tb.team_id = away_team_id
    LEFT JOIN re ra ON ra.match_id = m.match_id AND ra.team_id = home_team_id LEFT JOIN re rb ON rb.match_id = m.match_id AND rb.team_id = away_team_id),
k1 AS (SELECT *, {R("w1 / (w1 + w2 + w3)", 4)} AS home_prob, {R("w2 / (w1 + w2 + w3)", 4)} AS draw_prob, {R("w3 / (w1 + w2 + w3)", 4)} AS away_prob,
  label LIKE 'Europe -%' AND match_id % 23 = 2 AS between_countries FROM k0),
k AS (
  SELECT *, greatest(home_prob, draw_prob, away_prob) AS confidence,
    CASE WHEN home_position IS NULL OR away_position IS NULL THEN 1.0 WHEN least(home_position, away_position) <= 3 OR greatest(home_position, away_position) >= greatest(teams - 2, 1) THEN 1.08
         WHEN least(home_position, away_position) <= 6 THEN 1.03 ELSE 1.0 END::DOUBLE AS importance,
    CASE WHEN two_legs THEN 'two-leg-knockout' WHEN between_countries THEN 'qualification' WHEN match_id % 23 IN (0, 1, 3) THEN 'cup' ELSE 'league' END AS phase
  FROM k1)"""
REVIEWS = f"""{RECORD_SQL},
r0 AS (
  SELECT *, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS actual, CASE WHEN pred_home_goals > pred_away_goals THEN 'H' WHEN pred_home_goals < pred_away_goals THEN 'A' ELSE 'D' END AS predicted,
         CASE WHEN home_prob >= draw_prob AND home_prob >= away_prob THEN 'H' WHEN away_prob >= draw_prob AND away_prob >= home_prob THEN 'A' ELSE 'D' END AS likeliest
  FROM k WHERE status = 'FT' AND home_goals IS NOT NULL),
r AS (
  SELECT *, actual = predicted AS outcome_hit, actual = likeliest AS probability_hit, home_goals = pred_home_goals AND away_goals = pred_away_goals AS exact_hit,
         abs(home_goals - pred_home_goals) + abs(away_goals - pred_away_goals) AS goal_error, home_goals + away_goals - pred_home_goals - pred_away_goals AS goal_bias, home_goals - pred_home_goals AS home_bias, away_goals - pred_away_goals AS away_bias,
         CASE WHEN actual = predicted THEN [] ELSE list_filter([CASE WHEN abs(elo_diff) >= 80 THEN 'clubelo_misread' END, CASE WHEN NOT lineups_confirmed THEN 'open_lineups' END, CASE WHEN weather_risk = 'high' THEN 'weather_risk' END,
           CASE WHEN abs(rest_diff) >= 2 THEN 'rest_gap' END, CASE WHEN h2h_results >= 3 THEN 'h2h_signal' END, CASE WHEN abs(market_over_diff) >= 0.45 THEN 'market_misread' END, CASE WHEN agreement < 0.45 THEN 'low_model_agreement' END], lambda s: s IS NOT NULL) END AS signals
  FROM r0)"""


def reviewed(spark: SparkSession, d: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Reviews of the records; with all parts also the signals, with `meetings` the phase."""
    return evaluate.reviews(records(spark, d, parts))


def learned_sql(rows: str = "r") -> str:
    side = lambda n, o, h: (
        f"SELECT {n}_team_id AS team_id, outcome_hit, exact_hit, goal_error, signals, " + ", ".join(f"{x} AS {y}" for y, x in {
            "hb": f"{n}_bias" if h else "0", "ab": "0" if h else f"{n}_bias", "oh": f"(predicted = '{o}' AND actual <> '{o}')::INT" if h else "0", "oa": "0" if h else f"(predicted = '{o}' AND actual <> '{o}')::INT",
            "uh": f"(predicted <> '{o}' AND actual = '{o}')::INT" if h else "0", "ua": "0" if h else f"(predicted <> '{o}' AND actual = '{o}')::INT"}.items()) + f" FROM {rows}"
    )
    return f"""SELECT team_id, games, outcome_hits, exact_hits, {X("outcome_hits / games")} AS hit_rate, {X("exact_hits / games")} AS exact_rate, {X("e / games")} AS avg_goal_error, {X("hb / games")} AS home_goal_bias, {X("ab / games")} AS away_goal_bias,
  {X("(uh - oh) / games")} AS home_outcome_bias, {X("(ua - oa) / games")} AS away_outcome_bias, oh AS over_home, oa AS over_away, uh AS under_home, ua AS under_away, open_lineup_misses, weather_misses, h2h_misses
FROM (SELECT team_id, count(*) AS games, count(*) FILTER (outcome_hit) AS outcome_hits, count(*) FILTER (exact_hit) AS exact_hits, sum(goal_error)::BIGINT AS e, sum(hb)::BIGINT AS hb, sum(ab)::BIGINT AS ab, sum(oh)::BIGINT AS oh, sum(oa)::BIGINT AS oa,
        sum(uh)::BIGINT AS uh, sum(ua)::BIGINT AS ua, count(*) FILTER (list_contains(signals, 'open_lineups')) AS open_lineup_misses, count(*) FILTER (list_contains(signals, 'weather_risk')) AS weather_misses, count(*) FILTER (list_contains(signals, 'h2h_signal')) AS h2h_misses
      FROM ({side("home", "H", True)} UNION ALL {side("away", "A", False)}) GROUP BY team_id)"""


def reliable_sql(key: str, rows: str = "r") -> str:
    score = X("hit_rate * 0.68::DOUBLE + exact_rate * 0.22::DOUBLE + greatest(0, 1 - avg_goal_error / 4) * 0.1::DOUBLE")
    return f"""SELECT {key}, matches, hit_rate, exact_rate, avg_goal_error, CASE WHEN {key} LIKE 'Europe -%' THEN {X("score * 0.96::DOUBLE")} ELSE score END AS reliability
FROM (SELECT *, {score} AS score FROM (SELECT {key}, count(*) AS matches, {X("count(*) FILTER (outcome_hit) / count(*)")} AS hit_rate, {X("count(*) FILTER (exact_hit) / count(*)")} AS exact_rate, {X("sum(goal_error) / count(*)")} AS avg_goal_error FROM {rows} GROUP BY {key}))"""
