"""Prices, bookmakers and referees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchmill.functions.semantics import half_up, to_fixed
from matchmill.operators.before import running_before
from matchmill.operators.model import normalize_odds

VALID = "home_odd > 1.01 AND draw_odd > 1.01 AND away_odd > 1.01 AND outcome IS NOT NULL"


def implied(o: DataFrame) -> DataFrame:
    h, d, a = normalize_odds(F.col("home_odd"), F.col("draw_odd"), F.col("away_odd"))
    return o.withColumns({"p_home": h, "p_draw": d, "p_away": a})


def team_profile(o: DataFrame, *by: str) -> DataFrame:
    """Points won and points that prices promised, per team (and `by`), from an unpivot to team rows; sums are of whole
    ten-thousandths so that they don't depend on the order of rows."""
    units = lambda p, q: F.round((3 * F.col(p) + F.col(q)) * 10000).cast("long")
    side = lambda t, p, w: F.struct(F.col(t).alias("team_id"), units(p, "p_draw").alias("promised"), F.when(F.col("outcome") == w, 3).when(F.col("outcome") == "D", 1).otherwise(0).alias("won"))
    rows = implied(o.filter(VALID)).select("league", *by, "closing", F.explode(F.array(side("home_team_id", "p_home", "H"), side("away_team_id", "p_away", "A"))).alias("s"))
    g = rows.groupBy("league", *by, "s.team_id").agg(F.count(F.lit(1)).alias("games"), F.count_if("closing").alias("closing_rows"), F.sum("s.won").cast("long").alias("points"), F.sum("s.promised").alias("promised"))
    return g.withColumn("overperformance", half_up(F.col("points") / F.col("games") - F.col("promised") / 10000 / F.col("games"), 3)).drop("promised")


def side_profile(o: DataFrame) -> DataFrame:
    """Per league and team, home and away games apart: games, points won and points that prices promised, a game."""
    units = lambda p: F.round((3 * F.col(p) + F.col("p_draw")) * 10000).cast("long")
    side = lambda s, t, p, w: F.struct(F.lit(s).alias("side"), F.col(t).alias("team_id"), units(p).alias("promised"), F.when(F.col("outcome") == w, 3).when(F.col("outcome") == "D", 1).otherwise(0).alias("won"))
    rows = implied(o.filter(VALID)).select("league", F.explode(F.array(side("home", "home_team_id", "p_home", "H"), side("away", "away_team_id", "p_away", "A"))).alias("s")).select("league", "s.*")
    of = lambda c, s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0)).cast("long")
    g = rows.groupBy("league", "team_id").agg(*(F.count_if(F.col("side") == s).alias(f"{s}_games") for s in ("home", "away")), *(of(c, s).alias(f"{s}_{c}") for s in ("home", "away") for c in ("won", "promised")))
    a_game = lambda s, c, by: half_up(F.col(f"{s}_{c}") / by / F.greatest(f"{s}_games", F.lit(1)), 3)
    return g.select("league", "team_id", "home_games", "away_games", *(a_game(s, c, by).alias(f"{s}_{n}") for s in ("home", "away") for c, by, n in (("won", 1, "actual"), ("promised", 10000, "implied"))))


def league_meta(o: DataFrame) -> DataFrame:
    """Per league its valid prices and how many books of the match close: a match is covered by two of its first three."""
    per = o.filter(VALID).groupBy("league", "match_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("closing").alias("c"))
    g = per.groupBy("league").agg(F.sum("n").cast("long").alias("valid_rows"), F.count(F.lit(1)).alias("matches"), F.count_if(F.col("c") >= 2).alias("covered"))
    return g.withColumn("closing_coverage", half_up(F.col("covered") / F.col("matches"), 2))


def picked_odds(o: DataFrame, order: tuple[int, ...]) -> DataFrame:
    """Per match the three prices of the first book in `order` that has them all, its closing prices before its opening
    ones; of several such lines of a book the one with the lowest prices."""
    place = F.coalesce(*(F.when(F.col("book") == b, F.lit(i)) for i, b in enumerate(order)), F.lit(None).cast("int"))
    valid = o.filter("home_odd > 1.01 AND draw_odd > 1.01 AND away_odd > 1.01").withColumn("place", place).filter("place IS NOT NULL")
    first = F.min(F.struct((~F.col("closing")).alias("opening"), "place", "home_odd", "draw_odd", "away_odd", "book")).alias("b")
    return valid.groupBy("match_id").agg(first).select("match_id", "b.book", (~F.col("b.opening")).alias("closing"), "b.home_odd", "b.draw_odd", "b.away_odd")


def current_signals(o: DataFrame, most: int = 8) -> DataFrame:
    """Per match what its first books' prices lean to: one line a book, at most `most` books by number."""
    one = o.filter("home_odd > 1.01 AND draw_odd > 1.01 AND away_odd > 1.01").groupBy("match_id", "book").agg(F.min(F.struct("home_odd", "draw_odd", "away_odd")).alias("x"))
    one = one.withColumn("n", F.row_number().over(Window.partitionBy("match_id").orderBy("book"))).filter(F.col("n") <= most)
    h, d, a = normalize_odds(F.col("x.home_odd"), F.col("x.draw_odd"), F.col("x.away_odd"))
    one = one.select("match_id", "book", h.alias("h"), d.alias("d"), a.alias("a"))
    lean = F.when((F.col("h") >= F.col("a")) & (F.col("h") >= F.col("d")), "home").when(F.col("a") >= F.col("d"), "away").otherwise("neutral")
    one = one.select("match_id", "book", to_fixed(F.col("h") - F.col("a"), 2).alias("diff"), to_fixed(F.greatest("h", "d", "a") * 0.9, 2).alias("strength"), lean.alias("lean"))
    return one.withColumn("agreement", to_fixed(F.avg(F.when(F.col("lean") == "neutral", 0.0).otherwise(1.0)).over(Window.partitionBy("match_id")), 2))


BOOKS = range(8)


def match_prices(o: DataFrame, books: bool = False, overall: bool = True) -> DataFrame:
    """(match_id, outcome, and per match (`overall`) and per match and book (`books`): valid lines, points that they promised
    each side, closing lines)."""
    units = lambda p: F.round((3 * F.col(p) + F.col("p_draw")) * 10000).cast("long")
    rows = implied(o.filter(VALID)).select("match_id", "outcome", "book", "closing", units("p_home").alias("ph"), units("p_away").alias("pa"))
    groups = ({"": F.lit(True)} if overall else {}) | ({f"b{b}_": F.col("book") == b for b in BOOKS} if books else {})
    sums = [x for k, c in groups.items() for x in (F.count_if(c).alias(f"{k}n"), F.sum(F.when(c, F.col("ph"))).alias(f"{k}ph"), F.sum(F.when(c, F.col("pa"))).alias(f"{k}pa"), F.count_if(c & F.col("closing")).alias(f"{k}c"))]
    return rows.groupBy("match_id", "outcome").agg(*sums)


def side_measures(side: str, books: bool = False) -> dict[str, Column]:
    """What a match adds to the price record of its team on `side`, overall or per book."""
    win, promised = ("H", "ph") if side == "home" else ("A", "pa")
    points = F.when(F.col("outcome") == win, 3).when(F.col("outcome") == "D", 1).otherwise(0)
    out = {}
    for k in [f"b{b}_" for b in BOOKS] if books else [""]:
        for s in ("home", "away"):
            own = s == side
            out |= {f"{k}{s}_games": F.col(f"{k}n") if own else F.lit(0), f"{k}{s}_won": F.col(f"{k}n") * points if own else F.lit(0), f"{k}{s}_promised": F.col(f"{k}{promised}") if own else F.lit(0)}
        out |= {f"{k}closing": F.col(f"{k}c")}
    return out


def a_game(k: str, side: str) -> tuple[Column, Column, Column]:
    """Points won and promised a game at home or away, and how much more was won; null without games."""
    n = F.when(F.col(f"{k}{side}_games") > 0, F.col(f"{k}{side}_games"))
    won, promised = F.col(f"{k}{side}_won") / n, F.col(f"{k}{side}_promised") / 10000 / n
    return to_fixed(won, 2), to_fixed(promised, 2), to_fixed(won - promised, 2)


def side_record(k: str, side: str) -> tuple[Column, Column, Column, Column]:
    """a_game(), and the games on that side; null without any games of the team."""
    any_ = F.col(f"{k}home_games") + F.col(f"{k}away_games") > 0
    return *a_game(k, side), F.when(any_, F.col(f"{k}{side}_games"))


def coverage_before(m: DataFrame, prices: DataFrame, day: str = "match_date") -> DataFrame:
    """(league, day, closing_coverage): the share of the league's priced matches of earlier days that two closing prices
    cover; null without any."""
    rows = m.select("match_id", "league", day).join(prices.select("match_id", "n", "c"), "match_id", "left")
    sums = running_before(rows, ["league"], day, {"matches": F.col("n") > 0, "covered": F.col("c") >= 2})
    return sums.select("league", day, to_fixed(F.col("covered") / F.when(F.col("matches") > 0, F.col("matches")), 2).alias("closing_coverage"))


def book_figures(record: str) -> Column:
    """Of a struct of side_measures() per book an array with one entry per book: what it misjudged at home and away, games
    there, and the share of closing lines; null for a book without games."""
    raw = lambda b: F.struct(F.lit(b).alias("book"), *(F.col(f"{record}.b{b}_{c}").alias(c) for c in ("home_games", "home_won", "home_promised", "away_games", "away_won", "away_promised", "closing")))

    def one(r: Column) -> Column:
        def over(s: str) -> Column:
            n = F.when(r[f"{s}_games"] > 0, r[f"{s}_games"])
            return F.coalesce(to_fixed(r[f"{s}_won"] / n - r[f"{s}_promised"] / 10000 / n, 2), F.lit(0.0))

        rows = r["home_games"] + r["away_games"]
        figures = F.struct(over("home").alias("home_over"), over("away").alias("away_over"), r["home_games"].cast("double").alias("home_games"), r["away_games"].cast("double").alias("away_games"), to_fixed(r["closing"] / rows, 2).alias("coverage"))
        return F.when(rows > 0, figures)

    return F.transform(F.array(*(raw(b) for b in BOOKS)), one)


def side_figures(books: Column, side: str) -> Column:
    """Of book_figures() what counts for a team that plays on `side`."""
    return F.transform(books, lambda b: F.when(b.isNotNull(), F.struct(b[f"{side}_over"].alias("over"), b[f"{side}_games"].alias("games"), b["coverage"].alias("coverage"))))


def book_records(home: Column, away: Column) -> Column:
    """The side_figures() of both teams per book, as `goals.book_signals` takes them; a book that neither team has is left out."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    none = F.array_repeat(F.lit(None).cast("struct<over:double,games:double,coverage:double>"), len(BOOKS))
    sides = F.zip_with(F.coalesce(home, none), F.coalesce(away, none), lambda h, a: F.struct(h.alias("h"), a.alias("a")))
    both = lambda x, c: (zero(x[s][c]).alias(f"{n}_{c}") for s, n in (("h", "home"), ("a", "away")))
    records = F.transform(sides, lambda x, i: F.when(x["h"].isNotNull() | x["a"].isNotNull(), F.struct(i.cast("string").alias("book"), *(f for c in ("over", "games", "coverage") for f in both(x, c)))))
    return F.filter(records, lambda x: x.isNotNull())


def referees_before(m: DataFrame, day: str = "match_date") -> DataFrame:
    """(referee_id, day, avg_cards, penalty_rate) from a referee's games of earlier days; null without any."""
    cards = sum((F.col(f"{s}_{c}") * w for s in ("home", "away") for c, w in (("yellow", 1), ("red", 2))), F.lit(0))
    sums = running_before(m.filter("referee_id IS NOT NULL"), ["referee_id"], day, {"games": F.lit(1), "cards": cards, "penalties": F.col("penalties"), "counted": F.col("penalties").isNotNull()})
    a_game_of = lambda c, n: to_fixed(F.col(c) / F.when(F.col(n) > 0, F.col(n)), 2)
    return sums.select("referee_id", day, a_game_of("cards", "games").alias("avg_cards"), a_game_of("penalties", "counted").alias("penalty_rate"))


def referees(m: DataFrame, supplier: DataFrame) -> DataFrame:
    """Per referee the games, mean yellow and red cards, the mean of yellow + 2 red, the penalties a
    game of those that have a count (null if none has), and how strict that is."""
    n, total = F.count(F.lit(1)), lambda c: F.coalesce(F.sum(c), F.lit(0))
    yellow, red = F.col("home_yellow") + F.col("away_yellow"), F.col("home_red") + F.col("away_red")
    g = m.filter("referee_id IS NOT NULL").groupBy("referee_id").agg(
        n.alias("games"), half_up(total(yellow) / n, 2).alias("avg_yellow"), half_up(total(red) / n, 2).alias("avg_red"), half_up(total(yellow + red * 2) / n, 2).alias("avg_cards"), to_fixed(F.sum("penalties") / F.count("penalties"), 2).alias("penalty_rate"),
    )
    bucket = F.when(F.col("avg_cards") >= 4.8, "streng").when(F.col("avg_cards") >= 3.2, "gemiddeld").otherwise("laat doorspelen")
    return g.withColumn("strictness", bucket).join(supplier.select(F.col("s_suppkey").alias("referee_id"), F.col("s_name").alias("referee")), "referee_id", "left")
