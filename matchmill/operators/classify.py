"""Which events belong: age groups, leagues, internationals, phases, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import normalize_name

#: Tokens of women's and youth football.
WOMEN = ("women", "woman", "femminile", "feminine", "feminin", "frauen", "dames", "ladies", "vrouw")
YOUTH = ("u17", "u18", "u19", "u20", "u21", "u23", "under 17", "under 18", "under 19", "under 20", "under 21", "under 23", "youth", "junior")
#: Tokens that bar a tournament from being a senior international one.
NOT_SENIOR = ("u17", "u18", "u19", "u20", "u21", "u23", "women", "femin", "vrouw", "futsal")
#: League rules in their order, of which the first that fits decides (country, name, label, type).
LEAGUES = (
    ("netherlands", "eredivisie", "Netherlands - Eredivisie", "league"),
    ("netherlands", "eerste divisie", "Netherlands - Eerste Divisie", "league"),
    ("netherlands", "knvb beker", "Netherlands - KNVB Beker", "cup"),
    ("england", "premier league", "England - Premier League", "league"),
    ("england", "championship", "England - Championship", "league"),
    ("germany", "bundesliga", "Germany - Bundesliga", "league"),
    ("germany", "2. bundesliga", "Germany - 2. Bundesliga", "league"),
    ("spain", "laliga", "Spain - LaLiga", "league"),
    ("spain", "la liga", "Spain - LaLiga", "league"),
    ("spain", "laliga2", "Spain - LaLiga2", "league"),
    ("spain", "segunda", "Spain - LaLiga2", "league"),
    ("italy", "serie a", "Italy - Serie A", "league"),
    ("italy", "serie b", "Italy - Serie B", "league"),
    ("france", "ligue 1", "France - Ligue 1", "league"),
    ("france", "ligue 2", "France - Ligue 2", "league"),
    ("portugal", "liga portugal", "Portugal - Liga Portugal", "league"),
    ("portugal", "liga portugal 2", "Portugal - Liga Portugal 2", "league"),
    ("belgium", "pro league", "Belgium - Pro League", "league"),
    ("belgium", "challenger pro league", "Belgium - Challenger Pro League", "league"),
    ("", "champions league", "Europe - Champions League", "cup"),
    ("", "europa league", "Europe - Europa League", "cup"),
    ("", "conference league", "Europe - Conference League", "cup"),
)
#: European countries by their normalised names.
EUROPE = (
    "albania", "andorra", "armenia", "austria", "azerbaijan", "belarus", "belgium", "bosnia and herzegovina", "bosnia herzegovina", "bulgaria",
    "croatia", "cyprus", "czech republic", "czechia", "denmark", "england", "estonia", "faroe islands", "finland", "france", "georgia", "germany",
    "gibraltar", "greece", "hungary", "iceland", "ireland", "israel", "italy", "kazakhstan", "kosovo", "latvia", "liechtenstein", "lithuania",
    "luxembourg", "malta", "moldova", "montenegro", "netherlands", "north macedonia", "norway", "poland", "portugal", "romania", "san marino",
    "scotland", "serbia", "slovakia", "slovenia", "spain", "sweden", "switzerland", "turkey", "ukraine", "wales",
)
#: Zones of league tables by what the label holds, the first that fits: (key, from, to), negative from the end.
ZONES = (
    (("Premier League", "LaLiga", "Serie A", "Bundesliga", "Ligue 1"), (("ucl", 1, 4), ("europe", 5, 6), ("relegation", -2, 0))),
    (("Championship",), (("promotion", 1, 2), ("playoffs", 3, 6), ("relegation", -2, 0))),
    (("Eerste Divisie",), (("promotion", 1, 2), ("period", 3, 8))),
    (("Eredivisie",), (("ucl", 1, 3), ("playoffs", 4, 8), ("relegation", -2, 0))),
)


def has_token(tokens: tuple[str, ...], *columns: Column) -> Column:
    low = F.lower(F.concat_ws(" ", *columns))
    found = F.lit(False)
    for t in tokens:
        found |= F.contains(low, F.lit(t))
    return found


def excluded(*columns: Column) -> Column:
    return has_token(WOMEN, *columns) | has_token(YOUTH, *columns)


def segment(*columns: Column) -> Column:
    return F.when(has_token(YOUTH, *columns), "youth").otherwise("senior")


def league_of(country: Column, name: Column, longest: bool = False) -> Column:
    """(label, type) of the first rule that fits, or of the most specific one; null if none does."""
    rules = sorted(LEAGUES, key=lambda r: -len(r[1])) if longest else LEAGUES
    out = F.when(F.lit(False), F.lit(None).cast("struct<label:string,type:string>"))
    for c, n, label, kind in rules:
        out = out.when(F.contains(F.lower(country), F.lit(c)) & F.contains(F.lower(name), F.lit(n)), F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type")))
    return out


def european(country: Column) -> Column:
    return normalize_name(country).isin(*EUROPE)


def senior(tournament: Column) -> Column:
    name = normalize_name(tournament)
    return (name != "") & ~has_token(NOT_SENIOR, name)


def international(tournament: Column, category: Column, home_country: Column, away_country: Column) -> Column:
    """(label, type) of a senior international match in which Europe has a part; the first rule that fits, else null."""
    name, kind = normalize_name(tournament), normalize_name(category)
    holds = lambda *words: has_token(words, name)
    europe = F.coalesce(european(home_country), F.lit(False)) | F.coalesce(european(away_country), F.lit(False))
    here = F.contains(kind, F.lit("europe")) | europe
    qualifies = F.contains(name, F.lit("qualification"))
    label = lambda x, t: F.struct(F.lit(f"Europe - {x}").alias("label"), F.lit(t).alias("type"))
    return F.when(
        senior(tournament),
        F.when(holds("world championship qual", "world cup qual") & (here | holds("uefa")), label("World Cup Qualification", "league"))
        .when(((holds("european championship") & qualifies) | holds("euro qualification")) & here, label("Euro Qualification", "league"))
        .when(holds("uefa nations league"), label("UEFA Nations League", "league"))
        .when(holds("european championship") & ~qualifies & here, label("European Championship", "cup"))
        .when(holds("friendly games", "international friendly") & ~holds("club") & europe, label("International Friendly", "league")),
    )


def phase(league: Column, round_label: Column, summary: Column, league_type: Column, two_legs: Column) -> Column:
    """The bucket in which a match's review counts."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    lg, rd, sm, kind = text(league), text(round_label), text(summary), text(league_type)
    between = F.startswith(lg, F.lit("europe -")) & lg.rlike("nations league|qualification|friendly|international|world cup|championship")
    return (
        F.when(F.coalesce(two_legs, F.lit(False)) | sm.rlike("tweeluik|two-leg|aggregate"), "two-leg-knockout")
        .when(between & (lg.rlike("qualification") | rd.rlike("qualification") | sm.rlike("qualification")), "qualification")
        .when(between & (lg.rlike("friendly") | sm.rlike("friendly")), "friendly")
        .when((kind == "cup") | sm.rlike("knock|play-off") | rd.rlike("final|semi|quarter|round of|achtste|kwart|halve"), "cup")
        .when(between, "interland")
        .otherwise("league")
    )


def without_excluded(tables: dict[str, DataFrame], excluded_teams: DataFrame, key: str = "team_id") -> dict[str, DataFrame]:
    """Each keyed table without the excluded teams."""
    return {name: df.join(excluded_teams.select(key), key, "left_anti") for name, df in tables.items()}


def zones(label: Column, teams: Column) -> Column:
    """Zones of a league table as (ord, zone, low, high), in their order, by what its label holds."""
    n = teams.cast("int")
    end = lambda k: F.when(F.lit(k > 0), F.lit(k)).otherwise(n) if k >= 0 else F.greatest(n + k, F.lit(1))

    def shape(parts: tuple) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("zone"), end(a).cast("int").alias("low"), end(b).cast("int").alias("high")) for i, (k, a, b) in enumerate(parts)))

    other = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("top").alias("zone"), F.lit(1).alias("low"), F.least(F.lit(4), F.when(n == 0, 4).otherwise(n)).alias("high")),
        F.struct(F.lit(1).alias("ord"), F.lit("bottom").alias("zone"), F.greatest(n - 2, F.lit(1)).alias("low"), F.when(n == 0, 1).otherwise(n).alias("high")),
    )
    out = F.when(F.lit(False), other)
    for names, parts in ZONES:
        out = out.when(label.rlike("|".join(names)), shape(parts))
    return out.otherwise(other)


def weather_risk(wind: Column, rain: Column) -> Column:
    """high, medium or low from wind speed and the probability of rain; nulls count as calm and dry."""
    w, p = F.coalesce(wind, F.lit(0.0)), F.coalesce(rain, F.lit(0.0))
    return F.when((w >= 28) | (p >= 70), "high").when((w >= 20) | (p >= 50), "medium").otherwise("low")


def round_weight(label: Column) -> Column:
    """Order of a cup's rounds; `final` is tested first, so semifinals and quarterfinals weigh as finals do."""
    low = F.lower(F.coalesce(label, F.lit("")))
    rules = (("final", 90), ("semi", 80), ("quarter", 70), ("acht|round of 16|laatste 16", 60), ("play-off", 50), ("32", 40))
    out = F.when(F.lit(False), F.lit(0))
    for word, weight in rules:
        out = out.when(low.rlike(word), weight)
    return out.otherwise(10)
