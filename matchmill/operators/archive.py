"""Referees found in an archive by name: exact names, aliases, then likeness. All steps are joins on equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchmill.functions.semantics import normalize_name

#: Words of a name that variants leave out.
LEFT_OUT = ("de", "da", "del", "van", "von", "der", "den", "di", "la", "le", "jr", "sr")


def name_variants(name: Column) -> Column:
    """The normalised name and shorter forms of it, best first, without repeats."""
    full = normalize_name(name)
    words = F.filter(F.split(full, " "), lambda w: w != "")
    core = F.filter(words, lambda w: ~w.isin(*LEFT_OUT))
    core = F.when(F.size(core) > 0, core).otherwise(words)
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    initial = lambda a, i: F.substring(at(a, i), 1, 1)
    tail = lambda a, n: F.array_join(F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), F.lit(n)), " ")
    of = lambda a, least, *parts, sep=" ": F.when(F.size(a) >= least, F.concat_ws(sep, *parts))
    forms = [
        full, F.array_join(core, " "), at(words, -1),
        of(words, 2, at(words, 1), at(words, -1)), of(words, 2, initial(words, 1), at(words, -1)), of(words, 2, initial(words, 1), at(words, -1), sep="."), F.when(F.size(words) >= 2, tail(words, 2)),
        of(words, 3, at(words, 1), at(words, 2), at(words, -1)), of(words, 3, initial(words, 1), initial(words, 2), at(words, -1)),
        of(core, 2, at(core, 1), at(core, -1)), of(core, 2, initial(core, 1), at(core, -1)), F.when(F.size(core) >= 2, tail(core, 2)),
        F.when(F.size(core) >= 3, tail(core, 3)), of(core, 3, initial(core, 1), initial(core, 2), at(core, -1)),
    ]
    return F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull() & (v != "")))


def grams(name: Column) -> Column:
    """All pieces of one to three characters: whatever contains another name contains its head."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*(name.substr(i, F.lit(n)) for n in (1, 2, 3))))))


def rarest(names: DataFrame, name: str, count: DataFrame) -> DataFrame:
    """`names` (with `scope`) with `k`, the piece of each name that fewest entries have; one that none has counts first."""
    each = names.select("*", F.explode(grams(F.col(name))).alias("piece")).join(count.withColumnRenamed("k", "piece"), ["scope", "piece"], "left")
    return each.groupBy(*names.columns).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("piece").alias("k"))).alias("r")).select(*names.columns, "r.*")


def pieces(name: Column, sizes: Column) -> Column:
    """All pieces of a name that have one of these lengths."""
    fits = F.filter(sizes, lambda n: n <= F.length(name))
    return F.array_distinct(F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: name.substr(i, n)))))


def cut(df: DataFrame, name: str, like: DataFrame, other: str) -> DataFrame:
    """`df` with `piece`, one row for each piece of its name that is as long as one of the other names."""
    sizes = like.agg(F.collect_set(F.length(other)).alias("sizes_"))  # one row: lengths of names
    return df.crossJoin(F.broadcast(sizes)).select(*df.columns, F.explode(pieces(F.col(name), F.col("sizes_"))).alias("piece"))


def containing(asked: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of asked names (ref) and entries (key) of a scope, first those whose entry holds the name, then those whose name
    holds the entry. The longer name is cut into all pieces as long as the shorter one, which are compared as wholes."""
    held = asked.join(cut(entries, "key", asked, "ref").withColumnRenamed("piece", "ref"), ["scope", "ref"])
    holding = cut(asked, "ref", entries, "key").withColumnRenamed("piece", "key").join(entries, ["scope", "key"])
    return held, holding


def first_containing(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """As containing(), but of the entries that hold a name only the first by `ord`, which is found before the join: no pairs
    are made for a name that many entries hold."""
    first = cut(entries, "key", asked, "ref").groupBy("scope", F.col("piece").alias("ref")).agg(F.min(F.struct("ord", "referee")).alias("r"))
    held = asked.join(first.select("scope", "ref", "r.*"), ["scope", "ref"])
    return held.unionByName(containing(asked, entries)[1].select(held.columns))


def find_referees(df: DataFrame, id: str, league: str, name: str, archive: DataFrame) -> DataFrame:
    """(id, referee) for rows of `df` whose referee is found in `archive` (league, ord, referee, matches).

    The league's own alias or name counts before any league's, then variants in their order, then likeness: one name in
    the other, the same last word, or a common variant; of equals the league's own entries and the earlier `ord`. Between
    leagues the entry with most matches stands for a name. Distinct names are looked up once, not once per row."""
    own = archive.select(F.col("league").alias("scope"), "ord", "referee", normalize_name(F.col("referee")).alias("key")).filter("key <> ''")
    own = own.groupBy("scope", "key").agg(F.min(F.struct("ord", "referee")).alias("r")).select("scope", "key", "r.*")
    anywhere = archive.withColumn("key", normalize_name(F.col("referee"))).filter("key <> ''").groupBy("key").agg(F.max(F.struct("matches", (-F.col("ord")).alias("early"), "referee")).alias("r"))
    anywhere = anywhere.select(F.lit("").alias("scope"), "key", (-F.col("r.early")).alias("ord"), F.col("r.referee").alias("referee"))
    entries = own.unionByName(anywhere).withColumn("variants", name_variants(F.col("referee")))
    aliases = entries.select("scope", F.explode("variants").alias("alias"), "ord", "referee").groupBy("scope", "alias").agg(F.min(F.struct("ord", "referee")).alias("r")).select("scope", "alias", F.col("r.referee").alias("referee"))
    asked = df.select(F.col(league).alias("league"), normalize_name(F.col(name)).alias("ref"), F.col(name).alias("name")).filter("ref <> ''").groupBy("league", "ref").agg(F.min("name").alias("name"))
    places = F.array(F.struct(F.col("league").alias("scope"), F.lit(0).alias("far")), F.struct(F.lit("").alias("scope"), F.lit(1).alias("far")))
    asked = asked.select("league", "ref", F.explode(places).alias("p"), name_variants(F.col("name")).alias("variants")).select("league", "ref", "p.*", "variants")
    hit = lambda level, ord: F.struct(level.alias("level"), F.col("far"), ord.cast("long").alias("ord"), F.col("referee")).alias("hit")
    of = ["league", "ref"]

    tried = asked.select(*of, "scope", "far", F.posexplode("variants").alias("at", "alias")).join(aliases, ["scope", "alias"])
    by_alias = tried.select(*of, hit(F.when(F.col("at") == 0, F.col("far") * 2).otherwise(F.col("at") + 3), F.lit(0)))
    by_name = asked.withColumnRenamed("ref", "key").join(entries.drop("variants"), ["scope", "key"]).withColumnRenamed("key", "ref").select(*of, hit(F.col("far") * 2 + 1, F.col("ord")))

    last = lambda c: F.substring_index(c, " ", -1)
    marked = lambda kind, keys: F.transform(keys, lambda k: F.concat(F.lit(kind), k))
    alike = lambda c: F.flatten(F.array(marked("s:", F.array(last(F.col(c)))), marked("v:", F.col("variants"))))
    first = entries.select("scope", F.explode(alike("key")).alias("k"), "ord", "referee").groupBy("scope", "k").agg(F.min(F.struct("ord", "referee")).alias("r")).select("scope", "k", "r.*")
    near = asked.select(*of, "scope", "far", F.explode(alike("ref")).alias("k")).join(first, ["scope", "k"])
    held = first_containing(asked.select(*of, "scope", "far"), entries.select("scope", "key", "ord", "referee"))
    by_likeness = near.select(*of, hit(F.lit(1000), F.col("ord"))).unionByName(held.select(*of, hit(F.lit(1000), F.col("ord"))))
    best = by_alias.unionByName(by_name).unionByName(by_likeness).groupBy(*of).agg(F.min("hit").alias("hit")).select(F.col("league").alias("hit_league"), "ref", F.col("hit.referee").alias("referee"))
    rows = df.select(F.col(id), F.col(league).alias("hit_league"), normalize_name(F.col(name)).alias("ref"))
    return rows.join(best, ["hit_league", "ref"]).select(id, "referee")
