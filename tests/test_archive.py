"""The referee look-up by likeness."""

import random
import string

from pyspark.sql import functions as F

from matchmill.operators import archive


def test_containing(spark):
    """All pairs that hold one another, and none else, as comparing all with all gives them."""
    r = random.Random(8)
    name = lambda n: "".join(r.choices("abc ", k=n)).strip() or "a"
    asked = [(f"l{i % 2}", n, "x", 0) for i, n in enumerate({name(r.randrange(1, 9)) for _ in range(60)})]
    entries = [("x" if i % 5 else "y", n, i, f"R{i}") for i, n in enumerate({name(r.randrange(1, 9)) for _ in range(60)})]
    held, holding = archive.containing(spark.createDataFrame(asked, "league string, ref string, scope string, far int"), spark.createDataFrame(entries, "scope string, key string, ord long, referee string"))
    plain = lambda df: {(x["league"], x["ref"], x["key"]) for x in df.collect()}
    assert plain(held) == {(a[0], a[1], e[1]) for a in asked for e in entries if e[0] == a[2] and a[1] in e[1]}
    assert plain(holding) == {(a[0], a[1], e[1]) for a in asked for e in entries if e[0] == a[2] and e[1] in a[1]}


def test_rare_keys(spark):
    """Among many names that begin alike no name looks up more than a thousand entries."""
    r = random.Random(9)
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=7))
    names = sorted({f"mark {word()} {word()}" for _ in range(100_000)})
    entries = spark.createDataFrame([("", n, i, n) for i, n in enumerate(names)], "scope string, key string, ord long, referee string")
    count = entries.select("scope", F.explode(archive.grams(F.col("key"))).alias("k")).groupBy("scope", "k").agg(F.count(F.lit(1)).alias("n"))
    keys = archive.rarest(entries.select("scope", "key"), "key", count)
    assert keys.agg(F.max("n")).first()[0] < 1000 and keys.count() == len(names)


def test_names_that_share_pieces(spark):
    """Names of numbers share every short piece with many others; look-ups make no more rows than there are names that hold one another."""
    names = [f"supplier {i:09d}" for i in range(3000)]
    asked = [("l", n[-9:] if i % 2 else n, "", 0) for i, n in enumerate(names)] + [("l", "supplier", "", 0)]
    got = archive.first_containing(spark.createDataFrame(asked, "league string, ref string, scope string, far int"), spark.createDataFrame([("", n, i, n) for i, n in enumerate(names)], "scope string, key string, ord long, referee string"))
    first = {(r["ref"], r["ord"]) for r in got.collect()}
    assert first == {(a[1], i) for i, a in enumerate(asked[:-1])} | {("supplier", 0)}
    made = [n for n in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in n]
    assert made and not any("Contains" in n for n in made)
