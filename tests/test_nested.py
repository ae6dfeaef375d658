"""Prices in nested documents against a walk in plain Python."""

import json
import random

from pyspark.sql import functions as F

from matchmill.sources import nested


def truthy(x):
    return x not in (None, False, "") and not (isinstance(x, int | float) and not isinstance(x, bool) and x == 0)


def field(node, path):
    for part in path.split("."):
        node = node.get(part) if isinstance(node, dict) else None
    return node


def number(x):
    try:
        return float(x) if isinstance(x, str | int | float) and not isinstance(x, bool) else 0.0
    except ValueError:
        return 0.0


def walked(node, place=()):
    if isinstance(node, list):
        for i, x in enumerate(node):
            yield from walked(x, (*place, i))
    elif isinstance(node, dict):
        prices = [number(next((v for n in names if truthy(v := field(node, n))), 0)) for names in nested.PRICES.values()]
        if all(p > 1.01 for p in prices):
            yield place, str(next((v for n in nested.BOOKMAKER if truthy(v := field(node, n))), nested.NO_BOOKMAKER)), *prices
        for i, x in enumerate(node.values()):
            yield from walked(x, (*place, i))


def made(r, depth):
    if depth == 0:
        return r.choice([1, 2.5, "3.1", "x", None, True, "", '{"home": 2, "draw": 3, "away": 4}', [], {}])
    if r.random() < 0.3:
        return [made(r, depth - 1) for _ in range(r.randrange(4))]
    out = {}
    for n in r.sample(["z", "home", "draw", "away", "homeOdds", "drawValue", "oddsAway", "name", "bookmaker", "choice1", "choiceX", "a"], r.randrange(1, 9)):
        price = n in ("home", "draw", "away", "homeOdds", "drawValue", "oddsAway")
        out[n] = r.choice([1.5, 2, "2.75", 0, 1.01, made(r, depth - 1)]) if price else {"name": r.choice(["Bet A", "béta", ""])} if n == "bookmaker" else {"value": r.choice([2.2, "3"])} if n.startswith("choice") else r.choice(["Bet 1", 5, ""]) if n == "name" else made(r, depth - 1)
    return out


def test_price_nodes(spark):
    r = random.Random(1)
    docs = [json.dumps(made(r, r.randrange(1, 7))) for _ in range(300)] + ["", "not json", "[1, 2", "null", None, "3"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, j string")
    want = sorted((i, *x) for i, d in enumerate(docs[:300]) for x in walked(json.loads(d)))
    got = sorted((x["id"], tuple(x["place"]), x["bookmaker"], x["home"], x["draw"], x["away"]) for x in nested.price_nodes(rows, "j", "id").collect())
    assert got == want and len(want) > 50 and max(len(w[1]) for w in want) >= 4
    assert nested.price_nodes(rows.limit(0), "j", "id").count() == 0


def test_book_signals(spark):
    doc = {"markets": [{"x": {"list": [{"name": "B one", "home": 2.0, "draw": 4.0, "away": 4.0}, {"name": "b-ONE", "home": 9, "draw": 9, "away": 9}, {"home": 5, "draw": "2", "away": 5}]}}, {"name": "C", "home": 4, "draw": 4, "away": 2}]}
    rows = spark.createDataFrame([(1, json.dumps(doc))], "id long, j string")
    got = sorted((r["book"], r["bookmaker"], r["diff"], r["strength"], r["lean"], r["agreement"]) for r in nested.book_signals(nested.price_nodes(rows, "j", "id")).collect())
    assert got == [("b one", "B one", 0.25, 0.45, "home", 0.67), ("c", "C", -0.25, 0.45, "away", 0.67), ("sofascore", "Sofascore", 0.0, 0.5, "neutral", 0.67)]


def test_nesting(spark):
    rows = spark.createDataFrame([("[[{}]]",), ("3",), ("",), (None,)], "j string")
    assert [r[0] for r in rows.select(nested.nesting(F.col("j"))).collect()] == [3, 0, 0, None]


def test_brackets_in_text(spark):
    """Brackets in strings neither add to the depth nor take from it."""
    doc = {"a": '}}}}"\\', "b": {"c": {"name": "B", "home": 2, "draw": 3, "away": 4}}, "d": "[[[[[[["}
    rows = spark.createDataFrame([(1, json.dumps(doc))], "id long, j string")
    assert [tuple(r) for r in nested.price_nodes(rows, "j", "id").select("id", "bookmaker", "home").collect()] == [(1, "B", 2.0)]
    assert rows.select(nested.nesting(F.col("j"))).first()[0] == 3


def test_odd_documents(spark):
    """Fields count as a feed's reader takes them: text that spells zero or false is a value, a repeated key has its last one, an
    object or array is no price but holds the place of one; a deep document is walked to its end."""
    price = {"draw": 3, "away": 4, "name": "B"}
    deep = 1500
    docs = [
        json.dumps({"home": "0", "homeOdds": 2, **price}), json.dumps({"home": 0, "homeOdds": 2, **price}), '{"home": 1, "home": 2, "draw": 3, "away": 4, "name": 5}', json.dumps({"home": {}, "homeOdds": 2, **price}),
        "[" * deep + json.dumps({"home": " 2.0 ", **price}) + "]" * deep, '{"home": 2, "draw": 3, "away": 4, "name": "\\ud800"}', '{"home": NaN, "homeOdds": 2, "draw": 3, "away": 4}', '{"home": ' + "9" * 5000 + ', "draw": 3, "away": 4, "name": true}',
    ]
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, j string")
    got = sorted((r["id"], len(r["place"]), r["bookmaker"], r["home"]) for r in nested.price_nodes(rows, "j", "id").collect())
    assert got == [(1, 0, "B", 2.0), (2, 0, "5", 2.0), (4, deep, "B", 2.0), (5, 0, "?", 2.0), (7, 0, "true", float("inf"))]
