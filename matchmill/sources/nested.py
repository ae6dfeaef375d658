"""Prices in JSON documents of unknown nesting, found in one walk through each document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchmill.functions.semantics import normalize_name, to_fixed
from matchmill.operators.model import normalize_odds

#: Under which names a node holds its prices and its bookmaker, and what a node without one is called.
PRICES = {
    "home": ("home", "homeOdds", "homeValue", "oddsHome", "choice1.value"),
    "draw": ("draw", "drawOdds", "drawValue", "oddsDraw", "choiceX.value"),
    "away": ("away", "awayOdds", "awayValue", "oddsAway", "choice2.value"),
}
BOOKMAKER, NO_BOOKMAKER = ("bookmaker.name", "bookmakerName", "provider", "name", "marketName"), "Sofascore"
LEAST_PRICE, MOST_BOOKS = 1.01, 8
NUMBER = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", re.ASCII)
HOLDERS = (dict, list)
_BOOKMAKER, *_PRICES = ([tuple(n.partition(".")[::2]) for n in names] for names in (BOOKMAKER, *PRICES.values()))


def brackets(json: Column) -> Column:
    """The brackets of a document in their order, without those in strings."""
    plain = F.regexp_replace(json, r"(?s)\\.", "")  # an escape stands in a string only, so every quote left ends or begins one
    return F.regexp_replace(plain, r'"[^"]*"|[^\[\]{}"]+', "")


def nesting(json: Column) -> Column:
    """How deep a document is nested at most, by its brackets."""
    deeper = lambda x, c: F.struct((x["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(x["most"], x["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(F.split(brackets(json), ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper, lambda x: x["most"])


def _first(node: dict, names: list[tuple[str, str]]) -> Any:
    """The first of a node's fields that isn't missing, null, false, zero or empty; objects and arrays count, even empty ones."""
    for name, inner in names:
        if name in node:
            x = node[name]
            if inner:
                x = x.get(inner) if isinstance(x, dict) else None
            if x or isinstance(x, HOLDERS):
                return x
    return None


def _number(x: Any) -> float:
    if isinstance(x, str):
        return float(x) if NUMBER.fullmatch(x) else 0.0
    return x if isinstance(x, float) else 0.0


def _walked(document: str | None) -> Iterator[tuple[list[int], str, float, float, float]]:
    """(place, bookmaker, home, draw, away) of a document's priced nodes as they are read. Nodes wait on a stack, so no depth is
    too much for the walk; a document that can't be parsed has none."""
    try:
        whole = json.loads(document or "null", parse_int=float, parse_constant=_refused)
    except (ValueError, RecursionError):
        return
    waiting = [([], whole)] if isinstance(whole, HOLDERS) else []
    while waiting:
        place, node = waiting.pop()
        inner = node
        if isinstance(node, dict):
            inner = node.values()
            prices = []
            for names in _PRICES:
                if (price := _number(_first(node, names))) <= LEAST_PRICE:
                    break
                prices.append(price)
            else:
                name = _first(node, _BOOKMAKER)
                yield place, _text(NO_BOOKMAKER if name is None else name), *prices
        waiting += [([*place, i], x) for i, x in enumerate(inner) if isinstance(x, HOLDERS)][::-1]


def _text(x: Any) -> str:
    """A value as text; what stands for half a character becomes a question mark, as no table holds it."""
    return (x if isinstance(x, str) else json.dumps(x, ensure_ascii=False).removesuffix(".0")).encode("utf-8", "replace").decode()


def _refused(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


def price_nodes(docs: DataFrame, json: str, id: str) -> DataFrame:
    """(id, place, bookmaker, home, draw, away): the nodes that hold three prices above the least one, with their places: the
    positions of their ancestors among their siblings, so that places sort as the document is read.

    A document is read once and its containers are visited in their order; nothing of it moves between tasks but what is
    found. (Variants don't keep the order of keys; opening them level by level read the text anew at each level.)"""
    rows = docs.select(F.col(id).alias("id"), F.col(json).alias("document"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("place array<int>, bookmaker string, home double, draw double, away double")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *x) for i, d in enumerate(batch.column(1).to_pylist()) for x in _walked(d)]
            at, *columns = zip(*found) if found else [()] * 6
            own = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], arrow.names)

    return rows.mapInArrow(run, schema)


def book_signals(prices: DataFrame) -> DataFrame:
    """(id, book, bookmaker, diff, strength, lean, agreement): of each document the first node of each bookmaker, the first
    bookmakers in reading order, and what their prices lean to."""
    rows = prices.withColumn("book", normalize_name(F.col("bookmaker"))).filter("book <> ''").repartition("id")
    order = Window.partitionBy("id").orderBy("place")
    again = F.row_number().over(Window.partitionBy("id", "book").orderBy("place"))
    first = rows.withColumn("n", again).filter("n = 1").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_BOOKS)
    h, d, a = normalize_odds(F.col("home"), F.col("draw"), F.col("away"))
    shares = first.select("id", "book", "bookmaker", h.alias("h"), d.alias("d"), a.alias("a"))
    lean = F.when((F.col("h") >= F.col("a")) & (F.col("h") >= F.col("d")), "home").when(F.col("a") >= F.col("d"), "away").otherwise("neutral")
    out = shares.select("id", "book", "bookmaker", to_fixed(F.col("h") - F.col("a"), 2).alias("diff"), to_fixed(F.greatest("h", "d", "a") * 0.9, 2).alias("strength"), lean.alias("lean"))
    leaning = F.avg(F.when(F.col("lean") == "neutral", 0.0).otherwise(1.0)).over(Window.partitionBy("id"))
    return out.withColumn("agreement", to_fixed(leaning, 2))
