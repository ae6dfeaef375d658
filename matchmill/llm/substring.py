"""Substring dedup by seed and extend: winnowed anchors are the seeds, matching windows extend them to maximal repeats.

A window is `length` consecutive words. Of its runs of `seed` words the one with the least hash is its anchor, so equal
windows have equal anchors, wherever they stand, and a repeat of `length` words or more shares at least one.

1. Join on anchors: an anchor that two documents hold is a seed.
2. Extend: around its seeds each document takes the windows whose anchor is a seed, to both sides as far as they follow one
   another; a window that a smaller doc_id holds too is part of a repeat. Runs of such windows that overlap or touch are the
   maximal repeats, which no word to the left or right would prolong; their words go.

No pairs are made: an anchor or window is compared with the smallest doc_id that holds it. What many documents of one
batch share is settled there, and one row of the batch stands for them in the shuffle, so a passage in a third of all
documents is a group of as many rows as there are batches. Anchors are 64-bit hashes, as a seed too many does no harm;
windows are matched by two hashes of 64 bits each, so even 1e13 windows hold a false match with a probability of 1e-13.

Defined cases: null or empty texts have no words; repeats inside one document stay; rows that repeat a doc_id don't
remove each other, and each loses only what it holds itself; a null doc_id neither gives nor loses words; of documents that share a window the smallest doc_id keeps
it; a very long text is read in one pass of numpy; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .words import Words, mix, passes
from .workers import free

SETTLED = np.uint64(0x9E3779B97F4A7C15)


def _sliding(x: np.ndarray, n: int, f: Callable) -> np.ndarray:
    """f over each n neighbours, in len(x) - n + 1 places, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x, have = f(x[:-step], x[step:]), have + step
    return x


def anchors(words: Words, length: int, seed: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window its place, its hash, its anchor's hash, and another hash if asked for."""
    h = words.hashes()
    window, at = words.windows(length, h)
    if not len(at):
        return at, window, window, window
    other = words.windows(length, mix(h ^ SETTLED), 64)[0] if second else window
    runs = np.zeros(len(h), np.uint64)
    got, place = words.windows(seed, h)
    runs[place] = got
    return at, window, _sliding(runs, length - seed + 1, np.minimum)[at], other


def _settle(key: np.ndarray, other: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys and doc; whether the row's doc is the smallest of its keys here; whether they have another doc here."""
    order = np.lexsort((doc, other, key))
    k, o, d = key[order], other[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first = d == d[begin][group]
    several = np.zeros(len(begin), bool)
    np.logical_or.at(several, group, ~first)
    return order, first, several[group]


def _routed(key: np.ndarray, doc: np.ndarray, pos: np.ndarray | None, other: np.ndarray | None = None, row: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of one batch. settled 0: only one document here; 1: the smallest of several; 2: one of the others, sent
    anywhere as its case is decided. own is the key where route isn't."""
    order, first, several = _settle(key, key if other is None else other, doc)
    k, d = key[order], doc[order]
    settled = np.where(~several, 0, np.where(first, 1, 2)).astype(np.int8)
    moved = settled == 2
    route = np.where(moved, mix(k ^ mix(d.astype(np.uint64) ^ SETTLED)), k)
    arrays = [pa.array(route.view(np.int64)), pa.array(d), pa.array(settled)]
    if pos is None:
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.where(moved, k, np.uint64(0)).view(np.int64))], ["route", "doc_id", "settled", "own"])
    arrays += [pa.array(pos[order].astype(np.int32)), pa.array(other[order].view(np.int64))]
    names = ["route", "doc_id", "settled", "pos", "check"]
    return pa.RecordBatch.from_arrays(arrays, names) if row is None else pa.RecordBatch.from_arrays([*arrays, pa.array(row[order])], [*names, "row"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    free()
    for batch in batches:
        ids, keys, docs = batch.column(0).to_numpy(zero_copy_only=False), [], []
        for i, words in passes(batch.column(1)):
            at, _, anchor, _ = anchors(words, length, seed)
            if not len(at):
                continue
            doc = ids[i + np.searchsorted(words.first, at, "right") - 1]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            keys.append(anchor[new])
            docs.append(doc[new])
        if keys:
            yield _routed(np.concatenate(keys), np.concatenate(docs), None)


def _window_rows(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, seeds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        counts = np.diff(seeds.offsets.to_numpy())
        flat = seeds.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        known = np.sort(flat ^ mix(np.repeat(np.arange(len(ids)), counts).astype(np.uint64)))
        keys, docs, places, others, held = [], [], [], [], []
        numbers = batch.column(3).to_numpy(zero_copy_only=False) if batch.num_columns > 3 else None
        for i, words in passes(batch.column(1)):
            at, window, anchor, check = anchors(words, length, seed, True)
            if not len(at):
                continue
            row = i + np.searchsorted(words.first, at, "right") - 1
            want = anchor ^ mix(row.astype(np.uint64))
            hit = known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want
            keys.append(window[hit])
            docs.append(ids[row[hit]])
            places.append((at - words.first[row - i])[hit])
            others.append(check[hit])
            if numbers is not None:
                held.append(numbers[row[hit]])
        if keys:
            yield _routed(np.concatenate(keys), np.concatenate(docs), np.concatenate(places), np.concatenate(others), np.concatenate(held) if held else None)


def _without(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words of each text that no removed window covers, joined by spaces."""
    for batch in batches:
        places = batch.column(2)
        for i, words in passes(batch.column(1)):
            n = len(words.first) - 1
            kept = []
            removed = np.zeros(n, np.int64)
            for d in range(n):
                a, b = words.first[d], words.first[d + 1]
                stay = np.ones(b - a, bool)
                if (p := places[i + d]).is_valid and len(p.values):
                    edge = np.zeros(b - a + 1, np.int64)
                    p = p.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, np.minimum(p + length, b - a), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                removed[d] = (b - a) - stay.sum()
                kept.append(b" ".join(words.blob[s:e] for s, e in zip(words.start[a:b][stay].tolist(), words.end[a:b][stay].tolist())).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.diff(words.first)), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in _without(batches, length):
        sha = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in b.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], sha], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """Ids and texts, and the column that tells rows apart: the doc_id, or a number where doc_ids are shared. Both joins with
    texts deal them out alike, so Spark writes one shuffle of them for both."""
    texts = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text")
    if texts.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return texts, "doc_id"
    return written(texts.withColumn("row", F.monotonically_increasing_id()), "substring-numbered"), "row"


def _places(texts: DataFrame, own: str, length: int, seed: int) -> DataFrame:
    """(own, places): for each row that has any, where windows start that a smaller doc_id holds too."""
    texts = texts.filter("doc_id IS NOT NULL")
    rows = texts.select("doc_id", "text").mapInArrow(lambda it: _anchor_rows(it, length, seed), "route long, doc_id long, settled byte, own long")
    by = Window.partitionBy("route")
    held = rows.withColumns({"lo": F.min("doc_id").over(by), "hi": F.max("doc_id").over(by), "most": F.max("settled").over(by)})
    seeds = held.filter("lo < hi OR most > 0").select("doc_id", F.when(F.col("settled") == 2, F.col("own")).otherwise(F.col("route")).alias("anchor"))
    seeds = written(seeds.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")), "seeds")
    more = [] if own == "doc_id" else [own]
    schema = ", ".join(["route long, doc_id long, settled byte, pos int, check long", *(f"{c} long" for c in more)])
    near = texts.join(seeds, "doc_id").select("doc_id", "text", "anchors", *more).mapInArrow(lambda it: _window_rows(it, length, seed), schema)
    found = near.withColumn("lo", F.min("doc_id").over(Window.partitionBy("route", "check"))).filter("lo < doc_id OR settled = 2")
    return found.groupBy(own, *(["doc_id"] if more else [])).agg(F.collect_list("pos").alias("places"))


def maximal_repeats(docs: DataFrame, length: int = 13, seed: int = 7) -> DataFrame:
    """(doc_id, first, n_words): the stretches of words that remove() takes out, as first word and number of words."""
    texts, own = _texts(docs)
    at = Window.partitionBy(own).orderBy("place")
    places = _places(texts, own, length, seed).select(*dict.fromkeys((own, "doc_id")), F.explode("places").alias("place"))
    begins = F.coalesce(F.col("place") - F.lag("place").over(at) > length, F.lit(True))
    runs = places.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(at))
    ends = runs.groupBy(*dict.fromkeys((own, "doc_id", "run"))).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return ends.select("doc_id", "first", (F.col("last") + length - F.col("first")).alias("n_words"))


def _with_places(docs: DataFrame, length: int, seed: int) -> DataFrame:
    texts, own = _texts(docs)
    known = texts.filter("doc_id IS NOT NULL").join(_places(texts, own, length, seed).select(own, "places"), own, "left").select("doc_id", "text", "places")
    return known.unionByName(texts.filter("doc_id IS NULL").select("doc_id", "text"), allowMissingColumns=True)


def remove(docs: DataFrame, length: int = 13, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the text without the words of repeats, its words joined by single spaces."""
    return _with_places(docs, length, seed).mapInArrow(lambda it: _without(it, length), "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, length: int = 13, seed: int = 7) -> DataFrame:
    """As remove(), with a hash in place of the text."""
    return _with_places(docs, length, seed).mapInArrow(lambda it: _digested(it, length), "doc_id long, n_words long, n_removed long, kept_sha256 string")
