"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are counted in words. Sources share a total by weight, none above twice its size. A source gives all its words as
often as they fit its target; what is missing to the target is drawn without replacement from blocks of its documents.

Blocks are dealt to shards by a hash, which permutes them. A source's quota is split among its shards from the root of a
binary tree: a node with q words to draw gives its left half a hypergeometric share of them and the right half the rest,
so the quotas of the shards add up exactly. Within a shard blocks come in hash order until its quota is full; the last
one is cut. The number of shards grows with the input, so no shard of the largest source outgrows a task.

All choices depend on ids and block numbers alone, so reruns agree, whatever the partitions.

Defined cases: null counts as the empty text, of size 0, which takes nothing; a null source is a source of its own, after
the others; with no words at all nothing is taken; a null doc_id is hashed like any value; rows that repeat a doc_id are
each mixed; a very long text is many blocks in many shards; blocks of equal hash are ordered by doc_id, number and row;
other columns of the input are carried along by mix(), whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import numbered, unused, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2.0
BLOCK_WORDS = 256
#: Words of the input for one shard.
SHARD_WORDS = 1 << 20
#: Numbers from which numpy's generator of hypergeometric numbers gives up.
NUMPY_DRAWS = 10**9
#: Children of a node that one task splits.
FAN_BITS = 10
FAN = 1 << FAN_BITS


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """`sizes` (source, source_size) with `target`: the budget by weight, what is above `most` sizes shared again.

    With sources ordered by most * size / weight, the first are capped and the others share what is left by weight; the
    right number of capped ones is the one after which nobody is above. One row per source is sorted here, not documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(budget) - before) / rest)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def _log_ratio(n: int, k: int, m: int) -> float:
    """log of C(n, k) / C(n, m). Differences of log-factorials come from their series, so large numbers cost no digits."""

    def step(x: int, y: int) -> float:  # log(x! / y!)
        if x == y:
            return 0.0
        if x < y:
            return -step(y, x)
        if x - y <= 64 or y < 1000:
            return math.fsum(math.log(i) for i in range(y + 1, x + 1)) if x - y <= 4096 else math.lgamma(x + 1) - math.lgamma(y + 1)
        d = x - y
        return (y + 0.5) * math.log1p(d / y) + d * (math.log(x) - 1) + (1 / x - 1 / y) / 12 - (1 / x**3 - 1 / y**3) / 360

    return -step(k, m) - step(n - k, n - m)


def hypergeometric(rng: np.random.Generator, left: int, right: int, q: int) -> int:
    """How many of q draws without replacement fall to the left, exactly so for numbers of any size, by the ratio of
    uniforms around the mode; where numpy has the same law (under 10^9) its generator is asked."""
    if left == 0 or q == 0:
        return 0
    if right == 0:
        return q
    if max(left, right) < NUMPY_DRAWS:
        return int(rng.hypergeometric(left, right, q))
    n = left + right
    low, high = max(0, q - right), min(left, q)
    p = left / n
    center = q * p + 0.5
    spread = math.sqrt((n - q) / (n - 1) * q * p * (1 - p) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988  # fixed values: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
    mode = min(high, max(low, (q + 1) * (left + 1) // (n + 2)))
    while True:
        u, v = rng.random(2)
        if u == 0:
            continue
        k = math.floor(center + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= _log_ratio(left, k, mode) + _log_ratio(right, q - k, q - mode):
            return k


def split_quota(counts: np.ndarray, quota: int, seed: tuple[int, ...]) -> np.ndarray:
    """Quotas of the leaves: from the root on, each node gives its left half a hypergeometric share of its quota."""
    n = 1 << max(0, int(len(counts) - 1).bit_length())
    sums = np.zeros(2 * n, np.int64)
    sums[n : n + len(counts)] = counts
    for i in range(n - 1, 0, -1):
        sums[i] = sums[2 * i] + sums[2 * i + 1]
    quotas = np.zeros(2 * n, np.int64)
    quotas[1] = min(quota, int(sums[1]))
    for i in range(1, n):
        if quotas[i]:
            quotas[2 * i] = hypergeometric(np.random.default_rng((*seed, i)), int(sums[2 * i]), int(sums[2 * i + 1]), int(quotas[i]))
            quotas[2 * i + 1] = quotas[i] - quotas[2 * i]
    return quotas[n : n + len(counts)]


def _split(group: pd.DataFrame) -> pd.DataFrame:
    """Quotas of the at most FAN children of one node of one source."""
    g = group.sort_values("node")
    first = int(g["parent"].iloc[0]) * FAN
    counts = np.zeros(int(g["node"].max()) - first + 1, np.int64)
    counts[g["node"] - first] = g["words"]
    source = int(g["source_key"].iloc[0])
    q = split_quota(counts, int(g["quota"].iloc[0]), (source & 0x7FFFFFFFFFFFFFFF, int(g["level"].iloc[0]), first))
    return pd.DataFrame({"source_key": g["source_key"].to_numpy(), "node": g["node"].to_numpy(), "quota": q[g["node"] - first]})


def quotas_of(held: DataFrame, shards: int) -> DataFrame:
    """(source_key, shard, shard_quota) from `held` (source_key, shard, quota, words): the tree is cut into levels of FAN
    children a node, and a task splits one node, so no source is split in one piece however many shards it has."""
    levels = max(1, -(-(shards - 1).bit_length() // FAN_BITS))
    quota = held.groupBy("source_key").agg(F.first("quota").alias("quota")).withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        node = F.shiftright(F.col("shard").cast("long"), FAN_BITS * (levels - 1 - level))
        sums = held.groupBy("source_key", node.alias("node")).agg(F.sum("words").alias("words")).withColumn("parent", F.shiftright("node", FAN_BITS))
        both = sums.join(quota.withColumnRenamed("node", "parent"), ["source_key", "parent"]).withColumn("level", F.lit(level))
        quota = both.groupBy("source_key", "parent").applyInPandas(_split, "source_key long, node long, quota long")
    return quota.select("source_key", F.col("node").cast("int").alias("shard"), F.col("quota").alias("shard_quota"))


def plan(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, size, source_size, target, full) per row of `docs`, which have a row number, and the drawn blocks
    (row, block, words, shard, place)."""
    docs = written(docs.select("row", "doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = shares(sizes).withColumn("source_key", F.xxhash64(F.lit("source"), "source"))
    full = F.when(F.col("source_size") > 0, F.floor((F.col("target") + 1e-6) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = written(targets.withColumn("full", full).withColumn("quota", F.greatest(F.lit(0), F.round(F.col("target") - F.col("full") * F.col("source_size"))).cast("long")), "targets")
    words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shards = 1 << max(4, (int(words) // SHARD_WORDS).bit_length())
    docs = docs.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK_WORDS)))
    blocks = docs.filter("size > 0 AND quota > 0").select("row", "doc_id", "source_key", "quota", "size", block.alias("block"))
    # rows that repeat a doc_id get the same hash, and their copies then follow the row number
    blocks = blocks.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "block")).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    blocks = blocks.withColumn("words", F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("size") - F.col("block") * BLOCK_WORDS))
    held = blocks.groupBy("source_key", "shard", "quota").agg(F.sum("words").alias("words"))
    quotas = quotas_of(written(held, "shards"), shards)
    order = Window.partitionBy("source_key", "shard").orderBy("place", "doc_id", "block", "row").rowsBetween(Window.unboundedPreceding, -1)
    slim = blocks.select("row", "doc_id", "block", "words", "source_key", "shard", "place").withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    left = F.least("words", F.col("shard_quota") - F.col("before"))
    drawn = slim.join(quotas, ["source_key", "shard"]).select("row", "block", left.alias("words"), "shard", "place").filter("words > 0")
    return docs.select("row", "doc_id", "size", "source_size", "target", "full"), drawn


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row; taken counts repeats."""
    rows, drawn = plan(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row")))
    partial = drawn.groupBy("row").agg(F.sum("words").alias("partial"))
    out = rows.join(partial, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("full") + F.coalesce("partial", F.lit(0))).cast("long").alias("taken"))


def _joined(words: Column, drawn: Column) -> Column:
    """The words of drawn blocks (place, block, words), blocks in the order of their places."""
    parts = F.transform(F.sort_array(drawn), lambda b: F.array_join(F.slice(words, b["block"].cast("int") * BLOCK_WORDS + 1, b["words"].cast("int")), " "))
    return F.array_join(parts, "\n")


def mix(docs: DataFrame) -> DataFrame:
    """`docs` with each text as often as it is taken: whole copies, then the drawn blocks in shuffled order, by lines.
    Documents of which nothing is taken go; n_chars, where there is such a column, is counted anew."""
    columns = docs.columns
    row, full, drawn = (unused(docs, c) for c in ("row", "full", "drawn"))
    docs = numbered(docs, row, "mix-input")
    rows, blocks = plan(docs.select(F.col(row).alias("row"), "doc_id", "source", "text"))
    some = blocks.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("place", "block", "words")).alias(drawn))
    whole = rows.select(F.col("row").alias(row), F.col("full").alias(full))
    out = docs.join(whole, row).join(some, row, "left").filter((F.col(full) > 0) | F.col(drawn).isNotNull())
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.when(F.col(drawn).isNotNull(), _joined(words, F.col(drawn)))
    copies = F.when(F.col(full) > 0, F.array_join(F.array_repeat("text", F.col(full).cast("int")), "\n"))
    out = out.withColumn("text", F.concat_ws("\n", copies, part)).select(*columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out
