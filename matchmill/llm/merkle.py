"""Merkle manifest of a dataset in an external-memory node store.

A document's leaf is a hash of its fields. The leaves of a source, in order of doc_id, form a tree in which every three
consecutive nodes have their hash as parent, up to the source's root; the sources' roots, in order, form a tree likewise.

1. Leaf runs: leaves are sorted by (source, doc_id, leaf) into runs, one file each, and written. A leaf's coordinate in
   its source is its place in its run plus the leaves of that source in earlier runs, so no source is ever one group.
2. Node store: level k + 1 reads level k and is written as a Parquet partition of its own. A row holds the hashes of up to
   three children in a row, by coordinate, and their hash, the node.
3. Proofs: BLOCK_LEVELS levels at a time, the rows of all these levels are merged in order of the first leaf below them,
   upper levels first. While such a block of at most 3 ** BLOCK_LEVELS leaves is scanned, the last row of each level is an
   ancestor of the row at hand, whose children hold the siblings. What lies above a block comes from the scan above, one
   row a block, so no proof is shuffled per leaf.

The store stays, as it is the manifest: `roots` and `proofs` read it, and later data can be verified against it.

Defined cases: null fields are hashed as `-`; a null source is a source of its own, before all others; null doc_ids come
first in their source and count as not tampered with; rows with the same doc_id are leaves of their own, ordered by leaf,
so identical rows have proofs that differ by place only; a source of one leaf has that leaf as root; a very long text is
hashed where it is read and not moved; an empty table gives no rows and no root; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import shared_root, written

#: Children of a node, hexadecimal digits of a digest, levels that one scan merges.
ARITY, DIGEST, BLOCK_LEVELS = 3, 64, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STORE = "level int, tree long, at long, left long, children string, node string"
STEPS = "array<struct<before:string,after:string>>"


class Manifest(NamedTuple):
    """Where the two node stores lie, their heights, and the written leaves (row fields, tree, at) and sources (source, tree)."""

    sources: str
    top: str
    height: int
    top_height: int
    leaves: DataFrame
    names: DataFrame


def encoded(field: Column) -> Column:
    """`-` if null, else the value's UTF-8 byte count, a colon and the value."""
    value = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    """The hash of a document's fields, with `text` in place of its text."""
    return F.sha2(F.concat(*(encoded(F.col(f)) for f in FIELDS[:-1]), encoded(text)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the check of the manifest alters the document: the crc32 of its decimal doc_id is even."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _in_order(rows: DataFrame, group: str | None, *order: str) -> DataFrame:
    """`rows` with `at`, the place in order (by `group` where one is given, which must come first in `order`), and `left`,
    the number of rows of the group. Rows are dealt out by ranges, so equal groups span as many tasks as they need."""
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = written(runs.withColumns({"run": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "merkle-runs")
    by = ["run", group] if group else ["run"]
    found = runs.groupBy(*by).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))  # at most runs + groups rows
    all_of = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))  # without a group: one row a run
    earlier = all_of.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select(F.col("run").alias("run_"), *([F.col(group).alias("group_")] if group else []), "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(all_of).alias("left"))
    same = F.col("run") == F.col("run_")
    out = runs.join(starts, same & F.col(group).eqNullSafe(F.col("group_")) if group else same)
    return out.withColumn("at", F.col("place") - F.col("first") + F.col("before")).select(*rows.columns, "at", "left")


def _grow(spark: SparkSession, base: DataFrame, store: str) -> int:
    """Writes all levels above `base` (tree, at, left, node) and gives the number of levels."""
    most, level, below = base.agg(F.max("left")).first()[0] or 0, 0, base
    while most > 1:
        most, level = -(-most // ARITY), level + 1
        child = F.struct("at", "node")
        group = below.filter("left > 1").groupBy("tree", F.expr(f"at div {ARITY}").alias("up"), F.ceil(F.col("left") / ARITY).cast("long").alias("left"))
        rows = group.agg(F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["node"]), "").alias("children"))
        nodes = rows.select("tree", F.col("up").alias("at"), "left", "children", F.sha2("children", 256).alias("node"))
        nodes.sortWithinPartitions("tree", "at").write.parquet(f"{store}/level={level}")
        below = _levels(spark, store, level, level)
    return level


def _levels(spark: SparkSession, store: str, low: int, high: int) -> DataFrame:
    """The rows of some levels of a store; only their partitions are read."""
    return spark.read.schema(STORE).option("basePath", store).parquet(*(f"{store}/level={k}" for k in range(low, high + 1)))


def build(docs: DataFrame) -> Manifest:
    """Writes the node stores of `docs` into the shared folder."""
    spark = docs.sparkSession
    text = F.when(tampered(F.col("doc_id")), F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = docs.select(*FIELDS).select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(tampered(F.col("doc_id")) & F.contains("text", F.lit("\n")), leaf(text)).alias("altered"))
    placed = _in_order(written(fields, "merkle-leaves"), "source", "source", "doc_id", "leaf")
    names = written(_in_order(placed.groupBy("source").agg(F.count(F.lit(1)).alias("n_leaves")), None, "source").withColumnRenamed("at", "tree").drop("left"), "merkle-sources")
    named = names.select(F.col("source").alias("source_"), "tree")
    leaves = written(placed.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_"), "merkle-level-0")
    store, top = (f"{shared_root(spark)}/merkle-{kind}-{uuid4().hex}" for kind in ("nodes", "top"))
    height = _grow(spark, leaves.select("tree", "at", "left", F.col("leaf").alias("node")), store)
    made = Manifest(store, top, height, 0, leaves, names)
    top_height = _grow(spark, subroots(made).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "left", "node"), top)
    return made._replace(top_height=top_height)


def subroots(made: Manifest) -> DataFrame:
    """(tree, node, left) per source: its root, and the number of sources."""
    spark = made.leaves.sparkSession
    lone = made.leaves.filter("left = 1").select("tree", F.col("leaf").alias("node"))
    above = [_levels(spark, made.sources, 1, made.height).filter("left = 1").select("tree", "node")] if made.height else []
    ended = reduce(DataFrame.unionByName, [lone, *above])
    return ended.crossJoin(made.names.agg(F.count(F.lit(1)).alias("left")))  # one row


def root(made: Manifest) -> DataFrame:
    """(root): one row, or none for an empty table."""
    if made.top_height:
        return _levels(made.leaves.sparkSession, made.top, made.top_height, made.top_height).select(F.col("node").alias("root"))
    return subroots(made).select(F.col("node").alias("root"))


def _scan(carriers: DataFrame, rows: DataFrame | None, above: DataFrame, low: int, high: int) -> DataFrame:
    """`carriers` (tree, at, further columns; nodes of level `low`) with their `steps` to the root: `rows` are the store's
    levels low + 1 to high, `above` (tree, block, steps) what is known of each block's node of level `high`."""
    wide = ARITY ** (high - low)
    block = F.expr(f"at div {wide}L")
    if rows is None:
        return carriers.withColumn("block", F.col("at")).join(above, ["tree", "block"]).drop("block")
    height = F.col("level") - low
    reach = F.pow(F.lit(float(ARITY)), height.cast("double")).cast("long")
    first = F.col("at") * reach  # the first carrier below the row
    merged = carriers.withColumns({"block": block, "first": F.col("at"), "level": F.lit(low), "children": F.lit(None).cast("string")}).unionByName(
        rows.select("tree", "at", "level", "children", first.alias("first")).withColumn("block", F.expr(f"first div {wide}L")), allowMissingColumns=True
    )
    merged = merged.unionByName(above.withColumns({"level": F.lit(high + 1), "first": F.col("block") * wide}), allowMissingColumns=True)
    scan = Window.partitionBy("tree", "block").orderBy("first", F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda k, c: F.last(F.when(F.col("level") == k, F.col(c)), ignorenulls=True).over(scan)
    held = merged.withColumns({f"family{k}": last(k, "children") for k in range(low + 1, high + 1)} | {"steps": last(high + 1, "steps")}).filter(F.col("level") == low)
    own = []
    for k in range(low + 1, high + 1):
        place = F.expr(f"int((at div {ARITY ** (k - low - 1)}L) % {ARITY})")
        family = F.col(f"family{k}")
        own.append(F.when(family.isNotNull(), F.struct(family.substr(F.lit(1), place * DIGEST).alias("before"), family.substr((place + 1) * DIGEST + 1, F.lit(ARITY * DIGEST)).alias("after"))))
    steps = F.concat(F.filter(F.array(*own), lambda s: s.isNotNull()), F.col("steps"))
    return held.withColumn("steps", steps).select(*carriers.columns, "steps")


def _climb(carriers: DataFrame, store: str, height: int, end: DataFrame) -> DataFrame:
    """`carriers`, the lowest nodes of the trees of a store, with their `steps` to the root of their tree and on by `end`
    (tree, steps). Upper levels are scanned first; each scan gives the blocks of the one below what lies above them."""
    spark = carriers.sparkSession
    if not height:
        return carriers.join(end, "tree")
    cuts = [*range(0, height, BLOCK_LEVELS), height]
    above = end.select("tree", F.lit(0).cast("long").alias("block"), "steps")
    for low, high in reversed(list(zip(cuts[1:-1], cuts[2:]))):
        # a lower tree has no node of this level: its end is handed on as what lies above its only block
        nodes = _levels(spark, store, low, low).select("tree", "at")
        ended = above.join(nodes.select("tree").filter("at = 0"), "tree", "left_anti")
        seen = _scan(nodes, _levels(spark, store, low + 1, high), above, low, high)
        above = written(seen.select("tree", F.col("at").alias("block"), "steps").unionByName(ended), "merkle-above")
    return _scan(carriers, _levels(spark, store, 1, cuts[1]), above, 0, cuts[1])


def proofs(made: Manifest) -> DataFrame:
    """The leaves (doc_id, source, leaf, altered, at) with their `subroot`, and `steps`: the siblings before and after the
    leaf, then those of each ancestor, level by level to the root of all."""
    none = F.expr(f"cast(array() as {STEPS})")
    spark = made.leaves.sparkSession
    roots = written(subroots(made).select("tree", F.col("node").alias("subroot")), "merkle-subroots")
    end = spark.range(1).select(F.col("id").alias("tree"), none.alias("steps"))
    tops = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "subroot")
    to_root = written(_climb(tops, made.top, made.top_height, end).select(F.col("at").alias("tree"), "steps", "subroot"), "merkle-top-steps")
    carriers = made.leaves.select("tree", "at", "doc_id", "source", "leaf", "altered")
    climbed = _climb(carriers, made.sources, made.height, to_root.select("tree", "steps"))
    return climbed.join(to_root.select("tree", "subroot"), "tree").drop("tree")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, leaf, lambda f, s: F.sha2(F.concat(s["before"], f, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """The digests of a proof, joined level by level from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per document."""
    made = build(docs)
    out = proofs(made).crossJoin(root(made))  # one row
    out = out.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def changed(docs: DataFrame, made: Manifest) -> DataFrame:
    """(source, subroot, found_subroot) of the sources whose documents are no longer those of the manifest, either side null
    where it lacks the source: the first step of a comparison, which then only has to read these sources."""
    new = build(docs)
    side = lambda m, name: subroots(m).join(m.names, "tree").select("source", F.col("node").alias(name))
    old, now = side(made, "subroot").alias("o"), side(new, "found_subroot").alias("n")
    both = old.join(now, F.col("o.source").eqNullSafe(F.col("n.source")), "full")
    pick = F.when(F.col("subroot").isNotNull(), F.col("o.source")).otherwise(F.col("n.source")).alias("source")
    return both.filter(~F.col("subroot").eqNullSafe(F.col("found_subroot"))).select(pick, "subroot", "found_subroot")
