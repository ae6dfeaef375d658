"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of fixed size. Equal blocks get one integer name and different blocks different
ones; then neighbouring names are paired and the pairs named in the same way, until each document has one name. With the
number of blocks it is the document's identity, and no two different texts share it.

Names come from sorting: items fall into buckets by a 64-bit hash, the items of a bucket are sorted and numbered, and the
name is (bucket, number). The smallest and the largest item of a bucket come from one pre-aggregated shuffle; where they
are equal the bucket holds one item, number 0, and its text isn't moved again. Only contested buckets are sorted out in full.

Defined cases: null counts as the empty text; all empty texts are equal; of rows with equal text, length and doc_id one
stays; a null doc_id comes after all others; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import numbered, unused, written

WS = " \t\n\x0b\x0c\r"
BLOCK_CHARS = 1024
#: Parts in which the rows of one identity are joined to what is known of it.
PARTS = 32


def _contested(items: DataFrame, label: str) -> DataFrame:
    """Numbers of the items in buckets that hold more than one: (bucket, item, number). Mostly empty, and written."""
    ends = items.groupBy("bucket").agg(F.min("item").alias("lo"), F.max("item").alias("hi"))
    buckets = written(ends.filter("lo <> hi").select("bucket"), f"{label}-buckets")
    numbered = items.join(buckets, "bucket").distinct()
    order = Window.partitionBy("bucket").orderBy("item")
    return buckets if buckets.isEmpty() else written(numbered.withColumn("number", F.row_number().over(order) - 1), label)


def _named(rows: DataFrame, bucket_of: Callable[[Column], Column], label: str) -> DataFrame:
    """`rows` with its array `items` replaced by `names`, an array of (bucket, number)."""
    contested = _contested(rows.select(F.explode("items").alias("item")).select(bucket_of(F.col("item")).alias("bucket"), "item"), label)
    if "number" not in contested.columns:
        return rows.withColumn("names", F.transform("items", lambda x: F.struct(bucket_of(x).alias("bucket"), F.lit(0).alias("number")))).drop("items")
    others = [c for c in rows.columns if c != "items"]
    each = rows.withColumn("whole", F.monotonically_increasing_id()).select("whole", *others, F.posexplode("items").alias("at", "item"))
    each = each.withColumn("bucket", bucket_of(F.col("item"))).join(contested, ["bucket", "item"], "left")
    name = F.struct("at", "bucket", F.coalesce("number", F.lit(0)).alias("number"))
    back = each.groupBy("whole").agg(F.sort_array(F.collect_list(name)).alias("names"), *(F.first(c).alias(c) for c in others))
    return back.select(*others, F.transform("names", lambda x: F.struct(x["bucket"].alias("bucket"), x["number"].alias("number"))).alias("names"))


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_of: Callable[..., Column] = F.xxhash64, keep_row: bool = False) -> DataFrame:
    """(row, doc_id, n_chars, text_sha256, identity) per row; n_chars counts the original text. The result is written.
    keep_row: `docs` has a unique number `row` to use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("row" if keep_row else F.monotonically_increasing_id().alias("row"), "doc_id", F.length(text).alias("n_chars"), F.translate(text, WS, "").alias("plain"))
    blocks = F.when(F.length("plain") > 0, F.regexp_extract_all("plain", F.lit(f"(?s).{{1,{block_chars}}}+"), F.lit(0))).otherwise(F.array(F.lit("")))
    base = base.select("row", "doc_id", "n_chars", F.sha2("plain", 256).alias("text_sha256"), blocks.alias("items"))
    rows = _named(base, lambda x: hash_of(F.lit(0), x), "block-names")
    rows = written(rows.select("row", "doc_id", "n_chars", "text_sha256", F.size("names").alias("n_blocks"), "names"), "block-level-0")
    left, level = rows.agg(F.max("n_blocks")).first()[0] or 1, 0
    ended = [rows.filter(F.size("names") <= 1)]  # each text is written at its own levels only
    while left > 1:
        left, level = (left + 1) // 2, level + 1
        pairs = F.transform(F.sequence(F.lit(0), F.greatest((F.size("names") - 1).cast("int"), F.lit(0)), F.lit(2)), lambda i: F.struct(F.get("names", i).alias("l"), F.get("names", i + 1).alias("r")))
        bucket = lambda p, level=level: hash_of(F.lit(level), p["l"]["bucket"], p["l"]["number"], p["r"]["bucket"], p["r"]["number"])
        rows = written(_named(rows.filter(F.size("names") > 1).withColumn("items", pairs).drop("names"), bucket, f"block-names-{level}"), f"block-level-{level}")
        ended.append(rows.filter(F.size("names") <= 1))
    return reduce(DataFrame.unionByName, ended).select("row", "doc_id", "n_chars", "text_sha256", F.struct("n_blocks", F.get("names", F.lit(0)).alias("name")).alias("identity"))


def groups(docs: DataFrame, **how) -> DataFrame:
    """One row per document: keep_id, group_size, kept and text_sha256.

    Of a group the longest original text stays, then the smallest doc_id. Only identities that occur twice or more are
    joined back, and they are counted before the shuffle. The rows of an identity fall into PARTS, and what is known of
    it goes to the parts that exist, so a large group is joined in as many tasks and a small one gives few rows more."""
    return _judged(identities(docs, **how)).drop("row")


def _judged(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    parts = rows.groupBy("identity", "part").agg(F.count(F.lit(1)).alias("size"), F.min(rank).alias("first"))
    shared = parts.groupBy("identity").agg(F.sum("size").alias("group_size"), F.min("first").alias("best"), F.collect_list("part").alias("parts")).filter("group_size > 1")
    out = rows.join(shared.withColumn("part", F.explode("parts")).drop("parts"), ["identity", "part"], "left")
    alone = F.col("best").isNull()
    return out.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that groups() drops, row by row, so rows that share a doc_id but not their text stay."""
    columns, row = docs.columns, unused(docs, "row")
    rows = numbered(docs, row, "exact-numbered")
    judged = _judged(identities(rows.select("doc_id", "text", F.col(row).alias("row")), keep_row=True))
    dropped = written(judged.filter("NOT kept").select(F.col("row").alias(row)), "exact-dropped")
    return rows.join(dropped, row, "left_anti").select(*columns)
