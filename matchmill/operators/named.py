"""Names in the order and equality that readers of them expect, by collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of the root locale: letters before case, accents after letters. And names that differ in case alone as equal.
ORDER, CASELESS = "UNICODE", "UNICODE_CI"


def by_name(c: str) -> Column:
    return F.collate(F.col(c), ORDER)


def placed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """`df` with `place`, the number of its name among those of its keys in order; names that only differ in bytes come in
    the order of these."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(by_name(name), name)))


def groups(df: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """(key, n, items): rows grouped by a name whatever its case, each group's items in order."""
    rows = df.groupBy(F.collate(F.col(key), CASELESS).alias("same")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*order, item))).alias("x"))
    return rows.select(key, "n", F.transform("x", lambda r: r[item]).alias("items"))
