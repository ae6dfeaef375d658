"""Tables written between the jobs of one operator, in the folder all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, or the context's checkpoint folder. Where neither is set, a temporary
    folder on one machine (tests), and an error on a cluster, whose executors don't share such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("matchmill.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-matchmill-')}"
        spark.conf.set("matchmill.scratch", root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: its lineage ends there, so a lost executor costs only reads."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers of this session get at most so many rows at once: whole texts, so Spark's 10,000 would be tens of
    MB in the JVM and again in the worker. A lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` gave, once all that was made of them is written itself."""
    for table in tables:
        if path := _paths.pop(table, None):
            spark = table.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def numbered(docs: DataFrame, row: str, label: str, *order: Column) -> DataFrame:
    """`docs` with a unique number in the new column `row`: the doc_id where none is null or repeated, and nothing is
    written; else a written copy with numbers, in `order` if one is given."""
    whole = dict(docs.dtypes)["doc_id"] in ("bigint", "int")
    if whole and docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    return written((docs.orderBy(*order) if order else docs).withColumn(row, F.monotonically_increasing_id()), label)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front of it as long as `df` has a column that Spark takes for the same."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
