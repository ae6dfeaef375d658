"""Tables that several parts of one query read, written once."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def settled(df: DataFrame, label: str, *order: str) -> DataFrame:
    """`df` written to the folder of `spark.checkpoint.dir` and read again, so that it is computed once and a lost executor
    costs reads only. Where no folder is set it goes to a temporary one on a single machine, and stays as it is on a
    cluster, whose executors share none; then each reader computes it."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("matchmill.settled", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            return df
        root = f"file://{tempfile.mkdtemp(prefix='spark-settled-')}"
        spark.conf.set("matchmill.settled", root)
    path = f"{root.rstrip('/')}/{label}-{uuid4().hex}"
    (df.sortWithinPartitions(*order) if order else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
