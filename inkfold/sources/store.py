"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder. Without either only a local session gets a temporary folder; a cluster's executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a Parquet table below the shared folder, read back: computed once, and a lost executor costs a re-read."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
