"""Tables in the folder that driver and executors share: lineage is cut there, and what many branches read is worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own; a cluster gets an error, as its machines share no local one. What lies there goes when the application ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("ledgerloom.core.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("ledgerloom.core.dir", root)
    path = f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again. Files are split when they are read, so that a document of many rows is no single task."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
