"""Shared plumbing of the training-data operators: shared storage, table access, small helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows handed to a Python worker at once; small, as single texts can be very long.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster gets an error, as its machines share no local one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("ledgerloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("ledgerloom.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut and survives lost executors. The table goes when the application ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    ends_with_application(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def ends_with_application(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


#: How to empty what each operator's functions keep in a worker process, which Spark uses again for the next operator.
_caches: dict[str, Callable[[], None]] = {}


def kept_by(name: str, clear: Callable[[], None]) -> None:
    _caches[name] = clear


def only(name: str) -> None:
    """Empties what other operators have kept in this worker: its memory is that of one operator."""
    for other, clear in _caches.items():
        if other != name:
            clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, over as many partitions as there are cores if it has fewer: a file of one row group would keep one core busy."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of texts in a Python worker, and lets workers import this package from where the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def schema_of(df: DataFrame, ddl: str, *passed: str) -> T.StructType:
    """The fields of ddl, and those of df by name that are passed on as they are."""
    fields = [*T.StructType.fromDDL(ddl).fields] if ddl else []
    return T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in passed), *fields])
