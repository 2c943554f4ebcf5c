"""A record store in buckets of a key: records of all stages in one table, by stage and bucket, so that what is asked by key (the latest record, gates between stages) needs no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path


class BucketStore:
    """Records (key, stage, the columns of a schema) below a path. Each stage's records can be replaced as a whole; others stay as they are.

    The number of buckets is fixed when the table is made: choose it so that a bucket of a stage is a fair task. A bucket is read by one
    task, and a key lies in one bucket: it is for records, of which a document has a few, not for a document's rows.
    """

    def __init__(self, spark: SparkSession, schema: str, key: str = "input_id", buckets: int | None = None, path: str | None = None, name: str | None = None) -> None:
        self.spark, self.key = spark, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.name = name or f"ledgerloom_records_{uuid.uuid4().hex[:12]}"
        where = path or shared_path(spark, "records")
        spark.sql(f"create table if not exists {self.name} ({key} string, {schema}, stage string) using parquet partitioned by (stage) clustered by ({key}) into {self.buckets} buckets location '{where}'")

    def put(self, records: DataFrame, stage: str, replace: bool = False) -> None:
        """Adds records of a stage; with replace they take the place of all that the stage had."""
        columns = self.spark.table(self.name).columns
        rows = records.withColumn("stage", F.lit(stage)).select(*columns).repartition(self.buckets, self.key)  # a file for each bucket
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.write.insertInto(self.name, overwrite=replace)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def of(self, stage: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("stage") == stage).drop("stage")

    def latest(self, stage: str, *order: str) -> DataFrame:
        """The last record of each key in a stage."""
        rows = self.of(stage)
        rest = [c for c in rows.columns if c != self.key]
        # the key itself goes on, not a field of the record: Spark knows then that it is still dealt by it
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(self.key, "_r.*")

    def gate(self, inputs: str, needed: str, condition: str, *order: str) -> DataFrame:
        """The latest records of stage `inputs` with `ready`: whether the latest one of stage `needed` meets the condition."""
        good = self.latest(needed, *order).where(condition).select(self.key, F.lit(True).alias("_good"))
        found = self.latest(inputs, *order).join(good.hint("shuffle_hash"), self.key, "left")
        return found.withColumn("ready", F.coalesce("_good", F.lit(False))).drop("_good")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
