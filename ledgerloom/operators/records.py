"""Append-only records: write, latest by key, gates between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Adds records to a table of files."""
    w = df.write.mode("append")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key by order (its columns in turn). One partial aggregate, no sort of a key's rows."""
    picked = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return picked.select("_r.*")


def ready(inputs: DataFrame, needed: DataFrame, key: str, condition) -> tuple[DataFrame, DataFrame]:
    """Inputs whose record in needed meets the condition, and those refused."""
    good = needed.where(condition).select(key)
    return inputs.join(good, key, "left_semi"), inputs.join(good, key, "left_anti")


def singular_alias(df: DataFrame, plural: str = "transactions", singular: str = "transaction") -> DataFrame:
    """Either name for the list of transactions."""
    if singular not in df.columns:
        return df
    if plural not in df.columns:
        return df.withColumnRenamed(singular, plural)
    return df.withColumn(plural, F.coalesce(plural, singular)).drop(singular)


def reconciled(before: DataFrame, after: DataFrame, key: str = "input_id") -> DataFrame:
    """(key, same, removed, added): rows of two versions of each document, compared as multisets of their common columns; a row that is there twice in one and once in the other is once the same."""
    columns = [c for c in before.columns if c in after.columns]
    a, b = before.select(*columns), after.select(*columns)
    parts = [(a.intersectAll(b), "same"), (a.exceptAll(b), "removed"), (b.exceptAll(a), "added")]
    rows = None
    for df, name in parts:
        counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        rows = counted if rows is None else rows.unionByName(counted)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0).cast("long")).alias(name)
    return rows.groupBy(key).agg(*(of(name) for _, name in parts))
