"""Joins by time: the last row before, within a tolerance, and points within intervals. Both are equi-joins on bins of time: no row meets all others, and a hot key is dealt over its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: str, tolerance: int, prefix: str = "last_") -> DataFrame:
    """left with the columns of the last row of right with equal keys, at its day or up to `tolerance` days before, named with prefix; null where there is none.

    Of right's rows of one day the one with the largest `order` is the last. Rows of left with a null key or day stay and
    meet none. A row of right goes to its bin of `tolerance` days and to the next, so that one window over key and bin sees
    all that a row of left may meet.
    """
    rest = [c for c in right.columns if c not in keys]
    one = lambda b: F.floor(day(at) / tolerance) + b
    row = F.struct(*(F.col(c).alias(f"{prefix}{c}") for c in rest))
    whole = F.col(at).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    r = right.where(whole).select(*keys, F.explode(F.array(one(0), one(1))).alias("_bin"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(order).alias("_order"), row.alias("_right"), F.lit(None).cast(left.schema).alias("_left"))
    here = F.struct(*left.columns)
    n = left.where(whole).select(*keys, one(0).alias("_bin"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_order"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), here.alias("_left"))
    w = Window.partitionBy(*keys, "_bin").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    met = r.unionByName(n).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    near = F.datediff(F.col("_at"), F.col(f"_found.{prefix}{at}")) <= tolerance
    out = met.select("_left.*", F.when(near, F.col("_found")).alias("_found"))
    lone = left.where(~F.coalesce(whole, F.lit(False))).withColumn("_found", F.lit(None).cast(r.schema["_right"].dataType))
    return out.unionByName(lone).select(*left.columns, "_found.*")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of a point and an interval with equal keys and start <= at < end (days): the columns of both, those of intervals but the keys. width: days of a bin, about the length of an interval. Empty intervals and nulls meet nothing."""
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(day(start) / width), F.floor((day(end) - 1) / width))))
    p = points.withColumn("_bin", F.floor(day(at) / width))
    return p.join(i, [*keys, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin")
