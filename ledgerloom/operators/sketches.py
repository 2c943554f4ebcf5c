"""Counts of distinct values and quantiles that can be stored and merged: sketches by month, joined to any period without a look at the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: a relative standard error of 1.04 / sqrt(2 ** LG_K) for distinct counts, a rank error of about 1.3 % for quantiles.
LG_K, QUANTILE_K = 14, 200


def states(rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """(by, n, distinct_state, quantile_state): binary columns of a bounded size, whatever the rows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_state"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_K).alias("quantile_state"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The states of several groups as one for each of `by`."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_state").alias("distinct_state"), F.kll_merge_agg_double("quantile_state", QUANTILE_K).alias("quantile_state"))


def distinct_count() -> Column:
    return F.hll_sketch_estimate("distinct_state")


def quantile(p: float) -> Column:
    return F.kll_sketch_get_quantile_double("quantile_state", F.lit(p))
