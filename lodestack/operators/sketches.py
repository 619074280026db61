"""Mergeable sketches of distinct counts and quantiles, kept by day and group and merged when they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of an HLL sketch are 2 to the power of this; K of a KLL sketch bounds its rank error.
LG_K, KLL_K = 12, 200
#: Relative standard error of the HLL estimate (1.04 / sqrt(2^LG_K) for merged sketches), and rank error of KLL at 99 %.
HLL_RSE, KLL_RANK = 1.04 / 2 ** (LG_K / 2), 0.0133


def daily(rows: DataFrame, by: list[str], at: Column, item: Column, value: Column) -> DataFrame:
    """by, day, n, items (HLL), values (KLL): one row of some kilobytes for each group and day, whatever its rows.

    Partial sketches are made where rows are read, so only sketches are shuffled. Null items and values are not counted; a
    group without a value has a null sketch of them."""
    return rows.groupBy(*by, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, LG_K).alias("items"), F.call_function("kll_sketch_agg_double", value.cast("double"), F.lit(KLL_K)).alias("values"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, n, items, values over all days of the table (filter it first)."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.call_function("kll_merge_agg_double", F.col("values")).alias("values"))


def distinct(items: Column) -> Column:
    """The estimated number of distinct items."""
    return F.hll_sketch_estimate(items)


def quantile(values: Column, share: float) -> Column:
    """The estimated value at that rank (0 to 1)."""
    return F.call_function("kll_sketch_get_quantile_double", values, F.lit(share))
