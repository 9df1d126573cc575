"""Approximate medians and distinct counts from sketches that add up, stored by month.

Opt-in counterparts of the exact operators: a month's transactions are read
once, and any span of months is then answered from its sketches alone. A
quantile sketch (KLL) is off by ``QUANTILE_ERROR`` of the ranks at most, a distinct
count (HyperLogLog) by ``DISTINCT_ERROR`` of its value, each with a probability of
99 %. Both have a fixed size whatever the number of rows, so a busy
category is combined on the map side like any aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.measures import cents, month_key
from tallybook.operators.filters import expenses
from tallybook.schema import ANALYSIS, require_columns

QUANTILE_K = 400
QUANTILE_ERROR = 0.0075
DISTINCT_BITS = 14
# Three standard errors of 1.04 / sqrt(2 ** bits).
DISTINCT_ERROR = 0.0244


def monthly_sketches(df: DataFrame) -> DataFrame:
    """``month, Category, amounts, merchants, rows``: sketches of the expenses of each month."""
    require_columns(df, ANALYSIS, "monthly_sketches")
    spent = expenses(df).select(
        month_key(F.col("Date")).alias("month"), "Category", "Description", cents(-F.col("Amount")).alias("_cents")
    )
    return spent.groupBy("month", "Category").agg(
        F.kll_sketch_agg_bigint("_cents", QUANTILE_K).alias("amounts"),
        F.hll_sketch_agg("Description", DISTINCT_BITS).alias("merchants"),
        F.count("*").alias("rows"),
    )


def merge_months(sketches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``Category, median, merchants, rows`` of the months from ``start`` to ``end`` (yyyy-MM, both included)."""
    if start is not None:
        sketches = sketches.filter(F.col("month") >= start)
    if end is not None:
        sketches = sketches.filter(F.col("month") <= end)
    merged = sketches.groupBy("Category").agg(
        F.kll_merge_agg_bigint("amounts", QUANTILE_K).alias("_amounts"),
        F.hll_sketch_estimate(F.hll_union_agg("merchants")).alias("merchants"),
        F.sum("rows").alias("rows"),
    )
    middle = F.kll_sketch_get_quantile_bigint("_amounts", F.lit(0.5))
    return merged.select("Category", (middle / 100.0).alias("median"), "merchants", "rows")
