"""Exact medians that never put a whole group in one task.

The input is a stored frequency table: one row per group, whole-number value
and count. A table of at most ``DIRECT_ROWS`` rows is aggregated directly:
that bound on the table bounds what any one task can hold.

A longer table is searched in two levels. Values are split into as many ranges
as a range has values, by the span of the values in the table. The first level
adds up counts per range and finds the one or two ranges that hold the middle
ranks; the second level looks only into those. Each level sees at most about
the root of the span as distinct rows per group: 2**16 for a span of 2**32 (43
million in whole currency units, for values in cents), whatever the number of
transactions behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A range holds at least 2**16 values; more where the values span more than 2**32.
RANGE_BITS = 16
DIRECT_ROWS = 1_000_000


def frequencies(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count of each (keys, value): combined on the map side, spread over values."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("weight"))


def is_short(freq: DataFrame) -> bool:
    """Whether a stored frequency table is short enough for direct medians."""
    return freq.count() <= DIRECT_ROWS


def direct_twice_median(value: str | Column) -> Column:
    """Aggregate expression over ``weight``; for short tables only."""
    middle = F.percentile(value, F.lit(0.5), F.col("weight"))
    return F.round(middle * 2).cast("bigint")


def twice_median(
    freq: DataFrame, keys: Sequence[str], value: str, direct: bool | None = None
) -> DataFrame:
    """``keys, twice, n``: twice the exact median (a whole number), and the count.

    ``freq`` has columns ``keys``, ``value`` (bigint) and ``weight``; keys must
    not be null.
    """
    if is_short(freq) if direct is None else direct:
        return freq.groupBy(*keys).agg(
            direct_twice_median(value).alias("twice"), F.sum("weight").alias("n")
        )
    return _by_ranges(freq, keys, value)


def range_bits(freq: DataFrame, value: str) -> int:
    """How many bits of a value are its place in its range: half those of the span of all values."""
    ends = freq.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    span = 0 if ends["low"] is None else ends["high"] - ends["low"]
    return max(RANGE_BITS, (span.bit_length() + 1) // 2)


def _by_ranges(freq: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    keys = list(keys)
    group = Window.partitionBy(*keys)
    ranged = freq.withColumn("_range", F.shiftright(F.col(value), range_bits(freq, value)))
    upto = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    level = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("weight").alias("_c"))
        .withColumns({"_end": F.sum("_c").over(upto), "n": F.sum("_c").over(group)})
        .withColumns(
            {
                "_start": F.col("_end") - F.col("_c"),
                "_lo": F.expr("(n + 1) div 2"),
                "_hi": F.expr("n div 2 + 1"),
            }
        )
        .filter((F.col("_end") >= F.col("_lo")) & (F.col("_start") < F.col("_hi")))
        .select(*keys, "_range", "_start", "_lo", "_hi", "n")
    )
    within = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rank_end = F.min("_start").over(group) + F.sum("weight").over(within)
    return (
        ranged.join(level, [*keys, "_range"])
        .withColumn("_rank", rank_end)
        .groupBy(*keys)
        .agg(
            (
                F.min(F.when(F.col("_rank") >= F.col("_lo"), F.col(value)))
                + F.min(F.when(F.col("_rank") >= F.col("_hi"), F.col(value)))
            ).alias("twice"),
            F.first("n").alias("n"),
        )
    )
