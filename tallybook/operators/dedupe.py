"""Removal of repeated rows.

Rows combine on the map side, so one repeated a billion times reaches its
reducer as one partial row per task. ``drop_repeats`` and ``count_repeats`` are
hash aggregations. ``keep_first`` holds whole rows as its state, which Spark
aggregates by sorting on the key, before and after the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.schema import named

KEY = ("Date", "Description", "Amount", "Currency")


def repeat_key(df: DataFrame) -> list[str]:
    """Columns on which two rows count as the same, within one source file."""
    return [c for c in (*KEY, "source_file") if c in df.columns]


def drop_repeats(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys or repeat_key(df)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the first by ``order``, with all its other columns."""
    name = {c: named(c) for c in df.columns}
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[name[c] for c in rest]), order).alias("_first")
    picked = df.groupBy(*[name[c] for c in keys]).agg(first)
    return picked.select(*[F.col("_first").getField(c).alias(c) if c in rest else name[c] for c in df.columns])


def count_repeats(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows ``drop_repeats`` removes."""
    groups = df.groupBy(*(keys or repeat_key(df))).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))
