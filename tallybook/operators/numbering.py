"""Rows numbered in a global order without putting them all in one task."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.schema import named
from tallybook.session import stored

# A row id holds its partition above this many bits, its place there below.
_PLACE_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 by ``order``; stored.

    Rows are dealt to ranges and sorted within them; a row's number is its
    place in its range and the rows of the ranges before. Of each range only
    the count goes to the driver. ``order`` should tell all rows apart: ties
    are numbered in any order.
    """
    keys: list[Column] = [named(c) for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = stored(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _PLACE_BITS)
    counts = dict(held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    ends = itertools.accumulate(counts.get(p, 0) for p in range(max(counts, default=-1) + 1))
    before = F.array(*[F.lit(n) for n in (0, *ends)])
    place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    number = F.element_at(before, (part + 1).cast("int")) + place
    return held.withColumn(name, number.cast("bigint")).drop("_id")
