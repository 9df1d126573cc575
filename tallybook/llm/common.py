"""Helpers that the operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, carry: Sequence[str] | None = None) -> Column:
    """The columns ``carry`` of ``df``, or all, as one struct, so that no name of theirs clashes with ours."""
    return F.struct(*[quoted(c) for c in (df.columns if carry is None else carry)]).alias("_row")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def groups_for(spark: SparkSession, n_bytes: int, group_bytes: int) -> int:
    """Into how many groups to deal ``n_bytes`` so that none is expected to pass ``group_bytes``."""
    return max(parts(spark), math.ceil(n_bytes / group_bytes))


def text_bytes(df: DataFrame, name: str = "text") -> int:
    """Bytes of all texts; one aggregated row comes back."""
    return df.agg(F.sum(F.octet_length(text_or_empty(name)))).first()[0] or 0
