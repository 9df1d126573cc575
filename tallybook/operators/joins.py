"""Joins against a side whose size is checked, and joins that stand a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.schema import named

# A broadcast side may hold at most this many keys and bytes of key text.
BROADCAST_KEYS = 100_000
BROADCAST_BYTES = 32 << 20
# Words of 64 bits, broadcast with their numbers, in which the keys of a longer side leave marks.
FILTER_WORDS = 1 << 20


def few_keys(
    df: DataFrame,
    keys: Sequence[str],
    max_keys: int = BROADCAST_KEYS,
    max_bytes: int = BROADCAST_BYTES,
) -> bool:
    """Whether ``df`` has at most ``max_keys`` distinct keys of modest size.

    Reads the key columns only, combines on the map side and stops at the
    limit; it is what a broadcast decision here rests on.
    """
    width = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
    seen = (
        df.select(*keys)
        .distinct()
        .limit(max_keys + 1)
        .agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
        .first()
    )
    return seen["n"] <= max_keys and seen["bytes"] <= max_bytes


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_KEYS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, and their columns as text at most ``max_bytes``.

    Stops at the limit of rows, so that a large ``df`` is not measured to its end.
    """
    width = sum((F.coalesce(F.octet_length(named(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    seen = (
        df.select(width.alias("width"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes"))
        .first()
    )
    return seen["n"] <= max_rows and seen["bytes"] <= max_bytes


def thinned(big: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``big`` without most of the rows whose keys are not in ``side``; no row whose keys are there is lost.

    Keys mark two bits of one of at most ``FILTER_WORDS`` words, whatever their
    number; the words are broadcast. Past some ten keys a word more and more
    rows stay, which costs work only.
    """
    code = F.xxhash64(*[named(k) for k in keys])
    bit = lambda shift: F.expr(f"shiftleft(1L, cast((_code >> {shift}) & 63 as int))")
    word, marks = F.col("_code").bitwiseAND(FILTER_WORDS - 1), bit(32).bitwiseOR(bit(40))
    words = side.select(code.alias("_code")).groupBy(word.alias("_word")).agg(F.bit_or(marks).alias("_marks"))
    coded = big.withColumn("_code", code).withColumn("_word", word)
    met = coded.join(words.hint("broadcast"), "_word").filter(F.col("_marks").bitwiseAND(marks) == marks)
    return met.select(*map(named, big.columns))


def lookup(
    big: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    max_rows: int = BROADCAST_KEYS,
    how: str = "left",
    thin: bool = False,
) -> DataFrame:
    """Join of ``big`` to ``side``: broadcast if checked small, else a sort-merge join.

    In the latter the adaptive planner splits partitions of ``big`` that a hot
    key fills, by map output and thus also where its rows are all alike.
    With ``thin``, an inner sort-merge join shuffles only rows of ``big`` that may
    meet one of ``side`` (the planner would move a left_semi join below that choice).
    ``side`` should be stored or cheap, as it is measured first. ``how`` is
    left, inner or left_semi.
    """
    if fits_broadcast(side, max_rows):
        return big.join(side.hint("broadcast"), list(keys), how)
    if thin and how == "inner":
        big = thinned(big, side, keys)
    return big.join(side.hint("merge"), list(keys), how)
