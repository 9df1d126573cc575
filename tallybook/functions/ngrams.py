"""Character n-grams inside word bounds, as one native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_bounded_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """n-grams of every word padded by one blank on each side, ``low..high``.

    A padded word no longer than ``n`` gives itself once, and longer n are
    then skipped for it. Repeats are kept: they are the term frequencies.
    """
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(word: Column, n: int) -> Column:
        length = F.length(word)
        starts = F.sequence(F.lit(1), length - n + 1)
        sliding = F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))
        shortest = n - 1 if n > low else 0
        return (
            F.when(length > n, sliding)
            .when(length > shortest, F.array(word))
            .otherwise(F.array().cast("array<string>"))
        )

    def grams(word: Column) -> Column:
        return F.flatten(F.array(*[of_size(word, n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(padded, grams))
