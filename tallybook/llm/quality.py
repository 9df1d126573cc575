"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at a document's own figures and votes for (1) or against (-1)
it, or abstains (0). No rule is a filter by itself. The votes of all documents
are counted by pattern (at most 3 ** rules rows, whatever the input), and
expectation-maximisation on these counts estimates how often a good and a bad
document get each vote. A document's verdict is its posterior probability of
being good.

DataFrame functions only: the figures are computed inside the row, so no
document is split over a shuffle and no key can be hot; the only shuffle is
that of the pattern counts, combined on the map side. One row of sums returns
to the driver in each round of EM.

Null text: as empty. Empty or white-space text: no words, fails the base rule.
Repeated rows: judged alike, each kept or dropped with its twin. Empty table:
empty result. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, boxed, text_or_empty
from tallybook.session import stored

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ROUNDS = 12
MIN_WORDS = 50


def figures(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``_row`` (the document's columns ``carry``, or all) and one struct ``_fig`` of its figures.

    Repeated 3-word windows are found by sorting, per document, 64-bit values
    made of a window's hash and its position; neighbours of equal hash are
    compared word by word before they count.
    """
    words, n = F.col("_w"), F.col("_n")
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int")

    def window_at(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def packed(i: Column) -> Column:
        return F.call_function("shiftleft", window_at(i), F.col("_bits")).bitwiseOR(i.cast("long"))

    def hash_of(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("_bits"))

    def place_of(x: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
        return x.bitwiseAND(low).cast("int")

    def same(i: Column, j: Column) -> Column:
        return reduce(operator.and_, [F.get(words, i + k) == F.get(words, j + k) for k in range(3)])

    sorted_, one, two = F.col("_s"), F.col("_lead"), F.col("_pairs")
    empty_longs, empty_ints = F.array().cast("array<bigint>"), F.array().cast("array<int>")
    split = (
        docs.select(boxed(docs, carry), text_or_empty(text).alias("_t"))
        .withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
        .withColumn("_n", F.size("_w"))
        .withColumn("_bits", bits)
        .withColumn(
            "_s",
            F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), packed))).otherwise(empty_longs),
        )
        .withColumn(
            "_lead",
            F.when(
                F.size(sorted_) >= 2,
                F.filter(
                    F.sequence(F.lit(1), F.size(sorted_) - 1),
                    lambda i: hash_of(F.get(sorted_, i)) == hash_of(F.get(sorted_, i - 1)),
                ),
            ).otherwise(empty_ints),
        )
        .withColumn(
            "_pairs",
            F.filter(
                F.transform(
                    one,
                    lambda i: F.struct(
                        place_of(F.get(sorted_, i - 1)).alias("a"), place_of(F.get(sorted_, i)).alias("b")
                    ),
                ),
                lambda p: same(p["a"], p["b"]),
            ),
        )
        .withColumn(
            "_covered",
            F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            two,
                            lambda p: F.array(*[p[side] + k for side in ("a", "b") for k in range(3)]),
                        )
                    )
                )
            ),
        )
        .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    )

    # What is neither a small letter nor white space is rare; the other counts look at that alone.
    split = split.withColumn("_rest", F.regexp_replace("_t", r"[\p{Ll}\x20\x09-\x0D]+", ""))

    def among_rest(chars: str) -> Column:
        return (F.length("_rest") - F.length(F.translate("_rest", chars, ""))).cast("long")

    word_chars = F.length(F.array_join("_w", "")).cast("long")
    not_letters = F.length(F.regexp_replace("_rest", r"\p{L}+", "")).cast("long")
    return split.select(
        "_row",
        F.struct(
            n.cast("long").alias("n_words"),
            word_chars.alias("word_chars"),
            among_rest("#*$%&|<>").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.col("_covered").cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
            (word_chars - not_letters).alias("n_letters"),
            (F.length("_rest") - F.length(F.regexp_replace("_rest", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            among_rest(".!?").alias("n_stops"),
            among_rest("!?").alias("n_shouts"),
        ).alias("_fig"),
    )


def _rate(over: str, under: str) -> Column:
    return F.col(f"_fig.{over}") / F.greatest(F.col(f"_fig.{under}"), F.lit(1))


def _vote(against: Column, in_favour: Column) -> Column:
    return F.when(against, F.lit(-1)).when(in_favour, F.lit(1)).otherwise(F.lit(0))


def default_rules() -> dict[str, Column]:
    """Votes on the figures; the bounds are those that published web-text filters use, loosened.

    Most rules know one symptom: they vote against a document that has it and
    abstain on all others, as its absence says little. Two look for prose.
    """
    n, mean = F.col("_fig.n_words"), _rate("word_chars", "n_words")
    letters, marks = _rate("n_letters", "word_chars"), _rate("n_stops", "n_words")
    upper, symbols = _rate("n_upper", "n_letters"), _rate("n_symbols", "n_words")
    never = F.lit(False)
    return {
        "length": _vote(n < MIN_WORDS, never),
        "repeats": _vote(_rate("n_repeat_words", "n_words") > 0.3, never),
        "symbols": _vote(symbols > 0.1, never),
        "lines": _vote(_rate("n_dup_lines", "n_lines") > 0.3, never),
        "word_length": _vote((mean < 2.5) | (mean > 14), never),
        "upper": _vote(upper > 0.3, never),
        "shouts": _vote(_rate("n_shouts", "n_words") > 0.2, never),
        "variety": _vote(_rate("n_distinct", "n_words") < 0.1, never),
        "letters": _vote(letters < 0.8, letters >= 0.93),
        "sentences": _vote(marks == 0, marks.between(1 / 60, 1 / 3) & (upper < 0.12) & (symbols < 0.05)),
    }


def _log_odds(names: list[str], accuracy: Mapping[str, float], balance: float) -> Column:
    """Log odds of a good document, given its votes; an abstention says nothing."""
    total = F.lit(math.log(balance / (1 - balance)))
    for name in names:
        total = total + F.col(f"_votes.{name}") * F.lit(math.log(accuracy[name] / (1 - accuracy[name])))
    return total


def _posterior(names: list[str], accuracy: Mapping[str, float], balance: float) -> Column:
    return 1 / (1 + F.exp(-_log_odds(names, accuracy, balance)))


def estimate(
    votes: DataFrame,
    names: list[str],
    rounds: int = ROUNDS,
    balance: float = 0.5,
    trust: tuple[float, float] = (9, 1),
    tolerance: float = 1e-4,
) -> dict[str, float]:
    """How often each rule's votes (struct ``_votes``) are right, by EM over the counts of vote patterns.

    ``balance`` is the belief in a document before any vote; it is given, not
    fitted, since rules that fire on few documents cannot tell a rare class
    from their own mistakes. ``trust`` counts imagined right and wrong votes;
    they are the starting point and keep accuracies inside (0, 1).
    """
    patterns = stored(votes.groupBy("_votes").count().coalesce(1))
    accuracy = dict.fromkeys(names, trust[0] / sum(trust))
    for _ in range(rounds):
        held = patterns.select("_votes", "count", _posterior(names, accuracy, balance).alias("_good"))
        sums = []
        for name in names:
            vote = F.col(f"_votes.{name}")
            right = F.when(vote == 1, F.col("_good")).when(vote == -1, 1 - F.col("_good"))
            sums += [
                F.coalesce(F.sum(F.col("count") * right), F.lit(0.0)).alias(f"right_{name}"),
                F.coalesce(F.sum(F.when(vote != 0, F.col("count"))), F.lit(0)).alias(f"cast_{name}"),
            ]
        got = held.agg(*sums).first().asDict()
        old = accuracy
        accuracy = {k: (got[f"right_{k}"] + trust[0]) / (got[f"cast_{k}"] + sum(trust)) for k in names}
        if max(abs(accuracy[k] - old[k]) for k in names) < tolerance:
            break
    return accuracy


def judge(
    docs: DataFrame,
    text: str = "text",
    rules: Callable[[], Mapping[str, Column]] = default_rules,
    threshold: float = 0.5,
    rounds: int = ROUNDS,
    balance: float = 0.5,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``_row``, the figures ``_fig``, the votes, ``posterior``, ``base_failed`` and ``kept``.

    Figures and votes are stored once; the documents are read by one job.
    """
    voting = dict(rules())
    names = list(voting)
    judged = stored(
        figures(docs, text, carry).withColumn("_votes", F.struct(*[v.alias(k) for k, v in voting.items()]))
    )
    accuracy = estimate(judged, names, rounds, balance)
    n, repeats = F.col("_fig.n_words"), F.col("_fig.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeats > 50 * n)
    return (
        judged.withColumn("posterior", _posterior(names, accuracy, balance))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    return judge(docs, text).filter("kept").select("_row.*")
