"""Grouping of spelling variants by finite-state composition.

Words near to one another, by one inserted, deleted or replaced code point, are
the pairs that the composition A o E o A accepts: A is the minimised acceptor of
the vocabulary, E the transducer of two states that copies letters, makes one
edit on the way from its first state to its second, and copies on. While E is in
its first state the composition walks the diagonal of A x A; an edit leads off
it, after which both sides go on in step. So that each pair is accepted once, an
inserted letter differs from the one that follows it.

Partition by initial state: an edit lies in one half of a word. With m the length of the shorter
word, pairs edited after letter h share the first h letters, that is the state
of the diagonal from which the composition starts; those edited before it share
the last m - h, the state in which it ends. A word stands in one partition for
each half, once as the shorter and once as the longer word of a pair. A partition of
more than ``GROUP_WORDS`` words is parted again, by halves of the stretch where
the edit lies, until none is too large or the stretch is a single letter; then
it holds no more words than the alphabet has pairs of letters. No word is ever
left out, and no partition is compared pair by pair.

Each partition's acceptor is built from its words in order, with one register of
states for shorter and longer words, so that states with equal continuations are
one; where both sides of the composition reach the same state, everything from there on is common.

Scale: words are counted by each task before they are shuffled; from then on
work grows with the vocabulary, four short rows a word. Partitions are dealt to
buckets of bounded size. A word has at most some thousand near words, and forms
are chained at most log(n) deep, as each step multiplies the count.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, in which A-Z are lower-cased.
Null text: no words. Null id: counts as the empty string where ids matter. Long
texts are cut at word ends, and words of any length are taken. Equal rows count
as often as they occur. Ties: the smallest form in code-point order. Empty
table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import parts, quoted, text_or_empty
from tallybook.operators.joins import lookup
from tallybook.session import stored

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
GROUP_WORDS = 4096
BUCKET_ROWS = 20_000
_SLICE = 1 << 20
_HELD_WORDS = 200_000
# Latin-1 bytes: A-Z lower-cased, letters as they are, all others a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time."""
    raw, at = text.encode("latin-1", "replace").translate(_LETTERS), 0
    while at < len(raw):
        end = raw.find(b" ", at + _SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _thinned(word: bytes, prefix: int, every: int) -> bytes:
    """``word`` without one letter, if its checksum after the id's says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(
    docs: DataFrame,
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    doc_id: str = "doc_id",
    drop_every: int | None = None,
) -> DataFrame:
    """(word, n): the words of at least ``min_length`` letters that occur ``min_count`` times or more.

    With ``drop_every`` a word loses a letter wherever that number divides the
    crc32 of ``<id>:<word>``, which plants misspellings that repeat from run to run.
    """

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}

        def out() -> pd.DataFrame:
            words = pd.Series([w.decode("latin-1") for w in held], dtype=object)
            return pd.DataFrame({"word": words, "n": pd.Series(list(held.values()), dtype="int64")})

        for frame in frames:
            for i, t in zip(frame["id"], frame["text"], strict=True):
                prefix = zlib.crc32(f"{i}:".encode()) if drop_every else 0
                for words in _slices(t):
                    once: dict[bytes, int] = {}
                    for w in words:
                        if len(w) >= min_length:
                            once[w] = once.get(w, 0) + 1
                    for w, n in once.items():
                        if drop_every and len(w := _thinned(w, prefix, drop_every)) < min_length:
                            continue
                        held[w] = held.get(w, 0) + n
                    if len(held) > _HELD_WORDS:
                        yield out()
                        held.clear()
        yield out()

    read = docs.select(
        F.coalesce(quoted(doc_id).cast("string"), F.lit("")).alias("id") if drop_every else F.lit("").alias("id"),
        text_or_empty(text).alias("text"),
    )
    found = read.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= min_count)


class Acceptors:
    """Minimal acyclic acceptors of words of one length each, over one register of states.

    State 0 is final. ``arcs`` holds each state's letters and where they lead.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.register: dict[tuple, int] = {(): 0}

    def _settled(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
        return state

    def add(self, words: Sequence[str]) -> int | None:
        """The initial state of the acceptor of ``words``: sorted, distinct, of one length, not empty."""
        if not words:
            return None
        path: list[dict[str, int]] = [{}]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                state = self._settled(path.pop())
                path[-1][last[len(path) - 1]] = state
            path += [{} for _ in range(len(word) - same)]
            last = word
        while len(path) > 1:
            state = self._settled(path.pop())
            path[-1][last[len(path) - 1]] = state
        return self._settled(path[0])

    def common(self, p: int, q: int) -> Iterator[str]:
        """The strings that lead to the end from both states."""
        arcs, todo = self.arcs, [(p, q, "")]
        while todo:
            p, q, head = todo.pop()
            if p == 0:
                yield head
            elif p == q:
                todo += [(s, s, head + c) for c, s in arcs[p].items()]
            else:
                other = arcs[q]
                todo += [(s, other[c], head + c) for c, s in arcs[p].items() if c in other]

    def near(self, short: int, long: int | None, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs one edit apart: both accepted from ``short``, or one from ``short`` and one, a letter longer, from ``long``.

        A letter inserted after all others counts only with ``at_end``.
        """
        arcs = self.arcs
        diagonal: list[tuple[int, int | None, str]] = [(short, long, "")]
        while diagonal:
            p, q, head = diagonal.pop()
            here = arcs[p]
            for (c, s), (d, t) in itertools.combinations(here.items(), 2):
                for tail in self.common(s, t):
                    yield head + c + tail, head + d + tail
            if q is not None:
                for c, t in arcs[q].items():
                    after = arcs[t]
                    for d, s in here.items():
                        if d != c and d in after:
                            for tail in self.common(s, after[d]):
                                yield head + d + tail, head + c + d + tail
                    if p == 0 and at_end:
                        yield head, head + c
            there = arcs[q] if q is not None else {}
            diagonal += [(s, there.get(c), head + c) for c, s in here.items()]


def _pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of all partitions of one bucket, both ways round."""
    groups: dict[tuple, dict[str, int]] = {}
    for m, a, b, word, n in zip(*[frame[c].tolist() for c in ("m", "a", "b", "word", "n")], strict=True):
        end = len(word) - (m - b)
        groups.setdefault((m, a, b, word[:a], word[end:]), {})[word[a:end]] = n
    out: list[tuple[str, int, str, int]] = []
    for (m, a, b, head, tail), words in groups.items():
        if len(words) < 2:
            continue
        machine = Acceptors()
        short = machine.add(sorted(w for w in words if len(w) == b - a))
        if short is None:
            continue
        long = machine.add(sorted(w for w in words if len(w) > b - a))
        for u, v in machine.near(short, long, b == m):
            out.append((head + u + tail, words[u], head + v + tail, words[v]))
    made = pd.DataFrame(out, columns=["word", "n", "near", "near_n"], dtype=object)
    turned = made[["near", "near_n", "word", "n"]].set_axis(made.columns, axis=1)
    return pd.concat([made, turned], ignore_index=True)


def _stretch(a: Column | str, b: Column | str) -> Column:
    return F.struct(F.col("m").alias("m"), F.lit(a).alias("a"), F.lit(b).alias("b"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` of (m, a, b, word, n) with ``key``, which tells partitions apart."""
    head, tail = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - F.col("m") + F.col("b") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("m", "a", "b", head, tail))


def _halved(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """``rows`` of (m, word, n), once for each half of the stretch from a to b."""
    middle = F.floor((a + b) / 2).cast("int")
    halves = F.array(_stretch(a, middle), _stretch(middle, b))
    return _keyed(rows.select(F.explode(halves).alias("_s"), "word", "n").select("_s.*", "word", "n"))


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of near words; ``words`` has distinct ``word`` of 3 letters or more, and ``n``."""
    length = F.length("word")
    classes = words.select(F.explode(F.array(length, length - 1)).alias("m"), "word", "n")
    todo = stored(_halved(classes, F.lit(0), F.col("m")))
    ready = []
    while True:
        sizes = todo.filter(F.col("b") - F.col("a") > 1).groupBy("key").agg(F.count("*").alias("_rows"))
        large = stored(sizes.filter(F.col("_rows") > group_words).select("key", F.lit(True).alias("_large")))
        if large.isEmpty():
            ready.append(todo)
            break
        marked = lookup(todo, large, ["key"])
        ready.append(marked.filter("_large IS NULL").drop("_large"))
        todo = stored(_halved(marked.filter("_large").select("m", "a", "b", "word", "n"), F.col("a"), F.col("b")))
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    buckets = max(parts(words.sparkSession), math.ceil(rows.count() / bucket_rows))
    dealt = rows.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "m", "a", "b", "word", "n")
    return dealt.groupBy("bucket").applyInPandas(lambda frame: _pairs(frame), "word string, n long, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that ``forms``, (word, form), lead to; stored. Each round doubles the steps seen."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hops = stored(lookup(now, ahead, ["root"]))
        now = hops.select("word", F.coalesce("_next", "root").alias("root"))
        if hops.filter("_next IS NOT NULL").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words``, (word, n).

    The form is the commonest near word, if it is ``ratio`` times as common or
    more; the root is where forms lead to in the end.
    """
    words = stored(words.select("word", "n"))
    pairs = near_pairs(words, group_words)
    alone = words.withColumn("near", F.lit(None).cast("string")).withColumn("near_n", F.lit(None).cast("long"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))))
    judged = (
        alone.unionByName(pairs)
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("_best"))
        .withColumn("_far", -F.col("_best.m") >= ratio * F.col("n"))
        .select(
            "word",
            F.when(F.col("_far"), F.col("_best.near")).alias("form"),
            "n",
            "n_near",
            F.when(F.col("_far"), -F.col("_best.m")).alias("form_n"),
        )
    )
    judged = stored(judged)
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
