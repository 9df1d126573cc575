"""Suffix-array deduplication by difference-cover blockwise construction.

A byte is removed if a string of ``window`` bytes around it also starts
earlier: in a row of smaller id, or in the same row further left. The order of
suffixes is needed to a depth of ``window`` bytes only, so a suffix stands for
the window that starts with it.

* Cover sample. Positions x with x mod 57 in a difference cover are sampled,
  one in seven. For any two positions there is an offset below 57 at which both
  are sampled, so equal windows share a sampled pair of equal keys of
  window - 56 bytes. All samples are sorted, one bucket at a time, and those of
  equal key are tied.
* Contexts. Around a tied sample, all windows that reach it lie in its context,
  from 56 bytes before it to a window's length behind. Where contexts are equal
  too, all those windows are settled at once: they belong to the first. Samples
  whose key comes with one context only need nothing further.
* Suffixes. What is left, next to places where repeats begin and end, is dealt
  to suffix buckets and sorted one bucket at a time; within a tie, row and
  position decide which suffix comes first.

Keys are compared by fingerprint (48 bits for samples, where a false tie costs
work only, 104 bits for suffixes), not letter by letter: an order of
fingerprints puts equal strings side by side as an order of letters does, and
lets a suffix travel in a few bytes. Memory: a bucket or a home of texts, see
``positions``; neither grows with the table. A common passage costs a bucket one
entry per home.

Null text: no bytes. Rows of equal id are told apart by position only; null
ids come after all others. Repeated rows are all returned, judged alike. Texts
shorter than a window: kept whole. Empty table: empty result. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import positions as P
from tallybook.llm.common import groups_for, text_bytes
from tallybook.session import stored

WINDOW = 100
PERIOD = 57
# Every difference modulo PERIOD occurs between two of these.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)


# No byte of UTF-8; a window's length of it before and after each text keeps contexts apart from other texts.
GAP = b"\xff"


def _samples(chunk: P.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of each sampled window of ``width`` bytes within a row."""
    places = []
    longest = int(chunk.lengths.max(initial=0))
    all_ = (np.arange(0, longest + 1, PERIOD)[:, None] + np.array(COVER)).ravel()
    for n in chunk.lengths.tolist():
        places.append(all_[: np.searchsorted(all_, n - width, side="right")])
    return np.repeat(np.arange(len(places)), [len(x) for x in places]), np.concatenate(places)


def _prints(chunk: P.Chunk, row: np.ndarray, first: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Fingerprints of the ``width`` bytes from ``first`` on, which may lie in the gap around the row."""
    return P.prints_at(chunk.data, chunk.starts[row] + first, width, P.MULTIPLIERS[multiplier])


def _judge_ties(entries: P.Entries) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a repeated key are tied; one of them has to be known elsewhere."""
    order, cut = P.runs(entries)
    tied = np.zeros(len(entries.pos), bool)
    tied[order] = True
    send = ~tied
    send[order[cut[:-1]]] = True
    return tied, send


def _judge_later(entries: P.Entries) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a tie but the first by id and position; the first ones stay open."""
    order, cut = P.runs(entries)
    later = np.zeros(len(entries.pos), bool)
    if len(order):
        ids, pos = entries.ids[entries.doc[order]], entries.pos[order]
        first = np.repeat(cut[:-1], np.diff(cut))
        later[order[(ids > ids[first]) | (pos > pos[first])]] = True
    return later, ~later


def _judge_contexts(entries: P.Entries) -> tuple[np.ndarray, np.ndarray]:
    """Later ones of equal context, and, flagged, those left of a key that has several contexts."""
    later, left = _judge_later(entries)
    keys = np.sort(entries.prints[0][left])
    several = np.unique(keys[:-1][keys[1:] == keys[:-1]])
    entries.flag[:] = left & np.isin(entries.prints[0], several)
    return later | entries.flag, left


def repeats(docs: DataFrame, doc_id: str, text: str, window: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """The keyed rows, and packed byte positions with a ``kind``.

    Kind 1 are suffixes whose window also starts earlier. An unflagged sample of
    kind 0 stands for all the suffixes that reach it.
    """
    reach = PERIOD - 1
    rows = P.keyed(docs, doc_id, text, groups)
    homes = rows.select("home", "id", "key", "text").groupBy("home")

    def sample(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = P.Chunk.of(rows, GAP * window)
        row, place = _samples(chunk, window - reach)
        prints = [_prints(chunk, row, place, window - reach, 0)]
        return P.messages(chunk.entries(row, place, prints, np.zeros(len(row), bool)), _judge_ties, groups)

    tied = stored(P.settle(homes.applyInPandas(sample, P.MESSAGE), _judge_ties))

    def contexts(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(told):
            return P.nothing()
        chunk = P.Chunk.of(rows, GAP * window)
        found = P.found_by_rank(told, len(chunk.keys))
        row, place = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
        prints = [
            _prints(chunk, row, place, window - reach, 0),
            _prints(chunk, row, place - reach, window + reach, 1),
        ]
        entries = chunk.entries(row, place, prints, np.zeros(len(row), bool))
        return P.messages(entries, _judge_later, groups)

    near = homes.cogroup(tied.groupBy("home")).applyInPandas(contexts, P.MESSAGE)
    settled = stored(P.settle(near, _judge_contexts))

    def suffixes(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(told):
            return P.nothing()
        chunk = P.Chunk.of(rows, GAP * window)
        left = []
        kinds = [P.found_by_rank(told, len(chunk.keys), flag) for flag in (False, True)]
        for n, closed, open_ in zip(chunk.lengths.tolist(), *kinds, strict=True):
            near = P.covered(open_, reach, 1, n) & ~P.covered(closed, reach, 1, n)
            left.append(np.flatnonzero(near[: max(n - window + 1, 0)]))
        row, place = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.concatenate(left)
        prints = [_prints(chunk, row, place, window, m) for m in (0, 1)]
        return P.messages(chunk.entries(row, place, prints, np.ones(len(row), bool)), _judge_later, groups)

    near = homes.cogroup(settled.groupBy("home")).applyInPandas(suffixes, P.MESSAGE)
    found = stored(P.settle(near, _judge_later))
    return rows, settled.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row.

    ``spans`` are the maximal removed runs in bytes, from 0, end exclusive; ``kept`` holds the other bytes.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} bytes at least")
    groups = groups_for(docs.sparkSession, text_bytes(docs, text), P.GROUP_BYTES)
    rows, found = repeats(docs, doc_id, text, window, groups)

    def cut(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        n_bytes, n_removed, spans, kept = [], [], [], []
        samples = P.found_by_row(rows, told[told["kind"] == 0], False)
        suffixes = P.found_by_row(rows, told[told["kind"] == 1])
        for t, closed, later in zip(rows["text"], samples, suffixes, strict=True):
            raw = t.encode()
            repeated = P.covered(closed, PERIOD - 1, 1, len(raw))
            repeated[later] = True
            starts = np.flatnonzero(repeated[: max(len(raw) - window + 1, 0)])
            gone = P.covered(starts, 0, window, len(raw))
            n_bytes.append(len(raw))
            n_removed.append(int(gone.sum()))
            spans.append(P.spans_of(gone))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw)
        return pd.DataFrame(
            {"doc_id": rows["doc_id"], "n_bytes": n_bytes, "n_removed": n_removed, "spans": spans, "kept": kept}
        )

    kind = dict(docs.dtypes)[doc_id]
    return (
        rows.select("home", "key", "text", "doc_id")
        .groupBy("home")
        .cogroup(found.groupBy("home"))
        .applyInPandas(cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    )
