"""Substring deduplication of word windows by fixed-block anchors.

A window of ``window`` words is repeated if the same words also start in a row
of smaller id. Every row is cut into non-overlapping blocks of half a window,
so a repeated window holds a whole block of the earlier row. Those blocks are
the index; each row probes it with all its rolling windows of block length.
Around hits, on both sides, all windows are fingerprinted with 104 bits, and
the row of smallest id that holds a window keeps it: what overlapping repeated
windows cover is a maximal exact repeat. Fingerprints are rolling sums over two
independent 64-bit XXH3 hashes of each whole word (XXH64 in the first step,
where a false match costs work only), so words of any length and make, also
such that polynomials of their letters would confuse, count as different.

Blocks are every half window among the rolling windows of the same pass, so
index and probes travel in one packed shuffle, bucket by fingerprint. A common
passage costs a bucket one entry per home of texts, see ``positions``. Texts are
dealt by a hash of the row, once for each of three steps; nothing is broadcast
and no pair of rows is ever built.

Null text: no words. Texts shorter than a window: kept whole. Rows of equal id
are no source for one another; null ids come after all others. Repeated rows
are all returned, judged alike. Empty table: empty result. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from tallybook.llm import positions as P
from tallybook.llm.common import groups_for, text_bytes
from tallybook.session import stored

WINDOW = 50
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, seeds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start of each word in ``data``, and ``seeds`` (1 or 2) independent 64-bit hashes of it."""
    word = ~_SPACE[data]
    starts = np.flatnonzero(word & np.append(True, ~word[:-1])) if len(data) else np.empty(0, np.int64)
    raw, digest = data.tobytes(), xxhash.xxh64_digest if seeds == 1 else xxhash.xxh3_128_digest
    hashed = b"".join(map(digest, raw.split()))
    return starts, list(np.frombuffer(hashed, np.uint64).reshape(-1, seeds).T.copy())


def _windows(chunk: P.Chunk, width: int, seeds: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row and word position of each window of ``width`` words, with its fingerprints; and words per row."""
    starts, hashed = word_hashes(chunk.data, seeds)
    row = np.searchsorted(chunk.starts, starts, side="right") - 1
    counts = np.bincount(row, minlength=len(chunk.starts))
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    n = max(len(row) - width + 1, 0)
    whole = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.empty(0, np.int64)
    prints = [P.prints_at(h, whole, width, m) for h, m in zip(hashed, P.MULTIPLIERS, strict=False)]
    return row[whole], place[whole], prints


def _in_two_rows(entries: P.Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated fingerprints: their entries in order, run starts, and whether each run has two ids."""
    order, cut = P.runs(entries)
    ids = entries.ids[entries.doc[order]]
    return order, cut, ids[cut[:-1]] != ids[cut[1:] - 1]


def _judge_blocks(local: bool):
    """Hits: windows found in two ids, one of them a block; within a home any two ids will do."""

    def judge(entries: P.Entries) -> tuple[np.ndarray, np.ndarray]:
        order, cut, two = _in_two_rows(entries)
        hit, send = np.zeros(len(entries.pos), bool), np.ones(len(entries.pos), bool)
        if len(order):
            block = np.logical_or.reduceat(entries.flag[order], cut[:-1])
            chosen = two if local else two & block
            hit[order[np.repeat(chosen, np.diff(cut))]] = True
            if local:
                # One entry stands for a settled run, as a block if the run has one.
                first = order[cut[:-1][two]]
                send &= ~hit
                send[first] = True
                entries.flag[first] = block[two]
        return hit, send

    return judge


def _judge_repeats(entries: P.Entries) -> tuple[np.ndarray, np.ndarray]:
    """Repeats: windows of an id greater than the smallest that has them."""
    order, cut, _ = _in_two_rows(entries)
    later = np.zeros(len(entries.pos), bool)
    if len(order):
        ids = entries.ids[entries.doc[order]]
        later[order[ids > np.repeat(ids[cut[:-1]], np.diff(cut))]] = True
    return later, ~later


def repeats(docs: DataFrame, doc_id: str, text: str, window: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """The keyed rows, and the packed word positions at which repeated windows start."""
    block = window // 2
    rows = P.keyed(docs, doc_id, text, groups)
    homes = rows.select("home", "id", "key", "text").groupBy("home")

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = P.Chunk.of(rows)
        row, place, prints = _windows(chunk, block, 1)
        return P.messages(chunk.entries(row, place, prints, place % block == 0), _judge_blocks(local=True), groups)

    hits = stored(P.settle(homes.applyInPandas(probe, P.MESSAGE), _judge_blocks(local=False)))

    def extend(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(told):
            return P.nothing()
        chunk = P.Chunk.of(rows)
        row, place, prints = _windows(chunk, window, 2)
        near = np.zeros(len(row), bool)
        cut = np.searchsorted(row, np.arange(len(chunk.keys) + 1))
        for a, b, starts in zip(cut[:-1], cut[1:], P.found_by_rank(told, len(chunk.keys)), strict=True):
            if len(starts) and b > a:
                near[a:b] = P.covered(starts, window - block, 1, int(b - a))
        at = np.flatnonzero(near)
        entries = chunk.entries(row[at], place[at], [p[at] for p in prints], np.zeros(len(at), bool))
        return P.messages(entries, _judge_repeats, groups)

    near = homes.cogroup(hits.groupBy("home")).applyInPandas(extend, P.MESSAGE)
    found = stored(P.settle(near, _judge_repeats))
    return rows, found


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of each row.

    ``spans`` are the removed runs in words, from 0, end exclusive; ``kept`` the other words joined by spaces.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    groups = groups_for(docs.sparkSession, text_bytes(docs, text), P.GROUP_BYTES)
    rows, found = repeats(docs, doc_id, text, window, groups)

    def cut(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        n_words, n_removed, spans, kept = [], [], [], []
        for t, starts in zip(rows["text"], P.found_by_row(rows, told), strict=True):
            words = t.encode().split()
            gone = P.covered(starts, 0, window, len(words))
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            spans.append(P.spans_of(gone))
            left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            kept.append(b" ".join(left).decode())
        return pd.DataFrame(
            {"doc_id": rows["doc_id"], "n_words": n_words, "n_removed": n_removed, "spans": spans, "kept": kept}
        )

    kind = dict(docs.dtypes)[doc_id]
    return (
        rows.select("home", "key", "text", "doc_id")
        .groupBy("home")
        .cogroup(found.groupBy("home"))
        .applyInPandas(cut, f"doc_id {kind}, n_words long, n_removed long, spans array<array<long>>, kept string")
    )
