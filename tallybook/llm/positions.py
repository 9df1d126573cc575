"""Window fingerprints by position: sent packed, ranked bucket by bucket, and brought back to their texts.

Both substring operators ask the same of many positions at once: does the
window that starts here also start elsewhere, or earlier? A position becomes a
few packed bytes (rolling fingerprint, place in its text); positions are dealt
to buckets by fingerprint, and each bucket is sorted by itself. Answers return
packed, dealt to the group of their text.

Bounds. Rows are dealt to homes of a few megabytes of text by a hash of the row;
a longer text is taken whole. A home sends one representative for windows that
it holds several times, so that a bucket gets from a common passage one entry
per home, not per copy. Numbers of buckets and homes follow the bytes of input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import quoted, text_or_empty

GROUP_BYTES = 4 << 20
BLOCK = 1 << 16
# Ids order as they are; a null id comes after all others.
LAST = (1 << 63) - 1
MESSAGE = "bucket int, home int, packed binary"
ANSWER = "home int, packed binary"
# What is sent of fingerprints: 48 bits where a false match costs work only, else 104 in two.
ONE_PRINT = np.uint64((1 << 48) - 1)
TWO_PRINTS = (np.uint64((1 << 48) - 1), np.uint64((1 << 56) - 1))
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def keyed(docs: DataFrame, doc_id: str, text: str, groups: int) -> DataFrame:
    """(home, id, key, text, doc_id): ``key`` tells rows of different id or text apart, ``home`` is its group."""
    key = F.xxhash64(quoted(doc_id), text_or_empty(text))
    return docs.select(
        F.pmod(key, F.lit(groups)).cast("int").alias("home"),
        F.coalesce(quoted(doc_id).cast("long"), F.lit(LAST)).alias("id"),
        key.alias("key"),
        text_or_empty(text).alias("text"),
        quoted(doc_id).alias("doc_id"),
    )


@dataclass
class Chunk:
    """The different rows of a home, ordered by key, their texts in one array with ``gap`` around each."""

    home: int
    keys: np.ndarray
    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, gap: bytes = b" ") -> Chunk:
        keys, first = np.unique(rows["key"].to_numpy(), return_index=True)
        texts = [rows["text"].iat[i].encode() for i in first.tolist()]
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths + len(gap)) - lengths
        data = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
        return cls(int(rows["home"].iat[0]), keys, rows["id"].to_numpy()[first], data, starts, lengths)

    def entries(self, row: np.ndarray, place: np.ndarray, prints: list[np.ndarray], flag: np.ndarray) -> Entries:
        n = len(self.keys)
        return Entries(np.full(n, self.home), np.arange(n), self.ids, row, place, prints, flag)


@functools.cache
def _powers(multiplier: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, multiplier, np.uint64)))


def prints_at(values: np.ndarray, at: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """Fingerprints of the ``width`` values from each place in ``at`` (ascending) on.

    A window's polynomial is the difference of two running sums, brought to a
    common power. Sums are taken block by block, so the space needed beside the
    values is that of a block. Arithmetic is modulo 2 ** 64, as numpy's unsigned
    numbers wrap round.
    """
    power = _powers(int(multiplier), BLOCK + width)
    out = np.empty(len(at), np.uint64)
    i = 0
    while i < len(at):
        low = int(at[i])
        j = int(np.searchsorted(at, low + BLOCK))
        span = int(at[j - 1]) - low + width
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum(values[low : low + span] * power[:span], out=sums[1:])
        x = at[i:j] - low
        out[i:j] = (sums[x + width] - sums[x]) * power[BLOCK + width - x]
        i = j
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, which compress where high bytes are equal."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


@dataclass
class Entries:
    """Positions ``pos`` of rows ``doc``, sorted by row and position.

    A row is known by its ``home`` and its rank among the keys there.
    """

    homes: np.ndarray
    ranks: np.ndarray
    ids: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    prints: list[np.ndarray]
    flag: np.ndarray

    def pick(self, at: np.ndarray) -> Entries:
        prints = [p[at] for p in self.prints]
        return Entries(self.homes, self.ranks, self.ids, self.doc[at], self.pos[at], prints, self.flag[at])

    def pack(self) -> bytes:
        """All entries as bytes; they are of one home."""
        used, first, counts = np.unique(self.doc, return_index=True, return_counts=True)
        step = np.diff(self.pos, prepend=0)
        step[first] = self.pos[first]
        head = np.array([self.homes[used[0]], len(used), len(self.pos), len(self.prints)], np.int64).tobytes()
        docs = [np.diff(self.ranks[used], prepend=0).astype(np.uint32), self.ids[used], counts.astype(np.uint32)]
        return head + b"".join(map(_planes, [*docs, step.astype(np.uint32), self.flag, *self.prints]))

    @classmethod
    def unpack(cls, packed: Sequence[bytes]) -> Entries:
        """All entries of several packs, in their order; a row may occur in more than one."""
        homes, ranks, ids, docs, poss, flags, prints = [], [], [], [], [], [], []
        base = 0
        for raw in packed:
            home, n_docs, n, n_prints = np.frombuffer(raw, np.int64, 4).tolist()
            at = 32

            def take(count: int, kind: type, raw: bytes = raw) -> np.ndarray:
                nonlocal at
                size = np.dtype(kind).itemsize
                plane = np.frombuffer(raw, np.uint8, count * size, at).reshape(size, count).T
                at += count * size
                return np.ascontiguousarray(plane).view(kind).ravel()

            homes.append(np.full(n_docs, home))
            ranks.append(np.cumsum(take(n_docs, np.uint32).astype(np.int64)))
            ids.append(take(n_docs, np.int64))
            counts = take(n_docs, np.uint32).astype(np.int64)
            run = np.cumsum(take(n, np.uint32).astype(np.int64))
            flags.append(take(n, np.bool_))
            prints.append([take(n, np.uint64) for _ in range(n_prints)])
            before = np.concatenate([[0], run[np.cumsum(counts)[:-1] - 1]])
            poss.append(run - np.repeat(before, counts))
            docs.append(np.repeat(np.arange(n_docs), counts) + base)
            base += n_docs
        cat = np.concatenate
        columns = [cat(x) for x in (homes, ranks, ids, docs, poss)]
        return cls(*columns, [cat(p) for p in zip(*prints, strict=True)], cat(flags))


def runs(entries: Entries) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose fingerprint occurs more than once, ordered by fingerprint, id and position; run starts.

    Returned as places in ``entries``, and as places in that order, the total at the end.
    """
    first = entries.prints[0]
    order = np.argsort(first)
    equal = first[order[1:]] == first[order[:-1]]
    more = order[np.append(equal, False) | np.append(False, equal)]
    more = more[np.lexsort((entries.pos[more], entries.ids[entries.doc[more]], *[p[more] for p in entries.prints[::-1]]))]
    new = np.zeros(len(more), bool)
    for p in entries.prints:
        new[1:] |= p[more[1:]] != p[more[:-1]]
    if len(more):
        new[0] = True
    return more, np.append(np.flatnonzero(new), len(more))


def _by(where: np.ndarray, entries: Entries) -> Iterator[tuple[int, bytes]]:
    """Packs of the entries of each destination."""
    order = np.argsort(where, kind="stable")
    at, first = np.unique(where[order], return_index=True)
    for w, part in zip(at.tolist(), np.split(order, first[1:]), strict=True):
        yield w, entries.pick(part).pack()


def answers(entries: Entries, chosen: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(home, pack) for the chosen entries, without fingerprints."""
    at = np.flatnonzero(chosen)
    if len(at):
        at = at[np.lexsort((entries.pos[at], entries.ranks[entries.doc[at]]))]
        # A row that several packs named becomes one.
        rows, doc = np.unique(
            np.stack([entries.homes[entries.doc[at]], entries.ranks[entries.doc[at]]]), axis=1, return_inverse=True
        )
        told = Entries(rows[0], rows[1], np.zeros(rows.shape[1], np.int64), doc.ravel(), entries.pos[at], [], entries.flag[at])
        yield from _by(rows[0][told.doc], told)


def messages(
    entries: Entries, judge: Callable[[Entries], tuple[np.ndarray, np.ndarray]], buckets: int
) -> pd.DataFrame:
    """What a home sends: entries still open, by bucket, and what is settled within the home, to itself.

    ``judge`` returns which entries are settled (answered yes), and which of all still have to be sent.
    """
    rows: list[tuple[int, int, bytes]] = []
    if len(entries.pos):
        settled, send = judge(entries)
        rows = [(h % buckets, h, p) for h, p in answers(entries, settled)]
        if send.any():
            left = entries.pick(np.flatnonzero(send))
            bucket = ((left.prints[0] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            masks = TWO_PRINTS if len(left.prints) == 2 else (ONE_PRINT,)
            left.prints = [p & m for p, m in zip(left.prints, masks, strict=True)]
            rows += [(b, -1, p) for b, p in _by(bucket, left)]
    return pd.DataFrame(rows, columns=["bucket", "home", "packed"])


def nothing() -> pd.DataFrame:
    return pd.DataFrame({"bucket": [], "home": [], "packed": []})


def settle(sent: DataFrame, judge: Callable[[Entries], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The answers of each bucket, sorted by itself, and those that homes had settled."""

    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        told = frame["home"] >= 0
        rows = list(zip(frame["home"][told], frame["packed"][told], strict=True))
        if (~told).any():
            entries = Entries.unpack(frame["packed"][~told].tolist())
            rows += list(answers(entries, judge(entries)[0]))
        return pd.DataFrame(rows, columns=["home", "packed"])

    return sent.groupBy("bucket").applyInPandas(bucket, ANSWER)


def found_by_rank(told: pd.DataFrame, n: int, flag: bool | None = None) -> list[np.ndarray]:
    """For each of the ``n`` rows of a home, by rank, the positions that the answers (of this flag) name.

    They are sorted, and each named once.
    """
    if not len(told):
        return [np.empty(0, np.int64)] * n
    entries = Entries.unpack(told["packed"].tolist())
    if flag is not None:
        entries = entries.pick(np.flatnonzero(entries.flag == flag))
    of = entries.ranks[entries.doc]
    order = np.lexsort((entries.pos, of))
    of, pos = of[order], entries.pos[order]
    once = np.append(True, (np.diff(of) != 0) | (np.diff(pos) != 0))[: len(of)]
    of, pos = of[once], pos[once]
    cut = np.searchsorted(of, np.arange(n + 1))
    return [pos[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def found_by_row(rows: pd.DataFrame, told: pd.DataFrame, flag: bool | None = None) -> list[np.ndarray]:
    """As ``found_by_rank``, for each row of a home in its order."""
    keys, rank = np.unique(rows["key"].to_numpy(), return_inverse=True)
    found = found_by_rank(told, len(keys), flag)
    return [found[r] for r in rank.tolist()]


def covered(starts: np.ndarray, before: int, after: int, length: int) -> np.ndarray:
    """Places 0 <= p < length within [s - before, s + after) of some start s, as a mask."""
    edge = np.zeros(length + 1, np.int32)
    low, high = np.clip(starts - before, 0, length), np.clip(starts + after, 0, length)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> list[list[int]]:
    """Maximal runs of a mask as [start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2).tolist()
