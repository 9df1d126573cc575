"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

A text is cut into pieces by the vocabulary's pattern. Pieces that a worker has
not met lately are encoded together: their bytes lie in one flat array of
symbols, and each round looks up all neighbouring pairs by binary search among
the sorted pair keys, takes the lowest rank within each piece, merges every
occurrence of that pair from the left, and closes the array up. Pieces without
a mergeable pair leave the rounds. Merging all occurrences of a pair at once is
what a queue of single merges does, as a merge never makes a pair of lower rank.

Scale: rows are independent, there is no shuffle. A worker's cache of encoded
pieces is emptied when it is full, so memory is bounded; texts are taken in
slices of about a megabyte, a longer text by itself and whole. The vocabulary,
of fixed size, is read on the driver and broadcast.

Token ids come as binary, 4 bytes each, little-endian. Null text: as empty, no
tokens. Repeated rows: each encoded. Empty table: empty result. Extra columns
are carried in ``_row``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import boxed, text_or_empty

CACHE_PIECES = 150_000
SLICE_CHARS = 1 << 20
# The pattern of the vocabulary (a fixed value), with white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of a byte-level BPE file; ``keys`` are left * size + right, sorted."""

    size: int
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    pieces: list[bytes]
    special: dict[str, int]


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the file, as a rule.

    Printable Latin-1 bytes stand for themselves; the others are numbered from 256.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    ids, byte_of = data["model"]["vocab"], printable_bytes()
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    size = max([*ids.values(), *special.values()]) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    pieces = [b""] * size
    for token, i in ids.items():
        pieces[i] = bytes(byte_of[c] for c in token)
    for token, i in special.items():
        pieces[i] = token.encode()
    single = {pieces[i][0]: i for token, i in ids.items() if len(token) == 1}
    return Vocabulary(
        size=size,
        keys=keys[order],
        ranks=order.astype(np.int64),
        merged=np.array([ids[a + b] for a, b in pairs], np.int64)[order],
        byte_ids=np.array([single[b] for b in range(256)], np.int64),
        pieces=pieces,
        special=special,
    )


def merge_rounds(vocabulary: Vocabulary, words: Sequence[bytes]) -> list[bytes]:
    """The token ids of each (non-empty) word, packed."""
    v = vocabulary
    lengths = np.array([len(w) for w in words])
    symbols = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    none = np.int64(len(v.keys))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        key = symbols[:-1] * v.size + symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.where((v.keys[at] == key) & (owner[:-1] == owner[1:]), v.ranks[at], none)
        rank = np.append(rank, none)  # the last symbol begins no pair
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
        open_ = lowest < none
        if not open_.all():
            done.append((owner[~open_], symbols[~open_]))
            symbols, owner, rank, lowest = symbols[open_], owner[open_], rank[open_], lowest[open_]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == lowest)
        # Of overlapping occurrences, as in a run of equal symbols, every other one merges.
        fresh = np.append(True, np.diff(hit) != 1)
        place = np.arange(len(hit))
        hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        symbols[hit] = v.merged[np.searchsorted(v.keys, symbols[hit] * v.size + symbols[hit + 1])]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    owners = np.concatenate([o for o, _ in done])
    order = np.argsort(owners, kind="stable")
    packed = np.concatenate([s for _, s in done])[order].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(owners, minlength=len(words)))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905  one start too many


class Encoder:
    """Encodes texts, remembering the pieces met lately."""

    def __init__(self, vocabulary: Vocabulary, cache_pieces: int = CACHE_PIECES):
        self.vocabulary, self.cache_pieces = vocabulary, cache_pieces
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; a special token is a piece of its own, marked by a leading NUL pair."""
        if not (self.special and any(s in text for s in self.vocabulary.special)):
            return self.cut(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += ["\0\0" + part] if i % 2 else self.cut(part)
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > self.cache_pieces:
            self.known = {}
        known = self.known
        new = [p for p in set().union(*cut) if p not in known]
        ordinary = [p for p in new if not (p.startswith("\0\0") and p[2:] in self.vocabulary.special)]
        if ordinary:
            known.update(zip(ordinary, merge_rounds(self.vocabulary, [p.encode() for p in ordinary]), strict=True))
        for token, i in self.vocabulary.special.items():
            known["\0\0" + token] = i.to_bytes(4, "little")
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]


def _slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t) > limit:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def _decode(pieces: Sequence[bytes], ids: bytes) -> str:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(
    docs: DataFrame,
    text: str = "text",
    path: str | None = None,
    carry: Sequence[str] | None = None,
    decoded: bool = False,
) -> DataFrame:
    """``_row`` and ``_ids``: the token ids of the text, without special tokens added.

    With ``decoded`` also ``_text``, which the same worker makes from the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_vocabulary()))

    @F.pandas_udf("ids binary, text string" if decoded else "ids binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [x for part in _slices(batch.tolist()) for x in encoder.encode(part)]
            out = {"ids": pd.Series(ids, dtype=object)}
            if decoded:
                out["text"] = pd.Series([_decode(shared.value.pieces, x) for x in ids], dtype=object)
            yield pd.DataFrame(out)

    made = docs.select(boxed(docs, carry), text_or_empty(text).alias("_t")).select("_row", coded("_t").alias("_c"))
    return made.select("_row", F.col("_c.ids").alias("_ids"), *([F.col("_c.text").alias("_text")] if decoded else []))


def decoder(spark: SparkSession, path: str | None = None):
    """A column function from packed ids to text; bytes that are no UTF-8 become U+FFFD."""
    shared = spark.sparkContext.broadcast(load(path or default_vocabulary()).pieces)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_decode(shared.value, x) for x in batch], dtype=object)

    return text


def token_count(ids: str = "_ids"):
    return (F.octet_length(ids) / 4).cast("long")
