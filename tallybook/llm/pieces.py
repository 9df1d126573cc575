"""SentencePiece BPE: encoding by vectorised merge rounds in numpy, and decoding.

The model ranks pieces by score. Of all neighbouring symbols of a text whose
union is a piece, the union of the best score is made first, the leftmost of
equal ones, until no pair is left. No union reaches over two characters that
stand side by side in no piece, so a text falls into segments that merge on
their own; white space begins a word in such vocabularies, and words are
remembered by the worker.

Segments that are new are merged together: their symbols lie in one flat array,
each round looks up all neighbouring pairs by binary search among the sorted
pair keys, takes the best rank within each segment, merges the occurrences of
that rank from the left, and closes the array up; segments without a pair leave
the rounds. Unlike in byte-level BPE a merge may make a pair of a better rank
than its own, or of an equal one. Ranks of which this can be true (found when
the model is loaded) merge at their leftmost place only, and the next round
looks again. A segment of more than ``LONG`` symbols would take too many
rounds; it is merged one by one from a queue instead, in n log n steps.

Scale: rows are independent, there is no shuffle. The words a worker remembers
are bounded in number and characters; texts are taken in slices of about a
megabyte, a longer one by itself and whole. The model, of fixed size, is read on
the driver and broadcast.

Models of type BPE that leave text as it is (no normalisation, no pieces of the
user) are taken; any other is refused. Characters without a piece become their
UTF-8 bytes, or the unknown id where the model has no bytes. Token ids come as
binary, 4 bytes each, little-endian. Null text: as empty, which is the begin and
end ids alone. Repeated rows: each encoded. Empty table: empty result. Extra
columns are carried in ``_row``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.bpe import _slices
from tallybook.llm.common import boxed, text_or_empty

CACHE_WORDS = 150_000
CACHE_CHARS = 4 << 20
LONG = 512
SPACE = "▁"
CODE_POINTS = 0x110000


@dataclass(frozen=True)
class Model:
    """Arrays of a model; symbols are piece ids, or ``size`` + code point for a character without a piece.

    ``keys`` are left * ``base`` + right, sorted; ``ranks`` count from the best
    score; ``leftmost`` tells of each rank whether its merges are made singly.
    ``adjacent`` are the pairs of code points that some piece holds, sorted.
    """

    size: int
    base: int
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    leftmost: np.ndarray
    adjacent: np.ndarray
    characters: dict[int, int]
    byte_ids: list[int]
    unknown: int
    begin: int
    end: int
    pieces: list[str]
    bytes_of: dict[int, int]
    silent: frozenset[int]
    words_begin_with_space: bool


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _adjacent(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 21 | right


def load(path: str) -> Model:
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    size = len(held)
    pieces = [held.id_to_piece(i) for i in range(size)]
    bytes_of = {i: int(pieces[i][1:-1], 16) for i in range(size) if held.is_byte(i)}
    silent = {i for i in range(size) if held.is_control(i)}
    ids = {p: i for i, p in enumerate(pieces) if i not in bytes_of and i not in silent and not held.is_unknown(i)}
    probe = "Ａ  ﬁ "  # a normalising model would not give this back
    if any(held.is_unused(i) for i in range(size)) or held.decode(held.encode(probe)) != probe:
        raise ValueError(f"{path}: a model that changes texts or leaves out pieces is not supported")
    score = {p: held.get_score(i) for p, i in ids.items()}
    place = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    rank = {p: place[s] for p, s in score.items()}
    if any(a not in ids for p in ids for a in p):
        raise ValueError(f"{path}: a character of a piece is no piece itself")
    cuts = [(p[:k], p[k:], p) for p in ids for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    leftmost = np.bincount(list(rank.values()), minlength=len(place)) > 1
    for a, b, p in cuts:
        for part in (a, b):
            leftmost[rank[part]] |= rank[p] <= rank[part]
    base = size + CODE_POINTS
    keys = np.array([ids[a] * base + ids[b] for a, b, _ in cuts], np.int64)
    order = np.argsort(keys)
    side = {(ord(a) << 21) | ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)}
    names = {b: i for i, b in bytes_of.items()}
    return Model(
        size=size,
        base=base,
        keys=keys[order],
        ranks=np.array([rank[p] for _, _, p in cuts], np.int64)[order],
        merged=np.array([ids[p] for _, _, p in cuts], np.int64)[order],
        leftmost=np.append(leftmost, False),
        adjacent=np.array(sorted(side), np.int64),
        characters={ord(p): i for p, i in ids.items() if len(p) == 1},
        byte_ids=[names[b] for b in range(256)] if len(names) == 256 else [],
        unknown=held.unk_id(),
        begin=held.bos_id(),
        end=held.eos_id(),
        pieces=pieces,
        bytes_of=bytes_of,
        silent=frozenset(silent),
        words_begin_with_space=not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids),
    )


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``table``, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def merge_rounds(m: Model, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, and the segment of each; ``owner`` numbers segments in order."""
    none = len(m.leftmost) - 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        at, known = _found(m.keys, symbols[:-1] * m.base + symbols[1:])
        rank = np.full(len(symbols), none)  # the last symbol of a segment begins no pair
        pair = np.flatnonzero(known & (owner[:-1] == owner[1:]))
        rank[pair] = m.ranks[at[pair]]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
        open_ = best < none
        if not open_.all():
            done.append((owner[~open_], symbols[~open_]))
            symbols, owner, rank, best = symbols[open_], owner[open_], rank[open_], best[open_]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == best)
        # Of overlapping occurrences every other one merges, from the left.
        fresh = np.append(True, np.diff(hit) != 1)
        place = np.arange(len(hit))
        take = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        take &= ~m.leftmost[best[hit]] | np.append(True, owner[hit][1:] != owner[hit][:-1])
        hit = hit[take]
        symbols[hit] = m.merged[np.searchsorted(m.keys, symbols[hit] * m.base + symbols[hit + 1])]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    owners = np.concatenate([o for o, _ in done]) if done else owner
    order = np.argsort(owners, kind="stable")
    return (np.concatenate([s for _, s in done]) if done else symbols)[order], owners[order]


def merge_queue(m: Model, symbols: np.ndarray) -> np.ndarray:
    """Symbols of one long segment after all merges, the best pair first."""
    now, n = symbols.tolist(), len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    made: dict[int, tuple[int, int] | None] = {}

    def offers(i: int, j: int) -> list[tuple[int, int, int, int, int]]:
        """The merge of the symbols at i and j, if there is one: rank, place, both symbols, result."""
        key = now[i] * m.base + now[j]
        if key not in made:
            at, known = _found(m.keys, np.array([key]))
            made[key] = (int(m.ranks[at[0]]), int(m.merged[at[0]])) if known[0] else None
        union = made[key]
        return [(union[0], i, now[i], now[j], union[1])] if union else []

    queue = [x for i in range(n - 1) for x in offers(i, i + 1)]
    heapq.heapify(queue)
    while queue:
        _, i, left, right, into = heapq.heappop(queue)
        j = after[i]
        if now[i] != left or j < 0 or now[j] != right:
            continue  # one of the two has merged meanwhile
        now[i], now[j] = into, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for x in (offers(before[i], i) if before[i] >= 0 else []) + (offers(i, k) if k >= 0 else []):
            heapq.heappush(queue, x)
    return np.array([s for s in now if s >= 0], np.int64)


class Encoder:
    """Encodes texts, remembering the words met lately."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS, cache_chars: int = CACHE_CHARS, long: int = LONG):
        self.model, self.cache_words, self.cache_chars, self.long = model, cache_words, cache_chars, long
        self.symbol_of = np.arange(model.size, model.size + CODE_POINTS, dtype=np.int64)
        self.symbol_of[list(model.characters)] = list(model.characters.values())
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.cut(marked) if self.model.words_begin_with_space else [marked]

    def merged(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word, packed."""
        m = self.model
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        _, together = _found(m.adjacent, _adjacent(points[:-1], points[1:]))
        cut = np.append(True, ~together | (word[1:] != word[:-1]))
        owner, starts = np.cumsum(cut) - 1, np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(points)))
        symbols = self.symbol_of[points]
        long = lengths > self.long
        short = ~long[owner]
        done, of = merge_rounds(m, symbols[short], owner[short])
        for s in np.flatnonzero(long):
            one = merge_queue(m, symbols[starts[s] : starts[s] + lengths[s]])
            done, of = np.append(done, one), np.append(of, np.full(len(one), s))
        if long.any():
            order = np.argsort(of, kind="stable")
            done, of = done[order], of[order]
        ends = np.cumsum(np.bincount(word[starts][of], minlength=len(words))).tolist()
        packed, odd = done.astype("<u4").tobytes(), np.flatnonzero(done >= m.size)
        if not len(odd):
            return [packed[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        counts = np.ones(len(done), np.int64)
        spelt = {}
        for p in odd.tolist():
            c = int(done[p]) - m.size
            spelt[p] = [m.byte_ids[b] for b in chr(c).encode()] if m.byte_ids else [m.unknown]
            counts[p] = len(spelt[p])
        at = np.append(0, np.cumsum(counts))
        whole = np.repeat(done, counts)
        for p, ids in spelt.items():
            whole[at[p] : at[p + 1]] = ids
        packed = whole.astype("<u4").tobytes()
        return [packed[4 * at[a] : 4 * at[b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of each text, with the begin and end ids."""
        cut = [self.words(t) for t in texts]
        if len(self.known) > self.cache_words or self.chars > self.cache_chars:
            self.known, self.chars = {}, 0
        known = self.known
        new = [w for w in set().union(*cut) if w not in known]
        if new:
            known.update(zip(new, self.merged(new), strict=True))
            self.chars += sum(map(len, new))
        first, last = self.model.begin.to_bytes(4, "little"), self.model.end.to_bytes(4, "little")
        return [b"".join([first, *map(known.__getitem__, words), last]) for words in cut]


def _utf8(raw: bytes) -> str:
    """Text of a run of byte pieces; each byte that begins no whole character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        b = raw[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        try:
            out.append(raw[at : at + n].decode())
            at += n
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


class Decoder:
    def __init__(self, model: Model):
        self.spoken = [p.replace(SPACE, " ") for p in model.pieces]
        self.spoken[model.unknown] = " ⁇ "
        for i in model.silent:
            self.spoken[i] = ""
        self.model = model

    def decode(self, packed: bytes) -> str:
        m, ids = self.model, np.frombuffer(packed, "<u4").tolist()
        first = next((i for i in ids if i not in m.silent), None)
        if not m.bytes_of.keys().isdisjoint(ids):
            out, held = [], bytearray()
            for i in ids:
                if (b := m.bytes_of.get(i)) is not None:
                    held.append(b)
                    continue
                if held:
                    out.append(_utf8(bytes(held)))
                    held = bytearray()
                out.append(self.spoken[i])
            text = "".join(out) + (_utf8(bytes(held)) if held else "")
        else:
            text = "".join(map(self.spoken.__getitem__, ids))
        # The space that encoding put in front goes again.
        return text[1:] if first is not None and m.pieces[first].startswith(SPACE) else text


def encode(
    docs: DataFrame,
    text: str = "text",
    path: str | None = None,
    carry: Sequence[str] | None = None,
    decoded: bool = False,
) -> DataFrame:
    """``_row`` and ``_ids``: the token ids of the text, between the begin and end ids.

    With ``decoded`` also ``_text``, which the same worker makes from the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_model()))

    @F.pandas_udf("ids binary, text string" if decoded else "ids binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, back = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            ids = [x for part in _slices(batch.tolist()) for x in encoder.encode(part)]
            out = {"ids": pd.Series(ids, dtype=object)}
            if decoded:
                out["text"] = pd.Series([back.decode(x) for x in ids], dtype=object)
            yield pd.DataFrame(out)

    made = docs.select(boxed(docs, carry), text_or_empty(text).alias("_t")).select("_row", coded("_t").alias("_c"))
    return made.select("_row", F.col("_c.ids").alias("_ids"), *([F.col("_c.text").alias("_text")] if decoded else []))


def decoder(spark: SparkSession, path: str | None = None):
    """A column function from packed ids to text, as the library decodes."""
    shared = spark.sparkContext.broadcast(load(path or default_model()))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = Decoder(shared.value)
        for batch in batches:
            yield pd.Series([back.decode(x) for x in batch], dtype=object)

    return text
