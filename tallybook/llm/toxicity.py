"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Kernel. Two tokens are alike by the subsequences of ``ORDER`` characters they
share, gaps and inserted characters included, each discounted by ``DECAY`` for
every character it spans; normalised and raised to ``POWER``. Pairs that share
too few of a landmark's characters to come near it count 0. A sentence's kernel
with a landmark is the sum over its tokens.

Training. From labelled rows outside the held-out fold, a sample of at most
``max_toxic`` and ``max_clean`` documents (the first by a hash of their id) is
brought to the driver; that is the documented bound, all else covers all rows.
Landmarks are the tokens that most tell toxic from clean documents, clean tokens
that resemble them, and a few common ones. A linear machine is trained on the Nystroem features of sentences:
a clean document's sentences are all clean; of a toxic document the sentence
that the machine so far finds worst is taken as its witness, and the machine is
trained again. Stems, the first characters of tokens, that start a hundredth of
a document's words and tell toxic documents from clean ones are chosen until
each toxic document that has any is covered twice; their number has no limit. A second
machine weighs them beside the worst sentence. A sigmoid fitted with the classes' true shares gives the score.

Scoring. The machine is linear, so a token has one number, a sentence the sum,
a document its worst sentence and the weights of its stems. Whole texts are read; sentences end at . ! ? or
after 16 tokens, letters set apart by spaces are read as one token, and long
tokens in overlapping pieces. Rows are independent: there is no shuffle, and a
worker's memory of tokens is emptied when full.

Null or empty text: the score of a sentence without tokens. Labels that are
null, or none of one class: every score is the share of toxic labels, 0 without
labels. Repeated rows are scored alike. Extra columns are carried in ``_row``;
language, source and id are not read for a score.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import boxed, text_or_empty

ORDER, DECAY, POWER = 3, 0.8, 3
SHARED = 0.7
APART = 0.5
DECOY = 0.2
# Standard errors by which a token's share among toxic documents exceeds that among clean ones.
OUTSTANDING = 4
# A landmark that no clean sentence matches better than this is also taught with a character inserted.
ALONE = 0.5
LANDMARKS, DECOYS, COMMON = 40, 14, 8
PIECE, STEP = 24, 12
# Stems are the first so many characters of tokens; a document has one if it starts this share of its words.
STEM = range(3, 9)
STEM_SHARE = 0.01
# Training texts of a label whose sets of words are this similar count as one.
COPY = 0.9
SENTENCE = 16
CACHE_TOKENS = 150_000
_EDGES = string.punctuation + "«»“”„‘’…–—"


def _codes(tokens: Sequence[str], width: int, pad: int) -> np.ndarray:
    """Code points of tokens, filled up to ``width``."""
    out = np.full((len(tokens), width), pad, np.int32)
    for i, t in enumerate(tokens):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def shared_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of row i of ``a`` with row i of ``b`` (code points; paddings of the two differ).

    ``runs[k][:, j]`` sums the subsequences of k + 1 characters that end at or
    before b's character j and a's current one, discounted up to there.
    """
    lam = np.float32(DECAY)
    n, width = b.shape
    gaps = np.subtract.outer(np.arange(width), np.arange(width))
    spread = np.where(gaps <= 0, DECAY ** -gaps.astype(float), 0).astype(np.float32)
    runs = [np.zeros((n, width), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, np.float32)
    for at in range(a.shape[1]):
        same = (a[:, at, None] == b) * (lam * lam)
        ends = [same]
        for before in runs:
            now = np.zeros_like(same)
            now[:, 1:] = same[:, 1:] * before[:, :-1]
            ends.append(now)
        total += ends[-1].sum(axis=1)
        for k, before in enumerate(runs):
            runs[k] = before * lam + ends[k] @ spread
    return total


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.where(codes >= 0, np.uint32(1) << (codes & 31).astype(np.uint32), np.uint32(0))


class Kernel:
    """Kernel values of tokens with fixed landmarks."""

    def __init__(self, landmarks: Sequence[str]):
        self.landmarks = list(landmarks)
        width = max(map(len, landmarks))
        self.codes = _codes(self.landmarks, width, -2)
        self.sizes = np.array([len(z) for z in landmarks])
        self.own = shared_subsequences(_codes(self.landmarks, width, -1), self.codes)

    def pieces(self, tokens: Sequence[str]) -> np.ndarray:
        """(tokens, landmarks), for tokens of at most ``PIECE`` characters."""
        out = np.zeros((len(tokens), len(self.landmarks)), np.float32)
        sizes = np.array([len(t) for t in tokens])
        for low, high in ((ORDER, 6), (7, 9), (10, 13), (14, PIECE)):
            at = np.flatnonzero((sizes >= low) & (sizes <= high))
            for part in np.array_split(at, max(1, -(-len(at) // 4096))):
                if len(part):
                    out[part] = self._block([tokens[i] for i in part], high)
        return out

    def _block(self, tokens: Sequence[str], width: int) -> np.ndarray:
        codes = _codes(tokens, width, -1)
        has = np.bitwise_or.reduce(_bits(codes), axis=1)
        common = np.zeros((len(tokens), len(self.landmarks)), np.int8)
        for column in self.codes.T:
            common += (has[:, None] & _bits(column)[None, :]) != 0
        token, mark = np.nonzero(common >= SHARED * self.sizes)
        out = np.zeros(common.shape, np.float32)
        if len(token):
            used, back = np.unique(token, return_inverse=True)
            own = shared_subsequences(codes[used], np.where(codes[used] < 0, -2, codes[used]))
            value = shared_subsequences(codes[token], self.codes[mark])
            scale = np.sqrt(own[back] * self.own[mark])
            out[token, mark] = np.where(scale > 0, value / np.maximum(scale, 1e-30), 0) ** POWER
        return out

    def __call__(self, tokens: Sequence[str]) -> np.ndarray:
        """As ``pieces`` for tokens of any length; of a long one's pieces each landmark takes the nearest."""
        cut = [[t] if len(t) <= PIECE else [t[i : i + PIECE] for i in range(0, len(t) - STEP, STEP)] for t in tokens]
        values = self.pieces([p for c in cut for p in c])
        first = np.cumsum([0, *[len(c) for c in cut[:-1]]])
        return np.maximum.reduceat(values, first, axis=0) if len(tokens) else values


def words_of(text: str) -> list[str]:
    """Words in small letters; runs of three and more lone characters become one word."""
    words = text.lower().split()
    lone = np.fromiter((len(w) == 1 for w in words), bool, len(words))
    if len(lone) < 3 or not (lone[:-2] & lone[1:-1] & lone[2:]).any():
        return words
    out: list[str] = []
    run: list[str] = []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        out.append(w)
    return out[:-1]


@dataclass
class Words:
    """Numbers of words met lately: what their token is, and whether a sentence ends there."""

    numbers: dict[str, int]
    tokens: list[str]
    ends: list[bool]

    @classmethod
    def fresh(cls) -> Words:
        return cls({}, [], [])

    def add(self, words: Sequence[str]) -> list[str]:
        """Numbers those that are new; their tokens are returned."""
        new = [w for w in words if w not in self.numbers]
        for w in new:
            self.numbers[w] = len(self.tokens)
            self.tokens.append(w.strip(_EDGES))
            self.ends.append(w[-1] in ".!?")
        return self.tokens[len(self.tokens) - len(new) :] if new else []

    def sentences(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and the places at which sentences start."""
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if not len(number):
            return number, number
        end = np.asarray(self.ends)[number] if len(self.ends) < 4 * len(number) else np.array([self.ends[i] for i in number.tolist()])
        start = np.append(True, end[:-1])
        place = np.arange(len(number))
        since = place - np.maximum.accumulate(np.where(start, place, 0))
        return number, np.flatnonzero(since % SENTENCE == 0)


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, by Newton steps; ``y`` is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(x.shape[1], 1.0), 1e-3)
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        zi, yi, ci = z[inside], y[inside], weight[inside]
        new = np.linalg.solve((zi * ci[:, None]).T @ zi + np.diag(ridge), (zi * ci[:, None]).T @ yi)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance of ``y`` = 1; one imagined example each way keeps them finite."""
    m = np.concatenate([margin, [margin.min(), margin.max()]])
    t = np.concatenate([y > 0, [True, False]]).astype(float)
    c = np.concatenate([weight, [weight.mean() * 0.5] * 2])
    z = np.stack([m, np.ones_like(m)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (c * (t - p)))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass
class Model:
    kernel: Kernel | None
    token_weights: np.ndarray
    offset: float
    slope: float
    shift: float
    stems: dict[str, float] = field(default_factory=dict)

    def chance(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(None, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))


def choose_landmarks(toxic: Sequence[set[str]], clean: Sequence[set[str]]) -> tuple[list[str], int]:
    """Tokens whose share among toxic documents stands out most; the commonest of clean ones.

    Between them come decoys: tokens of clean documents that are near a telling one.
    """
    a, b = Counter(t for s in toxic for t in s), Counter(t for s in clean for t in s)
    fit = [t for t in a if ORDER <= len(t) <= 16]

    def stands_out(t: str) -> float:
        p, q = a[t] / len(toxic), b[t] / len(clean)
        pool = (a[t] + b[t] + 1) / (len(toxic) + len(clean) + 2)
        return (p - q) / np.sqrt(pool * (1 - pool) * (1 / len(toxic) + 1 / len(clean)))

    # Chosen to cover: each next one stands out most among the toxic documents that have none yet;
    # when all have one, the count begins anew. Of tokens that the kernel hardly tells apart, one will do.
    ranked = sorted(fit, key=lambda t: (-stands_out(t), t))[: 16 * LANDMARKS]
    ranked = [t for t in ranked if stands_out(t) > OUTSTANDING]
    alike = Kernel(ranked)(ranked) if ranked else np.zeros((0, 0))
    has = np.array([[t in s for t in ranked] for s in toxic], bool).reshape(len(toxic), len(ranked))
    rare = np.array([(b[t] + 1) / (len(clean) + 2) for t in ranked])
    chosen: list[int] = []
    bare, open_ = np.ones(len(toxic), bool), np.ones(len(ranked), bool)
    while len(chosen) < LANDMARKS and open_.any():
        gain = np.where(open_, has[bare].sum(axis=0) / len(toxic) / np.sqrt(rare), 0)
        i = int(gain.argmax())
        if gain[i] == 0:
            if bare.all():
                break
            bare[:] = True
            continue
        chosen.append(i)
        bare &= ~has[:, i]
        open_ &= alike[:, i] <= APART
        open_[i] = False
    best = [ranked[i] for i in chosen]
    known = set(best)
    others = sorted((t for t in b if ORDER <= len(t) <= 16 and t not in known and stands_out(t) < 2), key=lambda t: (-b[t], t))
    near = Kernel(best)(others).max(axis=1) if best and others else np.zeros(len(others))
    decoys = [t for t, v in zip(others, near, strict=True) if v > DECOY][:DECOYS]
    usual = [t for t in others if len(t) >= 6 and t not in set(decoys)][:COMMON]
    return best + decoys + usual, len(best)


def stems_of(tokens: Sequence[str]) -> set[str]:
    """Stems that start at least ``STEM_SHARE`` of the tokens of a document."""
    count = Counter(tokens)
    held = Counter()
    for t, n in count.items():
        for k in STEM:
            if len(t) >= k:
                held[t[:k]] += n
    return {s for s, n in held.items() if n >= STEM_SHARE * len(tokens)}


def choose_stems(toxic: Sequence[set[str]], clean: Sequence[set[str]]) -> list[str]:
    """Stems that tell toxic from clean documents, until each toxic document that has such a stem is covered twice."""
    a, b = Counter(t for s in toxic for t in s), Counter(t for s in clean for t in s)
    n, m = len(toxic), len(clean)

    def stands_out(t: str) -> float:
        pool = (a[t] + b[t] + 1) / (n + m + 2)
        return (a[t] / n - b[t] / m) / np.sqrt(pool * (1 - pool) * (1 / n + 1 / m))

    ranked = sorted(t for t in a if a[t] >= 3 and stands_out(t) > OUTSTANDING)
    has = np.array([[t in s for t in ranked] for s in toxic], bool).reshape(n, len(ranked))
    rare = np.array([(b[t] + 1) / (m + 2) for t in ranked])
    need, open_, chosen = np.full(n, 2), np.ones(len(ranked), bool), []
    while open_.any():
        gain = np.where(open_, has[need > 0].sum(axis=0) / np.sqrt(rare), 0)
        i = int(gain.argmax())
        if gain[i] == 0:
            break
        chosen.append(ranked[i])
        open_[i] = False
        need -= has[:, i]
    return chosen


def _without_copies(texts: Sequence[str], labels: Sequence[int]) -> tuple[list[str], list[int]]:
    """Texts without those whose set of words is nearly that of an earlier one of the same label.

    Compared are those that share the three smallest hashes of their words.
    """
    seen: dict[tuple, list[set[str]]] = {}
    kept: list[tuple[str, int]] = []
    for t, v in zip(texts, labels, strict=True):
        words = set(words_of(t))
        near = seen.setdefault((v, *sorted(zlib.crc32(w.encode()) for w in words)[:3]), [])
        if not any(len(words & w) >= COPY * len(words | w) for w in near):
            near.append(words)
            kept.append((t, v))
    return [t for t, _ in kept], [v for _, v in kept]


def _disguised(kernel: Kernel, telling: int, clean: np.ndarray) -> np.ndarray:
    """Kernel values of telling landmarks with a character inserted, where no clean sentence comes near them."""
    alone = np.flatnonzero(clean[:, :telling].max(axis=0, initial=0) < ALONE)
    made = []
    for z in (kernel.landmarks[i] for i in alone.tolist()):
        half = len(z) // 2
        made += [z[:half] + mark + z[half:] for mark in (".", "-", "*", z[half])]
    return kernel(made) if made else np.zeros((0, len(kernel.landmarks)))


def _train_sentences(
    kernel: Kernel, telling: int, words: Words, cut: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of landmarks, offset, and the margin of each document's worst sentence."""
    distinct = list(dict.fromkeys(words.tokens))
    place = {t: i for i, t in enumerate(distinct)}
    values = kernel(distinct)[[place[t] for t in words.tokens]]
    between = kernel(kernel.landmarks)
    size, base = np.linalg.eigh((between + between.T) / 2)
    root = base / np.sqrt(np.maximum(size, 1e-3)) @ base.T
    sums = [np.add.reduceat(values[n], s, axis=0) if len(s) else np.zeros((1, len(kernel.landmarks))) for n, s in cut]
    weights = np.append(np.ones(len(kernel.landmarks) - COMMON), np.zeros(COMMON))[-len(kernel.landmarks) :]
    sentences, bag = np.vstack(sums), np.repeat(np.arange(len(sums)), [len(s) for s in sums])
    first = np.cumsum([0, *[len(s) for s in sums[:-1]]])
    # At first a sentence of a toxic document is suspect if a token in it is nearly one of the telling ones.
    suspect = (sentences[:, :telling] > 0.5).any(axis=1)
    looks = sentences[:, :telling].sum(axis=1)
    kept, offset = np.zeros(len(sentences), bool), 0.0
    disguised = _disguised(kernel, telling, sentences[y[bag] < 0]) + sentences[y[bag] < 0].mean(axis=0)
    weights = np.zeros(len(kernel.landmarks))
    for _ in range(rounds):
        worst = looks == np.maximum.reduceat(looks, first)[bag]
        # Clean sentences that once looked worst stay; the toxic ones are chosen anew.
        kept |= (worst | suspect) & (y[bag] < 0)
        chosen = kept | (suspect & (y[bag] > 0))
        if not (suspect & (y[bag] > 0)).any():
            chosen |= worst
        real = y[bag[chosen]]
        signs = np.append(real, np.ones(len(disguised)))
        each = np.where(real > 0, 1 / (real > 0).sum(), 1 / (real < 0).sum()) * len(y)
        each = np.append(each, np.full(len(disguised), len(y) / max(1, len(disguised))))
        u, offset = linear_svm(np.vstack([sentences[chosen], disguised]) @ root, signs, each)
        weights = root @ u
        looks = sentences @ weights
        suspect = looks + offset > 0
    return weights, offset, np.array([(s @ weights).max() for s in sums]) + offset


def train(texts: Sequence[str], labels: Sequence[int], toxic_share: float, rounds: int = 5) -> Model:
    """Fits the machine to labelled texts; ``toxic_share`` is the share of label 1 among all labels."""
    texts, labels = _without_copies(texts, labels)
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return _constant(toxic_share)
    words = Words.fresh()
    cut = []
    for t in texts:
        held = words_of(t)
        words.add(list(dict.fromkeys(held)))
        cut.append(words.sentences(held))
    tokens = [{words.tokens[i] for i in set(number.tolist())} for number, _ in cut]
    landmarks, telling = choose_landmarks(
        [s for s, v in zip(tokens, y, strict=True) if v > 0], [s for s, v in zip(tokens, y, strict=True) if v < 0]
    )
    kernel, weights, offset, margins = None, np.zeros(0), 0.0, np.zeros(len(y))
    if telling:
        kernel = Kernel(landmarks)
        weights, offset, margins = _train_sentences(kernel, telling, words, cut, y, rounds)
    # The stems of a whole document weigh in beside its worst sentence.
    documents = [stems_of([words.tokens[i] for i in number.tolist()]) for number, _ in cut]
    stems = choose_stems([s for s, v in zip(documents, y, strict=True) if v > 0], [s for s, v in zip(documents, y, strict=True) if v < 0])
    has = np.array([[t in s for t in stems] for s in documents], float).reshape(len(y), len(stems))
    even = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()) * len(y)
    joint, offset2 = linear_svm(np.hstack([margins[:, None], has]), y, even)
    scale = max(float(joint[0]), 1e-3) if kernel else 1.0
    if kernel is None and not stems:
        return _constant(toxic_share)
    stem_weights = dict(zip(stems, (joint[1:] / scale).tolist(), strict=True))
    offset += offset2 / scale
    margins = margins + offset2 / scale + has @ (joint[1:] / scale)
    each = np.where(y > 0, toxic_share / (y > 0).sum(), (1 - toxic_share) / (y < 0).sum()) * len(y)
    slope, shift = fit_sigmoid(margins, y, each)
    return Model(kernel, weights, offset, max(slope, 0.0), shift, stem_weights)


class Scorer:
    """Margins of whole texts."""

    def __init__(self, model: Model):
        self.model, self.words, self.known = model, Words.fresh(), {}
        self.value = np.zeros(0)
        # Of each word the chosen stems that its token has.
        self.stems: list[list[str]] = []
        self.stemmed = np.zeros(0, bool)

    def _learn(self, words: Sequence[str]) -> None:
        if len(self.words.tokens) > CACHE_TOKENS:
            self.words, self.known, self.value = Words.fresh(), {}, np.zeros(0)
            self.stems, self.stemmed = [], np.zeros(0, bool)
        tokens = self.words.add(words)
        if tokens:
            new = list(dict.fromkeys(t for t in tokens if t not in self.known))
            if new:
                kernel = self.model.kernel
                value = kernel(new) @ self.model.token_weights if kernel else np.zeros(len(new))
                self.known.update(zip(new, value.tolist(), strict=True))
            self.value = np.append(self.value, [self.known[t] for t in tokens])
            held = [[t[:k] for k in STEM if len(t) >= k and t[:k] in self.model.stems] for t in tokens]
            self.stems += held
            self.stemmed = np.append(self.stemmed, [bool(h) for h in held])

    def _stem_sum(self, number: np.ndarray) -> float:
        count = Counter(s for i in number[self.stemmed[number]].tolist() for s in self.stems[i])
        return sum(self.model.stems[s] for s, n in count.items() if n >= STEM_SHARE * len(number))

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        if self.model.kernel is None and not self.model.stems:
            return np.zeros(len(texts))
        out = np.full(len(texts), self.model.offset)
        for at in range(0, len(texts), 256):
            held = [words_of(t) for t in texts[at : at + 256]]
            self._learn(list(set().union(*held)))
            for i, words in enumerate(held):
                number, start = self.words.sentences(words)
                if len(start):
                    out[at + i] += np.add.reduceat(self.value[number], start).max() + self._stem_sum(number)
        return out


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_toxic: int, max_clean: int) -> tuple[list, list, float]:
    """Texts and labels of the bounded training sample, and the share of toxic labels outside the fold."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").filter(~held_out("doc_id"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [
        known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for v, most in ((1, max_toxic), (0, max_clean))
    ]
    # At most max_toxic + max_clean rows are broadcast.
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "_id"))
    rows = (
        docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_t"))
        .join(wanted, "_id")
        .orderBy("_id", "toxic", "_t")
        .limit(max_toxic + max_clean)
        .collect()
    )
    share = count.get(1, 0) / max(1, sum(count.values()))
    return [r["_t"] for r in rows], [r["toxic"] for r in rows], share


def held_out(doc_id: str):
    """A fifth of all ids, never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_toxic: int = 1500,
    max_clean: int = 2500,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``_row`` and ``_score`` from 0 to 1, learnt from ``labels`` (doc_id, toxic)."""
    model = train(*sample(docs, labels, doc_id, text, max_toxic, max_clean))
    # Landmarks and their weights: a few kilobytes.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(shared.value.chance(scorer.margins(texts.tolist())))

    return docs.select(boxed(docs, carry), text_or_empty(text).alias("_t")).select("_row", scored("_t").alias("_score"))
