"""Whitening of embeddings by spectral divide and conquer on their covariance.

Entries are first put on a grid of whole numbers, x = floor(scale * c) + offset,
so that counts and sums over the table are exact. Then

1. one pass sums the numbers of each dimension, one more the products of the
   centred numbers, which is the covariance V of the table;
2. ``eigen`` splits V: the polar factor of V - s I, found by dynamically weighted
   Halley iterations on QR factors (QDWH), is +1 on the eigenvectors above s and
   -1 on those below, which gives the projector onto the upper ones; an
   orthonormal basis of its range and one of the rest turn V into two diagonal
   blocks, and each is split again until single components are left;
3. the components, scaled by the root of their eigenvalue, are broadcast, and a
   last pass projects every vector.

Scale: a pass returns a number for each pair of dimensions from each task, and
Spark adds them up; nothing else is shuffled. The driver holds the square of the
dimension (32 KB for 64, 134 MB for 4,096) whatever the number of vectors, and
broadcasts dimension times components.

No part is taken by vectors that are null, empty or hold a null or non-finite
entry; by vectors with an entry beyond ``LARGEST`` (its whole number would not
add up exactly); and by vectors of another length than the commonest (of equally
common ones the longest). Null or repeated ids: rows like any other. Equal
vectors count as often as they occur. Directions in which the vectors do not
differ cannot be whitened: an eigenvalue that is zero but for rounding makes no
component, so that equal vectors, a single vector and an empty table give none.
A deviation that no long holds is null. Extra columns are carried in ``_row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import boxed, quoted
from tallybook.session import stored

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = 2.0**32
_EPS = float(np.finfo(float).eps)
_CHUNK = 4096
# Sums of so many lengths are held before they are handed on.
_LENGTHS = 256


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: QDWH, about six rounds whatever its condition."""
    n = len(a)
    x, low = a / max(np.linalg.norm(a), np.finfo(float).tiny), 1e-16
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = math.sqrt(1 + d)
        f = root + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0))
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(h) * x, np.eye(n)]))
        new = (g / h) * x + (f - g / h) / math.sqrt(h) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (f + g * square) / (1 + h * square), 1.0)
        if 1 - low < 4 * _EPS and moved < 1e-10 * math.sqrt(n):
            break
    return x


def _halves(a: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces; None where all eigenvalues are equal but for ``noise``."""
    n, diagonal = len(a), np.diag(a)
    mean = float(diagonal.mean())
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= noise:
        return None
    step = spread / n
    # The mean of the eigenvalues lies between them; a place on an eigenvalue fails the test of the projector.
    for shift in (float(np.median(diagonal)), mean, *(mean + step * s for s in (0.1, -0.1, 0.31, -0.31, 0.62, -0.62))):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-9 * n:
            continue
        seen = np.random.default_rng([n, k]).standard_normal((n, k))
        for _ in range(2):
            seen = np.linalg.qr(projector @ seen)[0]
        basis = np.linalg.qr(seen, mode="complete")[0]
        upper, lower = basis[:, :k], basis[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 64 * noise:
            return upper, lower
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest entry positive) of a symmetric matrix."""
    a = np.asarray(a, float)
    noise = 4 * _EPS * len(a) * float(np.linalg.norm(a))
    done: list[np.ndarray] = []
    todo = [np.eye(len(a))] if len(a) else []
    while todo:
        basis = todo.pop()
        block = basis.T @ a @ basis
        halves = _halves((block + block.T) / 2, noise) if basis.shape[1] > 1 else None
        if halves is None:
            done.append(basis)
        else:
            todo += [basis @ halves[0], basis @ halves[1]]
    if not done:
        return np.zeros(0), np.zeros((0, 0))
    vectors = np.hstack(done)
    vectors = np.linalg.qr(vectors)[0]  # what rounding took from right angles
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """What the table gave: ``n`` vectors, exact sums of each dimension, components and their shares."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean of each dimension: its whole part and the rest."""
        whole, rest = zip(*[divmod(s, self.n) for s in self.sums], strict=True)
        return np.array(whole, np.int64), np.array(rest, np.int64)


def on_grid(
    vectors: DataFrame, vector: str = "embedding", carry: Sequence[str] | None = None, scale: float = SCALE, offset: int = OFFSET
) -> DataFrame:
    """``_row`` and ``_x``, the whole numbers of each vector that takes part, of whatever length."""
    fine = F.forall("_v", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))  # NaN is greater than any number
    held = vectors.select(boxed(vectors, carry), quoted(vector).cast("array<double>").alias("_v"))
    held = held.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & fine)
    return held.select("_row", F.transform("_v", lambda c: F.floor(scale * c).cast("long") + offset).alias("_x"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.int64, copy=False)


def _chunks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[np.ndarray]:
    for frame in frames:
        for at in range(0, len(frame), _CHUNK):
            part = frame["_x"].iloc[at : at + _CHUNK]
            part = part[part.map(len) == size]
            if len(part):
                yield _matrix(part)


def _sums(grid: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length, and the exact sum of each of their dimensions."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def out() -> pd.DataFrame:
            rows = [(size, i, n, s) for size, (n, sums) in held.items() for i, s in enumerate(sums.tolist())]
            return pd.DataFrame(rows, columns=["size", "place", "n", "s"])

        for frame in frames:
            for size, part in frame["_x"].groupby(frame["_x"].map(len)):
                for at in range(0, len(part), _CHUNK):
                    x = _matrix(part.iloc[at : at + _CHUNK])
                    n, sums = held.get(size, (0, 0))
                    held[size] = (n + len(x), sums + x.sum(axis=0))
                    if held[size][0] >= 1 << 20 or len(held) > _LENGTHS:
                        yield out()  # while sums of numbers below 2^39 fit into a long
                        held.clear()
        yield out()

    by_place = stored(
        grid.select("_x")
        .mapInPandas(summed, "size int, place int, n long, s long")
        .groupBy("size", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    )
    best = by_place.filter("place = 0").orderBy(F.desc("n"), F.desc("size")).select("size", "n").first()
    if best is None:
        return 0, []
    rows = by_place.filter(F.col("size") == best["size"]).collect()  # one for each dimension
    return best["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["place"])]


def _second_moment(grid: DataFrame, size: int, width: int, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the table of p and of p p', where p = ``project`` (x) has ``width`` entries."""

    def multiplied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width))
        for x in _chunks(frames, size):
            p = project(x)
            total[:width] += p.T @ p
            total[width] += p.sum(axis=0)
        yield pd.DataFrame({"place": np.arange(total.size), "s": total.ravel()})

    made = grid.select("_x").mapInPandas(multiplied, "place int, s double").groupBy("place").agg(F.sum("s").alias("s"))
    total = np.zeros((width + 1) * width)
    rows = made.toPandas()  # (width + 1) * width rows at any size of the table
    total[rows["place"]] = rows["s"]
    total = total.reshape(width + 1, width)
    return total[width], total[:width]


def _covariance(n: int, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    mean = sums / n  # zero but for rounding, as what was multiplied was centred
    return products / n - np.outer(mean, mean)


def fit(grid: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fits on all rows of ``grid``; two passes."""
    n, sums = _sums(grid)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    blank = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    whole, rest = blank.centre
    d = len(sums)
    covariance = _covariance(n, *_second_moment(grid, d, d, lambda x: (x - whole) - rest / n))
    values, vectors = eigen(covariance)
    trace = float(np.trace(covariance))
    k = min(components, int((values > 4 * _EPS * d * max(values[0], 0.0)).sum()) if trace > 0 else 0)
    return Whitening(n, sums, values[:k], vectors[:, :k], values[:k] / (trace or 1.0))


def _projection(fitted: Whitening):
    whole, rest = fitted.centre
    scaled, rest = fitted.components / np.sqrt(fitted.values), rest / fitted.n
    return lambda x: ((x - whole) - rest) @ scaled


def identity_error(grid: DataFrame, fitted: Whitening) -> float:
    """How far the covariance of the whitened vectors is from the identity; one pass."""
    k = len(fitted.values)
    if not k:
        return 0.0
    sums, products = _second_moment(grid, len(fitted.sums), k, _projection(fitted))
    return float(np.abs(_covariance(fitted.n, sums, products) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Of each row the sum of (n x - S)^2, exactly."""
    far = x - whole
    if n * (float(np.abs(far).max()) + 1) * math.sqrt(x.shape[1]) < 2.0**31:
        return ((n * far - rest) ** 2).sum(axis=1).tolist()
    exact = ((n * far.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in exact]


def whiten(grid: DataFrame, fitted: Whitening) -> DataFrame:
    """``_row``, ``_deviation`` and ``_whitened``, an entry for each component, of all rows of the fitted length."""
    if not len(fitted.values):
        return grid.select("_row", F.lit(0).cast("long").alias("_deviation"), F.array().cast("array<double>").alias("_whitened")).limit(0)
    shared = grid.sparkSession.sparkContext.broadcast(fitted)
    size = len(fitted.sums)

    @F.pandas_udf("deviation long, whitened array<double>")
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shared.value
        project, (whole, rest) = _projection(held), held.centre
        for batch in batches:
            out = []
            for at in range(0, len(batch), _CHUNK):
                x = _matrix(batch.iloc[at : at + _CHUNK])
                far = pd.array(_deviation(x, held.n, whole, rest), dtype="Int64")
                out.append(pd.DataFrame({"deviation": far, "whitened": list(project(x))}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"deviation": [], "whitened": []})

    made = grid.filter(F.size("_x") == size).select("_row", projected("_x").alias("_p"))
    return made.select("_row", F.col("_p.deviation").alias("_deviation"), F.col("_p.whitened").alias("_whitened"))
