"""SimHash near-duplicates, found by the generalised pigeonhole principle.

A fingerprint has 64 bits, set by the majority of the XXH64 values of a text's
word shingles. Fingerprints that differ in at most ``max_bits`` bits link, and
components of links are groups of near copies.

Search (``links``): the bits are dealt to m parts, correlated bits to the same
part, so that the other parts tell fingerprints apart. Part i gets a threshold
t_i, with sum(t_i + 1) = max_bits + 1: two linked fingerprints must agree in
some part to within its t_i bits. Number of parts and thresholds come from a
dynamic programme over the estimated cost, that is keys to send plus pairs to
compare, given the share of ones of each bit and the number of fingerprints.
Each distinct fingerprint is indexed by its bits in each part and probes all
keys within the threshold; pairs that meet are verified on all 64 bits.

Scale: rows of equal fingerprint are one from the start, whatever their number.
The number of groups follows the number of keys. A bucket (part and key) that
may hold more than ``TILE`` entries is split: its home entries and all its
entries are dealt to blocks by hash, and each pair of blocks is a tile of its
own, so that no task holds a large bucket and no link is lost. How many entries
a bucket may hold follows from counting home keys, as its probes come from keys
nearby. A tile yields a link from each member to its local representative, never
all pairs of a group; a member that has been reached is not compared again, so a
dense group costs about its size. Components come from alternating large-star
and small-star steps on stored edge tables; the edges of nodes of more than
``HUB`` neighbours find their smallest neighbour in a short table, not by a
shuffle on the node.

Null text: as empty. A text without words has fingerprint 0, which links like
any other. Null ids count for no component's smallest id. Repeated rows are all
returned. Empty table: empty result. Extra columns are carried in ``_row``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import boxed, parts, text_or_empty
from tallybook.operators.joins import lookup
from tallybook.session import stored

BITS = 64
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15
# Cost of sending one key, in units of comparing one pair.
KEY_COST = 200.0
# Entries that one tile and one group are meant to hold, and neighbours of a node that may meet in one task.
TILE = 1 << 15
GROUP = 1 << 18
HUB = 1_000


def fingerprint(text: str, width: int) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[width - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(last)
    spans = zip(starts, last)  # noqa: B905  as many as there are shingles
    while chunk := [digest(joined[a:b], SEED) for a, b in itertools.islice(spans, _CHUNK)]:
        raw = np.array(chunk, ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(
    docs: DataFrame, text: str = "text", width: int = 5, carry: Sequence[str] | None = None
) -> DataFrame:
    """``_row`` and ``_fp``, the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.select(boxed(docs, carry), prints(text_or_empty(text)).alias("_fp"))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j (64 x 64, summed by Spark)."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for frame in frames:
            for at in range(0, len(frame), _CHUNK):
                raw = frame["_fp"].to_numpy()[at : at + _CHUNK].astype(">i8").view(np.uint8)
                bits = np.unpackbits(raw.reshape(-1, 8), axis=1).astype(np.float32)
                n += len(bits)
                both += bits.T @ bits
        yield pd.DataFrame({"place": np.arange(BITS * BITS + 1), "n": [float(n), *both.ravel()]})

    rows = (
        prints.mapInPandas(counted, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()
    )  # 4,097 rows at any size
    sums = np.zeros(BITS * BITS + 1)
    for r in rows:
        sums[r["place"]] = r["n"]
    return int(sums[0]), sums[1:].reshape(BITS, BITS)


def deal_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits (0 is the highest) in ``m`` parts of about equal size, correlated ones together."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    left, dealt = set(range(BITS)), []
    for i in range(m):
        size = len(left) // (m - i)
        part = [max(left, key=lambda b: (sum(tie[b, c] for c in left if c != b), -b))]
        left.discard(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (sum(tie[b, c] for c in part), -b))
            part.append(best)
            left.discard(best)
        dealt.append(sorted(part))
    return dealt


def _within(differ: Sequence[float], most: int) -> list[float]:
    """Chance that at most 0, 1, ... ``most`` independent bits differ."""
    chance = [1.0] + [0.0] * most
    for p in differ:
        chance = [chance[k] * (1 - p) + (chance[k - 1] * p if k else 0) for k in range(most + 1)]
    return list(itertools.accumulate(chance))


def plan_search(n: int, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """Parts (bit numbers) with their thresholds, of the least estimated cost; -1 leaves a part out."""
    mean = np.diag(both) / max(n, 1)
    differ = 2 * mean * (1 - mean)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, max_bits + 2):
        dealt = deal_bits(n, both, m)
        # cost so far by the sum of t + 1, with the thresholds that lead there
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for part in dealt:
            chance = _within(differ[part], max_bits)
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, max_bits - used + 1):
                    ball = sum(math.comb(len(part), k) for k in range(t + 1))
                    more = KEY_COST * n * ball + (n * n * chance[t] if t >= 0 else 0)
                    at = used + t + 1
                    if at <= max_bits + 1 and (at not in grown or cost + more < grown[at][0]):
                        grown[at] = (cost + more, (*chosen, t))
            table = grown
        if (full := table.get(max_bits + 1)) and full[0] < best[0]:
            best = (full[0], list(zip(dealt, full[1], strict=True)))
    return best[1]


def _mask(bits: Sequence[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def _keys(plan: Sequence[tuple[list[int], int]]) -> list[tuple[int, np.uint64, list[np.uint64]]]:
    """Number of each part in use, its mask, and the flips that its probes make."""
    used = []
    for i, (part, t) in enumerate(plan):
        if t >= 0:
            flips = [np.uint64(_mask(c)) for k in range(1, t + 1) for c in itertools.combinations(part, k)]
            used.append((i, np.uint64(_mask(part)), flips))
    return used


def local_stars(prints: np.ndarray, home: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """(member, representative) for all linked members of one bucket.

    A member that is only probing is compared with those at home, as two
    probes need not meet here. What has been reached leaves the comparison.
    """
    left, at_home = prints, home
    while len(left):
        queue, first = [(left[0], at_home[0])], int(left[0])
        left, at_home = left[1:], at_home[1:]
        while queue and len(left):
            x, x_home = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if not x_home:
                near &= at_home
            if near.any():
                for y, y_home in zip(left[near], at_home[near], strict=True):
                    yield int(y), first
                    queue.append((y, y_home))
                left, at_home = left[~near], at_home[~near]


def _signed(mask: np.uint64) -> int:
    return int(np.uint64(mask).astype(np.int64))


def crowded(prints: DataFrame, used: Sequence[tuple[int, np.uint64, list[np.uint64]]], tile: int) -> DataFrame:
    """(part, key, blocks) of the buckets that may hold more than ``tile`` entries, and into how many blocks to split each.

    Entries of a bucket come from home keys within the part's threshold; those
    that hold a share of ``tile`` too small to matter are not counted.
    """
    homes = F.array(*[F.struct(F.lit(i).alias("part"), F.col("_fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m, _ in used])
    ball = F.create_map(*[F.lit(x) for i, _, flips in used for x in (i, len(flips) + 1)])
    near = F.create_map(
        *[x for i, _, flips in used for x in (F.lit(i), F.array(*[F.lit(_signed(f)) for f in (np.uint64(0), *flips)]))]
    )
    large = (
        prints.select(F.explode(homes).alias("h"))
        .groupBy("h.part", "h.key")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") * F.element_at(ball, F.col("part")) > tile)
    )
    reached = large.withColumn("flip", F.explode(F.element_at(near, F.col("part"))))
    total = F.sum("n")
    return (
        reached.groupBy("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
        .agg(F.ceil(total / tile).cast("int").alias("blocks"), total.alias("n"))
        .filter(F.col("n") > tile)
        .select("part", "key", "blocks")
    )


def _tiles(blocks: Column, block: Column, home: Column) -> Column:
    """Tiles of an entry in a bucket of so many blocks: structs (home block, entry block, as home).

    A home entry meets every block of entries at home, and as an entry the
    home blocks before its own; any other entry meets every home block.
    """
    every = F.sequence(F.lit(0), blocks - 1)
    at_home = F.transform(every, lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(True).alias("home")))
    rest = F.filter(every, lambda i: ~home | (i < block))
    probing = F.transform(rest, lambda i: F.struct(i.alias("i"), block.alias("j"), F.lit(False).alias("home")))
    return F.when(home, F.concat(at_home, probing)).otherwise(probing)


def links(prints: DataFrame, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (u, v) whose components are those of all links; column ``_fp`` holds distinct fingerprints."""
    n, both = bit_statistics(prints)
    used = _keys(plan_search(n, both, max_bits))
    keys = n * sum(len(flips) + 1 for _, _, flips in used)
    coarse = max(parts(prints.sparkSession) * 4, math.ceil(keys / GROUP))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2048):
                fp = frame["_fp"].to_numpy()[at : at + 2048].view(np.uint64)
                for i, mask, flips in used:
                    keys = np.concatenate([(fp & mask) ^ f for f in (np.uint64(0), *flips)])
                    yield pd.DataFrame(
                        {
                            "part": np.int32(i),
                            "key": keys.view(np.int64),
                            "fp": np.tile(fp, len(flips) + 1).view(np.int64),
                            "home": np.arange(len(keys)) < len(fp),
                        }
                    )

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        part, key, home = frame["part"].to_numpy(), frame["key"].to_numpy(), frame["home"].to_numpy()
        at, fp = frame["tile"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, ~home, at, key, part))
        part, key, at, home, fp = part[order], key[order], at[order], home[order], fp[order]
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(at) != 0)) + 1
        found = set()
        for a, b in itertools.pairwise([0, *cut.tolist(), len(key)]):
            if b - a > 1 and home[a]:
                found.update(local_stars(fp[a:b], home[a:b], max_bits))
        pairs = np.array(list(found), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    entries = prints.select("_fp").mapInPandas(spread, "part int, key long, fp long, home boolean")
    split = stored(crowded(prints, used, tile))
    if not split.isEmpty():
        blocks = F.coalesce("blocks", F.lit(1))
        block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        entries = (
            lookup(entries, split, ["part", "key"])
            .withColumn("_tile", F.explode(_tiles(blocks, block, F.col("home"))))
            .select("part", "key", "fp", "_tile.home", (F.col("_tile.i") * blocks + F.col("_tile.j")).cast("long").alias("tile"))
        )
    else:
        entries = entries.withColumn("tile", F.lit(0).cast("long"))
    group = F.pmod(F.xxhash64("part", "key", "tile"), F.lit(coarse)).cast("int")
    return entries.groupBy(group.alias("group")).applyInPandas(met, "u long, v long").distinct()


def _with_least(edges: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v) with m, the smallest of u and its neighbours; and (u, m) of each u.

    The edges of nodes with more than ``hub`` neighbours, of which there are
    at most one in ``hub`` edges, get it from a table of those nodes alone.
    """
    least = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    hubs, rest = least.filter(F.col("n") > hub).select("u", "m"), least.filter(F.col("n") <= hub).select("u", "m")
    if hubs.isEmpty():
        return edges.join(rest, "u"), rest
    marked = lookup(edges, hubs, ["u"])
    far = marked.filter("m IS NULL").drop("m").join(rest, "u")
    return marked.filter("m IS NOT NULL").unionByName(far), least.select("u", "m")


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(u, v) for every node u of ``edges`` that is not the smallest, v, of its component.

    Large-star links a node's greater neighbours to its smallest one, small-star
    its smaller neighbours and itself; components stay as they are and turn into
    stars in a number of rounds that grows with the logarithm of their size.
    """
    now = stored(edges.filter("u != v"))
    while True:
        both, _ = _with_least(now.union(now.select("v", "u")), hub)
        large = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = stored(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"))
        joined, least = _with_least(down, hub)
        small = (
            joined.filter("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        new = stored(small)
        if new.select("u", "v").exceptAll(now.select("u", "v")).isEmpty() and new.count() == now.count():
            return new
        now = new


def rooted(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(_fp, _root, component_id) of each row of ``distinct``, which has ``_fp`` and ``_least``, its smallest id."""
    roots = components(edges)
    named = distinct.join(roots, distinct["_fp"] == roots["u"], "left").select(
        "_fp", "_least", F.coalesce("v", "_fp").alias("_root")
    )
    ids = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return stored(named.join(ids, "_root").select("_fp", "_root", "component_id"))


def _components_of(prints: DataFrame, max_bits: int) -> DataFrame:
    """(_fp, _root, component_id) of each fingerprint; ``prints`` has ``_fp`` and ``_id``."""
    distinct = stored(prints.groupBy("_fp").agg(F.min("_id").alias("_least")))
    return rooted(distinct, links(distinct, max_bits))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    max_bits: int = 4,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``_row``, ``_id``, ``_fp``, ``_root`` (names the component) and ``component_id``, its smallest id."""
    keep = list(docs.columns if carry is None else carry)
    prints = with_fingerprints(docs, text, width, keep if doc_id in keep else [*keep, doc_id])
    prints = stored(prints.withColumn("_id", F.col("_row").getField(doc_id)))
    of_print = _components_of(prints, max_bits)
    return prints.join(of_print, "_fp").select("_row", "_id", "_fp", "_root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, max_bits: int = 4) -> DataFrame:
    """One row of each component, that of the smallest id, then fingerprint; columns as in ``docs``.

    The choice is made on ids and fingerprints alone; whole rows move once, spread by their number.
    """
    row = F.col("_row")
    prints = stored(
        with_fingerprints(docs, text, width)
        .withColumn("_id", row.getField(doc_id))
        .withColumn("_hash", F.xxhash64(row.getField(text)))
        .withColumn("_number", F.monotonically_increasing_id())
    )
    small = prints.select("_id", "_fp", "_hash", "_number")
    return first_of_each(prints, small.join(_components_of(small, max_bits), "_fp"))


def first_of_each(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of ``rows`` (``_row``, ``_number``) one of each ``_root``; ``found`` has ``_id`` and what ``rooted`` returns."""
    # Only the rows that share a component's smallest id are compared here.
    order = Window.partitionBy("_root").orderBy("_fp", "_hash", "_number")
    first = found.filter(F.col("_id").eqNullSafe(F.col("component_id")))
    kept = first.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select("_number")
    return rows.join(kept, "_number", "left_semi").select("_row.*")
