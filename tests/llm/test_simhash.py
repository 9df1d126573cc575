from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tallybook.llm import simhash
from tallybook.llm.queries import op9_simhash

SF = "/root/testdata/sf0.01"


def brute_print(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, max_bits):
    """prints: {fingerprint: smallest id}; the smallest id of each fingerprint's component."""
    keys = np.array(list(prints), np.uint64)
    comp, left = {}, set(range(len(keys)))
    while left:
        queue = [left.pop()]
        members = list(queue)
        while queue:
            near = np.flatnonzero(np.bitwise_count(keys ^ keys[queue.pop()]) <= max_bits)
            new = [i for i in near.tolist() if i in left]
            left -= set(new)
            queue += new
            members += new
        ids = [prints[int(keys[i])] for i in members]
        comp |= {int(keys[i]): min((x for x in ids if x is not None), default=None) for i in members}
    return comp


def check(rows, width, max_bits):
    least = {}
    for i, fp, _ in rows:
        old = least.get(fp)
        least[fp] = i if old is None else old if i is None else min(old, i)
    want = brute_components(least, max_bits)
    for _, fp, c in rows:
        assert want[fp] == c


TEXTS = [
    (1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one two three"), (6, "a b c d"), (7, "A  b\tC d"), (8, "ÀÉ x y z Ü"),
    (9, "long " * 40000), (9, "long " * 40000), (None, "a b c d"), (10, "q" * 200000),
]


def test_fingerprints_of_edge_texts():
    for _, t in TEXTS:
        for width in (1, 4, 5):
            assert simhash.fingerprint(t or "", width) == brute_print(t, width)


def test_edge_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, _fp int, component_id string")
    rows = [(r["_id"], r["_fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df, width=4).collect()]
    assert len(rows) == len(TEXTS)
    check(rows, 4, 4)
    kept = simhash.keep_one(df, width=4)
    assert kept.columns == df.columns
    assert kept.count() == len({c for _, _, c in rows})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_bits", [0, 2, 4])
def test_crowded_buckets_are_split_without_loss(spark, max_bits):
    """Fingerprints that agree in all but 24 bits, so that some keys hold them all."""
    rng = random.Random(max_bits)
    top = rng.getrandbits(40) << 24
    prints = list(dict.fromkeys([top | rng.getrandbits(24) for _ in range(1500)] + [rng.getrandbits(64) for _ in range(300)]))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "_fp long")
    want = brute_components({x: s[0] for x, s in zip(prints, signed, strict=True)}, max_bits)
    for tile in (50, 10**6):
        root = {r["u"]: r["v"] for r in simhash.components(simhash.links(df, max_bits, tile), hub=5).collect()}
        assert {s[0]: root.get(s[0], s[0]) for s in signed} == {s[0]: want[x] for x, s in zip(prints, signed, strict=True)}


def test_blocks_of_a_bucket_of_a_hundred_thousand(spark):
    """What a crowded bucket is split into: every pair with a home entry meets, no tile passes a few times its size."""
    from pyspark.sql import functions as F

    n, tile = 100_000, 1 << 13
    prints = spark.range(n).select((F.lit(5 << 40) + F.col("id")).alias("_fp"))
    high = np.uint64(((1 << 32) - 1) << 32)
    split = simhash.crowded(prints, [(0, high, [np.uint64(1 << 63)])], tile).collect()
    assert sorted((r["part"], r["key"], r["blocks"]) for r in split) == sorted([(0, 5 << 40, 13), (0, (5 << 40) - (1 << 63), 13)])
    rows = prints.select(F.col("_fp").alias("fp"), (F.col("_fp") % 3 > 0).alias("own"))
    block = F.pmod(F.xxhash64("fp"), F.lit(13)).cast("int")
    dealt = rows.select("fp", "own", F.explode(simhash._tiles(F.lit(13), block, F.col("own"))).alias("t"))
    sizes = dealt.groupBy("t.i", "t.j").count().collect()
    assert len(sizes) == 169 and max(r["count"] for r in sizes) < 2.2 * tile
    few = dealt.filter("fp % 499 = 0").select("fp", "own", "t.i", "t.j", "t.home").collect()
    held = {}
    for r in few:
        held.setdefault((r["i"], r["j"]), []).append(r)
    met = {frozenset((x["fp"], y["fp"])) for t in held.values() for x in t if x["home"] for y in t}
    some = {r["fp"]: r["own"] for r in few}
    assert all(frozenset((x, y)) in met for x in some for y in some if some[x])
    assert all(not r["home"] or r["own"] for r in few)


@pytest.mark.parametrize("hub", [2, 1000])
def test_components_of_a_star_and_a_chain(spark, hub):
    edges = [(7, 100 + i) for i in range(50)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (120, 3)]
    got = {tuple(r) for r in simhash.components(spark.createDataFrame(edges, "u long, v long"), hub).collect()}
    assert got == {(u, 3) for u in [7, *range(100, 150)]} | {(u, 1000) for u in range(1001, 1041)}


@pytest.mark.parametrize("max_bits", [0, 1, 4, 6])
def test_links_on_clustered_fingerprints(spark, max_bits):
    rng = random.Random(max_bits)
    prints = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(0, max_bits + 2))) & (1 << 64) - 1
            prints.append(x)
    prints = list(dict.fromkeys([*prints, *range(300)]))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "_fp long")
    root = {r["u"]: r["v"] for r in simhash.components(simhash.links(df, max_bits)).collect()}
    want = brute_components({x: s[0] for x, s in zip(prints, signed, strict=True)}, max_bits)
    assert {s[0]: root.get(s[0], s[0]) for s in signed} == {s[0]: want[x] for x, s in zip(prints, signed, strict=True)}


def test_pigeonhole_plan_covers_and_uses_all_bits():
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < np.linspace(0.1, 0.9, 64)).astype(float)
    for n in (500, 10**7, 10**10):
        for most in (0, 4, 8):
            plan = simhash.plan_search(n, bits.T @ bits * (n / 500), most)
            assert sorted(b for part, _ in plan for b in part) == list(range(64))
            assert sum(t + 1 for _, t in plan) == most + 1


def test_query_on_whole_table(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_simhash(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got[::7]:
        assert int(r["fingerprint"], 16) == brute_print(text[r["doc_id"]], 4)
    check([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got], 4, 4)
