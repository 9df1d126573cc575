from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallybook.llm import neighbours
from tallybook.llm.queries import op3_neighbours

SF = "/root/testdata/sf0.1"


def brute(vectors, queries, k=5):
    ids = np.array(list(vectors))
    x = np.stack([vectors[i] for i in ids.tolist()])
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        v = vectors[q]
        cosine = (x * v).sum(axis=1) / (norms * np.sqrt((v * v).sum()))
        order = [i for i in np.lexsort((ids, -cosine)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(cosine[i])) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def small(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return by_query(neighbours.nearest(df, F.col("id") % 50 == 0, **options).collect())


def test_ties_copies_and_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(20)] + [(50, [2.0, 1.0]), (60, [1.0, 0.0]), (61, [3.0, 0.0]), (50, [9.0, 9.0]), (50, [2.0, 1.0])]
    odd = [(100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [1.0, None]), (300, [inf, 1.0]), (350, []), (None, [1.0, 1.0]), (400, [1.0, 2.0, 3.0])]
    got = small(spark, rows + odd)
    good = {i: np.array(v) for i, v in rows if v != [9.0, 9.0]}
    assert got == brute(good, [0, 50])
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]


def test_few_candidates_and_empty(spark):
    assert small(spark, [(0, [1.0, 0.0])]) == {}
    assert [i for i, _ in small(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])])[0]] == [2, 1]
    assert small(spark, []) == {}


def test_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = small(spark, rows), brute({i: np.array(v) for i, v in rows}, range(0, 600, 50))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.95


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] is not None}
    want = brute(vectors, [i for i in vectors if i % 50 == 0])
    got = by_query(op3_neighbours(spark, SF).collect())
    assert got.keys() == want.keys()
    assert all(len(v) == 5 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
