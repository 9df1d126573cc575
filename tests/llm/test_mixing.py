from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from tallybook.llm import mixing
from tallybook.llm.queries import op4_mix_sources

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, total = set(names), {}, sum(sizes.values())
    while left:
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left.discard(s)
    return full


def check(rows, docs):
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORDS.findall(text or ""))
    want = brute_targets(sizes)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[s] += r["taken"]
        biggest[s] = max(biggest[s], r["size"])
    assert len(rows) == len(docs)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def rows_of(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).selectExpr(
        "_row.source source", "_size size", "_source_size source_size", "_target target", "_size * _copies taken"
    )
    return got.collect()


@pytest.mark.parametrize("n_sources", [1, 2, 3, 7])
def test_small_tables(spark, n_sources):
    rng = random.Random(n_sources)
    names = [None, "a", "é", "Z", "\U0001f600", "￮", ""][:n_sources]
    docs = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(names)) for i in range(200)]
    docs += [docs[0], docs[0], (None, None, names[0]), (None, "x y", names[0])]
    rows = rows_of(spark, docs)
    check(rows, docs)
    assert sorted(map(str, rows)) == sorted(map(str, rows_of(spark, docs)))


def test_empty_and_wordless(spark):
    assert rows_of(spark, []) == []
    assert [r["taken"] for r in rows_of(spark, [(1, None, "a"), (2, " ", None)])] == [0, 0]


def test_better_documents_come_first(spark):
    docs = spark.range(4000).selectExpr(
        "id doc_id", "'w w w w w w w w w w' text", "if(id % 4 = 0, 's', if(id % 4 = 1, 't', 'u')) source", "if(id % 8 < 4, 1.0D, 0.2D) q"
    )
    from pyspark.sql import functions as F

    got = mixing.mix(docs, quality=F.col("q"), weights=(1, 1, 1)).filter("_row.source = 'u'").groupBy("_row.q").avg("_copies").collect()
    share = {r[0]: r[1] for r in got}
    assert share[1.0] > 1.5 * share[0.2]
    assert mixing.mixed(docs, quality=F.col("q")).columns == docs.columns


@pytest.mark.parametrize("worth", ["1.0D", "0.1D", "0.01D", "if(id % 3 = 0, 1.0D, 0.05D)", "1 / (1 + id % 97)"])
def test_no_bucket_holds_much_of_a_source(spark, worth):
    from pyspark.sql import functions as F

    n = 400_000
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(3), F.col("id")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keys = spark.range(n).select(mixing.order_key(draw, F.expr(worth)).alias("k"))
    held = [tuple(r) for r in keys.groupBy(mixing.bucket_of(F.col("k")).alias("b")).agg(F.count("*"), F.min("k"), F.max("k")).collect()]
    assert max(c for _, c, _, _ in held) < 1.6 * n / mixing.BUCKETS
    held.sort()
    assert all(a[3] < b[2] for a, b in zip(held, held[1:], strict=False))


def test_qualities_that_are_none(spark):
    from pyspark.sql import functions as F

    docs = spark.range(900).selectExpr(
        "id doc_id", "'w w w w w w w w w w' text", "if(id % 3 = 0, 'a', 'b') source",
        "case id % 5 when 0 then cast(null as double) when 1 then 0.0D when 2 then double('NaN') when 3 then -1.0D else 1.0D end q",
    )
    rows = mixing.mix(docs, quality=F.col("q"), weights=(1, 5)).selectExpr("_row.source s", "_row.q q", "_copies c", "_target t").collect()
    short = [r for r in rows if r["s"] == "a"]
    assert abs(10 * sum(r["c"] for r in short) - short[0]["t"]) <= 5
    # A sixth of the words goes to a third of the documents: half of them, the good ones first.
    assert {r["c"] for r in short if r["q"] == 1.0} == {1}


def test_rows_without_id_do_not_draw_alike(spark):
    docs = [(None, "w " * (1 + i % 50) + str(i), "a" if i % 2 else "b") for i in range(400)]
    rows = rows_of(spark, docs)
    check(rows, docs)


def test_query_on_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    source = {d[0]: d[2] for d in docs}
    got = [r.asDict() | {"source": source[r["doc_id"]]} for r in op4_mix_sources(spark, SF).collect()]
    check(got, docs)
