from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import toxicity
from tallybook.llm.queries import op7_toxicity

SF = "/root/testdata/sf0.1"


def brute_kernel(s, t):
    """All pairs of equal subsequences, discounted by the characters both span."""
    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.ORDER):
        for b in itertools.combinations(range(len(t)), toxicity.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_against_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(3, 9))) for _ in range(30)]
    marks = words[:6]
    kernel = toxicity.Kernel(marks)
    got = kernel(words)
    for i, w in enumerate(words):
        for j, z in enumerate(marks):
            scale = (brute_kernel(w, w) * brute_kernel(z, z)) ** 0.5
            want = (brute_kernel(w, z) / scale if scale else 0.0) ** toxicity.POWER
            if len({c for c in z} & set(w)) == len(set(z)):
                assert got[i, j] == pytest.approx(want, rel=1e-3, abs=1e-5)
    assert kernel(["ab", "", "x" * 500 + marks[0] + "y" * 500]).shape == (3, 6)
    assert kernel(["x" * 500 + marks[0] + "y" * 500])[0, 0] > 0


def test_words():
    assert toxicity.words_of("an I D I O T now a b") == ["an", "idiot", "now", "a", "b"]
    assert toxicity.words_of("s c u m is") == ["scum", "is"]
    assert toxicity.words_of("a b is") == ["a", "b", "is"]
    assert toxicity.words_of("") == []


def corpus(n=500, seed=0):
    rng = random.Random(seed)
    syllables = ["th", "on", "er", "an", "re", "ti", "es", "in", "at", "ed"]
    vocab = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 150))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "numskull", "vermin"]))
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


def test_learns_and_tolerates_inserted_characters():
    rows = corpus()
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], 0.3)
    scorer = toxicity.Scorer(model)
    new = corpus(seed=1)
    chance = model.chance(scorer.margins([t for _, t, _ in new]))
    y = np.array([v for *_, v in new])
    assert (chance[y == 1] >= 0.5).mean() > 0.98 and (chance[y == 0] >= 0.5).mean() < 0.02
    odd = ["you block.head here", "a n u m s k u l l it is", "so numm-skull now", "ver*min in"]
    plain = ["you thonan here", "a thonan it is", "so thon-er now", "an*er in"]
    assert (scorer.margins(odd) > scorer.margins(plain) + 0.3).all()


def test_edge_rows(spark):
    rows = corpus(120) + [(1000, None, 0), (1001, "", 1), (None, "x", 0), (1002, "z" * 100000, None), (1002, "z" * 100000, None)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t, _ in rows], "doc_id long, text string, score int, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (5, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).select("_row.*", "_score").collect()
    assert len(got) == len(rows) and all(0 <= r["_score"] <= 1 for r in got)
    none = labels.filter("toxic = 0")
    assert max(r["_score"] for r in toxicity.score(docs, none).select("_score").collect()) < 1e-6
    assert toxicity.score(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    got = op7_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    for r in got[:500]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in held if labels[r["doc_id"]] == 0]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.03
    insults = F.lower("text").rlike("idiot|pathetic|worthless|disgusting")
    sure = {r["doc_id"] for r in docs.filter(insults).select("doc_id").collect()}
    assert np.mean([r["predicted"] for r in got if r["doc_id"] in sure]) > 0.95


def stem_corpus(n, seed):
    """Toxic documents have no token in common, only a stem that each of them starts with other letters."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(rng.randint(40, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), "bom" + "".join(rng.choices("aeioulnrst", k=rng.randint(6, 9))))
        rows.append((" ".join(words) + ".", toxic))
    return rows


def test_stems_that_no_whole_token_shares():
    model = toxicity.train(*map(list, zip(*stem_corpus(400, 0), strict=True)), 0.3)
    new = stem_corpus(300, 1)
    chance = model.chance(toxicity.Scorer(model).margins([t for t, _ in new]))
    y = np.array([v for _, v in new])
    assert (chance[y == 1] >= 0.5).mean() > 0.95 and (chance[y == 0] >= 0.5).mean() < 0.05


def test_only_copies_are_left_out_of_training():
    words = sorted((f"w{i}" for i in range(400)), key=lambda w: zlib.crc32(w.encode()))
    shared, rest = words[:3], words[3:]
    texts = [" ".join(shared + rest[i * 40 : i * 40 + 40]) for i in range(5)]
    near = texts[0] + " " + rest[300]
    got = toxicity._without_copies([*texts, near, near], [0, 0, 0, 0, 0, 0, 1])
    assert got == ([*texts, near], [0, 0, 0, 0, 0, 1])
