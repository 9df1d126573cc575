"""Both substring operators against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallybook.llm import positions, substrings, suffixes
from tallybook.llm.queries import op1_suffix_dedup, op8_substring_dedup

SF = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1


def covered(starts, width, n):
    gone = np.zeros(n, bool)
    for s in starts:
        gone[s : s + width] = True
    return gone


def brute_bytes(docs, window=100):
    first, raw = {}, [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - window + 1):
            k = b[p : p + window]
            first[k] = min(first.get(k, (LAST, LAST)), (i, p))
    out = []
    for i, b in raw:
        gone = covered([p for p in range(len(b) - window + 1) if first[b[p : p + window]] < (i, p)], window, len(b))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), len(positions.spans_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(docs, window=50):
    first, raw = {}, [(LAST if i is None else i, (t or "").encode().split()) for i, t in docs]
    for i, w in raw:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, LAST), i)
    out = []
    for i, w in raw:
        gone = covered([p for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i], window, len(w))
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "ü", "thing", "Über", "a", "b,", "x" * 30] + ["w%d" % i for i in range(300)]
    passages = [" ".join(rng.choices(vocab, k=rng.choice([20, 49, 50, 51, 60, 130]))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(1, 90))))
        docs.append((rng.choice([i, i * 3, 7, -i]), rng.choice([" ", "\n", "  "]).join(parts)))
    docs += [(1000, "ab" * 400), (1001, "ab" * 130), (2, "same " * 300), (3, "same " * 120), (4, None), (5, ""), (None, docs[0][1]), (None, docs[1][1])]
    docs += [docs[3], docs[3], (2000, docs[5][1] + " tail"), (2001, "z" + docs[5][1][1:])]
    return docs


def digest(rows, names):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[n] for n in names]) for r in rows)


def expected(docs, brute):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(docs, brute, strict=True))


def spark_docs(spark, docs, tmp_path):
    path = str(tmp_path / "sf" / "documents.parquet")
    spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, home int, key string").repartition(5).write.parquet(path)
    return str(tmp_path / "sf")


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_on_random_corpora(spark, tmp_path, seed):
    docs = corpus(seed)
    got = op1_suffix_dedup(spark, spark_docs(spark, docs, tmp_path)).collect()
    assert digest(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == expected(docs, brute_bytes(docs))


@pytest.mark.parametrize("seed", [3, 4])
def test_words_on_random_corpora(spark, tmp_path, seed):
    docs = corpus(seed)
    got = op8_substring_dedup(spark, spark_docs(spark, docs, tmp_path)).collect()
    assert digest(got, ["n_words", "n_removed", "kept_sha256"]) == expected(docs, brute_words(docs))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.deduplicate(docs).count() == 0
    assert substrings.deduplicate(docs).count() == 0


def test_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op1_suffix_dedup(spark, SF).collect()
    assert digest(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == expected(docs, brute_bytes(docs))
    got = op8_substring_dedup(spark, SF).collect()
    assert digest(got, ["n_words", "n_removed", "kept_sha256"]) == expected(docs, brute_words(docs))


def test_cover_has_every_difference():
    c = suffixes.COVER
    assert {(a - b) % suffixes.PERIOD for a in c for b in c} == set(range(suffixes.PERIOD))


def test_prints_tell_windows_apart(monkeypatch):
    values = np.random.default_rng(0).integers(0, 3, 3000).astype(np.uint8)
    for width in (1, 2, 7, 25, 44, 100):
        at = np.arange(len(values) - width + 1)
        prints = positions.prints_at(values, at, width, positions.MULTIPLIERS[0])
        windows = [values[i : i + width].tobytes() for i in at]
        assert len(set(zip(windows, prints.tolist(), strict=True))) == len(set(windows)) == len(set(prints.tolist()))
        assert (positions.prints_at(values, at[5::3], width, positions.MULTIPLIERS[0]) == prints[5::3]).all()
    monkeypatch.setattr(positions, "BLOCK", 64)
    for width in (3, 100):
        at = np.arange(len(values) - width + 1)
        prints = positions.prints_at(values, at, width, positions.MULTIPLIERS[0])
        windows = [values[i : i + width].tobytes() for i in at]
        assert len(set(zip(windows, prints.tolist(), strict=True))) == len(set(windows))


def test_each_word_has_its_hash():
    data = np.frombuffer(b"  one two\t\tthree one " + b"y" * 100 + b" two one\n\x0b\xc2\xa0 ", np.uint8)
    for seeds in (1, 2):
        starts, hashed = substrings.word_hashes(data, seeds)
        assert starts.tolist() == [2, 6, 11, 17, 21, 122, 126, 131] and len(hashed) == seeds
        for h in hashed:
            assert len(set(h.tolist())) == 5 and h[0] == h[3] == h[6] and h[1] == h[5]
    assert [len(x) for x in substrings.word_hashes(data[:0], 2)] == [0, 2]


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_words_that_polynomials_confuse_are_different(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(49))
    docs = [(i, f"{same} {thue_morse(n, flip)}") for i, (n, flip) in enumerate((n, f) for n in (1024, 2048, 30_000) for f in (False, True))]
    docs += [(90, docs[0][1] + " and more"), (91, " ".join(thue_morse(64, f) for f in (True, False)) * 30)]
    folder = spark_docs(spark, docs, tmp_path)
    got = {r["doc_id"]: r["n_removed"] for r in op8_substring_dedup(spark, folder).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 90: 50, 91: 0}


def test_repeats_inside_a_text_of_megabytes(spark, tmp_path):
    rng = random.Random(6)
    long = " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 12))) for _ in range(300_000))
    middle = " ".join(long.split()[150_000:150_200])
    folder = spark_docs(spark, [(1, long), (2, f"before {middle} after"), (3, "x" * 3_000_000)], tmp_path)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in op8_substring_dedup(spark, folder).collect()}
    assert got == {1: (300_000, 0), 2: (202, 200), 3: (1, 0)}
