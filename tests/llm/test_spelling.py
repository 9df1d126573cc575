from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import compare
import pytest

from tallybook.llm import spelling
from tallybook.llm.queries import SQL, op13_spelling

SF = "/root/testdata/sf0.001"
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100))) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_words(docs, least=7, times=2, every=31):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if every:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= times}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute(words, ratio=10):
    alphabet = {c for w in words for c in w}
    near = {w: sorted(edits(w, alphabet) & words.keys()) for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items()}


def rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_query_on_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(op13_spelling(spark, SF))
    assert len(got) == len(set(got)) and set(got) == brute(brute_words(docs))
    assert any(r[1] for r in got)


def test_query_as_its_sql(spark):
    con = compare.connect(SF)
    want = compare.sql_rows(con, SQL["op13_spelling"])
    assert want[1] and compare.differences(compare.spark_rows(op13_spelling(spark, SF)), want) is None


@pytest.mark.parametrize("letters, longest, limit", [("ab", 9, 4096), ("ab", 9, 3), ("abcé", 8, 40), ("a", 40, 2), ("abcdefgh", 7, 10)])
def test_pairs_as_brute_force(spark, letters, longest, limit):
    rng = random.Random(len(letters) * longest)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(3, longest))): rng.choice([1, 2, 30, 500]) for _ in range(400)}
    pairs = [(r["word"], r["near"], r["n"], r["near_n"]) for r in spelling.near_pairs(table(spark, words), limit).collect()]
    alphabet = set(letters)
    want = {(w, x, words[w], words[x]) for w in words for x in edits(w, alphabet) & words.keys()}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    got = rows(spelling.variants(table(spark, words), group_words=limit))
    assert set(got) == brute(words) and len(got) == len(words)


def test_a_partition_that_all_words_share_is_parted(spark):
    # All words agree in their first and last letters; only the middle differs.
    middles = ["".join(p) for p in itertools.product("abcd", repeat=4)]
    words = {f"prefix{m}suffix": 1 + len(set(m)) ** 5 for m in middles}
    got = rows(spelling.variants(table(spark, words), group_words=16))
    assert set(got) == brute(words)


def test_acceptors_are_minimal():
    machine = spelling.Acceptors()
    state = machine.add(sorted("".join(p) for p in itertools.product("abc", repeat=6)))
    assert len(machine.arcs) == 7  # one state for each letter and the end
    assert len(set(machine.common(state, state))) == 3**6
    assert machine.add([]) is None


def test_long_words_and_long_texts(spark):
    far = "x" * 30_000
    text = " ".join([far, far + "y", "z" + far, "plain words " * 200_000, far, far + "y", "z" + far])
    df = spark.createDataFrame([(1, text), (2, None), (None, "Résumés ÀÞß résumés Résumés — Abcdefg abcdefg")], "doc_id long, text string")
    words = spelling.vocabulary(df)
    held = {r["word"]: r["n"] for r in words.collect()}
    assert held == {far: 2, far + "y": 2, "z" + far: 2, "résumés": 3, "abcdefg": 2}
    near = {r["word"]: r["n_near"] for r in spelling.variants(words).collect()}
    assert near == {far: 2, far + "y": 1, "z" + far: 1, "résumés": 0, "abcdefg": 0}


def test_edge_tables(spark):
    schema = "doc_id long, text string, word string, n int, m string"
    odd = [(None, "letters letters", "w", 1, "x"), (3, "letters, lettres; letters", "w", 1, "x"), (3, "letters, lettres; letters", "w", 1, "x"), (4, "", None, 0, "")]
    df = spark.createDataFrame(odd, schema)
    docs = [("" if r[0] is None else r[0], r[1]) for r in odd]
    for every in (None, 31, 2, 1):
        assert set(rows(spelling.variants(spelling.vocabulary(df, drop_every=every)))) == brute(brute_words(docs, every=every))
    assert rows(spelling.variants(spelling.vocabulary(df.limit(0)))) == []


def test_forms_lead_to_one_root(spark):
    # Each word is a letter longer and ten times as common as the one before.
    words = {"abcdefghijkl"[: 7 + i]: 10**i for i in range(6)}
    got = {r[0]: r for r in rows(spelling.variants(table(spark, words)))}
    assert {r[2] for r in got.values()} == {"abcdefghijkl"}
    assert got["abcdefg"] == ("abcdefg", "abcdefgh", "abcdefghijkl", 1, 1, 10)
