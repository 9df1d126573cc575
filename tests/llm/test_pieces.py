from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import pieces
from tallybook.llm.bpe import token_count
from tallybook.llm.queries import op11_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


CASES = [
    "", " ", "  ", " a", "a ", "a  b   c", "\n", "\t\r\n", "<s>", "</s><unk>", "<0x41>", "▁", "a▁b ▁", "\x00", "﻿", "Ａﬁ",
    "日本語 \U0001f600 \U0001f9ff", " " * 40, "x" + " " * 33 + "y", "a" * 60, "-" * 70, "=-" * 30, "developdevelop resources", "1234567890" * 9,
    "ab" * 1500, "-" * 5000, " " * 5000, "é" * 700, "requirement" * 300,
]


def test_cases_as_the_library(library, model):
    rng = random.Random(3)
    long = ["".join(rng.choice("etaoinshrdlu  ,.\n") for _ in range(200_000)), "".join(rng.choice("etaoinsh") for _ in range(60_000))]
    back = pieces.Decoder(model)
    for limit in (pieces.LONG, 8, 10**9):  # the queue for few, most and no segments
        cases = CASES + long if limit < 10**9 else CASES
        for packed, text in zip(pieces.Encoder(model, long=limit).encode(cases), cases, strict=True):
            want = library.encode(text, add_bos=True, add_eos=True)
            assert ids_of(packed) == want
            assert back.decode(packed) == library.decode(want)


@settings(max_examples=400, deadline=None)
@given(
    st.text(
        alphabet=st.one_of(
            st.characters(exclude_categories=["Cs"], max_codepoint=0x2FF), st.sampled_from(" \n'ste<|>-=ー日"), st.characters(exclude_categories=["Cs"])
        ),
        max_size=60,
    )
)
def test_any_text_as_the_library(library, model, text):
    packed = pieces.Encoder(model).encode([text])[0]
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids_of(packed) == want
    assert pieces.Decoder(model).decode(packed) == library.decode(want)


def test_words_in_pieces_that_a_vocabulary_would_make_early(library, model):
    # Words glued from pieces whose merges can make better pairs than their own.
    odd = [p for p in model.pieces[259:] if p.isascii() and 2 <= len(p) <= 6]
    rng = random.Random(8)
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(2, 12))) for _ in range(3000)]
    for packed, text in zip(pieces.Encoder(model).encode(texts), texts, strict=True):
        assert ids_of(packed) == library.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 400), st.integers(0, 31_999)), max_size=30))
def test_any_ids_decode_as_the_library(library, model, ids):
    assert pieces.Decoder(model).decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_a_small_memory_of_words_changes_nothing(library, model):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(50)) for _ in range(40)]
    encoder = pieces.Encoder(model, cache_words=10, cache_chars=100)
    for text in texts:
        assert ids_of(encoder.encode([text])[0]) == library.encode(text, add_bos=True, add_eos=True)


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "two words", 0), (3, "two words", 0), (3, "two words", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ids int")
    coded = pieces.encode(df)
    got = coded.withColumn("back", pieces.decoder(spark)("_ids")).select("_row.*", token_count("_ids").alias("n"), "back").collect()
    assert sorted((r["back"], r["n"], r["_ids"]) for r in got) == [("", 2, 0)] * 2 + [("two words", 4, 0)] * 3
    assert pieces.encode(df.limit(0)).count() == 0


def test_query_on_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op11_pieces(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
