from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import bpe
from tallybook.llm.queries import op2_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(bpe.default_vocabulary()), cache_pieces=500)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


CASES = [
    "", " ", "  ", "a", "aaaaaaaaaaaaaaaa", "Hello world's  we'll\n\n\tx", "é ü ß ñ 日本語 \U0001f600", "<|endoftext|>",
    "a<|endoftext|><|endoftext|> b<|endoftext|", "\x00\x00<|endoftext|>", "\x1c\x1d\x85\xa0  x", "12345 ½ ² Ⅷ ٣",
    "x" * 3000, "ab" * 2000, "!?" * 500, "\r\n \r\n", "don't DON'T 's's", "�​　z",
]


def test_cases_as_the_library(library, encoder):
    rng = random.Random(5)
    long = "".join(rng.choice("etaoinshrdlu  ,.\n") for _ in range(200_000))
    for packed, text in zip(encoder.encode([*CASES, long]), [*CASES, long], strict=True):
        assert ids_of(packed) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"], max_codepoint=0x2FF), st.sampled_from(" \n'ste<|>")), max_size=60))
def test_any_text_as_the_library(library, encoder, text):
    assert ids_of(encoder.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "two words", 0), (3, "two words", 0), (3, "two words", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ids int")
    coded = bpe.encode(df)
    got = coded.withColumn("back", bpe.decoder(spark)("_ids")).select("_row.*", bpe.token_count("_ids").alias("n"), "back").collect()
    assert sorted((r["back"], r["n"]) for r in got) == [("", 0), ("", 0)] + [("two words", 2)] * 3
    assert bpe.encode(df.limit(0)).count() == 0


def test_ids_that_are_no_text_decode_with_replacement(spark, library):
    ids = [0, 187, 188, 50256, 189, 222, 10000]
    df = spark.createDataFrame([(bytearray(np.array(ids, "<u4").tobytes()),)], "_ids binary")
    assert df.select(bpe.decoder(spark)("_ids")).first()[0] == library.decode(ids, skip_special_tokens=False)


def test_query_on_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op2_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
