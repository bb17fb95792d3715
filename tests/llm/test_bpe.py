import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from sparkdesk.llm import bpe, queries
from tests.conftest import SF
from tests.llm.data import edge_documents, none

with open(queries.BYTE_BPE, "rb") as f:
    FILE = f.read()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(FILE),
                            special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(FILE, public_tokenizers.PATTERN)


def same(own, text):
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text), repr(text)
    assert own.decode(ids) == text.encode()


PIECES = ["a", "the", " the", "ing", " ", "  ", "\n", "\r\n", "\t", "é", "ñ", "'s", "'ll", "1", "2024", "...", "===", "\x1c",
          "\x85", " ", " ", "中文", "\U0001f642", "\U0001f468‍\U0001f469", "x" * 30, "Q"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=25).map("".join)))
def test_any_text(own, text):
    same(own, text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 5000, "=" * 3001, "é" * 2000, "\n" * 2000])
def test_long_pieces(own, text):
    same(own, text)


def test_random_letters_over_window_edges(own, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 64)
    r = random.Random(8)
    for _ in range(20):
        same(own, "".join(r.choice("abcdefinrst") for _ in range(1500)))


def test_full_memos(own, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    r = random.Random(9)
    for _ in range(50):
        same(own, " ".join("".join(r.choice("aeinrst") for _ in range(r.randrange(1, 9))) for _ in range(30)))


def test_edges(spark):
    df = edge_documents(spark)
    ids = bpe.encode(df, queries.BYTE_BPE, public_tokenizers.PATTERN)
    rows = bpe.decode(ids, queries.BYTE_BPE, public_tokenizers.PATTERN).collect()
    want = sorted(((r.doc_id, LIBRARY.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in df.collect()), key=str)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows), key=str) == want
    assert bpe.encode(none(spark), queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op8_byte_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r.text)
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
