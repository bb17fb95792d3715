import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from sparkdesk.llm import piece_bpe, queries
from tests.conftest import SF
from tests.llm.data import edge_documents, none

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)


@pytest.fixture(scope="module")
def own():
    with open(queries.PIECE_BPE, "rb") as f:
        return piece_bpe.PieceModel(f.read())


def same(own, text):
    ids, right = np.frombuffer(own.encode(text, True), "<i4"), LIBRARY.encode(text, add_eos=True)
    assert ids.tolist() == right, repr(text)
    assert own.decode(ids) == LIBRARY.decode(right)


PIECES = ["a", "the", " the", "ing", "in", "er", " ", "  ", "   ", "\n", "\t", "é", "ñ", "1", "2024", "...", "\x00", "▁",
          "中文", "\U0001f642", "x" * 30, "Q", "<s>", "</s>", "<0x41>", "　", "ß"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=25).map("".join)))
def test_any_text(own, text):
    same(own, text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 5001, "=" * 3001, "é" * 2000, "\n" * 2000, "中" * 3000,
                                  "\U0001f642" * 2000, "in" * 3000 + "g"])
def test_long_chunks(own, text):
    same(own, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262)), max_size=12))
def test_decoding_any_ids(own, ids):
    assert own.decode(np.array(ids, "<i4")) == LIBRARY.decode(ids)


def test_full_memos(own, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO", 10)
    monkeypatch.setattr(piece_bpe, "PAIRS", 10)
    r = random.Random(9)
    for _ in range(50):
        same(own, " ".join("".join(r.choice("aeinrst.") for _ in range(r.randrange(1, 9))) for _ in range(30)))


def test_edge_rows(spark):
    docs = edge_documents(spark)
    rows = piece_bpe.decode(piece_bpe.encode(docs, queries.PIECE_BPE), queries.PIECE_BPE).collect()
    want = sorted((str(r.doc_id), LIBRARY.encode(r.text or "", add_eos=True)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert all(r.decoded == LIBRARY.decode(r.ids) for r in rows)
    assert piece_bpe.encode(docs, queries.PIECE_BPE, end=False).where("size(ids) = 0").count() == 3
    assert piece_bpe.encode(none(spark), queries.PIECE_BPE).count() == 0


def test_query_matches_the_library(spark):
    rows = {r.doc_id: r for r in queries.op11_piece_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, r = LIBRARY.encode(d.text or "", add_eos=True), rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
