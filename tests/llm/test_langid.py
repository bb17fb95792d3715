import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkdesk.llm import langid, queries
from tests.conftest import SF
from tests.llm.data import documents, edge_documents, none


def slow_bits(train, text):
    """PPM code length with escape C, by dictionaries."""
    counts = [Counter() for _ in range(langid.ORDER + 1)]
    start = b"\n" * langid.ORDER
    data = [start + t.lower() for t in train]
    for d in data:
        for i in range(langid.ORDER, len(d)):
            for k in range(langid.ORDER + 1):
                counts[k][d[i - k:i + 1]] += 1
    after = [{} for _ in counts]
    for k, c in enumerate(counts):
        for g, n in c.items():
            t, d = after[k].get(g[:-1], (0, 0))
            after[k][g[:-1]] = (t + n, d + 1)
    total, text = 0.0, start + text.lower()
    for i in range(langid.ORDER, len(text)):
        for k in range(langid.ORDER, -1, -1):
            ctx = text[i - k:i]
            if ctx not in after[k]:
                continue
            t, d = after[k][ctx]
            n = counts[k][text[i - k:i + 1]]
            if n:
                total -= math.log2(n / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
    return total


def tree(train):
    grams = np.concatenate([langid._grams(langid.START + t.lower()) for t in train])
    return langid.Tree(*np.unique(grams, return_counts=True))


def test_exact_code_lengths():
    r = random.Random(1)
    train = {lang: ["".join(r.choice(letters) for _ in range(300)).encode() for _ in range(3)]
             for lang, letters in {"a": "abc de", "b": "bcdéf "}.items()}
    model = {lang: tree(t) for lang, t in train.items()}
    texts = [b"", b"a", "abé dz".encode(), b"\xff\xfe", train["a"][0], b"x" * 50]
    got = langid._lengths(model, texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model):
            assert got[i, j] == pytest.approx(slow_bits(train[lang], t), abs=1e-6)


def test_pieces_and_dense_numbers(monkeypatch):
    model = {"a": tree([b"the cat sat on the mat " * 9]), "b": tree([b"le chat est sur la table " * 9])}
    texts = [b"the mat", bytes(range(256)) * 9, b"la table " * 300]
    want = langid._lengths(model, texts)
    monkeypatch.setattr(langid, "CHUNK", 64)
    np.testing.assert_allclose(langid._lengths(model, texts), want)
    monkeypatch.setattr(langid, "DENSE", 0)
    np.testing.assert_allclose(langid._lengths(model, texts), want)


def test_edges(spark):
    df = edge_documents(spark).withColumn("lang", langid.F.lit("en"))
    model = langid.fit(df)
    out = {(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (6, "en"), (7, "en"), (None, "und"), (None, "en")} <= out
    assert langid.predict(df, model).count() == df.count()
    assert langid.fit(none(spark)) == {} and langid.predict(none(spark), model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}


def test_keep_known(spark):
    noise = bytes(random.Random(2).choices(range(0x400, 0x500), k=0)).decode()
    noise += "".join(chr(random.Random(i).randrange(0x4E00, 0x9FFF)) for i in range(200))
    texts = ["the cat sat on the mat", "12345 !?", noise, None, ""]
    df = documents(spark, texts)
    model = {"en": tree([b"the cat sat on the mat and the dog ran " * 20])}
    kept = langid.keep_known(df.union(df), model)
    assert kept.schema == df.schema
    assert [r.doc_id for r in kept.collect()] == [0, 0]
    assert langid.keep_known(none(spark), model).count() == 0


def test_held_out_accuracy(spark):
    out = queries.op10_langid(spark, SF).toPandas()
    docs = duckdb.sql(f"select doc_id, lang, text from '{SF}/documents.parquet'").df()
    both = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) == len(both)
    held = both[both.held_out]
    import zlib
    assert set(held.doc_id) == {i for i in docs.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert both.score.between(0, 1).all()
