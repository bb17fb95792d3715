import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkdesk.llm import queries, toxicity
from tests.conftest import SF
from tests.llm.data import WORDS, documents, edge_documents, none


def slow_pooled(net, text):
    """Largest filter responses of one text, filter by filter."""
    words = (text or "").lower().split()
    x = [np.mean([net.emb[b] for b in f], axis=0) if (f := toxicity.word_features(toxicity.bare_word(w.encode()))) else np.zeros(toxicity.DIM)
         for w in words] or [np.zeros(toxicity.DIM)]
    out = []
    for width, filters in zip(toxicity.WIDTHS, net.filters):
        for f in range(toxicity.FILTERS):
            out.append(max(sum(x[i + k] @ filters[k, :, f] for k in range(width) if i + k < len(x)) for i in range(len(x))))
    return np.array(out)


def test_pooling_over_blocks(monkeypatch):
    net = toxicity.Net(3)
    net.emb *= 50
    r = random.Random(1)
    texts = ["", "!!! ...", "one", " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(700)), "a b", "c d e f"]
    want = np.array([slow_pooled(net, t) for t in texts])
    for chunk, memo in ((1 << 16, 200_000), (50, 200_000), (7, 20)):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        monkeypatch.setattr(toxicity, "MEMO", memo)
        got, _ = toxicity.Scorer(net).pooled([t.encode() for t in texts])
        np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-5)


def test_best_cut():
    logit, label = np.array([3.0, 2.0, 1.0, 0.0, -1.0]), np.array([1, 1, 0, 1, 0])
    assert toxicity.best_cut(logit, label, np.ones(5)) == -0.5
    assert toxicity.best_cut(logit, np.array([1, 1, 0, 0, 0]), np.ones(5)) == 1.5


def test_edges(spark):
    df = edge_documents(spark)
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "x"), (4, None, "x"), (6, 0, "x"), (None, 1, "x"), (99, 1, "x")],
                                   "doc_id bigint, toxic int, score string")
    net = toxicity.fit(df, labels)
    rows = toxicity.score(df, net).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[0] == by_id[1] and len(by_id[4]) == 1
    assert toxicity.fit(df, labels.where("toxic = 0")) is None and toxicity.fit(none(spark), labels) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(none(spark), net).count() == 0


def test_learns_a_word_in_long_texts(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        words = [r.choice(WORDS) + "ish" * r.randrange(3) for _ in range(r.choice([5, 60, 300]))]
        if i % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["vile,", "VILE.", "viler"]))
        rows.append(" ".join(words))
    df = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    out = {x.doc_id: x.score for x in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) > 0.95


def made_up(r, n):
    return ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(5)) for _ in range(n)]


def test_word_tables_match_word_features():
    r = random.Random(4)
    words = ["", "a", "über", "ß" * 30, "x" * 24, "y" * 25, "abcd", "abcde", "ünder" * 6, "𝒳𝒴", "日本語日本語日本語日"]
    words += ["".join(r.choice("ab9é") for _ in range(r.randrange(28))) for _ in range(300)]
    for word, row in zip(words, toxicity.bucket_table([w.encode() for w in words])):
        assert sorted(b for b in row.tolist() if b != toxicity.NONE) == sorted(toxicity.word_features(word))


def test_every_label_is_learned(spark):
    """Each toxic text has a word of its own, so a text that is left out is not known."""
    r = random.Random(5)
    marks = made_up(r, 5000)
    fill = lambda: " ".join(r.choice(WORDS) for _ in range(4))
    texts = [f"{fill()} {m} {fill()}" for m in marks] + [fill() for _ in marks] + [f"{m} {fill()}" for m in marks]
    df = documents(spark, texts).repartition(4)
    labels = spark.createDataFrame([(i, int(i < 5000)) for i in range(10_000)], "doc_id bigint, toxic int")
    out = {x.doc_id: x.score for x in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert np.mean([out[i] >= 0.5 for i in range(10_000, 15_000)]) > 0.9
    assert np.mean([out[i] < 0.5 for i in range(5000, 10_000)]) > 0.9


def test_long_texts_are_learned(spark):
    """The only toxic texts are long, their word is at the end."""
    r = random.Random(6)
    rows = [" ".join(r.choice(WORDS) for _ in range(3000 if i % 4 == 0 else 30)) + (" vile" if i % 4 == 0 else "")
            for i in range(120)]
    df = documents(spark, rows)
    assert all(len(t) > 12_000 for t in rows[::4])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    net = toxicity.fit(df, labels)
    assert net is not None
    assert all((score >= 0.5) == (i % 4 == 0) for i, score in enumerate(toxicity.Scorer(net).score([t.encode() for t in rows])))


def test_cuts_count_all_rows(spark):
    """Thresholds have the best F1 over all labelled rows, in any number of shards and pieces."""
    r = random.Random(7)
    texts = [" ".join(r.choice(WORDS) for _ in range(40)) for _ in range(300)]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(r.random() < 0.3)) for i in range(300)], "doc_id bigint, toxic int")
    net = toxicity.Net(3)
    net.emb *= 50
    rows = toxicity.labelled(df, labels, "doc_id", "text", "toxic", 70)
    assert rows.rdd.getNumPartitions() == 5 and rows.agg({"texts": "sum"}).first()[0] == 300
    best, counts = toxicity.Scorer(net).pooled([t.encode() for t in texts])
    lang, y = toxicity.language_of(counts), np.array([x.toxic for x in labels.orderBy("doc_id").collect()])
    cell = np.rint(net.logit(best).astype(float) * toxicity.CELLS) / toxicity.CELLS
    cuts = toxicity.choose_cuts(rows, net)
    for k, name in enumerate(toxicity.LANGS):
        here = lang == k if y[lang == k].sum() >= 5 else lang >= 0
        assert abs(cuts[name] - toxicity.best_cut(cell[here], y[here], np.ones(here.sum()))) < 3 / toxicity.CELLS


def test_long_texts_in_pieces(monkeypatch):
    """A text in many pieces is learned as one in a single piece."""
    r = random.Random(8)
    bodies = [" ".join(r.choice(WORDS) for _ in range(n)).encode() for n in (0, 1, 2, 3, 50, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(bodies), pa.array([0, 1, 0, 1, 0, 1], pa.int32())], ["body", "y"])
    found = []
    for chunk in (1 << 16, 7):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        trainer = toxicity.Trainer(toxicity.Net(3), toxicity.Trainer.no_sums())
        for part in toxicity.ready(toxicity.make_ready([batch])):
            trainer.learn(part, np.ones(2))
        found.append((trainer.net.emb, trainer.columns, trainer.net.out))
    for a, b in zip(*found):
        np.testing.assert_allclose(a, b, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("folder", [SF.replace("sf0.01", "sf0.1")])
def test_held_out(spark, folder):
    out = queries.op7_toxicity(spark, folder).toPandas()
    labels = duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").df()
    assert len(out) == 10_000 and out.score.between(0, 1).all()
    assert ((out.score >= 0.5).astype(int) == out.predicted).all()
    both = out[out.held_out].merge(labels, on="doc_id")
    hit = ((both.predicted == 1) & (both.toxic == 1)).sum()
    assert hit / (both.predicted == 1).sum() > 0.85 and hit / (both.toxic == 1).sum() > 0.75
