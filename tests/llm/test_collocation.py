import random
import re
from collections import Counter

import pytest

from sparkdesk.llm import collocation
from tests.llm.data import documents, edge_documents, none


def brute(rows, max_words=3, least=10):
    """Every gram counted on its own; ``{(lang, phrase): (a, l, r, n, score)}``."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = {}
    for (lang, *w), a in found.items():
        inside = any(o[0] == lang and len(o) > len(w) + 1 and 100 * n >= 50 * a
                     and any(list(o[i:i + len(w)]) == w for i in range(1, len(o) - len(w) + 1))
                     for o, n in found.items())
        if not inside:
            cuts = [(10 ** 6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang, " ".join(w)] = (a, f[lang, *w[:k]], f[lang, *w[k:]], total[lang], score)
    return out


def found(df):
    rows = df.collect()
    out = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(seed, n, letters="abcdef"):
    r = random.Random(seed)
    fixed = " ".join(r.choice("ghijkl") + str(k) for k in range(14))          # one long unary path
    return [" ".join(r.choice(letters) + r.choice(["", "", "", ",", "."]) for _ in range(r.randrange(40)))
            + (f". {fixed}" if r.random() < 0.4 else "") for _ in range(n)]


@pytest.mark.parametrize("max_words", [2, 3, 4, 5])
def test_random_texts(spark, max_words):
    docs = documents(spark, texts(max_words, 150))
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(collocation.collocations(docs, max_words)) == brute(rows, max_words)


def test_flows_over_batch_edges_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(collocation, "RUNS", 3)
    docs = documents(spark, texts(9, 200, "abcdefghij"))
    rows = [(r.lang, r.text) for r in docs.collect()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert found(collocation.collocations(docs)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_grams_of_one_text():
    r = random.Random(4)
    pieces = [[r.choice("abc") for _ in range(r.randrange(1, 60))] for _ in range(40)]
    columns, counts = collocation.grams(" ; ".join(" ".join(p) for p in pieces).upper().encode(), 3)
    want = Counter(tuple(x.encode() for x in [*p, "", ""][i:i + 3]) for p in pieces for i in range(len(p)))
    assert Counter(dict(zip(zip(*(c.to_pylist() for c in columns)), counts.tolist()))) == want


def test_many_words_to_a_gram():
    # codes of long grams over many words pass 62 bits
    text = " ".join(f"w{k}" for k in range(3000)).encode()
    columns, counts = collocation.grams(text, 9)
    assert len(counts) == 3000 and set(counts.tolist()) == {1}
    assert [c[0].as_py() for c in columns] == [f"w{k}".encode() for k in range(9)]


def test_paths_are_compact(spark):
    docs = documents(spark, ["one two three four five six seven"] * 12 + ["two three four five x"] * 10)
    g = collocation.graph(docs, 3, 10)
    got = collocation.paths(g.where("level = 3").select("lang", "phrase", "n"), g.where("level = 2")).collect()
    assert sorted((" ".join(r["words"]), r.n) for r in got) == [
        ("four five six seven", 12), ("four five x", 10), ("one two three", 12),
        ("two three four five", 22)]


def test_control_bytes_and_separators(spark):
    odd = ["a\x01 b\x0e c\x02", "a b\x01 c", "a b c\x1f", "x\ty\t z", "p\x0bq\x0cr", "a b c"]
    rows = [("l\tang" if k % 2 else None, t) for k, t in enumerate(odd * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(collocation.collocations(docs)) == brute(rows)


def test_exact_past_64_bits(spark):
    big = 3 * 10 ** 14
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, phrase string, n long")
    one = spark.createDataFrame([("en", "a b", big - 1, None, None)],
                                "lang string, phrase string, a long, l_known long, r_known long")
    row = collocation.scored(one, counts).first()
    assert row.score == 10 ** 6 * (big - 1) ** 2 // (big * (big + 7))


def test_ranks(spark):
    rows = [("en", "b c", 10, 5), ("en", "a c", 10, 5), ("en", "d", 12, 5), ("en", "é", 12, 5), ("fr", "z", 1, 9)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = [(r.lang, r["rank"], r.phrase) for r in collocation.best(df, 3).orderBy("lang", "rank").collect()]
    assert got == [("en", 1, "d"), ("en", 2, "é"), ("en", 3, "a c"), ("fr", 1, "z")]


def test_edge_rows(spark):
    docs = edge_documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(collocation.collocations(docs, min_count=2)) == brute(rows, least=2)
    assert collocation.collocations(none(spark)).count() == 0
