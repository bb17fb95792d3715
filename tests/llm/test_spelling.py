import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sparkdesk.llm import queries, spelling
from tests.conftest import SF
from tests.llm.data import documents, edge_documents, none


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(vocabulary, ratio=10):
    """By deletion neighbourhoods, each match verified."""
    shared = defaultdict(set)
    for w in vocabulary:
        for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            shared[v].add(w)
    near = defaultdict(set)
    for group in shared.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in vocabulary:
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        if best is not None and vocabulary[best] >= ratio * vocabulary[w]:
            form[w] = best
    out = {}
    for w, n in vocabulary.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), vocabulary[form[w]] if w in form else None, root)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def words_of(rows):
    out = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


@pytest.mark.parametrize("letters,shortest,longest,size,most", [
    ("abc", 1, 6, 300, 20), ("abcé", 3, 9, 1500, 50), ("ab", 1, 9, 400, 5), ("abcdefghij", 7, 9, 2000, 20_000)])
def test_any_vocabulary(spark, letters, shortest, longest, size, most):
    r = random.Random(size)
    vocabulary = {"".join(r.choice(letters) for _ in range(r.randrange(shortest, longest + 1))): int(10 ** (4 * r.random())) + 1
                  for _ in range(size)}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert found(spelling.variants(df, most=most)) == brute(vocabulary)


def test_hot_list_is_cut(spark):
    # a third of the words share their first letters, another third their last ones
    r = random.Random(2)
    tail = lambda n: "".join(r.choice("abcde") for _ in range(n))
    vocabulary = {w: r.randrange(1, 5000) for w in
                  {"prefix" + tail(5) for _ in range(700)} | {tail(5) + "suffix" for _ in range(700)}
                  | {tail(8) for _ in range(300)}}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    lists = spelling.sorted_lists(df, 40)
    assert lists.where("free > 1").groupBy("key").count().where("count > 40").count() == 0
    assert found(spelling.variants(df, most=40)) == brute(vocabulary)


def test_chain_of_forms(spark):
    words = [("aaaaaaaa", 1), ("aaaaaaab", 10), ("aaaaaabb", 100), ("aaaaabbb", 1000), ("aaaabbbb", 10 ** 4),
             ("aaabbbbb", 10 ** 5), ("aabbbbbb", 10 ** 6)]
    rows = found(spelling.variants(spark.createDataFrame(words, "word string, n long")))
    assert {r[4] for r in rows.values()} == {"aabbbbbb"}


def test_ties_go_to_the_smaller(spark):
    rows = found(spelling.variants(spark.createDataFrame(
        [("mmmmmmm", 1), ("mmmmmmz", 50), ("mmmmmma", 50)], "word string, n long")))
    assert rows["mmmmmmm"] == (1, 2, "mmmmmma", 50, "mmmmmma")


def test_long_text_and_blocks(spark, monkeypatch):
    text = "Wordsworth÷Éclairs " * 30_000 + "x" * 300_000
    monkeypatch.setattr(spelling, "BLOCK", 1000)
    assert spelling.document_words("1", text.encode(), 7, 31) == Counter(
        {k: v for k, v in words_of([(1, text), (1, "x" * 300_000)]).items() if k[:1] != "x"}
        | {w: 1 for w in ["x" * 300_000]})


def test_edge_rows(spark):
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = spelling.word_counts(docs, drop_every=31)
    assert {r.word: r.n for r in words.collect()} == words_of(rows)
    assert found(spelling.variants(words)) == brute(words_of(rows))
    assert spelling.variants(spelling.word_counts(none(spark))).count() == 0
    assert spelling.word_counts(documents(spark, [None, "", "short"])).count() == 0


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.op12_spelling(spark, SF)) == brute(words_of([tuple(r) for r in docs]))
