import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from sparkdesk.llm import pii, queries
from tests.conftest import SF
from tests.llm.data import documents, edge_documents, none

PLAIN = {                                    # the base patterns as the contract writes them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, d in enumerate(map(int, reversed(number))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def slow(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def found(df, base=True):
    rows = pii.find(df).select("doc_id", F.filter("spans", lambda s: s["base"] | F.lit(not base)).alias("s")).collect()
    return [(r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.s]) for r in rows]


def test_random_texts(spark):
    r = random.Random(4)
    parts = ["a.b@c.de", "x@", "@y.z", "1.2.3.4", "256.1.1.1", "001.2.3.040.5", "4111 1111 1111 1111", "4111111111111112",
             "+1 (555) 010-2030", "+49 30 1234 5678-", "++12", "é", "\U0001f642", " ", " ", "\n", ".", "%", "-", "7", "12",
             "a@b.c%d@e.f", "5500-0000-0000-0004", "(", ")", "q"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 25))) for _ in range(600)]
    df = documents(spark, texts)
    got = dict(found(df))
    for i, t in enumerate(texts):
        assert got[i] == slow(t), t


def test_edges(spark):
    df = edge_documents(spark)
    assert sorted(found(df), key=str) == sorted(((r.doc_id, slow(r.text)) for r in df.collect()), key=str)
    assert found(none(spark)) == []
    masked = pii.mask(df)
    assert masked.schema.names == df.schema.names
    assert sorted(map(str, masked.collect())) == sorted(map(str, df.collect()))
    assert pii.mask(none(spark)).count() == 0


def test_many_matches_and_long_runs(spark):
    many = "a@b.co 1.2.3.4 " * 3000
    texts = [many, "a" * 300_000, "1" * 300_000, "1." * 100_000, "+1-" * 100_000, "x." * 50_000 + "@", "a@" + "b." * 50_000]
    df = documents(spark, texts)
    t0 = time.time()
    got = dict(found(df))
    assert time.time() - t0 < 90
    assert got[0] == slow(many)
    assert got[1] == got[2] == got[4] == got[5] == []
    assert got[3] == [f"ip:{8 * i}:{8 * i + 7}" for i in range(25_000)]
    assert got[6] == ["email:0:100001"]


def test_method_adds_spans_and_masks(spark):
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'user token = "{secret}" end'] * 30 + ["call me at 1.2.3.4 or bob@mail.com, page 12"] * 30 + ["plain words"] * 30
    df = documents(spark, texts)
    spans = dict(found(df, base=False))
    assert spans[0] == [f"secret:{texts[0].index(secret)}:{texts[0].index(secret) + 40}"]
    assert spans[30] == slow(texts[30]) and spans[60] == []
    out = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert out[0] == 'user token = "[SECRET]" end' and out[60] == "plain words"
    assert out[30] == "call me at [IP] or [EMAIL], page 12"


def test_reliabilities(spark):
    """EM tells a labeler that follows the truth from one that votes at random."""
    r, rows = random.Random(2), []
    for _ in range(4000):
        true = r.random() < 0.5
        good = lambda p: (1 if true else -1) * (1 if r.random() < p else -1)      # noqa: E731, B023
        rows.append(([(0, 5, "id", False, good(0.95), good(0.9), r.choice([-1, 0, 1]), good(0.9), 9)],))
    kind = "array<struct<start:int,end:int,kind:string,base:boolean,shape:int,gazetteer:int,context:int,check:int,length:int>>"
    model = pii.fit(spark.createDataFrame(rows, f"found {kind}"), "found")
    right = {n: (t[1][2] + t[0][0]) / 2 for n, t in model["reliability"].items()}
    assert right["shape"] > 0.88 and right["gazetteer"] > 0.8 and right["check"] > 0.8 and right["context"] < 0.5
    assert model["weights"]["shape=1"] > model["weights"]["shape=-1"]


def test_running_sum(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    for n in (1, 2, 3, 4, 7, 30):
        row = spark.range(1).select(pii.running_sum(F.array(*[F.lit(i) for i in range(1, n + 1)])).alias("s")).first()
        assert row.s == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op4_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, got = slow(r.text), rows[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [
            sum(s.startswith(k + ":") for s in want) for k in pii.BASE]
        assert set(want) <= set(got.spans.split(",")) if want else True
    assert len(rows) == 1000
