import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdesk.llm import ann, queries
from tests.conftest import SF
from tests.llm.test_topk import frame


def slow(rows, every, k):
    ok = sorted({(i, tuple(np.float32(x).item() for x in v)) for i, v in rows
                 if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    unit = {r: np.array(r[1]) / np.linalg.norm(r[1]) for r in ok}
    out = {}
    for q in ok:
        if q[0] % every == 0:
            best = sorted((-round(float(unit[q] @ unit[c]), 9), c[0]) for c in ok if c[0] != q[0])[:k]
            out[q[0]] = [(i, -s) for s, i in best]
    return out


def found(df, every, k):
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % every == 0, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(out[r.query_id])
    return out


def test_hilbert_keys_are_a_walk():
    """Every cell once, and neighbours on the curve are neighbours in space."""
    for n, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("slab,block", [(2048, 2048), (5, 3)])
def test_small_tables_are_exact(spark, monkeypatch, slab, block):
    monkeypatch.setattr(ann, "SLAB", slab)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(300 + i, [1.0, 2.0, 0, 0, 0, 0, 0, 1.0]) for i in range(50)]          # one common vector
    rows += [(400, None), (405, [0.0] * 8), (410, [float("nan")] * 8), (415, [None] + [1.0] * 7), (None, [1.0] * 8),
             (420, [float("inf")] * 8), (0, rows[0][1]), (10, rows[10][1])]
    assert found(frame(spark, rows), 5, 4) == slow(rows, 5, 4)


def test_few_and_none(spark):
    assert found(frame(spark, []), 5, 3) == {}
    assert found(frame(spark, [(0, [1.0, 2.0])]), 5, 3) == {}
    rows = [(0, [1.0, 2.0]), (5, [1.0, -2.0]), (7, [3.0, 0.0]), (10, [1.0])]
    got = found(frame(spark, rows), 5, 3)
    assert got == {0: [(7, 0.447213595), (5, -0.6)], 5: [(7, 0.447213595), (0, -0.6)]}


def test_places_count_every_row(spark):
    r = random.Random(2)
    reps = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(500)],
                                 "rid bigint, vec array<float>").repartition(7)
    rows = ann._places(reps, 3).collect()
    for c in range(3):
        assert sorted(x.place for x in rows if x.curve == c) == list(range(500))


def test_recall(spark):
    """At least 0.9 of the true nearest, on the largest table of the test data."""
    folder = SF.replace("sf0.01", "sf0.1")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = slow([(r.vec_id, r.embedding) for r in rows], 50, 5)
    got = queries.op3_hilbert_ann(spark, folder).collect()
    assert len(got) == 5 * len(want)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits / len(got) >= 0.9


def test_first_word_is_the_cell():
    """The words after the first only order the rows of one cell."""
    cells = np.random.default_rng(1).integers(0, 1 << 6, (500, 8))
    deep = cells << ann.FINE | np.random.default_rng(2).integers(0, 1 << ann.FINE, cells.shape)
    whole = ann._word(ann._transposed(deep, 6 + ann.FINE), 6 + ann.FINE, ann.FINE)
    assert (whole == ann.hilbert_keys(cells, 6)).all()


@pytest.mark.parametrize("noise", [1e-3, 1e-4, 1e-5])
def test_recall_among_near_copies(spark, noise):
    """At least 0.9 of the true nearest where a third of the rows are near copies of one vector."""
    r = np.random.default_rng(7)
    x = r.standard_normal((3000, 64))
    hot = r.permutation(3000)[:1000]
    x[hot] = x[hot[0]] + noise * r.standard_normal((1000, 64))
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    asks = sorted(int(i) for i in hot if i % 20 == 0)
    score = unit[asks] @ unit.T
    score[np.arange(len(asks)), asks] = -1
    want = {q: set(row) for q, row in zip(asks, np.argsort(-score, axis=1, kind="stable")[:, :5].tolist())}
    got = [x for x in ann.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]),
                                  F.col("vec_id") % 20 == 0).collect() if x.query_id in want]
    assert len(got) == 5 * len(asks)
    assert sum(x.vec_id in want[x.query_id] for x in got) / len(got) >= 0.9


def test_multiples_are_one_point(spark):
    """Rows that are multiples of one vector are found by their ids, as equal rows are."""
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(1200)]
    rows[300:900] = [(i, [c * x for x in (1.0, 2, 0, -3, 0, 0, 5, 1)]) for c, i in enumerate(range(300, 900), 1)]
    got = found(frame(spark, rows), 5, 4)
    for q in range(300, 900, 5):
        assert [i for i, _ in got[q]] == [i for i in range(300, 305) if i != q][:4]
    assert found(frame(spark, [(0, [1.0, 2.0]), (0, [2.0, 4.0]), (1, [3.0, 6.0]), (1, [0.5, 1.0]), (2, [1.0, 0.0])]),
                 5, 2) == {0: [(1, 1.0), (2, 0.447213595)]}


def test_only_windows_are_scored(spark):
    """A query is scored against the rows of its windows, not against their whole slabs."""
    r = np.random.default_rng(6)
    df = frame(spark, [(i, r.standard_normal(16).tolist()) for i in range(1500)])
    rows = ann.nearest(df, F.col("vec_id") % 50 == 0, k=3, curves=4, window=0.02).collect()
    assert len(rows) == 30 * 3
    # 100 rows to either side, and itself, on each curve
    assert all(4 * 101 <= x.scored <= 4 * 201 for x in rows)


def test_an_id_with_two_vectors(spark):
    rows = [(1, [0.9, 0.1]), (1, [-1.0, 0.2]), (5, [1.0, 0.0]), (7, [0.0, 1.0])]
    got = found(frame(spark, rows), 5, 3)
    # components are stored as float
    assert [(i, round(x, 6)) for i, x in got.pop(5)] == [(1, 0.993884), (7, 0.0), (1, -0.980581)] and not got
