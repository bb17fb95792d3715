"""Stored changes merged on reading, and exact search that leaves far vectors unread."""

import glob
import math

import numpy as np
import pytest

from sparkdesk.operators import contacts as K, pivots

ROWS = "id long, name string, phone string, city string, created_at timestamp_ntz"
EDITS = "id long, name string, phone string, city string, seq int"


def table(spark, n):
    return spark.range(1, n + 1).selectExpr("id", "concat('n', id) AS name", "cast(id AS string) AS phone",
                                            "'c' AS city", "timestamp_ntz'2025-01-01 00:00:00' AS created_at")


def rows(df):
    return {r.id: (r.name, r.phone, r.city) for r in df.collect()}


def test_changes_write_few_rows_and_read_alike(spark, tmp_path):
    base = str(tmp_path)
    K.commit(spark, base, lambda _: table(spark, 5000).repartition(8))
    before = {f: open(f, "rb").read() for f in glob.glob(base + "/v=1/*.parquet")}
    edits = spark.createDataFrame([(7, "late", None, "x", 2), (7, "early", "1", "x", 1), (9, "first", "2", "y", None),
                                   (9, "second", "3", "y", 0), (99999, "nobody", "4", "z", 1), (None, "q", "q", "q", 1)], EDITS)
    K.log_changes(spark, base, edits=edits)
    K.log_changes(spark, base, edits=spark.createDataFrame([(9, "third", None, None, 1), (11, "gone", "5", "y", 1)], EDITS),
                  deletes=spark.createDataFrame([(11,), (5000,), (11,), (None,), (123456,)], "id long"))
    # an edit of a key that a batch before deleted brings nothing back
    K.log_changes(spark, base, edits=spark.createDataFrame([(5000, "back", "6", "y", 1)], EDITS))
    assert {f: open(f, "rb").read() for f in glob.glob(base + "/v=1/*.parquet")} == before
    assert spark.read.parquet(base + "/changes/after=1").count() == 3 + 5 + 1 - 1
    want = rows(table(spark, 5000))
    want.update({7: ("late", None, "x"), 9: ("third", None, None)})
    del want[11], want[5000]
    current, version = K.read_latest(spark, base)
    assert version == 1 and rows(current) == want and current.columns == table(spark, 1).columns
    K.compact(spark, base)
    current, version = K.read_latest(spark, base)
    assert version == 2 and rows(current) == want
    # changes after the new snapshot start afresh, and ids of deleted rows are not given out again
    K.log_changes(spark, base, deletes=spark.createDataFrame([(1,)], "id long"))
    up = spark.createDataFrame([(1, "new", "77", "t")], "upload_pos int, name string, phone string, city string")
    K.commit_import(spark, base, up)
    del want[1]
    want[5001] = ("new", "77", "t")
    assert rows(K.read_latest(spark, base)[0]) == want


def test_unfinished_changes_are_not_read(spark, tmp_path):
    import os
    base = str(tmp_path)
    K.commit(spark, base, lambda _: table(spark, 3))
    path = K.log_changes(spark, base, deletes=spark.createDataFrame([(2,)], "id long"))
    assert set(rows(K.read_latest(spark, base)[0])) == {1, 3}
    os.rename(path + "/_SUCCESS", str(tmp_path / "mark"))
    assert set(rows(K.read_latest(spark, base)[0])) == {1, 2, 3}


def test_changes_on_no_table_and_no_changes(spark, tmp_path):
    with pytest.raises(ValueError):
        K.log_changes(spark, str(tmp_path))
    K.log_changes(spark, str(tmp_path), deletes=spark.createDataFrame([(2,)], "id long"))
    current, version = K.read_latest(spark, str(tmp_path))
    assert version == 0 and current.count() == 0
    K.compact(spark, str(tmp_path))
    assert K.read_latest(spark, str(tmp_path))[1] == 1


def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(((np.array(x) - np.array(v)) ** 2).sum()), i) for i, x in vectors)[:k]
        out.update({(q, r + 1): (i, dist) for r, (dist, i) in enumerate(d)})
    return out


def frame(spark, points, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points], f"{key} long, embedding array<double>")


def check(spark, vectors, queries, k, **kw):
    store = pivots.store_vectors(frame(spark, vectors, "vec_id"), pivots=kw.pop("pivots", 16))
    hits, effort = pivots.search(store, frame(spark, queries, "query_id"), k, **kw)
    got = {(r.query_id, r.rank): (r.id, r.distance) for r in hits.collect()}
    want = brute(vectors, queries, k)
    assert {a: v[0] for a, v in got.items()} == {a: v[0] for a, v in want.items()}
    assert all(math.isclose(got[a][1], want[a][1], rel_tol=1e-9, abs_tol=1e-12) for a in want)
    return {r.query_id: r.compared for r in effort.collect()}


def test_clusters_are_pruned_and_exact(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 16)) * 10
    vectors = [(i, centres[i % 30] + r.normal(size=16) * 0.1) for i in range(3000)]
    queries = [(q, centres[q % 30] + r.normal(size=16) * 0.1) for q in range(60)]
    effort = check(spark, vectors, queries, 5, pivots=64)
    assert len(effort) == 60
    # a tenth of all rows and less; a scan compares all 3000
    assert sum(effort.values()) / (60 * 3000) < 0.1


def test_unstructured_and_hot_cells_in_blocks(spark):
    r = np.random.default_rng(5)
    # a third of the rows are one vector (ties go to the smaller id), blocks much smaller than a cell
    vectors = [(i, np.ones(8) if i % 3 == 0 else r.normal(size=8)) for i in range(900)]
    queries = [(q, np.ones(8) if q % 2 else r.normal(size=8)) for q in range(40)]
    check(spark, vectors, queries, 7, vector_rows=50, query_rows=6)


def test_few_vectors_and_defined_edges(spark):
    check(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0])], [(5, [0.0, 1.0])], 4)
    bad = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [1.0, 1.0])],
                                "vec_id long, embedding array<double>")
    hits, effort = pivots.search(pivots.store_vectors(bad), bad.withColumnRenamed("vec_id", "query_id"), 3)
    assert [tuple(x) for x in hits.collect()] == [(4, 1, 4, 0.0)] and effort.first().compared == 1
    hits, effort = pivots.search(pivots.store_vectors(bad.where("vec_id < 3")), frame(spark, [(1, [0.0])], "query_id"), 3)
    assert hits.count() == 0 and effort.count() == 0
    none = frame(spark, [(1, [0.0, 0.0])], "query_id").where("query_id < 0")
    hits, _ = pivots.search(pivots.store_vectors(bad), none, 3)
    assert hits.count() == 0
