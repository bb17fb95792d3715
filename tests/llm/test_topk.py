import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdesk.llm import queries, topk
from tests.conftest import SF

KIND = "vec_id bigint, embedding array<float>, label int, id string, terms string, score string, rank string"


def frame(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], KIND)


def slow(rows, every, k):
    ok = sorted({(i, tuple(np.float32(x).item() for x in v)) for i, v in rows
                 if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in ok]
    out = []
    for q, a in ints:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, every, k):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k=k).collect())


@pytest.mark.parametrize("blocks", [(8192, 2048, 16), (7, 3, 2)])
def test_random_ties_and_invalid(spark, monkeypatch, blocks):
    for name, value in zip(("ROWS", "QUERIES", "CHUNK"), blocks):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.0, 0.5, -0.25, 1.0]) for _ in range(6)]) for i in range(40)]
    rows += [(100, None), (101, [float("nan")] * 6), (102, [float("inf"), 0, 0, 0, 0, 0]), (103, [None, 1, 1, 1, 1, 1]),
             (None, [1.0] * 6), (104, [0.0] * 6), (0, rows[0][1]), (5, rows[5][1]), (110, [1e6] * 6), (115, [-1e6] * 6)]
    rows += [(200 + i, [0.5] * 6) for i in range(30)]
    assert found(frame(spark, rows), 5, 4) == slow(rows, 5, 4)


def test_few_and_none(spark):
    assert found(frame(spark, []), 5, 3) == []
    assert found(frame(spark, [(0, [1.0, 2.0])]), 5, 3) == []
    rows = [(0, [1.0, 2.0]), (5, [1.0, -2.0]), (7, [3.0, 0.0])]
    assert found(frame(spark, rows), 5, 3) == slow(rows, 5, 3)


def test_whole_table_against_sql(spark):
    duckdb.sql(f"create or replace view embeddings as select * from '{SF}/embeddings.parquet'")
    want = duckdb.sql(topk.ORACLE).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    got = queries.op6_topk(spark, SF).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)
