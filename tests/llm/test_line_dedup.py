import random

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from sparkdesk.llm import line_dedup, queries
from tests.conftest import SF
from tests.llm.data import documents, edge_documents, none


def slow(rows):
    """rows: (id, text) -> text of each; ids in order of nulls, then value."""
    first, cover = {}, {}
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: x[:2])
    for has, i, t in order:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if w not in first:
                first[w] = (has, i, t, p)
            else:
                fh, fi, ft, fp = first[w]
                since = max(p, fp + 3) if (fh, fi, ft) == (has, i, t) else p
                cover.setdefault((has, i, t), set()).update(range(since, p + 3))
    out = []
    for i, t in rows:
        gone = cover.get((i is not None, i or 0, t), set()) if t is not None else set()
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "text").collect()), key=str)


def test_random_lines(spark):
    r = random.Random(1)
    texts = ["\n".join(r.choice("abcd") * r.choice([0, 1, 1]) for _ in range(r.randrange(0, 14))) for _ in range(80)]
    texts += ["a\na\na\na\na\na", None, "", "a\nb", "\n\n\n\n", "é\nü\nñ\n", "é\nü\nñ\nx"]
    df = documents(spark, texts)
    df = df.union(df.limit(5))
    assert found(df) == slow([(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()])


def test_edges(spark):
    df = edge_documents(spark)
    out = line_dedup.dedup_lines(df)
    assert out.schema.names == df.schema.names
    assert found(df) == slow([(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()])
    assert line_dedup.dedup_lines(none(spark)).count() == 0


def test_hot_passage_and_long_text(spark):
    passage = "first\nsecond\nthird"
    texts = [f"own {i}\n{passage}\nend {i}" for i in range(300)] + ["\n".join(f"l{i % 5000}" for i in range(20_000))]
    df = documents(spark, texts)
    got = dict(found(df))
    assert got[0] == texts[0] and all(got[i] == f"own {i}\nend {i}" for i in range(1, 300))
    assert got[300] == "\n".join(f"l{i}" for i in range(5000))


def test_whole_table_against_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(line_dedup.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op1_line_dedup(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)
    assert got.n_removed.sum() > 0


def test_columns_with_the_operators_own_names(spark):
    names = ["_th", "_th_", "_id", "_id_", "_gone", "_gone_", "_gone_th", "_lines", "_Lines_", "h1", "until"]
    texts = ["a\nb\nc\nd", "x\na\nb\nc", None]
    df = documents(spark, texts).select("doc_id", "text").select("*", *[F.lit(n).alias(n) for n in names])
    rows = line_dedup.dedup_lines(df, lines_col="n_lines", removed_col="gone_th").orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.gone_th) for r in rows] == [(texts[0], 4, 0), ("x", 4, 3), (None, 0, 0)]
    assert all(r[n] == n for r in rows for n in names)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, lines_col="_TH")
