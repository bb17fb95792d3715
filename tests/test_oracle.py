"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), and rows-only queries produce rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check_oracle import duck, rows_of

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(rows) > 0
        return
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert rows_of(df.columns, rows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.schema == entry.entry(spark).schema


def test_csv_encodings_round_trip(spark):
    from pyspark.sql import functions as F
    from sparkdesk.sources import views as V
    got = QUERIES["csv_encodings"](spark, SF).select("doc_id", F.col("text").alias("back"), "encoding")
    src = V.docs(spark, SF).select("doc_id", "lang", "text")
    j = src.join(got, "doc_id")
    assert j.count() == src.count()
    utf = j.where(F.col("lang").isin("en", "es"))
    assert utf.where(F.col("encoding") != "UTF-8").count() == 0
    assert utf.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
    # Latin-1 files decode back to the source wherever the text is Latin-1 encodable
    rows = j.where(~F.col("lang").isin("en", "es")).select("text", "back").collect()
    same = [r for r in rows if r.text is not None and all(ord(ch) < 256 for ch in r.text)]
    assert same and all(r.back == r.text for r in same)


def test_landed_profile_matches_source(spark):
    from pyspark.sql import functions as F
    from sparkdesk.sources import views as V
    r = QUERIES["landed_profile"](spark, SF).first()
    h = V.health(spark, SF)
    nulls = h.select(sum(F.col(c).isNull().cast("long") for c in h.columns).alias("n")).agg(F.sum("n")).first()[0]
    assert (r.rows, r.columns, r.missing, r.files, r.status) == (h.count(), 5, nulls, 1, "ok")
    assert r.file_bytes > 0


def test_text_files_and_dispatch_values(spark):
    from sparkdesk.sources import views as V
    tf = QUERIES["text_files"](spark, SF).collect()
    assert {r.status for r in tf} == {"ok", "quarantine"}
    assert all((r.text is None) == (r.status == "quarantine") for r in tf)
    fd = {r.kind: r for r in QUERIES["format_dispatch"](spark, SF).collect()}
    assert fd["csv"].rows == V.health(spark, SF).count() and fd["csv"].status == "ok"
    assert fd["txt"].rows == 1 and fd["unsupported"].status == "unsupported"
