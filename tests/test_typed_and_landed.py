"""Typed CSV reads, ingest statuses, stored pages, linear chunks, first rows over landings."""

import os
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sparkdesk.functions import patterns as P
from sparkdesk.operators import facets, numbering, pages, retrieval
from sparkdesk.sources import files as Fi
from sparkdesk.sources import ingest, typed
from sparkdesk.streaming.first_rows import first_rows, land_first_rows

ORDER = ["boolean", "bigint", "double", "date", "timestamp_ntz"]
VALUES = {"boolean": ["true", "False", "TRUE"], "bigint": ["0", "-12", "+7", "123456789012345678"],
          "double": ["1.5", ".5", "-2.", "1e5", "3E-2"], "date": ["2024-02-29", "1999-12-31"],
          "timestamp_ntz": ["2024-02-29 10:20:30", "2024-01-01T00:00:00.25"],
          "string": ["x", "2023-02-29", "1,5", "12a", "tRue", "nan nan", "1234567890123456789x"]}


def write(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode(encoding))


def test_narrowest_types(spark, tmp_path):
    rows = ["b,i,d,day,at,s,none,i2"]
    for k in range(6):
        rows.append(",".join([VALUES["boolean"][k % 3], VALUES["bigint"][k % 4], (VALUES["double"] + ["4"])[k],
                              VALUES["date"][k % 2], (VALUES["timestamp_ntz"] + ["2024-05-06"])[k % 3],
                              VALUES["string"][k], P.MISSING_TOKENS[k], "NA" if k % 2 else str(k)]))
    write(tmp_path / "in", "a.csv", "\n".join(rows).replace("1,5", '"1,5"'))
    df = typed.read_csv_typed(spark, str(tmp_path / "in"))
    assert dict(df.dtypes) == {"b": "boolean", "i": "bigint", "d": "double", "day": "date", "at": "timestamp_ntz",
                               "s": "string", "none": "string", "i2": "bigint"}
    assert df.where("i2 is null").count() == 3 and df.where("none is not null").count() == 0
    assert df.agg(F.sum("d")).first()[0] == pytest.approx(1.5 + .5 - 2 + 1e5 + .03 + 4)


def test_every_missing_token(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "n,v\n" + "\n".join(f'{k},"{t}"' for k, t in enumerate(P.MISSING_TOKENS)) + "\n99,5\n")
    df = typed.read_csv_typed(spark, str(tmp_path / "in"))
    assert dict(df.dtypes) == {"n": "bigint", "v": "bigint"}
    assert [(r.n, r.v) for r in df.where("v is not null").collect()] == [(99, 5)]
    assert df.count() == len(P.MISSING_TOKENS) + 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([v for vs in VALUES.values() for v in vs] + [None]), min_size=1, max_size=4),
                min_size=2, max_size=3))
def test_types_of_parts_join(spark, parts):
    frame = lambda vs: spark.createDataFrame([(v,) for v in vs], "v string")          # noqa: E731
    known = lambda vs: typed.column_types(frame(vs))["v"] if any(v is not None for v in vs) else None
    joined = None
    for p in parts:
        joined = typed.join_types(joined, known(p)) if joined or known(p) else None
    assert (joined or "string") == typed.column_types(frame([v for p in parts for v in p]))["v"]


def test_empty_and_odd_columns(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "a.b,c`d,E\n")
    df = typed.read_csv_typed(spark, str(tmp_path / "in"))
    assert df.count() == 0 and {t for _, t in df.dtypes} == {"string"}


def test_encodings_without_a_file_list(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(12):
        text = f'k,v\n{k},"é{k}\n""ü"""\n'
        write(folder, f"part{k}.csv", text, "utf-8" if k % 3 else "latin-1")
    df = Fi.read_csv_any_encoding(spark, folder, "k int, v string", multiline=True)
    rows = df.orderBy("k").collect()
    assert [(r.k, r.v, r.encoding) for r in rows] == [
        (k, f'é{k}\n"ü"', "UTF-8" if k % 3 else "ISO-8859-1") for k in range(12)]
    assert "part3.csv" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_file_statuses(spark, tmp_path):
    folder = str(tmp_path / "in")
    good = '"id",name\n1,"a"\n2,b\n'
    for name, text in {"ok.csv": good, "empty.csv": "", "header.csv": "id,name\n", "other.csv": "x,y\n1,2\n",
                       "binary.csv": b"id,name\n\x00\x01\n", "blank.csv": "id,name\n\n  \n"}.items():
        write(folder, name, text)
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.lines, r.size)
           for r in ingest.file_report(spark, folder, ["id", "name"]).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        "ok.csv": ("ok", 2), "header.csv": ("empty", 0), "other.csv": ("bad file", 1),
        "binary.csv": ("bad file", 1), "blank.csv": ("empty", 0)}
    assert got["ok.csv"][2] == len(good)
    os.makedirs(tmp_path / "bare")
    write(str(tmp_path / "zero"), "zero.csv", "")
    report = ingest.landing_report(spark, {"mixed": folder, "bare": str(tmp_path / "bare"), "zero": str(tmp_path / "zero"), "gone": str(tmp_path / "gone")},
                                   ["id", "name"])
    assert {r.source: (r.status, r.files, r.good_files, r.lines) for r in report.collect()} == {
        "mixed": ("bad file", 6, 1, 2), "bare": ("none found", 0, 0, 0), "zero": ("empty", 1, 0, 0), "gone": ("none found", 0, 0, 0)}


def test_pages_read_their_files_only(spark, tmp_path):
    n = 5000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.lit("x").alias("v")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = pages.store(df, "k", str(tmp_path / "pages"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = kept.index().count()
    assert kept.count() == n and parts > 3
    for number in (1, 250, n // 10, n // 10 + 1):
        page = kept.page(number, 10)
        want = list(range((number - 1) * 10, min(number * 10, n)))
        assert [(r.k, r.s_no) for r in page.orderBy("s_no").collect()] == [(k, k + 1) for k in want]
        assert len(kept.parts_of(number * 10 - 9, number * 10)) <= 2
        if want:
            opened = {f.split("_folder=")[1].split("/")[0] for f in page.inputFiles() if "_folder=" in f}
            assert len(opened) <= 2 < parts
    with pytest.raises(ValueError):
        kept.page(0, 10)


def test_pages_of_nothing_and_of_ties(spark):
    none = pages.store(spark.createDataFrame([], "k long, v string"), "k")
    assert none.count() == 0 and none.page(1, 5).count() == 0
    same = pages.store(spark.range(300).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("v")), "k")
    rows = [r.s_no for p in range(1, 32) for r in same.page(p, 10).collect()]
    assert sorted(rows) == list(range(1, 301))
    assert numbering.slice_rows(spark.range(9), "id", 3, 2).count() == 0


def test_first_seen_order(spark):
    rows = [("b", 3), ("a", 7), ("b", 1), (None, 0), ("c", 2), ("a", 2)]
    got = facets.first_seen(spark.createDataFrame(rows, "v string, pos long").repartition(4), "v", "pos")
    assert [(r.option, r.ord) for r in got.orderBy("ord").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    assert facets.first_seen(spark.createDataFrame([], "v string, pos long"), "v", "pos").count() == 0


def test_chunks_of_a_long_text_take_linear_time(spark):
    text = "".join(random.Random(1).choice("aé中\U0001f642 \n") for _ in range(1 << 16)) * 64      # 4 million code points
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    rows = retrieval.chunk_text(df).orderBy("chunk_no").collect()
    assert time.time() - began < 60
    step = P.CHUNK_SIZE - P.CHUNK_OVERLAP
    assert [r.chunk for r in rows] == [text[k:k + P.CHUNK_SIZE] for k in range(0, len(text), step)]


@pytest.mark.parametrize("size,overlap", [(1, 0), (5, 4), (7, 3), (10, 9), (4, 0), (50, 1)])
def test_chunks_for_any_overlap(spark, size, overlap):
    texts = ["", "a", "aé\U0001f642\n" * 9, "x" * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.chunk_no): r.chunk for r in retrieval.chunk_text(df, size=size, overlap=overlap).collect()}
    assert got == {(d, c): t[k:k + size] for d, t in enumerate(texts) if t
                   for c, k in enumerate(range(0, len(t), size - overlap))}


def test_first_rows_survive_a_broken_run(spark, tmp_path):
    base, inbox, schema = str(tmp_path / "base"), str(tmp_path / "inbox"), "file string, pos long, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)         # noqa: E731
    frame([("a", 2, "a2"), ("a", 1, "a1"), ("b", 5, "b5"), (None, 1, "no name")]).write.mode("append").parquet(inbox)
    kind = frame([]).schema
    assert land_first_rows(spark, inbox, kind, base) == 1
    frame([("a", 0, "late"), ("c", 1, "c1")]).write.mode("append").parquet(inbox)
    assert land_first_rows(spark, inbox, kind, base) == 2
    # the result of run 2 is lost before it was complete: the next call does that run again
    for name in os.listdir(f"{base}/first/v=2"):
        if "_SUCCESS" in name:
            os.remove(f"{base}/first/v=2/{name}")
    frame([("d", 1, "d1"), ("b", 1, "late")]).write.mode("append").parquet(inbox)
    assert land_first_rows(spark, inbox, kind, base) == 2
    assert land_first_rows(spark, inbox, kind, base) == 3                   # nothing new
    rows = first_rows(spark, base, kind).orderBy("file").collect()
    assert [(r.file, r.pos, r.text) for r in rows] == [("a", 1, "a1"), ("b", 5, "b5"), ("c", 1, "c1"), ("d", 1, "d1")]


def test_equal_rows_spread_over_partitions(spark):
    same = spark.range(4000).select(F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = numbering._ordered(same, [], ["k"]).groupBy("_part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 3000
    assert [r.n for r in numbering.number_rows(same, "k", "n").orderBy("n").collect()] == list(range(1, 4001))


def test_carry_is_sent_to_the_rows(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), F.col("id").alias("pos"), (F.col("id") * 1.0).alias("v"))
    plan = numbering.previous_values(df, "v", "pos", "g", number="no")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_change_from_a_negative_zero(spark):
    from sparkdesk.operators import bills
    df = spark.createDataFrame([(1, -0.0), (2, 5.0), (3, 0.0), (4, 5.0), (5, -0.0), (6, -5.0)], "pos long, amount double")
    got = [r.pct_change for r in bills.with_change(df, "amount", "pos").orderBy("pos").collect()]
    assert got == [None, float("-inf"), -100.0, float("inf"), -100.0, float("inf")]
