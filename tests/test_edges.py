"""Hand-made edge rows (FIXTURES.md §4) and golden values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkdesk.functions import exprs as X
from sparkdesk.functions import patterns as P
from sparkdesk.operators import (bills, chat, contacts, facets, profile, retrieval, series, text,
                                 timeline)


def test_tail_chunk_inside_overlap(spark):
    df = spark.createDataFrame([(1, "a" * 460)], "doc_id long, text string")
    rows = retrieval.chunk_text(df).orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in rows] == [460, 10]


def test_empty_and_null_text_give_no_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert retrieval.chunk_text(df).count() == 0


def test_bad_chunk_parameters(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    with pytest.raises(ValueError):
        retrieval.chunk_text(df, size=10, overlap=10)


def test_chunks_count_code_points(spark):
    s = "é😀" * 300
    df = spark.createDataFrame([(1, s)], "doc_id long, text string")
    rows = retrieval.chunk_text(df, size=100, overlap=10).orderBy("chunk_no").collect()
    assert [r.chunk for r in rows] == [s[i:i + 100] for i in range(0, len(s), 90)]


def _changes(spark, vals, fill):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "pos long, amount double")
    return [(r.pct_change, r.anomaly) for r in
            bills.with_change(df, "amount", "pos", fill=fill).orderBy("pos").collect()]


def test_change_from_zero_is_spike(spark):
    assert _changes(spark, [0.0, 5.0], "pad") == [(None, "Normal"), (math.inf, P.SPIKE_LABEL)]


def test_change_through_null(spark):
    pad = _changes(spark, [10.0, None, 12.0], "pad")
    assert pad[0][0] is None and pad[1][0] == 0.0 and abs(pad[2][0] - 20.0) < 1e-9
    assert [c for c, _ in _changes(spark, [10.0, None, 12.0], "none")] == [None, None, None]


def test_month_outside_list(spark):
    df = spark.createDataFrame([("1 Jan 2024 - 1 January 2024",), ("1 Jan 2024 - 3 Feb 2024",)],
                               "statement_period string")
    rows = bills.with_month_year(df).collect()
    assert rows[0].month is None and rows[0].month_ord is None
    assert rows[1].month == "Feb" and rows[1].month_ord == 2 and rows[1].year == "2024"
    assert bills.month_filter(bills.with_month_year(df)).count() == 1


def test_one_bill_only(spark):
    df = spark.createDataFrame([(1, 100.0, "Jan", 1, "2024")],
                               "pos long, amount double, month string, month_ord int, year string")
    rows = bills.insights(df).collect()
    assert [r.message for r in rows] == [P.NO_DATA_INSIGHT]


def test_insight_messages(spark):
    df = spark.createDataFrame([(1, 100.0, "Jan", 1, "2024"), (2, 150.0, "Feb", 2, "2024"),
                                (3, 120.0, "Mar", 3, "2024")],
                               "pos long, amount double, month string, month_ord int, year string")
    msgs = [r.message for r in bills.insights(df).orderBy("seq").collect()]
    assert msgs == ["📈 Overall trend is increasing", "🔺 Spike detected: +50.0% in Feb",
                    "🔻 Drop detected: -20.0% in Mar", "💰 Highest bill: ₹150.00 (Feb)",
                    "💸 Lowest bill: ₹100.00 (Jan)"]


def test_bill_field_extraction(spark):
    t = ("Hello x.y-z@mail.example call 9876543210 now\nAirtel Black Plan 599\rtail\n"
         "id 123456789012345 Statement 1 Jan 2024 - 31 Jan 2024 due 15 Feb 2024 ₹ 1,234.50")
    df = spark.createDataFrame([("f.pdf", t)], "file string, text string")
    r = bills.extract_fields(df).first()
    assert r.email == "x.y-z@mail.example"
    assert r.phone == "9876543210"
    assert r.plan == "Airtel Black Plan 599\rtail"     # only \n ends the line
    assert r.account_id == "123456789012345"
    assert r.statement_date == "1 Jan 2024" and r.due_date == "15 Feb 2024"
    assert r.statement_period == "1 Jan 2024 - 31 Jan 2024"
    assert r.amount == 1234.5


def test_digits_need_unicode_word_boundary(spark):
    df = spark.createDataFrame([("é9876543210",), ("_9876543210",), (" 9876543210é",), ("x 9876543210.",)], "t string")
    got = [r.p for r in df.select(X.bounded_digits("t", "10").alias("p")).collect()]
    assert got == [None, None, None, "9876543210"]


def test_null_name_search_drops_row(spark):
    df = spark.createDataFrame([(1, None), (2, "Anna"), (3, "bob")], "id long, name string")
    assert [r.id for r in facets.search(df, "^[ab]").orderBy("id").collect()] == [2, 3]
    assert facets.search(df, "").count() == 3
    with pytest.raises(ValueError):
        facets.search(df, "(")


def test_page_count_exact_multiple(spark):
    df = spark.range(20)
    r = facets.page_counts(df, [10]).first()
    assert r.page_count == 3 and r.page_count_exact == 2


def test_title_case(spark):
    df = spark.createDataFrame([("cote d'ivoire",), ("united states",), ("NATION_3",)], "s string")
    assert [r.t for r in df.select(X.py_title("s").alias("t")).collect()] == \
        ["cote d'ivoire".title(), "united states".title(), "NATION_3".title()]


def test_strip_unicode_whitespace(spark):
    s = "\t  hi there  \n"
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(X.py_strip("s").alias("t")).first().t == s.strip()


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(76.25,)], "heart_rate double")
    assert series.kpis(df).first().avg_heart_rate == 76.2


def test_malformed_end_is_run_time(spark):
    h = spark.createDataFrame([("o", 1, "x", "+2001-05-01T00:00:00Z", "garbage"),
                               ("o", 2, "y", "+2001-05-01T00:00:00Z", None),
                               ("o", 3, "z", "bad start", None)],
                              "office string, stmt long, leader string, start_value string, end_value string")
    rows = timeline.tenure(h, "2026-01-01 00:00:00").collect()
    assert len(rows) == 2
    assert all(r.end == dt.datetime(2026, 1, 1) and r.tenure_label == "2001-2026" and r.years_served == 25
               for r in rows)


def test_parse_question(spark):
    df = spark.createDataFrame([("Prime Ministers of india",), ("presidents of united states",),
                                ("who leads france",), ("president in office",)], "question string")
    got = [(r.role, r.country) for r in timeline.parse_question(df).collect()]
    assert got == [("Prime Minister", "India"), ("President", "United States"), (None, None),
                   ("President", "Fice")]


def test_fewer_vectors_than_k(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.1, 0.0])], "query_id long, embedding array<float>")
    rows = retrieval.nearest(v, q, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in rows] == [(0, 1), (1, 2)]


def test_empty_store_routes_direct(spark):
    qs = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    hits = spark.createDataFrame([], "query_id long, rank long, vec_id long, distance double, text string")
    r = retrieval.prompts(qs, hits).first()
    assert r.route == "direct" and r.n_hits == 0 and r.prompt == "why?"


def test_duplicate_edit_keys_and_edit_to_null(spark):
    base = spark.createDataFrame([(1, "a", "1", "c1", None), (2, "b", "2", "c2", None)],
                                 "id long, name string, phone string, city string, created_at timestamp_ntz")
    edits = spark.createDataFrame([(1, "x", "1", "c1", 1), (1, "y", "1", "c1", 2), (2, None, "2", "c2", 1),
                                   (9, "z", "9", "c9", 1)],
                                  "id long, name string, phone string, city string, seq int")
    once = contacts.update_rows(base, edits)
    got = {r.id: r.name for r in once.collect()}
    assert got == {1: "y", 2: None}
    twice = contacts.update_rows(once, edits)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_import_keeps_repeats_and_null_keys(spark):
    base = spark.createDataFrame([(1, "a", "1", "c", None)],
                                 "id long, name string, phone string, city string, created_at timestamp_ntz")
    up = spark.createDataFrame([(1, "a", "1", "c"), (2, "n", "5", "c"), (3, "n", "5", "c"), (4, None, "1", "c")],
                               "upload_pos long, name string, phone string, city string")
    out = contacts.import_rows(base, up, run_ts="2026-01-01 00:00:00").orderBy("id").collect()
    assert [(r.id, r.name) for r in out] == [(1, "a"), (2, "n"), (3, "n"), (4, None)]


def test_latin1_file(spark, tmp_path):
    from sparkdesk.sources import files as Fi
    (tmp_path / "a.csv").write_bytes(b"k,v\n1,caf\xe9\n")
    (tmp_path / "b.csv").write_bytes("k,v\n2,café\n".encode("utf-8"))
    rows = Fi.read_csv_any_encoding(spark, str(tmp_path), "k int, v string").orderBy("k").collect()
    assert [(r.v, r.encoding) for r in rows] == [("café", "ISO-8859-1"), ("café", "UTF-8")]
    q = Fi.read_text_files(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [r.status for r in q] == ["quarantine", "ok"]


def test_missing_tokens_and_profile(spark):
    df = spark.createDataFrame([(1, "NA", float("nan")), (None, "x", 1.0), (3, "", None)],
                               "a long, b string, c double")
    r = profile.profile(df).first()
    assert (r.rows, r.columns, r.missing, r.numeric_columns) == (3, 3, 5, "a,c")


def test_golden_health_sample(spark):
    rows = [("2026-03-01", 72, 5000, 6.5, 120), ("2026-03-02", 80, 7000, 7.0, 125),
            ("2026-03-03", 65, 4000, 5.5, 118), ("2026-03-04", 90, 9000, 6.0, 135),
            ("2026-03-05", 75, 6500, 7.5, 122)]
    df = spark.createDataFrame(rows, "date string, heart_rate int, steps int, sleep_hours double, bp_systolic int")
    k = series.kpis(df).first()
    assert (k.avg_heart_rate, k.avg_steps, k.avg_sleep) == (76.4, 6300, 6.5)
    assert series.alerts(df).count() == 0
    d = {(r.metric, r.stat): r.value for r in profile.describe(df, ["heart_rate"]).collect()}
    assert d[("heart_rate", "50%")] == 75.0 and d[("heart_rate", "25%")] == 72.0
    assert abs(d[("heart_rate", "std")] - 9.343447) < 1e-6


def test_repair_single_column(spark):
    df = spark.createDataFrame([("2026-03-01,72,5000,6.5,120",), ("bad,row",)], "line string")
    rows = series.repair_single_column(df, "line").collect()
    assert rows[0].heart_rate == 72.0 and rows[0].steps == 5000 and rows[0].error is None
    assert rows[1].date is None and rows[1].error == "expected 5 fields, got 2"


def test_transcript_hides_leading_system(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (2, 0, "user", "v")],
                               "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in chat.transcript(df).collect()) == [(1, 1), (2, 0)]


def test_page_assembly_keeps_order_and_nulls(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, None), (2, 5, "z")],
                               "doc_id long, page_no long, text string")
    got = {r.doc_id: (r.text, r.n_pages) for r in text.assemble_pages(df, block=2).collect()}
    assert got == {1: ("ac", 3), 2: ("z", 1)}


def test_null_keys_skip_the_join_but_keep_their_result(spark):
    from sparkdesk.operators.joins import join_skipping_null_keys
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, k string")
    right = spark.createDataFrame([("a", 10), (None, 99)], "k string, v long")
    anti = sorted(r.id for r in join_skipping_null_keys(left, right, ["k"], "left_anti").collect())
    semi = sorted(r.id for r in join_skipping_null_keys(left, right, ["k"], "left_semi").collect())
    outer = sorted((r.id, r.v) for r in join_skipping_null_keys(left, right, ["k"], "left").collect())
    assert anti == [2, 3] and semi == [1] and outer == [(1, 10), (2, None), (3, None)]
    nulls = [r for r in join_skipping_null_keys(left, right, ["k"], "left").collect() if r.id == 2]
    assert nulls[0].k is None


def test_landing_takes_each_file_once(spark, tmp_path):
    from sparkdesk.sources import files as Fi
    from sparkdesk.streaming.landing import land_csv
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(3, "z")], "k int, v string")
    inbox, table, ckpt = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    Fi.write_csv(a, inbox, mode="append")
    land_csv(spark, inbox, "k int, v string", table, ckpt)
    land_csv(spark, inbox, "k int, v string", table, ckpt)          # nothing new
    Fi.write_csv(b, inbox, mode="append")
    land_csv(spark, inbox, "k int, v string", table, ckpt)
    got = spark.read.parquet(table)
    assert sorted(r.k for r in got.collect()) == [1, 2, 3]
    assert got.where("source_file is null").count() == 0


def test_snapshot_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    p = contacts.write_snapshot(df, str(tmp_path), 1)
    assert spark.read.parquet(p).count() == 3
    with pytest.raises(Exception):
        contacts.write_snapshot(df, str(tmp_path), 1)


def test_dispatch_by_suffix_any_case(spark, tmp_path):
    from sparkdesk.sources import files as Fi
    (tmp_path / "a.TXT").write_text("hello\nworld\n")
    (tmp_path / "b.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "c.Csv").write_text("k\n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.file_name: (r.kind, r.rows, r.status) for r in Fi.dispatch(spark, str(tmp_path)).collect()}
    assert got == {"a.TXT": ("txt", 1, "ok"), "b.csv": ("csv", 2, "ok"),
                   "c.Csv": ("csv", 0, "ok"), "d.pdf": ("unsupported", None, "unsupported")}


def test_reingest_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a" * 700), (2, "b" * 300), (3, "a" * 700)], "doc_id long, text string")
    store = retrieval.ingest_chunks(None, retrieval.chunk_text(docs))
    again = retrieval.ingest_chunks(store, retrieval.chunk_text(docs))
    assert sorted(store.collect()) == sorted(again.collect())
    # doc 3 repeats doc 1: its chunks are stored once, ids are 1..n
    assert sorted(r.chunk_id for r in store.collect()) == [1, 2, 3]


def test_vector_dimension_mismatch_raises(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.1, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        retrieval.nearest(v, q, k=3).collect()


def test_lenient_numbers(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("1d",), ("abc",), ("-3",), ("1e3",), ("",)], "s string")
    got = [(r.d, r.n) for r in df.select(X.lenient_double("s").alias("d"), X.lenient_long("s").alias("n")).collect()]
    assert got == [(12.5, None), (None, None), (None, None), (-3.0, -3), (1000.0, None), (None, None)]


def test_versioned_snapshots(spark, tmp_path):
    base = str(tmp_path / "contacts")
    first = spark.createDataFrame([(1, "a", "1", "c", None)],
                                  "id long, name string, phone string, city string, created_at timestamp_ntz")
    contacts.write_snapshot(first, base, 1)
    up = spark.createDataFrame([(1, "b", "2", "d")], "upload_pos long, name string, phone string, city string")
    contacts.commit(spark, base, lambda cur: contacts.import_rows(cur, up, run_ts="2026-01-01 00:00:00"))
    assert contacts.snapshot_versions(spark, base) == [1, 2]
    latest, v = contacts.read_latest(spark, base)
    assert v == 2 and sorted(r.id for r in latest.collect()) == [1, 2]
    assert spark.read.parquet(base + "/v=1").count() == 1


def test_empty_upload_adds_nothing(spark):
    base = spark.createDataFrame([(1, "a", "1", "c", None)],
                                 "id long, name string, phone string, city string, created_at timestamp_ntz")
    up = spark.createDataFrame([], "upload_pos long, name string, phone string, city string")
    assert contacts.import_rows(base, up).count() == 1
    assert contacts.import_report(base, up).count() == 0


def test_all_null_amounts_not_enough_data(spark):
    df = spark.createDataFrame([(1, None, "Jan", 1, "2024"), (2, None, "Feb", 2, "2024")],
                               "pos long, amount double, month string, month_ord int, year string")
    assert [r.message for r in bills.insights(df).collect()] == [P.NO_DATA_INSIGHT]
    k = bills.kpis(df).first()
    assert (k.bills, k.total_spend, k.avg_bill, k.max_bill) == (2, 0.0, None, None)


def test_share_of_zero_total_is_null(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v long")
    assert [r.share for r in facets.share_of_total(df, "k", "v").collect()] == [None, None]


def test_embed_hook(spark):
    import numpy as np
    df = spark.createDataFrame([(1, "hello world hello"), (2, ""), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.embedding for r in retrieval.embed(df, retrieval.hashed_bag_of_words(8), 8).collect()}
    assert abs(np.linalg.norm(out[1]) - 1.0) < 1e-6 and not any(out[2]) and not any(out[3])
    with pytest.raises(Exception, match="want"):
        retrieval.embed(df, lambda texts: np.zeros((len(texts), 3)), 8).collect()


from hypothesis import given, settings, strategies as st  # noqa: E402

_WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=_WS + "ab é-'", max_size=12), min_size=1, max_size=8))
def test_py_strip_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, s string")
    got = [r.t for r in df.select("i", X.py_strip("s").alias("t")).orderBy("i").collect()]
    assert got == [t.strip() for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ '-_1 ", max_size=15), min_size=1, max_size=8))
def test_py_title_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, s string")
    got = [r.t for r in df.select("i", X.py_title("s").alias("t")).orderBy("i").collect()]
    assert got == [t.title() for t in texts]


_BILL_ALPHABET = "0123456789٣ abcéJanFeb@.-_,₹\t\n" + " "


_TOKEN = st.one_of(
    st.text(alphabet="0123456789", min_size=1, max_size=14),
    st.text(alphabet="0123456789٣", min_size=1, max_size=4),
    st.sampled_from(["Jan", "Feb", "Sept", "déc", "x_1", "a.b-c", "@", "₹", "₹ ", ",", ".", "-", " - ",
                     " ", "  ", "\t", "\n", "Airtel Black", "1,234.50", "mail@x.example",
                     "12 Jan 2024", "3 Feb 2025 - 4 Mar 2025", "1\tJan\n2024", "12 Jan 20245",
                     "7 déc 2023 - 8 Jan 2024", "₹ 1,234.56", "₹12.30", "₹1,2,3.45", "₹ 99.9"]),
    st.text(alphabet=_BILL_ALPHABET, max_size=6))
_TEXT = st.lists(_TOKEN, max_size=25).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(_TEXT, min_size=1, max_size=10))
def test_bill_fields_match_python_re(spark, texts):
    import re as pyre

    def first(p, t, g=0):
        m = pyre.search(p, t)
        return m.group(g) if m else None
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string")
    got = {r.file: r for r in bills.extract_fields(df).collect()}
    for i, t in enumerate(texts):
        r = got[str(i)]
        dates = pyre.findall(r"\d{1,2}\s\w+\s\d{4}", t)
        assert r.email == first(r"[\w\.-]+@[\w\.-]+", t)
        assert r.phone == first(r"\b\d{10}\b", t)
        assert r.account_id == first(r"\b\d{12,}\b", t)
        assert r.statement_date == (dates[0] if dates else None)
        assert r.due_date == (dates[-1] if len(dates) >= 2 else None)
        assert r.statement_period == first(r"\d{1,2}\s\w+\s\d{4}\s-\s\d{1,2}\s\w+\s\d{4}", t)
        raw = first(r"₹\s?([\d,]+\.\d{2})", t, 1)
        if raw is not None and raw.isascii():
            want = float(raw.replace(",", "")) if raw.replace(",", "").replace(".", "", 1).isdigit() else None
            assert r.amount == want


@settings(max_examples=30, deadline=None)
@given(st.lists(_TEXT, min_size=1, max_size=10))
def test_month_year_match_python_re(spark, texts):
    import re as pyre
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, statement_period string")
    got = {r.i: r for r in bills.with_month_year(df).collect()}
    for i, t in enumerate(texts):
        m = pyre.search(r"-\s\d{1,2}\s(\w+)", t)
        month = m.group(1) if m and m.group(1) in P.MONTHS else None
        y = pyre.search(r"(\d{4})$", t)
        assert got[i].month == month
        assert got[i].year == (y.group(1) if y else None)


_QUESTION = st.lists(st.sampled_from(["Prime Ministers", "prime minister", "PRESIDENTS", "vice president",
                                      " of ", "OF", "office", "india", "côte d'ivoire", "united  states",
                                      "\t", " ", "leaders", "in", "of the"]), max_size=8).map("".join)


@settings(max_examples=30, deadline=None)
@given(st.lists(_QUESTION, min_size=1, max_size=10))
def test_parse_question_matches_python(spark, qs):
    def parse(text):
        t = text.lower()
        role = "Prime Minister" if "prime minister" in t else ("President" if "president" in t else None)
        if role is None or "of" not in t:
            return None, None
        return role, t.split("of")[-1].strip().title()
    df = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "i long, question string")
    got = {r.i: (r.role, r.country) for r in timeline.parse_question(df).collect()}
    assert got == {i: parse(q) for i, q in enumerate(qs)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 5.0, 10.0, 12.0, -3.0]),
                          st.floats(-1000, 1000, allow_nan=False)), min_size=1, max_size=40))
def test_change_and_label_match_pandas(spark, values):
    import warnings
    import pandas as pd
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = (pd.Series(values, dtype="float64").pct_change() * 100).tolist()
    labels = [P.SPIKE_LABEL if x > 15 else (P.DROP_LABEL if x < -15 else P.NORMAL_LABEL) for x in want]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, amount double")
    got = bills.with_change(df, "amount", "pos").orderBy("pos").collect()
    for r, w, lab in zip(got, want, labels):
        if w != w:                                   # pandas NaN -> null here
            assert r.pct_change is None
        else:
            assert r.pct_change == w or abs(r.pct_change - w) <= 1e-9 * max(1.0, abs(w))
        assert r.anomaly == lab


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-50, 50)),
                          st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False))), min_size=1, max_size=60),
       )
def test_describe_matches_pandas(spark, rows):
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["a", "b"], dtype="float64")
    want = pdf.describe()
    df = spark.createDataFrame([(None if a is None else int(a), b) for a, b in rows], "a long, b double")
    got = {(r.metric, r.stat): r.value for r in profile.describe(df, ["a", "b"]).collect()}
    for col in ["a", "b"]:
        for stat in want.index:
            w, g = want.loc[stat, col], got.get((col, stat))
            if w != w:
                assert g is None
            else:
                assert g is not None and abs(g - w) <= 1e-6 * max(1.0, abs(w)), (col, stat, g, w)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False),
                          st.sampled_from([0.15, 0.25, 0.35, 76.35, 9.95, 0.05, -0.15, 2.675])),
                min_size=1, max_size=30))
def test_py_round_and_fixed_match_python(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    rows = df.select("i", X.py_round("x", 1).alias("r"), X.py_fixed("x", 1).alias("f")).orderBy("i").collect()
    assert [r.r for r in rows] == [round(x, 1) for x in xs]
    assert [r.f for r in rows] == [f"{x:.1f}" for x in xs]


def test_csv_agrees_with_pandas(spark, tmp_path):
    import glob
    from sparkdesk.sources import files as Fi
    import pandas as pd
    rows = [(1, 'Bob "Bo" Ray', "x"), (2, "end\\", "y"), (3, 'a,b\\"', "z"), (4, "plain", "w")]
    df = spark.createDataFrame(rows, "id long, name string, t string").coalesce(1)
    Fi.write_csv(df, str(tmp_path / "out"))
    back = pd.concat(pd.read_csv(f) for f in glob.glob(str(tmp_path / "out" / "*.csv")))
    assert sorted(back.itertuples(index=False, name=None)) == rows
    back.to_csv(tmp_path / "pandas.csv", index=False)
    got = Fi.read_csv(spark, str(tmp_path / "pandas.csv"), "id long, name string, t string")
    assert sorted(map(tuple, got.collect())) == rows


def test_vectors_that_are_not_finite_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [nan, 1.0]), (2, [1.0, 0.0]), (3, [inf, 0.0]), (4, None),
                               (5, [None, 1.0]), (6, [3.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, [nan, 0.0])], "query_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in retrieval.nearest(v, q, 3).orderBy("rank").collect()] == [
        (7, 0), (7, 2), (7, 6)]


def test_edit_without_a_seq_is_not_lost(spark):
    c = spark.createDataFrame([(1, "a", "1", "x", None)], contacts.CONTACT_SCHEMA)
    edits = spark.createDataFrame([(1, "b", "2", "y", None)], "id long, name string, phone string, city string, seq long")
    assert contacts.update_rows(c, edits).first().name == "b"


def test_strip_of_a_long_run_of_blanks(spark):
    import time
    df = spark.createDataFrame([("x" + " " * 1_000_000 + "y　\x1c",)], "t string")
    t0 = time.time()
    assert df.select(F.length(X.py_strip("t")).alias("n")).first().n == 1_000_002
    assert time.time() - t0 < 10


def test_store_keeps_texts_and_vectors_of_one_dimension(spark):
    docs = spark.createDataFrame([(1, "a" * 700), (2, "b"), (3, "b")], "doc_id long, text string")
    vecs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "doc_id long, embedding array<float>")
    chunks = retrieval.attach_vectors(retrieval.chunk_text(docs), vecs, ["doc_id"], 2)
    store = retrieval.ingest_chunks(None, chunks, keep=("chunk", "embedding"))
    rows = [(r.chunk_id, r.doc_id, r.chunk_no, r.chunk, r.embedding) for r in store.orderBy("chunk_id").collect()]
    assert rows == [(1, 1, 0, "a" * 500, [1.0, 2.0]), (2, 1, 1, "a" * 250, [1.0, 2.0]), (3, 2, 0, "b", [3.0, 4.0])]
    with pytest.raises(Exception, match="dimension"):
        retrieval.attach_vectors(chunks.drop("embedding"), vecs, ["doc_id"], 3).collect()
