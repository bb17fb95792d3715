"""Ordered operators give the same answers as a one-partition window, whatever the number of
partitions, and plans have the intended shape."""

import numpy as np
import pytest


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keep the partitions that small inputs would be merged into one of."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from sparkdesk.functions import exprs as X
from sparkdesk.operators import bills, numbering, profile, retrieval, text
from tests.conftest import SF


def _plain_previous(df, v, order, groups, fill):
    w = Window.partitionBy(*groups).orderBy(order)
    if fill == "none":
        return df.select("*", F.col(v).alias("_cur"), F.lag(v).over(w).alias("_prev"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cur = df.withColumn("_cur", F.last(v, ignorenulls=True).over(upto))
    return cur.withColumn("_prev", F.lag("_cur").over(w))


def _events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_number_rows_equals_plain(spark):
    e = _events(spark).select("event_id", "user_id", "ts")
    plain = e.withColumn("rn", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long"))
    for b in (1, 3, 8, 37):
        spark.conf.set("spark.sql.shuffle.partitions", b)
        got = numbering.number_rows(e, ["ts", "event_id"], "rn")
        assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_grouped_numbering_with_a_hot_group(spark):
    # user 7 gets a third of all rows; numbering per user must still be 1..n
    e = _events(spark).select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(7))
                              .otherwise(F.col("user_id")).alias("user_id"))
    plain = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    got = numbering.number_rows(e, ["event_id"], "rn", partition_by=["user_id"])
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()


@pytest.mark.parametrize("fill", ["pad", "none"])
def test_previous_values_equals_plain(spark, fill):
    e = _events(spark).select("event_id", F.when(F.col("event_id") % 5 < 3, None)
                              .otherwise(F.col("value")).alias("v"))
    e = e.withColumn("v", F.when(F.col("event_id").between(2000, 4000), None).otherwise(F.col("v")))
    plain = _plain_previous(e, "v", "event_id", (), fill)
    got = numbering.previous_values(e, "v", "event_id", fill=fill)
    cols = ["event_id", "v", "_cur", "_prev"]
    assert got.select(cols).exceptAll(plain.select(cols)).count() == 0


def test_grouped_change_equals_plain(spark):
    e = _events(spark).select("event_id", "user_id", "value")
    got = bills.with_change(e, "value", "event_id", partition_by="user_id").select(*e.columns, "pct_change")
    plain = _plain_previous(e, "value", "event_id", ["user_id"], "pad").select(
        *e.columns, X.pct_change_expr("_cur", "_prev").alias("pct_change"))
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_slice_rows(spark):
    e = _events(spark).select("event_id", "value")
    got = numbering.slice_rows(e, "event_id", 4321, 4340, "rn")
    assert [(r.rn, r.event_id) for r in got.orderBy("rn").collect()] == [(i, i - 1) for i in range(4321, 4341)]


def test_exact_quantiles_equals_percentile(spark):
    e = _events(spark)
    long_ = e.select(F.explode(F.array(
        F.struct(F.lit("value").alias("metric"), F.col("value").alias("v")),
        F.struct(F.lit("user").alias("metric"), F.col("user_id").cast("double").alias("v")),
        F.struct(F.lit("flat").alias("metric"), F.lit(1.0).alias("v")))).alias("m")).select("m.*")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = {(r.metric, p): q for r in long_.groupBy("metric").agg(
        F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect() for p, q in zip(probs, r.q)}
    got = {(r.metric, r.p): r.q for r in profile.exact_quantiles(long_, probs).collect()}
    assert want.keys() == got.keys()
    for k in want:
        assert abs(want[k] - got[k]) < 1e-9, k


def test_equal_sort_keys_spread_over_partitions(spark):
    """A key that a third of the rows share is numbered 1..n and meets in no one partition."""
    e = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    rows = numbering._ordered(e, [], ["k"])
    assert rows.where("k = 7").select("_part").distinct().count() > 1
    got = numbering.number_rows(e, "k", "rn").orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, 3001))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_running_sum_and_deep_slices(spark):
    e = spark.range(30_000).select("id", ((F.col("id") * 7919) % 104729).alias("k"), F.lit(2).cast("long").alias("v"))
    got = numbering.running_sum(e, "v", "k", "s").orderBy("k").collect()
    assert [r.s for r in got] == list(range(2, 60_002, 2))
    ids = [r.id for r in e.orderBy("k").collect()]
    for lo in (1, 9_995, 25_000, 29_999, 40_000):
        rows = numbering.slice_rows(e, "k", lo, lo + 9, "rn").orderBy("rn").collect()
        assert [(r.rn, r.id) for r in rows] == [(i + 1, ids[i]) for i in range(lo - 1, min(lo + 9, 30_000))]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_moves_no_rows_into_one_partition(spark):
    e = _events(spark).select("event_id", "value")
    lines = _plan(numbering.number_rows(e, "event_id", "rn")).splitlines()
    # the only one-partition exchange carries a row per partition
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[_part" in lines[i + 1]


def test_vector_search_forms_no_pairs_join(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = retrieval.centroids(v, "label").withColumnRenamed("label", "query_id")
    p = _plan(retrieval.nearest_plan(v, q, 3))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    # top k of each pair of blocks in Python, then WindowGroupLimit trims before the shuffle
    assert "FlatMapGroupsInPandas" in p and "WindowGroupLimit" in p and p.count("embeddings.parquet") == 1


def test_text_and_bill_plans_stay_in_jvm(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (retrieval.chunk_text(d), bills.enrich(bills.extract_fields(d, keep=("doc_id",)), "doc_id")):
        p = _plan(df)
        assert "Python" not in p and "ArrowEval" not in p


def test_parquet_scan_prunes_columns(spark):
    from sparkdesk.plans.queries import QUERIES
    p = _plan(QUERIES["contact_kpis"](spark, SF))
    assert "c_acctbal" not in p and "c_mktsegment" not in p


# --- properties -----------------------------------------------------------

@settings(max_examples=25, deadline=None)
@given(st.text(max_size=1200), st.integers(1, 300), st.integers(0, 299))
def test_chunks_rebuild_text(spark, s, size, overlap):
    overlap = overlap % size
    df = spark.createDataFrame([(1, s)], "doc_id long, text string")
    rows = retrieval.chunk_text(df, size=size, overlap=overlap).orderBy("chunk_no").collect()
    step = size - overlap
    assert [r.chunk for r in rows] == [s[i:i + size] for i in range(0, len(s), step)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 50), st.text(max_size=5)), max_size=40))
def test_pages_partition_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    got = {r.doc_id: r.n_pages for r in text.assemble_pages(df, block=4).collect()}
    want = {}
    for d, _, _ in rows:
        want[d] = want.get(d, 0) + 1
    assert got == want


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(0, 2 ** 31))
def test_topk_equals_full_sort(spark, n, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, size=(n, 4)).astype(np.float32)    # ties on purpose
    q = rng.integers(-3, 4, size=(2, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<float>")
    qs = spark.createDataFrame([(j, q[j].tolist()) for j in range(2)], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in retrieval.nearest(v.repartition(3), qs, k).collect())
    want = []
    for j in range(2):
        d = ((x.astype(np.float64) - q[j]) ** 2).sum(1)
        order = sorted(range(n), key=lambda i: (d[i], i))[:k]
        want += [(j, r + 1, i) for r, i in enumerate(order)]
    assert got == sorted(want)


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 300), st.integers(1, 9))
def test_numbering_is_1_to_n_for_any_partitioning(spark, n, parts):
    df = spark.range(n).repartition(parts).withColumn("k", (F.col("id") * 7919) % 1009)
    got = numbering.number_rows(df, ["k", "id"], "rn")
    assert sorted(r.rn for r in got.collect()) == list(range(1, n + 1))


def test_query_blocks_give_the_same_neighbours(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    one = retrieval.nearest(v, q, 4)
    many = retrieval.nearest(v, q, 4, vector_rows=50, query_rows=3)
    cols = ["query_id", "rank", "vec_id"]
    assert one.count() == q.count() * 4
    assert sorted(one.select(cols).collect()) == sorted(many.select(cols).collect())


def test_bucketed_numbering_with_null_and_string_keys(spark):
    e = _events(spark).select("event_id", F.when(F.col("event_id") % 4 == 0, None)
                              .otherwise(F.col("event_type")).alias("k"))
    plain = e.withColumn("rn", F.row_number().over(Window.orderBy("k", "event_id")).cast("long"))
    got = numbering.number_rows(e, ["k", "event_id"], "rn")
    assert got.exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_bucketed_statement_tables_join_without_shuffle(spark, tmp_path):
    import uuid
    from sparkdesk.operators import timeline
    from sparkdesk.sources import files as Fi, views as V
    tag = uuid.uuid4().hex[:8]
    t = {n: Fi.write_bucketed(getattr(V, n)(spark, SF), f"{n}_{tag}", "stmt", 8, str(tmp_path / n))
         for n in ("statements", "starts", "ends")}
    j = (t["statements"].join(t["starts"].withColumnRenamed("value", "start_value"), "stmt")
         .join(t["ends"].withColumnRenamed("value", "end_value"), "stmt", "left"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "Exchange" not in p
    plain = timeline.office_holders(V.statements(spark, SF), V.starts(spark, SF), V.ends(spark, SF),
                                    V.labels_q(spark, SF))
    assert j.count() == plain.count()


def test_bucketed_grouped_paths_keep_null_groups(spark):
    e = _events(spark).select("event_id", "value",
                              F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("user_id") % 7).alias("g"))
    plain_n = e.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("event_id")).cast("long"))
    got_n = numbering.number_rows(e, ["event_id"], "rn", partition_by=["g"])
    assert got_n.count() == e.count() and got_n.exceptAll(plain_n).count() == 0
    plain_p = _plain_previous(e, "value", "event_id", ["g"], "pad")
    got_p = numbering.previous_values(e, "value", "event_id", partition_by="g")
    assert got_p.count() == e.count() and got_p.exceptAll(plain_p).count() == 0


def test_quantiles_and_transcript_keep_null_groups(spark):
    from sparkdesk.operators import chat
    e = _events(spark).select(F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_type")).alias("metric"),
                              F.col("value").alias("v"))
    small = {(r.metric, 0.5): r.q for r in e.groupBy("metric").agg(F.percentile("v", 0.5).alias("q")).collect()}
    big = {(r.metric, r.p): r.q for r in profile.exact_quantiles(e, [0.5]).collect()}
    assert (None, 0.5) in small and small.keys() == big.keys()
    assert all(abs(small[k] - big[k]) < 1e-9 for k in small)
    log = spark.createDataFrame([(None, 0, "system", "s"), (None, 1, "user", "u")],
                                "conv_id long, turn long, role string, text string")
    assert [r.turn for r in chat.transcript(log).collect()] == [1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=80),
       st.integers(1, 12), st.sampled_from(["pad", "none"]))
def test_previous_values_property(spark, values, buckets, fill):
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "pos long, v double, g long")
    for groups in ((), ("g",)):
        plain = _plain_previous(df, "v", "pos", groups, fill)
        got = numbering.previous_values(df, "v", "pos", partition_by=groups, fill=fill)
        assert sorted(plain.collect()) == sorted(got.collect())


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 200), st.integers(1, 250), st.integers(0, 60), st.integers(1, 9))
def test_slice_rows_property(spark, n, lo, width, buckets):
    df = spark.range(n).withColumn("k", (F.col("id") * 37) % 101)
    got = numbering.slice_rows(df, ["k", "id"], lo, lo + width, "rn")
    assert [r.rn for r in got.orderBy("rn").collect()] == list(range(lo, min(n, lo + width) + 1))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=120), st.integers(1, 9))
def test_quantiles_equal_numpy(spark, values, buckets):
    df = spark.createDataFrame([("m", float(v)) for v in values], "metric string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = {p: float(np.percentile(np.array(values, dtype=float), p * 100)) for p in probs}
    got = {r.p: r.q for r in profile.exact_quantiles(df, probs).collect()}
    assert all(abs(got[p] - want[p]) < 1e-9 for p in probs), (got, want)


def test_spread_runs_nothing_on_shuffled_plans(spark):
    from sparkdesk.session import spread
    sc = spark.sparkContext
    d = spark.read.parquet(f"{SF}/documents.parquet")
    g = d.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).join(d, "lang")
    sc.setJobGroup("spread-check", "spread-check")
    try:
        assert spread(g) is g
        assert len(sc.statusTracker().getJobIdsForGroup("spread-check")) == 0
    finally:
        sc.setJobGroup("", "")
    one_split = d.select("text")
    assert spread(one_split).rdd.getNumPartitions() >= min(sc.defaultParallelism, 2)
