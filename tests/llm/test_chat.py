import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sparkdesk.llm import chat, queries
from tests.conftest import SF

KIND = "conv_id bigint, turn bigint, text string, role string, seg string, part string, mid string, states string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], KIND)


def score(codes, states, before=chat.STATES):
    total = 0.0
    for c, s in zip(codes, states):
        total += chat.MOVE[before, s] + chat.EMIT[c, s]
        before = s
    return total


def test_viterbi_and_chained_runs():
    r = random.Random(1)
    for _ in range(15):
        codes = bytes(r.randrange(256) for _ in range(5))
        best = max(score(codes, p) for p in itertools.product(range(chat.STATES), repeat=5))
        whole = chat.run_matrix(codes)
        (before, after), = chat.chain([whole])
        assert np.isclose(score(codes, chat.decode(codes, before, after)), best)
        cuts = [codes[:2], codes[2:3], codes[3:]]
        ends = chat.chain([chat.run_matrix(c) for c in cuts])
        path = b"".join(chat.decode(c, b, a) for c, (b, a) in zip(cuts, ends))
        assert np.isclose(score(codes, path), best)
        assert np.allclose(chat.run_matrix(codes[2:], chat.run_matrix(codes[:2])), whole)


def parsed(df):
    return [tuple(r) for r in chat.parse(df, ["turn"]).select("conv_id", "turn", "seg", "role", "starts", "content")
            .orderBy(F.col("conv_id").asc_nulls_first(), "turn", "seg").collect()]


def test_turns_in_one_text_and_continued(spark):
    rows = [(1, 0, "System: be brief\nUser: what is\nit?\n\n**Assistant:** this\n- a\n- b"), (1, 1, "Human: and that?"),
            (2, 0, "no marker here?"), (2, 1, "### Assistant\nyes")]
    assert parsed(frame(spark, rows)) == [
        (1, 0, 0, "system", True, "be brief"), (1, 0, 1, "user", True, "what is\nit?"),
        (1, 0, 2, "assistant", True, "this\n- a\n- b"), (1, 1, 0, "user", True, "and that?"),
        (2, 0, 0, "user", True, "no marker here?"), (2, 1, 0, "assistant", True, "yes")]


def test_edges(spark):
    rows = [(None, 0, "User: a"), (None, 1, None), (5, 0, ""), (5, 0, ""), (6, None, "AI: x"), (7, 0, "User: y"),
            (7, 0, "User: z"), (8, 0, "User: " + "long words " * 40_000)]
    out = parsed(frame(spark, rows))
    assert len([x for x in out if x[0] == 5]) == 1 and len([x for x in out if x[0] == 7]) == 2
    assert [x[3:] for x in out if x[0] == 8] == [("user", True, ("long words " * 40_000).strip("\n"))]
    assert {x[0] for x in out} == {None, 5, 6, 7, 8}
    assert parsed(frame(spark, [])) == []


def test_one_transcript_over_many_partitions(spark):
    """Chained runs give states as likely as one Viterbi over the whole transcript."""
    r = random.Random(4)
    rows = [(1, i, r.choice(["User: ", "Assistant: ", "", ""]) + r.choice(["why?", "so it is " * 25, "ok"])) for i in range(600)]
    codes = [chat.line_codes(t) for _, _, t in rows]
    before, after = chat.chain([chat.run_matrix(b"".join(codes))])[0]
    states = chat.decode(b"".join(codes), before, after)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = parsed(frame(spark, rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [x[1] for x in out] == list(range(600))
    got = [chat.ROLES.index(role) + (0 if starts else 3) for _, _, _, role, starts, _ in out]
    assert np.isclose(score(b"".join(codes), got), score(b"".join(codes), states))


def test_recovered_roles(spark):
    """A row for each turn: that rows start turns is learned, not given."""
    out = chat.parse(queries.transcripts(spark, SF), ["turn"], rounds=chat.ROUNDS).where("seg = 0").toPandas()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()
    both = out.merge(turns, on=["conv_id", "turn"], suffixes=("_found", ""))
    assert len(both) == len(turns)
    assert (both.role == both.role_found).mean() > 0.97
    assert (both.content == both.text.str.strip("\n")).mean() > 0.97


def test_recovered_from_lines(spark):
    """The registered query: a row for each line, so turn starts come from the text alone."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()
    out = queries.op2_chat_format(spark, SF).toPandas()
    both = out.merge(turns, on=["conv_id", "turn"], suffixes=("_found", ""))
    assert len(both) == queries.transcript_lines(spark, SF).count()
    start = both.line == 0
    hits = (both.starts & start).sum()
    assert (both.role == both.role_found).mean() > 0.96
    assert hits / both.starts.sum() > 0.95 and hits / start.sum() > 0.92


def test_recovered_from_whole_texts(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    whole = (queries.transcripts(spark, SF).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
             .select("conv_id", F.lit(0).alias("turn"), F.array_join("t.text", "\n").alias("text")))
    exact = {}
    for rounds in (0, chat.ROUNDS):
        out = chat.parse(whole, ["turn"], rounds=rounds).where("starts").toPandas().sort_values(["conv_id", "seg"])
        exact[rounds] = (out.groupby("conv_id").role.agg(list) == turns.groupby("conv_id").role.agg(list)).mean()
    assert exact[chat.ROUNDS] > 0.85 and exact[chat.ROUNDS] >= exact[0]


def test_estimate_counts_every_line(spark):
    """A round over runs of one transcript in several partitions equals counts by hand."""
    r = random.Random(5)
    codes = [bytes(r.randrange(256) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    key = [1] * 40 + [2] * 20
    part = [i // 15 for i in range(60)]
    lines = spark.createDataFrame([(part[i], key[i], i, codes[i]) for i in range(60)],
                                  "part bigint, id bigint, mid bigint, codes binary")
    found = chat._estimate(lines, chat.START)
    emit, move = np.zeros((chat.CODES, chat.STATES)), np.zeros((chat.STATES + 1, chat.STATES))
    for k in (1, 2):
        whole = b"".join(c for c, x in zip(codes, key) if x == k)
        (before, after), = chat.chain([chat.run_matrix(whole)])
        for c, s in zip(whole, chat.decode(whole, before, after)):
            emit[c, s] += 1
            move[before, s] += 1
            before = s
    same = chat.START.estimated(emit, move)
    assert np.allclose(found.moves, same.moves)
    assert all(np.allclose(found.shares[n], same.shares[n]) for n in chat.FEATURES)
    assert np.allclose(found.moves.sum(axis=1), 1)


def test_estimated_edges(spark):
    rows = [(None, 0, None), (None, 0, None), (1, 0, ""), (2, 0, "User: a\nAI: b"), (2, None, "x"), (3, 1, "AI: y")]
    out = [tuple(x) for x in chat.parse(frame(spark, rows), ["turn"], rounds=2).select("conv_id", "role").collect()]
    assert {k for k, _ in out} == {None, 1, 2, 3} and (2, "assistant") in out and (3, "assistant") in out
    assert chat.parse(frame(spark, []), ["turn"], rounds=2).collect() == []


def test_markers_of_null_roles_and_texts(spark):
    df = spark.createDataFrame([(None, "a", 1), ("user", None, 1), ("user", "a", 1)], "role string, text string, k int")
    got = [r[0] for r in df.select(chat.with_markers(F.col("role"), F.col("text"), F.col("k"))).collect()]
    assert got == ["a", None, "User: a"]
