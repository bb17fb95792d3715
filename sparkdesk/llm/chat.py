"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is the lines of its parts (rows of one key, in order); parts may end
anywhere, between turns or inside them.  Every line is reduced to a code of its
features: the speaker marker it starts with, whether it asks, is a list item or
code, how long it is, and whether it opens a part.  The model's states are the
first and the further lines of a turn of each role; Viterbi finds the likeliest
states of the whole transcript, and the lines are rendered as turns in one
canonical form, markers cut off.

The model starts from the fixed values below.  With ``rounds`` it is estimated
from the transcripts themselves, without labels: each round finds the likeliest
states of every line, counts codes and moves by state over all rows, and takes
the shares (the fixed values weigh as much as ``PRIOR`` lines a state).  Whether
the start of a part says anything about turns, or how long the lines of a role
are, is learned this way.  A round is one more pass over the codes, a byte a line.

A transcript may be longer than a task should hold, so the parts are
range-partitioned in order and a transcript may run over several partitions.
Per run (a transcript's rows in one partition) one pass reduces the lines to a
matrix of best scores from the state before to the state at its end; runs of
one transcript (at most one per partition) are chained by those matrices;
with its two end states fixed each run is decoded on its own.

Defined results: null and empty texts are one blank line; repeated rows (same
key, order and text) count once; rows of one key and order with different
texts follow each other by text hash; rows with a null key are one transcript;
equal scores go to the earlier state
(at the end of a run first); an empty table gives an empty result;
extra columns are ignored, whatever their names; of a very long transcript a
task holds the codes of one run, and the texts of one Arrow batch.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sparkdesk.llm.common import bounded_batches
from sparkdesk.session import materialize

# Roles, and the names that speaker markers give them.
ROLES = ["system", "user", "assistant"]
NAMES = {
    "system": "system instruction instructions context",
    "user": "user human customer client question q me you prompt",
    "assistant": "assistant bot ai model agent answer a gpt response support",
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names.split()}
MARKER = re.compile(r"[ \t]*(?:#{1,4}[ \t]*|\*\*|\[|<\|?)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True))
                    + r")(?:\*\*[ \t]*:?|:\*\*|[ \t]*:|\]:?|\|?>|[ \t]+[-–—](?=[ \t])|[ \t]*$)[ \t]*", re.I)
FORMATTED = re.compile(r"[ \t]*(?:[-*•][ \t]|[0-9]{1,3}[.)][ \t]|```|[ \t]{4})")
# The model to start from.  States 0..2 open a turn of a role, 3..5 go on with it.
STATES = 2 * len(ROLES)
MARK_P = 0.7                     # an opening line has a marker of its role
WRONG_P = 0.002                  # a line has a marker of another role
BLANK_P = (0.01, 0.08)           # an opening line is blank; a further line is
ASKS_P = (0.05, 0.30, 0.10)      # a line asks, by role (system, user, assistant)
FORMATTED_P = (0.10, 0.03, 0.15)
OPENS_P = 0.5                    # a line opens a part, in every state
NEXT_ROLE = {                    # role of the next turn, by role
    "system": (0.02, 0.90, 0.08), "user": (0.02, 0.08, 0.90), "assistant": (0.02, 0.90, 0.08)}
FIRST_ROLE = (0.25, 0.70, 0.05)
GO_ON = 0.5                      # a line is followed by one of the same turn

PRIOR = 20.0                     # lines a state that the fixed values weigh as much as
ROUNDS = 3                       # of estimating; more change nothing on the test tables
NEVER = -1e9                     # log probability of a move that cannot be
SIZES = 8                        # classes of line length: blank, below 8, 16, 32 ... 256, longer
# feature of a code -> (lowest bit, number of values)
FEATURES = {"mark": (0, len(ROLES) + 1), "asks": (2, 2), "formatted": (3, 2), "size": (4, SIZES), "opens": (7, 2)}
CODES = 256


class Model:
    """Probabilities of each feature's values by state (``shares``) and of moves between
    states, the start as the last row (``moves``); ``emit`` and ``move`` are their logs, by
    code and state."""

    def __init__(self, shares: dict[str, np.ndarray], moves: np.ndarray):
        self.shares, self.moves = shares, moves
        self.move = np.where(moves > 0, np.log(np.where(moves > 0, moves, 1)), NEVER)
        self.emit = sum(np.log(p[:, feature_values(name)]).T for name, p in shares.items())

    def estimated(self, codes: np.ndarray, moves: np.ndarray) -> "Model":
        """The model by counts of codes (code, state) and of moves, with the fixed values as
        ``PRIOR`` lines a state."""
        shares = {}
        for name, p in START.shares.items():
            counts = PRIOR * p
            np.add.at(counts.T, feature_values(name), codes)
            shares[name] = counts / counts.sum(axis=1, keepdims=True)
        counts = moves + PRIOR * START.moves
        return Model(shares, counts / counts.sum(axis=1, keepdims=True))


def feature_values(name: str) -> np.ndarray:
    """The value of a feature in each code."""
    low, values = FEATURES[name]
    return np.arange(CODES) >> low & (values - 1)


def _start() -> Model:
    n = len(ROLES)
    shares = {name: np.zeros((STATES, values)) for name, (_, values) in FEATURES.items()}
    moves = np.zeros((STATES + 1, STATES))
    for s in range(STATES):
        role, first = s % n, s < n
        right = MARK_P if first else WRONG_P
        shares["mark"][s] = WRONG_P
        shares["mark"][s, role + 1] = right
        shares["mark"][s, 0] = 1 - right - WRONG_P * (n - 1)
        blank = BLANK_P[0 if first else 1]
        shares["size"][s] = [blank] + [(1 - blank) / (SIZES - 1)] * (SIZES - 1)
        for name, p in (("asks", ASKS_P[role]), ("formatted", FORMATTED_P[role]), ("opens", OPENS_P)):
            shares[name][s] = 1 - p, p
        moves[s, n + role] = GO_ON
        moves[s, :n] = np.array(NEXT_ROLE[ROLES[role]]) * (1 - GO_ON)
    moves[STATES, :n] = FIRST_ROLE
    return Model(shares, moves)


START = _start()
EMIT, MOVE = START.emit, START.move


def line_codes(text: str | None) -> bytes:
    """One code per line of a part."""
    out = bytearray()
    for i, line in enumerate((text or "").split("\n")):
        m, length = MARKER.match(line), len(line.strip())
        mark = 1 + ROLES.index(ROLE_OF[m.group(1).lower()]) if m else 0
        size = min(SIZES - 1, max(1, length.bit_length() - 2)) if length else 0
        out.append(mark | line.rstrip().endswith("?") << 2 | bool(FORMATTED.match(line)) << 3
                   | size << 4 | (i == 0) << 7)
    return bytes(out)


def run_matrix(codes: bytes, best: np.ndarray | None = None, model: Model = START) -> np.ndarray:
    """Best score from each state before a run (the start as the last row) to each state at
    its end; ``best`` is the matrix of the lines before, in the same run."""
    emit, move = model.emit, model.move
    for c in codes:
        if best is None:
            best = move + emit[c]
        else:
            best = (best[:, :, None] + move[None, :STATES]).max(axis=1) + emit[c]
    return best


def decode(codes: bytes, before: int, after: int, model: Model = START) -> bytes:
    """Likeliest states of a run's lines between the state before and the state at its end."""
    emit, move = model.emit, model.move
    score, back = move[before] + emit[codes[0]], np.zeros((len(codes), STATES), np.uint8)
    for i, c in enumerate(codes[1:], 1):
        step = score[:, None] + move[:STATES]
        back[i] = step.argmax(axis=0)
        score = step.max(axis=0) + emit[c]
    states = bytearray(len(codes))
    states[-1] = after
    for i in range(len(codes) - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return bytes(states)


def chain(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """States before and at the end of every run of one transcript."""
    score, back = matrices[0][STATES], []
    for m in matrices[1:]:
        step = score[:, None] + m[:STATES]
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    ends = [int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return list(zip([STATES, *ends[:-1]], ends))


def turns(text: str | None, states: bytes) -> list[tuple[str, bool, str]]:
    """(role, whether a turn starts here, content) of each stretch of a part's lines."""
    out: list[tuple[str, bool, list[str]]] = []
    for line, s in zip((text or "").split("\n"), states):
        role, first = ROLES[s % len(ROLES)], s < len(ROLES)
        m = MARKER.match(line)
        if m and ROLE_OF[m.group(1).lower()] == role:
            line = line[m.end():]
        if first or not out:
            out.append((role, first, []))
        out[-1][2].append(line)
    return [(role, first, "\n".join(lines).strip("\n")) for role, first, lines in out]


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("part").sortWithinPartitions("part", "mid")


def _bounded_runs(lines: DataFrame, model: Model) -> DataFrame:
    """``lines`` (part, id, mid, codes) with the likeliest states before and at the end of
    their run."""
    id_type = lines.schema["id"].dataType.simpleString()

    def reduce_runs(batches):
        now, best, out = None, None, []
        schema = None
        for batch in batches:
            schema = pa.schema([("part", pa.int64()), ("id", batch.schema.field(1).type),
                                ("matrix", pa.list_(pa.float64())), ("after", pa.int32())])
            for part, key, _, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (part, key):
                    if now is not None:
                        out.append((*now, best.ravel().tolist(), int(best[STATES].argmax())))
                    now, best = (part, key), None
                best = run_matrix(codes, best, model)
            if len(out) > 2000:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out)))), schema)
                out = []
        if now is not None:
            out.append((*now, best.ravel().tolist(), int(best[STATES].argmax())))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out)))), schema)

    runs = materialize(_in_order(lines).mapInArrow(
        reduce_runs, f"part bigint, id {id_type}, matrix array<double>, after int"))
    split = runs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("key"))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        ends = chain([np.reshape(m, (STATES + 1, STATES)) for m in group["matrix"]])
        return pd.DataFrame({"part": group["part"], "id": group["id"],
                             "before": [a for a, _ in ends], "after": [b for _, b in ends]})

    # a partition's edge splits one transcript at most, so few are chained
    linked = (runs.join(split, F.col("id").eqNullSafe(F.col("key")), "left_semi")
              .groupBy("id").applyInPandas(link, f"part bigint, id {id_type}, before int, after int"))
    whole = (runs.join(split, F.col("id").eqNullSafe(F.col("key")), "left_anti")
             .select("part", "id", F.lit(STATES).alias("before"), "after"))
    ends = whole.unionByName(linked).select(F.col("part").alias("p"), F.col("id").alias("key"), "before", "after")
    return lines.join(ends, (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("key"))).select(
        "part", "id", "mid", "codes", "before", "after")


def _each_run(batches):
    """(states before and at the end, codes of each row, place of each row) of every run."""
    now, held, mids, ends = None, [], [], (0, 0)
    for batch in batches:
        for part, key, mid, codes, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (part, key):
                if now is not None:
                    yield ends, held, mids
                now, held, mids, ends = (part, key), [], [], (before, after)
            held.append(codes)
            mids.append(mid)
    if now is not None:
        yield ends, held, mids


def _states(lines: DataFrame, model: Model) -> DataFrame:
    """``(mid, states)``: the likeliest state of every line of each row."""
    def decode_runs(batches):
        for ends, held, mids in _each_run(batches):
            states, at, cuts = decode(b"".join(held), *ends, model), 0, []
            for c in held:
                cuts.append(states[at:at + len(c)])
                at += len(c)
            yield pa.RecordBatch.from_arrays([pa.array(mids, pa.int64()), pa.array(cuts, pa.binary())],
                                             ["mid", "states"])

    return _in_order(_bounded_runs(lines, model)).mapInArrow(decode_runs, "mid bigint, states binary")


def _estimate(lines: DataFrame, model: Model) -> Model:
    """The model by counts over the likeliest states of all lines under ``model``.  The
    driver receives one number for each (code, state) and each move."""
    def count_runs(batches):
        codes, moves = np.zeros((CODES, STATES), np.int64), np.zeros((STATES + 1, STATES), np.int64)
        for (before, after), held, _ in _each_run(batches):
            line = np.frombuffer(b"".join(held), np.uint8)
            path = np.frombuffer(decode(line.tobytes(), before, after, model), np.uint8)
            np.add.at(codes, (line, path), 1)
            np.add.at(moves, (np.concatenate([[before], path[:-1]]), path), 1)
        flat = np.concatenate([codes.ravel(), moves.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], ["slot", "n"])

    flat = np.zeros(CODES * STATES + (STATES + 1) * STATES)
    counts = (_in_order(_bounded_runs(lines, model)).mapInArrow(count_runs, "slot bigint, n bigint")
              .groupBy("slot").agg(F.sum("n").alias("n")))
    for row in counts.collect():
        flat[row["slot"]] = row["n"]
    cut = CODES * STATES
    return model.estimated(flat[:cut].reshape(CODES, STATES), flat[cut:].reshape(STATES + 1, STATES))


def parse(parts: DataFrame, order_by: list[str], id_col: str = "conv_id", text_col: str = "text",
          rounds: int = 0) -> DataFrame:
    """``(id_col, *order_by, seg, role, starts, content, rendered)``: the stretches of every
    part in order; ``rendered`` of all of them in order is the canonical transcript.
    ``rounds`` times the model is estimated from these transcripts first."""
    bounded_batches(parts.sparkSession)
    rows = (parts.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)],
                         F.col(text_col).alias("text")).distinct())
    order = ["id", *[f"o{i}" for i in range(len(order_by))], "th"]
    placed = (rows.withColumn("th", F.xxhash64("text"))
              .repartitionByRange(*order).sortWithinPartitions(*order).drop("th")
              .withColumn("mid", F.monotonically_increasing_id())
              .withColumn("part", F.shiftright("mid", 33)))

    def code(batches):
        for batch in batches:
            codes = [line_codes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())],
                                             [*batch.schema.names, "codes"])

    table = materialize(placed.mapInArrow(
        code, StructType([*placed.schema.fields, StructField("codes", BinaryType())])))
    lines, model = table.select("part", "id", "mid", "codes"), START
    for _ in range(rounds):
        model = _estimate(lines, model)
    states = _states(lines, model)
    names = [*[f"o{i}" for i in range(len(order_by))]]

    def render(batches):
        for batch in batches:
            out = [turns(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("states").to_pylist())]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in out])
            flat = [x for xs in out for x in xs]
            keep = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [keep.column(n) for n in ("id", *names)]
                + [pa.array([i for xs in out for i in range(len(xs))], pa.int32()),
                   pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.bool_()),
                   pa.array([x[2] for x in flat], pa.string()),
                   pa.array([(f"<|{r}|>\n" if first else "") + body + "\n" for r, first, body in flat], pa.string())],
                ["id", *names, "seg", "role", "starts", "content", "rendered"])

    joined = table.select("id", *names, "text", "mid").join(states, "mid").drop("mid")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ["id", *names])
    done = joined.mapInArrow(render, f"{kinds}, seg int, role string, starts boolean, content string, rendered string")
    return done.select(F.col("id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, order_by)],
                       "seg", "role", "starts", "content", "rendered")


def with_markers(role: Column, text: Column, draw: Column) -> Column:
    """A turn as transcripts write it: behind one of several speaker markers of its role, or,
    for one turn in eight and every null role, behind none.  ``draw`` is a whole number that
    picks the style."""
    title = F.initcap(role)
    person = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(title)
    styles = [F.lit(""), F.concat(title, F.lit(": ")), F.concat(F.upper(role), F.lit(": ")),
              F.concat(person, F.lit(": ")), F.concat(F.lit("### "), title, F.lit("\n")),
              F.concat(F.lit("**"), title, F.lit(":** ")), F.concat(F.lit("<|"), role, F.lit("|>")),
              F.concat(F.lit("["), role, F.lit("] "))]
    marker = F.element_at(F.array(*styles), (F.pmod(draw, F.lit(len(styles))) + 1).cast("int"))
    return F.concat(F.coalesce(marker, F.lit("")), text)
