"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces and pieces into words.  The graph's edges are the
longest grams (``max_words`` words); an edge runs from the node of its first
words to the node of its last ones, so neighbouring edges overlap in all words
but one.  Only edges are counted in the texts, together with the shorter grams
that a piece ends in.  The count of every shorter gram follows from them: what
flows out of its node over all edges, plus the pieces that end there.

Edges are summed over some megabytes of text at a time (in numpy, over word
numbers) by the tasks that read the texts and sent, many to a row, to
the group of their first two words.  There Spark sorts them (and may spill), and
one pass over the sorted rows sums edges and the flow of every node as runs, with
nothing held but the current run's sum.  Groups are hashes, so a frequent word is
spread over all of them.  Only frequent edges and nodes and one row per first
word and partition run are written.

Among the frequent edges, unary paths are compacted: where a node's whole flow
comes in over one edge and goes out over one edge, both are parts of one path.
Pointer doubling finds every edge's path and place (a round for each doubling of
the longest path).  A path's inner nodes have its own count, so only the flow of
its two end nodes is kept, and the longest phrases are read off the paths.

Scores are exact: products are computed in 38-digit decimals.

Defined results: null and empty texts have no words; a null language is
``und``; very long texts and pieces are read whole; repeated rows count again; ties are ordered by count, then phrase; an
empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.llm.common import bounded_batches
from sparkdesk.session import materialize

HELD = 4 << 20                 # bytes of text a task counts together before it passes grams on
RUNS = 1 << 16                 # sorted rows that are summed together
GROUPS = 1 << 14               # groups of nodes
# Bytes of words, blanks and ends of pieces; A-Z in lower case.
BLANKS, PIECE_ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(range(256)).lower()
CLASS = np.zeros(256, np.int8)
CLASS[list(BLANKS)], CLASS[list(PIECE_ENDS)] = 1, 2
# Tabs part the words of a gram and sort before all else: lower bytes are written as
# ESCAPE and the byte plus 64.
ESCAPE, LOW, LOW_IN_TEXT = b"\x0e", re.compile(rb"[\x00-\x0a\x0e]"), re.compile(rb"[\x00-\x08\x0e]")


def _escaped(data: bytes, low: re.Pattern) -> bytes:
    return low.sub(lambda m: ESCAPE + bytes([m[0][0] + 64]), data)


def _plain(data: bytes) -> bytes:
    return re.sub(rb"(?s)\x0e(.)", lambda m: bytes([m[1][0] - 64]), data)


def _joined(columns: list[pa.Array], by: bytes) -> pa.Array:
    return pc.binary_join_element_wise(*columns, pa.scalar(by, pa.binary())) if len(columns) > 1 else columns[0]


def word_pieces(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text in lower case and the number of each one's piece."""
    raw = np.frombuffer(_escaped(data.translate(LOWER), LOW_IN_TEXT), np.uint8)
    kind = CLASS[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges_at = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges_at[::2], edges_at[1::2]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[kind == 0]))])
    return words.cast(pa.binary()), np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)


def grams(data: bytes, max_words: int) -> tuple[list[pa.Array], np.ndarray]:
    """The different longest grams of a text, a column for each place, and their counts.  A
    window that reaches over its piece's end has empty words there: the shorter grams that
    pieces end in."""
    words, piece = word_pieces(data)
    n = len(words)
    coded = words.dictionary_encode()
    vocabulary = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary])
    ids = coded.indices.to_numpy().astype(np.int64) + 1          # 0: no word there
    size = len(vocabulary)
    code, bound, columns = np.zeros(n, np.int64), 1, []
    for k in range(max_words):
        here = np.zeros(n, np.int64)
        here[:n - k] = np.where(piece[k:] == piece[:n - k], ids[k:], 0) if k < n else 0
        columns.append(here)
        if bound * size >= 1 << 62:                              # number the prefixes anew
            found, code = np.unique(code, return_inverse=True)
            bound = len(found)
        code, bound = code * size + here, bound * size
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return [vocabulary.take(pa.array(c[first])) for c in columns], counts


def _rows(held: dict[bytes, list[bytes]], max_words: int, groups: int) -> pa.RecordBatch:
    """One row per group: its grams, a line each with the language first, and their counts."""
    lines, counts, ids = [], [], []
    for lang, texts in held.items():
        columns, n = grams(b"\n".join(texts), max_words)
        node = [c.dictionary_encode() for c in columns[:2]]
        hashes = [np.array([zlib.crc32(w, 7 * k) for w in c.dictionary.to_pylist()], np.int64)[c.indices.to_numpy()]
                  for k, c in enumerate(node)] if len(n) else []
        lines.append(_joined([pa.array([lang], pa.binary()).take(pa.array(np.zeros(len(n), np.int64))), *columns], b"\t"))
        counts.append(n)
        ids.append(sum(hashes) % groups if hashes else np.zeros(0, np.int64))
    lines, counts, ids = pa.concat_arrays(lines), np.concatenate(counts), np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    found, starts = np.unique(ids[order], return_index=True)
    offsets = pa.array(np.append(starts, len(ids)).astype(np.int32))
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.take(pa.array(order))), b"\n")
    return pa.RecordBatch.from_arrays(
        [pa.array(found.astype(np.int32)), texts, pa.ListArray.from_arrays(offsets, pa.array(counts[order]))],
        ["g", "grams", "counts"])


def edges(docs: DataFrame, max_words: int = 3, text_col: str = "text", lang_col: str = "lang",
          groups: int = GROUPS) -> DataFrame:
    """``(gram, n)``: counts of the graph's edges and piece ends, a row from each text block that
    has one; the rows of a group (of the first two words) are in one partition, sorted."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"),
                      F.col(text_col).cast("binary").alias("body")).where("length(body) > 0")

    def run(batches):
        held, size = defaultdict(list), 0
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[_escaped(lang, LOW)].append(data)
                size += len(data)
                if size >= HELD:
                    yield _rows(held, max_words, groups)
                    held, size = defaultdict(list), 0
        if held:
            yield _rows(held, max_words, groups)

    sent = src.mapInArrow(run, "g int, grams binary, counts array<bigint>").repartition("g")
    each = F.posexplode(F.split(F.col("grams").cast("string"), "\n", -1)).alias("k", "gram")
    return (sent.select("counts", each).select("gram", F.get("counts", F.col("k")).alias("n"))
            .where("gram <> ''").sortWithinPartitions("gram"))


class _Flow:
    """Sums of the sorted edges' counts by their first ``level`` words; a run may go on in the
    next rows."""

    def __init__(self, level: int, least: int):
        self.level, self.least = level, least
        self.key: list[bytes] | None = None
        self.n = 0

    def _batch(self, parts: list[pa.Array], n: np.ndarray) -> pa.RecordBatch:
        """Rows of the runs that are frequent and have ``level`` words."""
        keep = (n >= self.least) & pc.not_equal(parts[self.level], b"").to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(keep))
        lang, *words = [p.take(at) for p in parts]
        phrase = _joined(words, b" ")
        lang, phrase = [pa.array([_plain(x) for x in c.to_pylist()], pa.binary())
                        if pc.any(pc.match_substring(c, ESCAPE)).as_py() else c for c in (lang, phrase)]
        return pa.RecordBatch.from_arrays(
            [lang, phrase, pa.array(n[keep]), pa.array(np.full(len(at), self.level, np.int32))],
            ["lang", "phrase", "n", "level"])

    def add(self, parts: list[pa.Array], counts: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The runs that ended; ``starts`` has the first row of each run."""
        sums = np.add.reduceat(counts, starts)
        firsts = [p.take(pa.array(starts)) for p in parts[:self.level + 1]]
        if [p[0].as_py() for p in firsts] == self.key:
            sums[0] += self.n
        else:
            yield from self.end()
        yield self._batch([p[:-1] for p in firsts], sums[:-1])
        self.key, self.n = [p[-1].as_py() for p in firsts], int(sums[-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key:
            yield self._batch([pa.array([k], pa.binary()) for k in self.key], np.array([self.n]))


def graph(docs: DataFrame, max_words: int = 3, min_count: int = 10, text_col: str = "text",
          lang_col: str = "lang", groups: int = GROUPS) -> DataFrame:
    """``(lang, phrase, n, level)``: for ``level`` 2 to ``max_words`` the phrases of that many words
    found at least ``min_count`` times; for 1, words with a part of their count each."""
    found = edges(docs, max_words, text_col, lang_col, groups)

    def tables(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUNS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        flows = [_Flow(k, 1 if k == 1 else min_count) for k in range(1, max_words + 1)]
        for table in tables(batches):
            flat = pc.split_pattern(table.column(0).chunk(0).cast(pa.binary()), b"\t").flatten()
            parts = [flat.take(pa.array(np.arange(k, len(flat), max_words + 1))) for k in range(max_words + 1)]
            counts, new = table.column(1).chunk(0).to_numpy(), np.zeros(table.num_rows - 1, bool)
            for k, part in enumerate(parts):
                new = new | pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)
                if k:
                    yield from flows[k - 1].add(parts, counts, np.append(0, np.flatnonzero(new) + 1))
        for f in flows:
            yield from f.end()

    rows = found.mapInArrow(run, "lang binary, phrase binary, n bigint, level int")
    return rows.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"),
                       "n", "level")


def _after_first(phrase: str) -> Column:
    return F.expr(f"substring({phrase}, length(substring_index({phrase}, ' ', 1)) + 2)")


def paths(longest: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(lang, words, n, first_flow, last_flow)``: the unary paths of the frequent edges
    ``longest (lang, phrase, n)``; ``nodes (lang, phrase, n)`` has the flow of the frequent nodes.
    All edges of a path have the count ``n``."""
    flow = lambda at, name: nodes.select("lang", F.col("phrase").alias(at), F.col("n").alias(name))
    whole = materialize(longest.select("lang", "phrase", "n", _node("phrase").alias("tail"),
                                       _after_first("phrase").alias("head"))
                        .join(flow("tail", "flow"), ["lang", "tail"]).join(flow("head", "head_flow"), ["lang", "head"]))
    before = whole.where("n = head_flow").select("lang", F.col("head").alias("tail"), F.col("phrase").alias("prev"))
    linked = whole.where("n = flow").join(before, ["lang", "tail"]).select("lang", "phrase", "prev")
    place = materialize(whole.select("lang", "phrase").join(linked, ["lang", "phrase"], "left").select(
        "lang", "phrase", F.coalesce("prev", "phrase").alias("start"),
        F.col("prev").isNotNull().cast("bigint").alias("at")))
    while True:
        ahead = place.where("at > 0").select("lang", F.col("phrase").alias("start"), F.col("start").alias("from"),
                                             F.col("at").alias("more"))
        longer = place.join(ahead, ["lang", "start"], "left")
        if longer.where("more is not null").isEmpty():
            break
        place = materialize(longer.select("lang", "phrase", F.coalesce("from", "start").alias("start"),
                                          (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))
    last_word = F.substring_index("phrase", " ", -1)
    step = F.struct("at", last_word.alias("word"), "flow", "head_flow")
    return (place.join(whole, ["lang", "phrase"]).groupBy("lang", "start")
            .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(step)).alias("steps"))
            .select("lang", F.concat(F.split("start", " ", -1), F.slice("steps.word", F.lit(2), F.size("steps")))
                    .alias("words"), "n", F.get("steps.flow", F.lit(0)).alias("first_flow"),
                    F.element_at("steps.head_flow", -1).alias("last_flow")))


def _node(phrase: str) -> Column:
    """An edge's first node: all words but the last."""
    return F.expr(f"substring({phrase}, 1, length({phrase}) - length(substring_index({phrase}, ' ', -1)) - 1)")


def windows(found: DataFrame, max_words: int) -> DataFrame:
    """``(lang, phrase, a, l_known, r_known)``: the longest phrases read off the paths, with the
    flow of their first and last node."""
    last = F.size("words") - max_words
    at = F.explode(F.sequence(F.lit(0), last)).alias("k")
    return found.select("*", last.alias("last"), at).select(
        "lang", F.array_join(F.slice("words", F.col("k") + 1, F.lit(max_words)), " ").alias("phrase"),
        F.col("n").alias("a"),
        F.when(F.col("k") == 0, F.col("first_flow")).otherwise(F.col("n")).alias("l_known"),
        F.when(F.col("k") == F.col("last"), F.col("last_flow")).otherwise(F.col("n")).alias("r_known"))


def scored(candidates: DataFrame, counts: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """``(lang, phrase, a, l, r, score)``: the cut with the lowest score of every candidate.
    ``candidates (lang, phrase, a, l_known, r_known)``: known counts of all words but the
    last and but the first; ``counts (lang, phrase, n)``: those of the other parts."""
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    size = F.size("w")
    cuts = (candidates.withColumn("w", words).select("*", cut).select(
        "lang", "phrase", "a", "k",
        F.when(F.col("k") == size - 1, F.col("l_known")).alias("l_known"),
        F.when(F.col("k") == 1, F.col("r_known")).alias("r_known"),
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, size), " ").alias("right")))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l_found"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r_found"))
    both = (cuts.join(left, ["lang", "left"], "left").join(right, ["lang", "right"], "left")
            .withColumn("l", F.coalesce("l_known", "l_found")).withColumn("r", F.coalesce("r_known", "r_found")))
    # 38 digits hold scale * a * a up to counts of 10^16
    score = F.expr(f"(cast({scale} as decimal(8,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return (both.groupBy("lang", "phrase", "a").agg(lowest)
            .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))


def absorbed(candidates: DataFrame, percent: int = 50) -> DataFrame:
    """``(lang, phrase)`` of candidates inside a longer one that has at least ``percent`` of their count."""
    w, size = F.col("w"), F.size("w")
    lengths = F.explode(F.sequence(F.lit(2), size - 1)).alias("len")
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s")
    inside = (candidates.select("lang", F.col("a").alias("longer"), F.split("phrase", " ", -1).alias("w"))
              .where(size > 2).select("lang", "longer", w, lengths).select("lang", "longer", "w", "len", starts)
              .select("lang", "longer", F.array_join(F.slice("w", F.col("s"), F.col("len")), " ").alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    return (candidates.select("lang", "phrase", "a").join(inside, ["lang", "phrase"])
            .where(F.col("longer") * 100 >= F.col("a") * percent).select("lang", "phrase"))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, percent: int = 50,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of every phrase of 2 to ``max_words`` words found at
    least ``min_count`` times in its language, without the absorbed ones; ``n`` counts the
    words of the language."""
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    found = materialize(graph(docs, max_words, min_count, text_col, lang_col))
    level = F.col("level")
    words = materialize(found.where(level == 1).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    longest = found.where(level == max_words).select("lang", "phrase", "n")
    shorter = found.where((level > 1) & (level < max_words)).select("lang", "phrase", "n", "level")
    nodes = shorter.where(level == max_words - 1) if max_words > 2 else words
    compact = paths(longest, nodes)
    none = F.lit(None).cast("bigint")
    candidates = materialize(
        shorter.select("lang", "phrase", F.col("n").alias("a"), none.alias("l_known"), none.alias("r_known"))
        .unionByName(windows(compact, max_words)))
    counts = (words.where(F.col("n") >= min_count)
              .unionByName(shorter.where(level < max_words - 1).select("lang", "phrase", "n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = scored(candidates, counts).join(absorbed(candidates, percent), ["lang", "phrase"], "left_anti")
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase, with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
            .withColumn("rank", F.col("rank").cast("bigint")))


#: DuckDB twin over the table ``documents``: every gram counted on its own.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT id, lang, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM q),
v AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
f1 AS (SELECT lang, a, count(*) AS n FROM v GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS n FROM v WHERE b IS NOT NULL GROUP BY ALL HAVING n >= 10),
f3 AS (SELECT lang, a, b, c, count(*) AS n FROM v WHERE c IS NOT NULL GROUP BY ALL HAVING n >= 10),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang),
u AS (SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, 1 AS j, f2.n AS a, x.n AS l, y.n AS r
      FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
      UNION ALL
      SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 1, f3.n, x.n, y.n
      FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a
      JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
      UNION ALL
      SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 2, f3.n, x.n, y.n
      FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b
      JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM u),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
g AS (SELECT lang, phrase, max(n) AS longer FROM (
        SELECT lang, a || ' ' || b AS phrase, n FROM f3 UNION ALL SELECT lang, b || ' ' || c, n FROM f3) GROUP BY ALL),
k AS (SELECT m.* FROM m LEFT JOIN g ON g.lang = m.lang AND g.phrase = m.phrase
      WHERE g.longer IS NULL OR 100 * g.longer < 50 * m.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, k.a DESC, phrase) AS rank,
       phrase, k.a, l, r, t.n, score
FROM k JOIN t ON t.lang = k.lang QUALIFY rank <= 2000
"""
