"""Spelling variants: words one edit apart, grouped under their most frequent neighbours.

Two words are near if one inserted, deleted or replaced code point turns one
into the other.  The search scans sorted lists of words and keeps, for every
searching word, the band of three cells of the edit matrix that can still hold
a distance of one.  A row of the matrix belongs to a prefix, so entries of the
sorted list take over the rows of the entry before as far as their longest
common prefix reaches, and a range whose shared prefix is already two edits
away is skipped as a whole.  All searching words of a list go through it
together, depth by depth, in numpy.

Lists.  Of two words one edit apart, the shorter of length m, either the first
m // 2 code points are equal or the last m - m // 2 are.  So a word stands in
the lists of (m, that prefix) and (m, that suffix), for m its length and its
length less one, and only what lies between the equal ends is compared.  A list
that holds more than ``LIST`` words is cut by the same rule applied to what lies
between, as often as needed: each cut halves the free part, and a free part of
one code point leaves no more words than an alphabet.  Every pair belongs to one
list only (the prefix one, where both fit), so links come out once, no list
outgrows a task, and none is capped.

The vocabulary is never sent whole to a task or the driver.

Defined results: null and empty texts have no words; very long texts are read a
block at a time and count whole; repeated rows count again; a null key writes as
nothing in the seeded misspellings; an empty table gives an empty result; extra
columns are ignored, whatever their names; ties between near words of equal
count go to the smaller one in code-point order.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparkdesk.llm.common import BLOCK, bounded_batches, id_and_bytes
from sparkdesk.session import materialize

RUN = "A-Za-zÀ-ÿ"
LIST = 20_000                  # most words of one sorted list
SEARCHING = 1 << 13            # words that go through a list together
GATHER = 1 << 15               # rows of small lists that are searched together
WORDS_HELD = 300_000           # different words a task counts before it passes them on
FAR = 2                        # every distance above one


def _blocks(text: str, gap: re.Pattern) -> Iterator[str]:
    """Parts of a text that cut no run."""
    pos = 0
    while pos < len(text):
        hit = gap.search(text, pos + BLOCK) if len(text) - pos > 2 * BLOCK else None
        end = hit.end() if hit else len(text)
        yield text[pos:end]
        pos = end


def document_words(key: str, data: bytes, min_chars: int, drop_every: int | None) -> Counter:
    """Words of a text with counts: maximal runs of letters, A-Z in lower case, of at least
    ``min_chars`` code points; where ``drop_every`` divides h = crc32("key:run"), the run has
    lost code point h modulo its length."""
    words, gap = re.compile(f"[{RUN}]{{{min_chars},}}"), re.compile(f"[^{RUN}]")
    found: Counter = Counter()
    for part in _blocks(data.lower().decode("utf-8", "replace"), gap):
        found.update(words.findall(part))
    if not drop_every:
        return found
    seed = zlib.crc32(f"{key}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), seed)
        if h % drop_every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < min_chars:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7,
                min_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """``(word, n)`` of every word of at least ``min_chars`` code points that occurs at least
    ``min_count`` times in all texts; ``drop_every`` seeds misspellings (``document_words``)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update(document_words("" if key is None else str(key), data or b"", min_chars, drop_every))
                if len(held) >= WORDS_HELD:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return (id_and_bytes(docs, id_col, text_col).mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                      ["word", "n"])


def _entry(m: Column, head: Column, tail: Column, below: Column) -> Column:
    """A word's place in the list of shorter length ``m`` with ``head`` first and ``tail``
    last code points equal; pairs there share fewer than ``below`` first code points."""
    return F.struct(m.alias("m"), head.alias("head"), tail.alias("tail"), below.alias("below"))


def _halves(m: Column, head: Column, tail: Column, below: Column) -> list[Column]:
    """The two lists that hold the pairs of one: by the first half of the free part, or,
    for pairs that differ there, by the rest of it."""
    half = ((m - head - tail) / 2).cast("int")
    return [_entry(m, head + half, tail, below), _entry(m, head, m - head - half, head + half)]


def _placed(rows: DataFrame) -> DataFrame:
    """``(key, free, below, mid, word, n)`` of words and their places ``at``."""
    m, head, tail = F.col("at.m"), F.col("at.head"), F.col("at.tail")
    word, size = F.col("word"), F.length("word")
    key = F.concat_ws(":", m, head, tail, F.substring(word, F.lit(1), head),
                      F.substring(word, size - tail + 1, tail))
    return rows.select("at", key.alias("key"), (m - head - tail).alias("free"),
                       (F.col("at.below") - head).alias("below"),
                       F.substring(word, head + 1, size - head - tail).alias("mid"), "word", "n")


def sorted_lists(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """The rows of all lists (see the module's text), none of more than ``most`` words where a
    further cut is possible."""
    size, none = F.length("word"), F.lit(1 << 20)
    lengths = F.explode(F.array(size, size - 1)).alias("m")
    rows = (vocabulary.where(size > 0).select("word", "n", lengths)
            .select("word", "n", F.explode(F.array(*_halves(F.col("m"), F.lit(0), F.lit(0), none))).alias("at")))
    placed, done = _placed(rows), None
    while True:
        large = materialize(placed.where("free > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
                            .where(F.col("size") > most).select("key"))
        fit = placed.join(large, "key", "left_anti") if not large.isEmpty() else placed
        done = fit if done is None else done.unionByName(fit)
        if large.isEmpty():
            return done.drop("at")
        cut = F.explode(F.array(*_halves(*[F.col(f"at.{c}") for c in ("m", "head", "tail", "below")]))).alias("at")
        placed = _placed(materialize(placed.join(large, "key", "left_semi").select("word", "n", cut)))


def near_in_lists(group: np.ndarray, free: np.ndarray, mids: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers ``(a, b)`` of all pairs one edit apart in the same list, ``a`` of the list's
    shorter length ``free``.  Rows are sorted by list, then by ``mid`` in code-point order."""
    n = len(mids)
    codes = np.array(mids, dtype=np.str_)
    width = codes.dtype.itemsize // 4
    codes = np.hstack([codes.view(np.uint32).reshape(n, width) if width else np.zeros((n, 0), np.uint32),
                       np.zeros((n, 3), np.uint32)])
    size = np.fromiter(map(len, mids), np.int64, n)
    # adjacent longest common prefixes; -1 where a list begins
    lcp = np.full(n, -1)
    if n > 1:
        same = group[1:] == group[:-1]
        differ = (codes[1:] != codes[:-1]).argmax(axis=1)
        lcp[1:] = np.where(same, differ, -1)
    starts = np.flatnonzero(lcp < 0)
    bounds = np.append(starts, n)
    list_of = np.cumsum(lcp < 0) - 1
    found_a, found_b = [], []
    searching = np.flatnonzero(size == free)
    for first in range(0, len(searching), SEARCHING):
        q = searching[first:first + SEARCHING]
        lo, hi = bounds[list_of[q]], bounds[list_of[q] + 1]
        # the band of row d holds the distances to the first d-1, d and d+1 code points of q
        band = np.tile(np.array([FAR, 0, 1], np.int8), (len(q), 1))
        for d in range(width + 1):
            nodes = np.append(np.flatnonzero(lcp <= d), n)      # where a prefix of d + 1 code points begins
            a, b = np.searchsorted(nodes, lo), np.searchsorted(nodes, hi)
            each = b - a
            at = np.repeat(np.arange(len(q)), each)
            k = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each) + a[at]
            q, band, lo, hi = q[at], band[at], nodes[k], nodes[k + 1]
            over = size[lo] == d                                # the entry ends here
            if over.any():
                last = size[q[over]] - d + 1
                inside = (last >= 0) & (last <= 2)
                hit = np.zeros(len(last), bool)
                hit[inside] = band[over][inside, last[inside]] == 1
                found_a.append(q[over][hit])
                found_b.append(lo[over][hit])
            q, band, lo, hi = q[~over], band[~over], lo[~over], hi[~over]
            char = codes[lo, d]
            left = band[:, 0] + (codes[q, d - 1] != char) if d else FAR
            row = np.empty_like(band)
            row[:, 0] = np.minimum(left, band[:, 1] + 1)
            row[:, 1] = np.minimum(np.minimum(band[:, 1] + (codes[q, d] != char), band[:, 2] + 1), row[:, 0] + 1)
            row[:, 2] = np.minimum(band[:, 2] + (codes[q, d + 1] != char), row[:, 1] + 1)
            # cells past the end of q are no prefix of it
            past = size[q] - d
            row[past < 1, 1] = FAR
            row[past < 2, 2] = FAR
            np.minimum(row, FAR, out=row)
            live = (row < FAR).any(axis=1)
            q, band, lo, hi = q[live], row[live], lo[live], hi[live]
            if not len(q):
                break
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def _links(table: pa.Table) -> pa.RecordBatch:
    """Links both ways of the whole lists in a sorted table."""
    group = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    mids, free = table["mid"].to_pylist(), table["free"].to_numpy()
    a, b = near_in_lists(group, free, mids)
    # a pair that shares more first code points than the list's own belongs to the other list
    shared = np.fromiter((next((k for k, (x, y) in enumerate(zip(mids[i], mids[j])) if x != y),
                               min(len(mids[i]), len(mids[j]))) for i, j in zip(a.tolist(), b.tolist())),
                         np.int64, len(a))
    own = shared < table["below"].to_numpy()[a]
    a, b = a[own], b[own]
    back = np.asarray([len(mids[j]) for j in b.tolist()], np.int64) != free[a]      # found from one side only
    left, right = pa.array(np.concatenate([a, b[back]])), pa.array(np.concatenate([b, a[back]]))
    words, n = table["word"].combine_chunks(), table["n"].combine_chunks()
    return pa.RecordBatch.from_arrays([words.take(left), words.take(right), n.take(right)],
                                      ["word", "near", "near_n"])


def near_words(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """``(word, near, near_n)``: every word of ``vocabulary`` (``word``, distinct, and ``n``) with
    each of its near words, both ways, once."""
    bounded_batches(vocabulary.sparkSession)
    schema = "key string, free int, below int, mid string, word string, n bigint"
    columns = [c.split()[0] for c in schema.split(", ")]
    lists = (sorted_lists(vocabulary, most).select(*columns)
             .repartition("key").sortWithinPartitions("key", "mid"))

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < GATHER:
                continue
            table = pa.Table.from_batches(held)
            key = table["key"].combine_chunks()
            # the last list may go on in the next batch
            whole = pc.index(key, key[len(key) - 1]).as_py()
            if whole:
                yield _links(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
            rows = table.num_rows - whole
        if held:
            yield _links(pa.Table.from_batches(held))

    return lists.mapInArrow(run, "word string, near string, near_n bigint")


def variants(vocabulary: DataFrame, ratio: int = 10, most: int = LIST) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word: the number of its near words;
    its form, the near word of largest count (ties: the smallest), if that is at least
    ``ratio`` times its own; and the last of its forms' forms, or the word itself."""
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = materialize(vocabulary.select("word", F.col("n").cast("bigint").alias("n")))
    best = near_words(words, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    fits = -F.col("best.n") >= ratio * F.col("n")
    found = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")))
    formed = found.where("form is not null")
    # counts grow by ``ratio`` from form to form, so chains are short; each round doubles the reach
    largest = formed.agg(F.max("form_n")).first()[0] or 1
    steps = math.log(max(largest, 2)) / math.log(ratio) + 1
    roots = formed.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return (found.join(roots, "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
