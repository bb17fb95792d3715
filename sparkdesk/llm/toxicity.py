"""Toxicity by a convolutional text classifier trained in numpy.

A word is the mean of hashed embeddings: of itself, its beginnings and its
ending.  Filters of several widths slide over the words of the whole text,
each keeps its largest response (max pooling), and a logistic layer adds them
up.  Training is plain AdaGrad over single texts: only the words a filter
stopped at get a gradient, so a step touches a few embedding rows.

Every labelled text is learned from, whole.  The labelled rows are spread by
hash over shards of about ``SHARD_DOCS`` texts, one Spark task each; in every
epoch each shard goes on from the shared net over its own texts, one block of
words at a time, and the changes are averaged by Spark, block of embedding rows
by block, an embedding row over the shards that changed it.  The driver sees
class counts, one net an epoch and the counts below.

The threshold differs by language: the text's own function words tell the
language, and for each the cut that gives the best F1 over all labelled texts
is taken off the logit, so that a score of 0.5 is the calibrated threshold
everywhere.  Spark counts all labelled texts by language and logit, rounded to
1 / ``CELLS``.

Defined results: null and empty texts, and texts without a word, are scored as
one word without meaning; repeated rows get repeated scores and are learned
once, while every different text of a key is learned; several labels of
one key count as their largest; labels that are null or of unknown keys are
skipped; without labels of both classes every score is 0; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparkdesk.llm.common import bounded_batches, id_and_bytes, word_blocks
from sparkdesk.session import materialize

BUCKETS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12                     # of each width
PREFIXES = range(4, 10)          # beginnings of a word that are hashed, in letters
SUFFIX = 4
SHARD_DOCS = 6000                # labelled texts between two averages, about
EPOCHS = 4
CELLS = 1024                     # steps of a logit when thresholds are chosen
MEMO = 400_000                   # words a worker remembers
CHUNK = 1 << 16                  # words under the filters at once
FILTER_BITS = 16                 # of the filter before texts meet labels, for each label
EMB_ROWS = 1 << 10               # embedding rows averaged together
LONG = 32                        # bytes; words up to here are hashed many at once
NONE = BUCKETS                   # an unused place of a word; its embedding is zero
SLOTS = 2 + len(PREFIXES)
PAD = max(WIDTHS) - 1
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
# the columns of all filters side by side, by word of the filter: which filter, which word
COL_FILTER = np.concatenate([np.arange(FILTERS) + j * FILTERS for j, w in enumerate(WIDTHS) for _ in range(w)])
COL_WORD = np.repeat([k for w in WIDTHS for k in range(w)], FILTERS)
CRC_STEP = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)
# Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the and of to in is that it for was with as be by on this are from at not".split(),
    "de": "der die und das den von mit zu im ist nicht ein eine sich auf für dem des auch".split(),
    "fr": "le la les des et un une du est que qui dans pour pas sur au par avec ce".split(),
    "es": "el los las del y un una por con para que al se su lo como es más".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]
SCHEMA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])
LANGUAGES_OF = {w.encode(): [w in words for words in FUNCTION_WORDS.values()]
                for w in set().union(*FUNCTION_WORDS.values())}


def bare_word(chunk: bytes) -> str:
    """A word between blanks: its letters and digits in lower case."""
    word = chunk.decode("utf-8", "replace").lower()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def word_features(word: str) -> list[int]:
    """Buckets of a word."""
    if not word:
        return []
    parts = ["w" + word, *("p" + word[:n] for n in PREFIXES if len(word) >= n)]
    if len(word) > SUFFIX:
        parts.append("s" + word[-SUFFIX:])
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def bare_bytes(chunk: bytes) -> bytes:
    """``bare_word`` of a chunk already in lower case as far as ASCII goes, in UTF-8."""
    plain = chunk.strip(MARKS)
    return plain if plain.isalnum() else bare_word(chunk).encode("utf-8", "surrogatepass")


def bucket_table(words: list[bytes]) -> np.ndarray:
    """``word_features`` of many words in UTF-8 (words x SLOTS), NONE where a word has fewer."""
    out = np.full((len(words), SLOTS), NONE, np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    for i in np.flatnonzero(size > LONG):
        found = word_features(words[i].decode("utf-8", "surrogatepass"))
        out[i, :len(found)] = found
    plain = np.flatnonzero((size > 0) & (size <= LONG))
    if not len(plain):
        return out
    # by size, so that the words that still go on at a byte are a slice
    plain = plain[size[plain].argsort(kind="stable")]
    size = size[plain]
    width = int(size[-1])
    chars = np.ascontiguousarray(np.array([words[i] for i in plain], f"S{width}").view(np.uint8)
                                 .reshape(-1, width).T)
    table = np.full((len(plain), SLOTS), NONE, np.int32)
    starts = (chars & 0xC0) != 0x80                     # bytes that begin a letter (or are past the end)
    letters = (starts & (np.arange(width)[:, None] < size)).sum(axis=0)

    def bucket(state: np.ndarray) -> np.ndarray:
        return ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int32)

    whole, begun, ending = (np.full(len(plain), zlib.crc32(mark) ^ 0xFFFFFFFF, np.uint32) for mark in (b"w", b"p", b"s"))
    count = np.zeros(len(plain), np.int64)
    for j in range(width):
        on = slice(int(size.searchsorted(j, "right")), None)        # words with a byte here
        byte = chars[j, on]
        whole[on] = CRC_STEP[(whole[on] ^ byte) & 255] ^ (whole[on] >> 8)
        begun[on] = CRC_STEP[(begun[on] ^ byte) & 255] ^ (begun[on] >> 8)
        count[on] += starts[j, on]
        tail = count[on] > letters[on] - SUFFIX
        ending[on] = np.where(tail, CRC_STEP[(ending[on] ^ byte) & 255] ^ (ending[on] >> 8), ending[on])
        # a beginning is whole where the next byte begins a letter or there is none
        full = (count[on] >= PREFIXES[0]) & (count[on] <= PREFIXES[-1])
        if j + 1 < width:
            full &= starts[j + 1, on] | (size[on] == j + 1)
        at = np.flatnonzero(full) + on.start
        table[at, count[at] - PREFIXES[0] + 1] = bucket(begun[at])
    table[:, 0] = bucket(whole)
    table[:, SLOTS - 1] = np.where(letters > SUFFIX, bucket(ending), NONE)
    out[plain] = table
    return out


class Net:
    """Embeddings, filters and output layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = np.zeros((BUCKETS + 1, DIM), np.float32)      # the last row, of NONE, stays zero
        self.emb[:BUCKETS] = rng.normal(0, 0.02, (BUCKETS, DIM))
        self.filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.cuts = dict.fromkeys(LANGS, 0.0)           # logit threshold by language

    def columns(self) -> np.ndarray:
        """All filters as rows of one matrix, in the order of COL_FILTER and COL_WORD."""
        return np.concatenate([f[k].T for w, f in zip(WIDTHS, self.filters) for k in range(w)])

    def vectors(self, slots: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Mean embedding of each word's buckets (SLOTS x words); zero for a word without any."""
        out = self.emb.take(slots[0], axis=0)
        for k in range(1, SLOTS):
            out += self.emb.take(slots[k], axis=0)
        out *= share[:, None]
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.bias


def shares(buckets: np.ndarray) -> np.ndarray:
    """What one bucket counts in the mean of its word."""
    return 1 / np.maximum((buckets != NONE).sum(axis=1, dtype=np.float32), 1)


def responses(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter responses (filters x words) at every word; ``x`` ends in ``PAD`` zero rows."""
    n = len(x) - PAD
    parts = columns @ x.T
    z = np.empty((len(WIDTHS) * FILTERS, n), np.float32)
    at = 0
    for j, w in enumerate(WIDTHS):
        mine = z[j * FILTERS:(j + 1) * FILTERS]
        mine[:] = parts[at:at + FILTERS, :n]
        for k in range(1, w):
            mine += parts[at + k * FILTERS:at + (k + 1) * FILTERS, k:n + k]
        at += w * FILTERS
    return z


def pieces(bodies: list[bytes]):
    """Lists, of about CHUNK words each, of pieces of texts: ``(text, words, how many of them
    were held before, whether the text ends here)``."""
    held, size = [], 0
    for owner, body in enumerate(bodies):
        now: list[bytes] = []
        again = 0
        for words in word_blocks(body):
            for at in range(0, len(words), CHUNK):
                if now:
                    held.append((owner, now, again, False))
                    size += len(now)
                    if size >= CHUNK:
                        yield held
                        held, size = [], 0
                now, again = now[-PAD:] + words[at:at + CHUNK], min(PAD, len(now))
        held.append((owner, now, again, True))
        size += len(now)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def piece_tops(columns: np.ndarray, vec: np.ndarray, at: np.ndarray, cuts: np.ndarray,
               ends: np.ndarray) -> np.ndarray:
    """Largest filter responses (pieces x filters) of pieces whose words, with vectors
    ``vec[at]``, follow each other, cut at ``cuts``."""
    # a text without words is one zero row; zero rows also part the texts
    length = np.maximum(np.diff(cuts), 1) + PAD
    first = np.concatenate([[0], np.cumsum(length)])
    x = np.zeros((first[-1] + PAD, DIM), np.float32)
    x[np.arange(len(at)) + np.repeat(first[:-1] - cuts[:-1], np.diff(cuts))] = vec[at]
    z = responses(columns, x)
    for k in range(PAD):
        z[:, first[1:] - 1 - k] = -np.inf
    for i in np.flatnonzero(~ends):                     # the last words come again with what follows
        z[:, max(first[i], first[i + 1] - 2 * PAD):first[i + 1]] = -np.inf
    return np.maximum.reduceat(z, first[:-1], axis=1).T


class Words:
    """Remembers the buckets of words, and the languages they tell."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.kept = {"buckets": np.zeros((1 << 12, SLOTS), np.int32),
                     "flags": np.zeros((1 << 12, len(FUNCTION_WORDS)), np.int32)}

    def added(self, at: int, end: int) -> None:
        """Called when the rows from ``at`` to ``end`` hold new words."""

    def look_up(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The row of every different word, and the number among these of every word."""
        words = list(dict.fromkeys(chain.from_iterable(lists)))
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > MEMO:
            self.rows, new = {}, words
        if new:
            at, end = len(self.rows), len(self.rows) + len(new)
            while end > len(self.kept["buckets"]):
                self.kept = {k: np.concatenate([a, np.zeros_like(a)]) for k, a in self.kept.items()}
            self.rows.update(zip(new, range(at, end)))
            bare = list(map(bare_bytes, new))
            self.kept["buckets"][at:end] = bucket_table(bare)
            self.kept["flags"][at:end] = 0
            for k, w in enumerate(bare, at):
                if w in LANGUAGES_OF:
                    self.kept["flags"][k] = LANGUAGES_OF[w]
            self.added(at, end)
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        number = dict(zip(words, range(len(words))))
        size = sum(map(len, lists))
        return rows, np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, size)


class Scorer(Words):
    """Scores texts with a net, remembering the vectors of words."""

    def __init__(self, net: Net):
        super().__init__()
        self.net, self.columns = net, net.columns()
        self.kept["vec"] = np.zeros((len(self.kept["buckets"]), DIM), np.float32)

    def added(self, at: int, end: int) -> None:
        buckets = self.kept["buckets"][at:end]
        self.kept["vec"][at:end] = self.net.vectors(buckets.T, shares(buckets))

    def pooled(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter responses (texts x filters) and function-word counts (texts x languages)."""
        best = np.full((len(bodies), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        counts = np.zeros((len(bodies), len(FUNCTION_WORDS)), np.int64)
        for held in pieces(bodies):
            lists = [words for _, words, _, _ in held]
            rows, at = self.look_up(lists)
            cuts = np.cumsum([0] + [len(words) for words in lists])
            top = piece_tops(self.columns, self.kept["vec"][rows], at, cuts, np.array([ends for *_, ends in held]))
            flags = self.kept["flags"][rows][at]
            for i, (owner, _, again, _) in enumerate(held):
                best[owner] = np.maximum(best[owner], top[i])
                counts[owner] += flags[cuts[i] + again:cuts[i + 1]].sum(axis=0)
        return best, counts

    def score(self, bodies: list[bytes]) -> np.ndarray:
        if not bodies:
            return np.zeros(0)
        best, counts = self.pooled(bodies)
        cut = np.array([self.net.cuts[name] for name in LANGS])[language_of(counts)]
        return 1 / (1 + np.exp(-np.clip(self.net.logit(best).astype(np.float64) - cut, -30, 30)))


# Pieces of texts ready to be learned from: of each piece its words, whether its text ends,
# the text's label and its function words by language; of each word its number among the
# different ones; of these the buckets and which are NONE.  A long text goes on in the next row.
READY = ("texts int, hits int, length binary, ends binary, y binary, langs binary, at binary, buckets binary, "
         "none binary")
READY_ARROW = pa.schema([("texts", pa.int32()), ("hits", pa.int32())] +
                        [(c, pa.binary()) for c in ("length", "ends", "y", "langs", "at", "buckets", "none")])


def make_ready(batches):
    """READY rows of ``(body, y)`` batches."""
    known = Words()
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for held in pieces(batch.column(0).to_pylist()):
            lists = [words for _, words, _, _ in held]
            rows, at = known.look_up(lists)
            length = np.array([len(words) for words in lists], np.int32)
            ends = np.array([e for *_, e in held])
            y = np.array([labels[owner] for owner, *_ in held], np.int8)
            flags, cuts = known.kept["flags"][rows][at], np.cumsum([0, *length])
            langs = np.array([flags[cuts[i] + again:cuts[i + 1]].sum(axis=0)
                              for i, (_, _, again, _) in enumerate(held)], np.int32)
            buckets = known.kept["buckets"][rows]
            small = at.astype(np.uint16 if len(rows) <= 1 << 16 else np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) if isinstance(v, bytes) else pa.array([v], pa.int32()) for v in (
                    int(ends.sum()), int((y * ends).sum()), length.tobytes(), ends.tobytes(), y.tobytes(),
                    langs.tobytes(), small.tobytes(), (buckets % BUCKETS).astype(np.uint16).tobytes(),
                    np.packbits(buckets == NONE, axis=1).tobytes())], schema=READY_ARROW)


class Ready:
    """One READY row as arrays; the last of the different words is no word."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.cuts = np.concatenate([[0], np.cumsum(read("length", np.int32), dtype=np.int64)])
        self.ends, self.y = read("ends", bool), read("y", np.int8)
        self.langs = read("langs", np.int32).reshape(-1, len(FUNCTION_WORDS))
        wide = len(row["at"]) > 2 * self.cuts[-1]
        self.at = read("at", np.uint32 if wide else np.uint16).astype(np.int64)
        buckets = read("buckets", np.uint16).astype(np.int32).reshape(-1, SLOTS)
        unused = np.unpackbits(read("none", np.uint8).reshape(len(buckets), -1), axis=1, count=SLOTS)
        buckets[unused.astype(bool)] = NONE
        buckets = np.concatenate([buckets, np.full((1, SLOTS), NONE, np.int32)])
        self.share, self.slots = shares(buckets), np.ascontiguousarray(buckets.T)


def ready(batches):
    for batch in batches:
        for k in range(len(batch)):
            yield Ready(batch.slice(k, 1).to_pylist()[0])


class Trainer:
    """Goes on training a net, text by text, from given sums of squared gradients."""

    def __init__(self, net: Net, sums: dict[str, np.ndarray]):
        self.net, self.columns = net, net.columns()
        self.sums = {k: v.copy() for k, v in sums.items()}
        self.best = np.full(len(net.out), -np.inf, np.float32)
        self.x = np.zeros((len(COL_WORD), DIM), np.float32)      # words the filters stopped at
        self.slots = np.full((SLOTS, len(COL_WORD)), NONE, np.int32)

    @staticmethod
    def no_sums() -> dict[str, np.ndarray]:
        return {"emb": np.zeros(BUCKETS + 1, np.float32), "columns": np.zeros((len(COL_WORD), DIM), np.float32),
                "out": np.zeros(len(WIDTHS) * FILTERS, np.float32), "bias": np.zeros(1, np.float32)}

    def learn(self, part: Ready, weights: np.ndarray) -> None:
        no_words = np.full(PAD, len(part.share) - 1)
        for i, ends in enumerate(part.ends):
            at = part.at[part.cuts[i]:part.cuts[i + 1]]
            self._read(part, np.concatenate([at if len(at) else no_words[:1], no_words]), ends)
            if ends:
                self._step(part.y[i], weights[part.y[i]])

    def _read(self, part: Ready, at: np.ndarray, ends: bool) -> None:
        """Pool over a piece, keeping the words under each filter's largest response."""
        last = len(at) - PAD if ends else len(at) - 2 * PAD      # the last words come again with what follows
        if last <= 0:
            return
        slots = part.slots.take(at, axis=1)
        x = self.net.vectors(slots, part.share.take(at))
        z = responses(self.columns, x)[:, :last]
        peak = z.argmax(axis=1)
        top = z[np.arange(len(z)), peak]
        better = top > self.best
        self.best[better] = top[better]
        taken = better[COL_FILTER]
        place = (peak[COL_FILTER] + COL_WORD)[taken]
        self.x[taken], self.slots[:, taken] = x[place], slots[:, place]

    def _step(self, label: int, weight: float) -> None:
        net, sums, rate, eps = self.net, self.sums, 0.1, 1e-6
        pooled = self.best.copy()
        self.best[:] = -np.inf
        p = 1 / (1 + np.exp(-np.clip(net.logit(pooled), -30, 30)))
        d = np.float32((p - label) * weight)
        if abs(d) < 1e-3:
            return
        back = (d * net.out)[COL_FILTER, None]
        g = d * pooled + 1e-4 * net.out
        sums["out"] += g * g
        net.out -= rate * g / np.sqrt(sums["out"] + eps)
        sums["bias"] += d * d
        net.bias -= np.float32(rate * d / np.sqrt(sums["bias"][0] + eps))
        grad = self.columns * back
        g = self.x * back + 1e-5 * self.columns
        sums["columns"] += g * g
        self.columns -= rate * g / np.sqrt(sums["columns"] + eps)
        # the buckets of all words a filter stopped at, each with the sum of its gradients
        flat = self.slots.ravel()
        order = flat.argsort(kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        at = ordered[first]
        total = np.add.reduceat(grad[order % len(grad)], first, axis=0)
        if at[-1] == NONE:
            at, total = at[:-1], total[:-1]
        here = sums["emb"][at] + np.einsum("ij,ij->i", total, total) / DIM
        sums["emb"][at] = here
        net.emb[at] -= rate * total / np.sqrt(here + eps)[:, None]


def language_of(counts: np.ndarray) -> np.ndarray:
    """Index into LANGS: most function words, the first of equals; none: other."""
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(LANGS) - 1)


def best_cut(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Threshold of best weighted F1, halfway to the next lower logit."""
    order = np.argsort(-logit, kind="stable")
    x, y, w = logit[order], label[order], weight[order]
    hit, taken = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (taken + (w * y).sum())
    f1[:-1][x[:-1] == x[1:]] = -1                       # equal logits fall on the same side
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2 if k + 1 < len(x) else x[k] - 1)


def likely(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The texts whose ``id`` may be one of ``marks``, by a bitmap of id hashes with
    FILTER_BITS for each mark, so that few other texts are moved to the labels.  All texts
    where equal keys may have different hashes."""
    kind = texts.schema["id"].dataType.simpleString()
    if kind not in ("int", "bigint", "string", "binary") or kind != marks.schema["id"].dataType.simpleString():
        return texts

    def place(name):
        return F.pmod(F.xxhash64("id"), F.lit(bits)).alias(name)

    bits = max(1, marks.count()) * FILTER_BITS
    bitmaps = (marks.select(place("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")))
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    kept = (texts.select("*", place("place")).withColumn("bucket", F.bitmap_bucket_number("place"))
            .join(F.broadcast(bitmaps), "bucket"))
    return kept.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select("id", "body")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
             shard_docs: int) -> DataFrame:
    """READY rows of every labelled text, whole; a partition for each shard, in a fixed order."""
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")))
    marks = materialize(marks)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    size = docs.select(F.col(id_col).alias("id")).join(marks, "id").count()
    shards = max(1, -(-size // shard_docs))
    # a join would choose the number of partitions itself, so texts and labels meet in a window
    both = (likely(texts, marks).select("id", "body", F.lit(None).cast("int").alias("y"))
            .union(marks.select("id", F.lit(None).cast("binary"), "y")).repartition(shards, "id")
            .withColumn("y", F.max("y").over(Window.partitionBy("id"))))
    rows = (both.where("body is not null and y is not null").dropDuplicates(["id", "body"])
            .sortWithinPartitions(F.xxhash64("id", F.lit("toxicity")), "id", "body"))
    return rows.select("body", "y").mapInArrow(make_ready, READY)


def average_changes(changes: pd.DataFrame) -> pd.DataFrame:
    """One row for the changes of a block of parameters by several shards: their mean, for an
    embedding row over the shards that changed it."""
    block = int(changes["block"].iloc[0])
    total = count = 0
    for body in changes.sort_values("shard")["body"]:
        change = np.frombuffer(body, np.float32)
        if block >= 0:
            change = change.reshape(-1, DIM + 1)
        total = total + change.astype(np.float64)
        count = count + (change[:, DIM:] > 0 if block >= 0 else 1)
    mean = (total / np.maximum(count, 1)).astype(np.float32)
    return pd.DataFrame({"block": [block], "body": [mean.tobytes()]})


def dense(net: Net, columns: np.ndarray, sums: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the embeddings, with their sums, one after another."""
    return np.concatenate([columns.ravel(), net.out, [net.bias], sums["columns"].ravel(), sums["out"],
                           sums["bias"]]).astype(np.float32)


def train(rows: DataFrame, share: float, seed: int = 7) -> Net:
    """Fit a net to READY rows, each partition a shard; ``share`` of the labels are 1."""
    context = rows.sparkSession.sparkContext
    weights = np.array([0.5 / (1 - share), 0.5 / share])
    net, sums = Net(seed), Trainer.no_sums()
    for _ in range(EPOCHS):
        shared = context.broadcast((net, sums))

        def run(batches):
            given, given_sums = shared.value
            mine = Net(seed)
            mine.emb, mine.filters = given.emb.copy(), [f.copy() for f in given.filters]
            mine.out, mine.bias = given.out.copy(), given.bias
            trainer, empty = Trainer(mine, given_sums), True
            for part in ready(batches):
                trainer.learn(part, weights)
                empty = False
            if empty:
                return
            shard = TaskContext.get().partitionId()
            change = dense(mine, trainer.columns, trainer.sums) - dense(given, given.columns(), given_sums)
            yield pa.RecordBatch.from_pylist([{"block": -1, "shard": shard, "body": change.tobytes()}], SCHEMA)
            change = np.column_stack([mine.emb - given.emb, trainer.sums["emb"] - given_sums["emb"]])[:BUCKETS]
            for at in range(0, BUCKETS, EMB_ROWS):
                here = change[at:at + EMB_ROWS]
                if here[:, DIM].any():
                    yield pa.RecordBatch.from_pylist(
                        [{"block": at // EMB_ROWS, "shard": shard, "body": here.tobytes()}], SCHEMA)

        changes = (rows.mapInArrow(run, "block int, shard int, body binary")
                   .groupBy("block").applyInPandas(average_changes, "block int, body binary").collect())
        columns = net.columns()
        for r in changes:
            change = np.frombuffer(r["body"], np.float32)
            if r["block"] >= 0:
                change = change.reshape(-1, DIM + 1)
                here = slice(r["block"] * EMB_ROWS, r["block"] * EMB_ROWS + len(change))
                net.emb[here] += change[:, :DIM]
                sums["emb"][here] += change[:, DIM]
            else:
                sizes = [columns.size, net.out.size, 1] * 2
                parts = np.split(change, np.cumsum(sizes)[:-1])
                columns = columns + parts[0].reshape(columns.shape)
                net.out, net.bias = net.out + parts[1], net.bias + parts[2][0]
                for name, part in zip(("columns", "out", "bias"), parts[3:]):
                    sums[name] += part.reshape(sums[name].shape)
        cuts = np.cumsum([0] + [w * FILTERS for w in WIDTHS])
        net.filters = [np.ascontiguousarray(columns[a:b].reshape(w, FILTERS, DIM).transpose(0, 2, 1))
                       for w, a, b in zip(WIDTHS, cuts, cuts[1:])]
        shared.unpersist()
    return net


def choose_cuts(rows: DataFrame, net: Net) -> dict[str, float]:
    """Threshold of each language over all READY rows; of all languages together where
    fewer than 5 texts of a language are labelled 1."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        columns, best, count = shared.value.columns(), -np.inf, 0
        for part in ready(batches):
            top = piece_tops(columns, shared.value.vectors(part.slots, part.share), part.at, part.cuts, part.ends)
            pooled, counts = [], []
            for i, ends in enumerate(part.ends):
                best, count = np.maximum(best, top[i]), count + part.langs[i]
                if ends:
                    pooled.append(best)
                    counts.append(count)
                    best, count = -np.inf, 0
            if pooled:
                logit = shared.value.logit(np.array(pooled)).astype(np.float64)
                cell = np.rint(np.clip(logit, -30, 30) * CELLS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(language_of(np.array(counts)), pa.int32()), pa.array(cell),
                     pa.array(part.y[part.ends], pa.int32())], ["lang", "cell", "y"])

    counts = (rows.mapInArrow(run, "lang int, cell int, y int")
              .groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
              .orderBy("lang", "cell").toPandas())

    def cut(part: pd.DataFrame) -> float:
        part = part.groupby("cell", as_index=False)[["n", "hits"]].sum()
        n = part["n"].to_numpy(float)
        return best_cut(part["cell"].to_numpy(float) / CELLS, part["hits"].to_numpy(float) / n, n)

    whole, cuts = cut(counts), {}
    for k, name in enumerate(LANGS):
        here = counts[counts["lang"] == k]
        cuts[name] = cut(here) if here["hits"].sum() >= 5 else whole
    return cuts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", shard_docs: int = SHARD_DOCS) -> Net | None:
    """Learn from all labelled rows given (the caller keeps held-out rows away); None
    without labels of both classes."""
    bounded_batches(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col, label_col, shard_docs).persist(StorageLevel.DISK_ONLY)
    try:
        texts, hits = rows.agg(F.sum("texts"), F.sum("hits")).first()
        if not hits or hits == texts:
            return None
        net = train(rows, hits / texts)
        net.cuts = choose_cuts(rows, net)
        return net
    finally:
        rows.unpersist()


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of every row, from the text alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = id_and_bytes(docs, id_col, text_col)
    if net is None:
        return src.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            out = scorer.score([b or b"" for b in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
