"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree up to ``ORDER`` bytes deep, held as the
sorted (context, byte) counts of every depth.  A byte's code length under a
language is exact PPM with escape method C: in the longest known context the
byte costs ``-log2(n / (total + kinds))``; if it is new there, the escape
costs ``-log2(kinds / (total + kinds))`` and the next shorter context is
asked, down to 8 bits for a byte never seen.  The statistics are frozen: the
text being scored never changes them.  The language with the shortest code
wins; ``score`` is its share ``2**-length`` of all languages'.

Trees are learned from a bounded sample (``docs_per_lang`` texts of each
language in expectation, picked by a hash of the key); prediction covers every
byte of every text.

Defined results: null texts and texts without a letter are ``und`` with score
0; an empty training set makes everything ``und``; ties go to the smaller
language name; rows with a null key are predicted but never learned from;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import bounded_batches, id_and_bytes

ORDER = 3                       # longest context in bytes; a gram is context + byte
DOCS_PER_LANG = 1000
CHUNK = 2 << 20                 # bytes scored together
DENSE = 1 << 24                 # cells of the table that numbers a chunk's distinct grams
MAX_BITS = 8.0                  # bits per byte: a text that no language codes in less than its own size goes
START = b"\n" * ORDER           # context of a text's first bytes
LETTER = regex.compile(r"\p{L}")
UND = "und"


def _grams(block: bytes) -> np.ndarray:
    """All (ORDER + 1)-byte windows of a block, packed big-endian."""
    raw = np.frombuffer(block, np.uint8).astype(np.uint32)
    out = raw[:-ORDER].copy()
    for k in range(1, ORDER + 1):
        out = (out << np.uint32(8)) | raw[k:len(raw) - ORDER + k]
    return out


def _pieces(data: bytes):
    """The text in pieces of at most CHUNK coded bytes, each led by its context."""
    data = START + data.lower()
    for pos in range(ORDER, len(data), CHUNK):
        yield data[pos - ORDER:pos + CHUNK]


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, n)`` over ``docs``; counted per batch before the shuffle."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(lang_col).cast("string").alias("lang"),
                      F.col(text_col).cast("binary").alias("body"))

    def run(batches):
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in _pieces(body.as_py() or b""):
                    by_lang.setdefault(lang, []).append(_grams(piece))
            for lang, parts in by_lang.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)),
                     pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return (src.mapInArrow(run, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Tree:
    """Frozen context tree of one language: for each depth the sorted grams with their
    code length, and the sorted contexts with the cost of an escape."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.levels = []
        for depth in range(ORDER, -1, -1):
            keep = np.uint32((1 << (8 * (depth + 1))) - 1)
            g, inv = np.unique(gram & keep, return_inverse=True)
            c = np.bincount(inv, n, len(g))
            ctx, inv = np.unique(g >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(inv, c, len(ctx)), np.bincount(inv, None, len(ctx))
            self.levels.append((keep, g, -np.log2(c / (total + kinds)[inv]),
                                ctx, -np.log2(kinds / (total + kinds))))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length in bits of each gram's last byte after its other bytes."""
        out = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        for keep, g, cost, ctx, escape in self.levels:
            if not len(open_) or not len(g):
                continue
            now = gram[open_] & keep
            at = np.minimum(np.searchsorted(g, now), len(g) - 1)
            hit = g[at] == now
            out[open_[hit]] += cost[at[hit]]
            open_, now = open_[~hit], now[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(ctx, now), len(ctx) - 1)
            known = ctx[at] == now
            out[open_[known]] += escape[at[known]]
        out[open_] += 8.0
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs_per_lang: int = DOCS_PER_LANG) -> dict[str, Tree]:
    """Learn one tree per language of ``docs`` (rows without text, language or key are
    skipped).  The sample is bounded in expectation by ``docs_per_lang`` texts a language:
    a row is taken when the hash of its key falls below that share of its language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                      & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in
             rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items())
                                        for v in (lang, min(1.0, docs_per_lang / n))]),
                         F.col("lang"))
    table = count_grams(rows.where(draw < share), "text", "lang").toPandas()
    return {lang: Tree(part["gram"].to_numpy().astype(np.uint32), part["n"].to_numpy())
            for lang, part in table.groupby("lang")}


def _distinct(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(gram, return_inverse=True)`` without a sort: the byte pairs that occur
    are numbered, and a gram is a cell of the table pair x pair.  Texts with too many
    different pairs for the table are sorted."""
    high, low = gram >> np.uint32(16), gram & np.uint32(0xFFFF)
    seen = np.zeros(1 << 16, bool)
    seen[high] = True
    seen[low] = True
    pairs = np.flatnonzero(seen)
    if len(pairs) ** 2 > DENSE:
        return np.unique(gram, return_inverse=True)
    number = (np.cumsum(seen) - 1).astype(np.int32)
    cell = number[high] * np.int32(len(pairs)) + number[low]
    used = np.zeros(len(pairs) ** 2, bool)
    used[cell] = True
    cells = np.flatnonzero(used)
    rank = np.empty(len(used), np.int32)
    rank[cells] = np.arange(len(cells), dtype=np.int32)
    found = (pairs[cells // len(pairs)] << 16) | pairs[cells % len(pairs)]
    return found.astype(np.uint32), rank[cell]


def _lengths(model: dict[str, Tree], bodies: list[bytes]) -> np.ndarray:
    """Code length in bits of every text (rows) under every language (columns)."""
    out = np.zeros((len(bodies), len(model)))
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def flush():
        nonlocal held, owner, size
        if not held:
            return
        gram, inv = _distinct(np.concatenate(held))
        starts = np.cumsum([0] + [len(h) for h in held[:-1]])
        for k, tree in enumerate(model.values()):
            np.add.at(out[:, k], owner, np.add.reduceat(tree.bits(gram)[inv], starts))
        held, owner, size = [], [], 0

    for row, body in enumerate(bodies):
        for piece in _pieces(body):
            held.append(_grams(piece))
            owner.append(row)
            size += len(piece)
            if size >= CHUNK:
                flush()
    flush()
    return out


def classify(model: dict[str, Tree], texts: list[bytes | None]
             ) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits per byte (0 for ``und``) of each text."""
    names = list(model)
    ok = [bool(names and t and LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
    lengths = _lengths(model, [t if o else b"" for t, o in zip(texts, ok)])
    langs, scores, bits = [], [], []
    for o, row, text in zip(ok, lengths, texts):
        if not o:
            langs.append(UND)
            scores.append(0.0)
            bits.append(0.0)
            continue
        best = int(np.argmin(row))
        langs.append(names[best])
        scores.append(float(1.0 / np.exp2(np.maximum(row[best] - row, -1000.0)).sum()))
        bits.append(float(row[best] / len(text)))
    return langs, scores, bits


def predict(docs: DataFrame, model: dict[str, Tree], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, bits_per_byte)`` of every row, from the text alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    src = id_and_bytes(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            langs, scores, bits = classify(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(bits, pa.float64())], ["id", "lang_pred", "score", "bits_per_byte"])

    id_type = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {id_type}, lang_pred string, score double, bits_per_byte double")
            .withColumnRenamed("id", id_col))


def keep_known(docs: DataFrame, model: dict[str, Tree], text_col: str = "text",
               max_bits_per_byte: float = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` in a language the model knows: not ``und``, and coded by the
    best language in at most ``max_bits_per_byte`` (noise and foreign scripts take over 8).
    Rows pass through whole, so repeated rows and rows without a key are decided alike."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else t.encode("utf-8", "surrogatepass")
                     for t in batch.column(at).to_pylist()]
            langs, _, bits = classify(shared.value, texts)
            yield batch.filter(pa.array([lang != UND and b <= max_bits_per_byte
                                         for lang, b in zip(langs, bits)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
