"""SimHash near-duplicate groups by multi-index hashing.

A document's 64-bit fingerprint has bit *b* set when more than half of its
word-shingle hashes have it set.  Documents whose fingerprints differ in at
most ``max_bits`` bits are linked; a group is a connected component.

Search: the fingerprint is cut into segments, as many as leave at most one
differing bit in one of them (two of 32 bits for ``max_bits=2``).  A table keyed
by segment number and segment value holds every fingerprint once a segment;
a fingerprint looks up the Hamming ball of radius 1 around each of its segment
values, and what it meets is verified on all 64 bits.  Of two values one bit
apart the one with the zero looks up the other, so only zeros are flipped.

A segment value that more than ``HOT`` fingerprints share (a group of near
copies) would be compared pairwise, so its bucket is split by the remaining
bits: every member is written for each value of the small ball around its
remaining bits, and fingerprints within ``max_bits`` meet in one of the parts.
All members of a part are within ``max_bits`` of each other by construction,
so they are linked to the smallest one, as is a fingerprint that looks the
part up: no pairs, no cap, and no part outgrows a ball.

Equal fingerprints are one node from the start, so exact copies cost nothing.

The joins of exploded rows are sort-merge joins at every size: Spark takes an
exploded array for one value, so a side of some 34 rows a fingerprint would
look small enough to broadcast and be gathered on the driver.

Defined results: null, empty and all-whitespace texts have fingerprint 0 and
are linked like any other; a text of fewer words than a shingle hashes its
whole word sequence; repeated rows each get a row; a null key never names a
component unless all keys of the component are null; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from sparkdesk.llm.common import (bounded_batches, connected_components, free_names, id_and_bytes,
                                  word_blocks)
from sparkdesk.session import materialize

HOT = 64                         # fingerprints of a segment value above which its bucket is split


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text (unsigned)."""
    digest = xxhash.xxh64_intdigest
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data or b""):
        words = carry + words
        carry = words[-(shingle_words - 1):] if shingle_words > 1 else []
        if len(words) < shingle_words:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - shingle_words + 1
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in
                              zip(starts[:n].tolist(), ends[shingle_words - 1:].tolist())),
                             np.uint64, n)
        counts += _bit_counts(hashes)
        total += n
    if not total:
        if not carry:
            return 0
        counts, total = _bit_counts(np.array([digest(b" ".join(carry), seed)], np.uint64)), 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = 3) -> DataFrame:
    """``(id, fp)`` of every row, ``fp`` the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    src = id_and_bytes(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle_words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_type}, fp bigint")


def _ball(bits: list[int], radius: int) -> list[int]:
    """Masks (signed longs) of at most ``radius`` of the bits."""
    masks = [sum(1 << b for b in some) for n in range(radius + 1) for some in itertools.combinations(bits, n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _around(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: value.bitwiseXOR(m))


def candidates(nodes: DataFrame, max_bits: int = 2, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Table matches ``(a, b)`` still to be verified, and links ``(a, b)`` that split buckets prove."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")
    n_segments = max_bits // 2 + 1
    radius, inner = min(max_bits // n_segments, 1), max_bits // 2
    segments = [range(64 * i // n_segments, 64 * (i + 1) // n_segments) for i in range(n_segments)]
    rest = [[b for b in range(64) if b not in s] for s in segments]
    own = [sum(_ball(list(s), 1)[1:]) for s in segments]          # the bits of a segment, as one mask
    stored, asked = [], []
    for i, s in enumerate(segments):
        value = F.col("fp").bitwiseAND(F.lit(own[i]).cast("bigint"))
        zeros = F.filter(F.array(*[F.lit(m).cast("bigint") for m in _ball(list(s), 1)[1:]]),
                         lambda m: value.bitwiseAND(m) == 0)
        flips = F.transform(zeros, lambda m: value.bitwiseOR(m))
        stored.append(nodes.select(F.lit(i).alias("seg"), value.alias("value"), "fp"))
        asked.append(nodes.select(F.lit(i).alias("seg"), F.posexplode(
            F.concat(F.array(value), flips) if radius else F.array(value)).alias("nth", "value"), "fp")
            .select("seg", "value", "fp", (F.col("nth") > 0).cast("int").alias("off")))
    table, asks = functools.reduce(DataFrame.union, stored), functools.reduce(DataFrame.union, asked)
    full = materialize(table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
                       .where(F.col("n") > hot).select("seg", "value"))
    met = (asks.withColumnRenamed("fp", "a")
           .join(table.join(full, ["seg", "value"], "left_anti").withColumnRenamed("fp", "b").hint("merge"),
                 ["seg", "value"])
           .where((F.col("a") < F.col("b")) | (F.col("off") == 1) & (F.col("a") != F.col("b")))
           .select("a", "b"))

    def split(rows: DataFrame, reach: int) -> DataFrame:
        """Rows of full buckets, once for each value around their remaining bits."""
        parts = F.lit(None).cast("array<bigint>")
        for i in range(n_segments):
            others = F.col("fp").bitwiseAND(F.lit(~own[i]).cast("bigint"))
            parts = F.when(F.col("seg") == i, _around(others, _ball(rest[i], reach))).otherwise(parts)
        return rows.select("seg", "value", "fp", F.explode(parts).alias("part"))

    key = ["seg", "value", "part"]
    members = split(table.join(full, ["seg", "value"], "left_semi"), inner)
    lowest = members.groupBy(*key).agg(F.min("fp").alias("b"))
    asks = asks.join(full, ["seg", "value"], "left_semi")
    rows = members
    for off in range(radius + 1):
        reach = max_bits - off - inner
        if off or reach != inner:           # else they are the members themselves
            rows = rows.union(split(asks.where(F.col("off") == off), reach))
    proved = rows.withColumnRenamed("fp", "a").join(lowest.hint("merge"), key).where("a <> b").select("a", "b")
    return met, proved


def links(nodes: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """Verified links ``(a, b)``, some more than once, that connect all fingerprints of ``nodes``
    (column ``fp``, distinct) at most ``max_bits`` apart."""
    met, proved = candidates(nodes, max_bits, hot)
    return met.union(proved).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle_words: int,
             max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of every row, and ``(fp, low, root)`` of every fingerprint: its smallest key and the
    fingerprint that names its group."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = connected_components(links(nodes.select("fp"), max_bits))
    return marked, (nodes.join(roots, nodes["fp"] == roots["node"], "left")
                    .select("fp", "low", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: one row per input row; ``component_id`` is
    the smallest key of the group and ``fingerprint`` 16 lower-case hex digits."""
    marked, rooted = _grouped(docs, id_col, text_col, shingle_words, max_bits)
    first = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    # a row per document on both sides: files of repeated fingerprints are far smaller than their rows
    return (marked.join(named.hint("merge"), "fp")
            .select(F.col("id").alias(id_col),
                    F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without near duplicates: each group keeps one document, that of the
    smallest key, then text hash.  A document is a key with a text: a key with several texts
    is several documents, repeated rows of one are one, of which the row with the smallest
    hash stays; rows without a key cannot be told apart and stay."""
    key, hashed, row, fp = free_names(docs, ["_id", "_th", "_row", "_fp"])
    body = docs.withColumn(hashed, F.xxhash64(text_col)).withColumn(fp, F.col(text_col))
    keyed = body.where(F.col(id_col).isNotNull())
    # the fingerprint belongs to the text: its hash goes along in the key
    both = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(hashed).alias("th")).alias(key), F.col(fp))
    _, rooted = _grouped(both, key, fp, shingle_words, max_bits)
    kept = (rooted.groupBy("root").agg(F.min("low").alias("low"))
            .select(F.col("low.id").alias(key), F.col("low.th").alias(fp)))
    columns = [f for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    stay = (keyed.drop(fp).join(kept, (F.col(id_col) == F.col(key)) & (F.col(hashed) == F.col(fp)), "left_semi")
            .groupBy(F.col(id_col).alias(key), F.col(hashed).alias(fp))
            .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]),
                          F.xxhash64(*[F.col(f"`{f.name}`") for f in columns])).alias(row)))
    return (stay.select(*[F.col(row)[c].alias(c) for c in docs.columns])
            .unionByName(docs.where(F.col(id_col).isNull())))
