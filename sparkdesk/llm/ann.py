"""Approximate nearest neighbours by shifted Hilbert curves.

Unit vectors are projected on ``dims`` random orthonormal directions, shifted
by a random part of a cell, cut into cells and put in the order of the Hilbert
curve through the cells; ``curves`` such orderings (each with directions and a
shift of its own) are made.  A query looks at the neighbouring key window of
each ordering, ``window`` of all vectors in all (half before and half after its
own place), and the windows' candidates are merged and ranked again by the
exact cosine.

Plan: keys alone are range-partitioned and sorted; a place in the order is the
row's number in its partition and the counts of the partitions before it.
Places are cut into slabs of ``SLAB`` rows; a query goes to the slabs its
window touches, and each (curve, slab, block of queries) is one bounded group
scored in numpy.  Only the best ``k`` of each group leave it.

Rows of one cell are ordered by the curve's further course inside it (``FINE``
bits a direction), so each curve orders a group of near copies in its own way.

Equal vectors, and vectors that are equal over their largest magnitude (exact
multiples), are indexed once with their ``k + 1`` smallest ids, so a direction
that a third of all rows share is one point on the curves, and ties go to the
smaller id whatever the size of the group.  Multiples that rounding has changed
are near copies.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; repeated rows (same id and direction) count once; an
id with several directions is a row for each, found once for each, and asks once
for each (its ranks start again); a query never finds a row of its own id; rows with a null id take no part; fewer
candidates than ``k`` are all returned where the windows reach them; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.llm.common import bounded_batches
from sparkdesk.session import materialize

CURVES = 16
WINDOW = 0.07                   # share of all vectors in a query's window on one curve
LEAST = 100                     # but at least this many rows to either side
DIMS = 8
BITS = 6                        # cells per direction: 2**BITS
WORD = 7                        # further bits a direction in each word of the finer key
FINE = 3 * WORD                 # bits inside a cell: below what a cosine can tell apart
KEYS = ["key", *(f"key{w}" for w in range(1, FINE // WORD + 1))]
REACH = 3.0                     # cells span this many standard deviations to either side
SLAB = 2048
QUERY_BLOCK = 2048


def _transposed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Skilling's transposed form of the Hilbert positions, a row for each coordinate."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, below = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    return x


def _word(x: np.ndarray, high: int, low: int) -> np.ndarray:
    """The part of the positions that the bits from ``high`` (without) down to ``low`` give."""
    key = np.zeros_like(x[0])
    for level in range(high - 1, low - 1, -1):
        for i in range(len(x)):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer cells (rows, ``bits`` bits a coordinate) on the Hilbert curve:
    Skilling's transposed form, worked on all rows at once."""
    return _word(_transposed(cells, bits), bits, 0)


def curve_keys(unit: np.ndarray, curves: int, seed: int = 0, dims: int = DIMS) -> np.ndarray:
    """Hilbert keys of unit vectors on every curve (rows x curves x words): the cell's key,
    then the words of the curve's course inside the cell."""
    d = unit.shape[1]
    dims = min(dims, d)
    width = 2 * REACH / np.sqrt(d) / (1 << BITS)
    out = np.empty((len(unit), curves, len(KEYS)), np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, d, c])
        basis = np.linalg.qr(rng.standard_normal((d, dims)))[0]
        at = unit @ basis / width + rng.random(dims)
        cells = np.floor(at)
        inside = np.minimum((at - cells) * (1 << FINE), (1 << FINE) - 1).astype(np.int64)
        cells = np.clip(cells + (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
        x = _transposed(cells << FINE | inside, BITS + FINE)
        out[:, c, 0] = _word(x, BITS + FINE, FINE)
        for w in range(1, len(KEYS)):
            out[:, c, w] = _word(x, FINE - (w - 1) * WORD, FINE - w * WORD)
    return out


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def direction(vec: Column) -> Column:
    """A vector over its largest magnitude: bitwise equal for exact multiples of one vector."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    return F.zip_with(vec, F.array_repeat(top, F.size(vec)), lambda x, t: x.cast("double") / t + F.lit(0.0))


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _places(reps: DataFrame, curves: int) -> DataFrame:
    """``(curve, place, rid)``: place from 0 of every vector in every ordering."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1)
            size = np.diff(flat.offsets.to_numpy())
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                rows = flat.take(pa.array(at))
                unit = _unit(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d))
                keys = curve_keys(unit, curves)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(curves, dtype=np.int32), len(at))),
                    *(pa.array(keys[:, :, w].ravel()) for w in range(len(KEYS))),
                    batch.column(0).take(pa.array(np.repeat(at, curves)))], ["curve", *KEYS, "rid"])

    id_type = reps.schema["rid"].dataType.simpleString()
    keys = reps.select("rid", "vec").mapInArrow(run, f"curve int, {', '.join(f'{k} bigint' for k in KEYS)}, rid {id_type}")
    ordered = materialize(keys.repartitionByRange("curve", *KEYS, "rid")
                          .sortWithinPartitions("curve", *KEYS, "rid")
                          .select("curve", "rid", F.monotonically_increasing_id().alias("mid"))
                          .withColumn("part", F.shiftright("mid", 33)))
    counts = ordered.groupBy("curve", "part").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("add"))
    return ordered.join(starts, ["curve", "part"]).select("curve", (F.col("mid") + F.col("add")).alias("place"), "rid")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = 5, curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """``(query_id, rank, id_col, score, scored)``: the ``k`` nearest found of every row that
    ``is_query`` (an expression over ``id_col``) holds for, by cosine, nearest first, and how
    many rows the query was scored against on all curves together."""
    bounded_batches(vectors.sparkSession)
    rows = (vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
            .select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                    F.col(vec_col).alias("vec"))
            .groupBy("id", "asks", direction(F.col("vec")).alias("dir")).agg(F.min("vec").alias("vec")))
    in_group = Window.partitionBy("dir").orderBy("id")
    first = (rows.select("dir", "vec", "id", F.row_number().over(in_group).alias("nth"))
             .where(F.col("nth") <= k + 1))
    members = materialize(first.select(F.xxhash64("dir").alias("h"), "dir", "vec", "id", "nth"))
    # a point is a direction: an id with several of them is several points
    points = materialize(members.where("nth = 1").select("h", "dir", "vec", F.col("id").alias("low"),
                                                         F.monotonically_increasing_id().alias("rid")))
    reps = points.select("vec", "low", "rid")
    points = points.select("h", "dir", "rid")
    members = members.select("h", "dir", "id").join(points, ["h", "dir"]).select("rid", "id")
    asking = materialize(rows.where("asks").select(F.xxhash64("dir").alias("h"), "dir", F.col("id").alias("query_id"))
                         .join(points, ["h", "dir"]).select("rid", "query_id"))
    n, n_asking = reps.count(), asking.select("rid").distinct().count()
    half = max(int(np.ceil(n * window / 2)), LEAST)
    blocks = max(1, int(np.ceil(n_asking * (2 * half + SLAB) / max(n, 1) / QUERY_BLOCK)))
    placed = _places(reps, curves).join(reps, "rid")
    stored = (placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
              .select("curve", F.floor(F.col("place") / SLAB).alias("slab"), "block", F.lit(False).alias("asks"),
                      "place", "rid", "low", "vec"))
    searched = (placed.join(asking.select("rid").distinct(), "rid", "left_semi")
                .select("*", F.explode(F.sequence(
                    F.greatest(F.floor((F.col("place") - half) / SLAB), F.lit(0)),
                    F.least(F.floor((F.col("place") + half) / SLAB), F.lit((max(n, 1) - 1) // SLAB)))).alias("slab"))
                .select("curve", "slab", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"),
                        F.lit(True).alias("asks"), "place", "rid", "low", "vec"))
    id_type = reps.schema["low"].dataType.simpleString()

    def best(group: pd.DataFrame) -> pd.DataFrame:
        kept, out = group[~group["asks"]], []
        asks = group[group["asks"]]
        for size, some in asks.groupby(asks["vec"].map(len)):
            have = kept[kept["vec"].map(len) == size].sort_values("place")
            if not len(have):
                continue
            x, rid, low, place = (_unit(_matrix(have["vec"])), *(have[c].to_numpy() for c in ("rid", "low", "place")))
            first = np.searchsorted(place, some["place"].to_numpy() - half, "left")
            last = np.searchsorted(place, some["place"].to_numpy() + half, "right")
            for q, own, a, b in zip(_unit(_matrix(some["vec"])), some["rid"].to_numpy(), first, last):
                # only the rows inside the window are scored
                score = np.clip(x[a:b] @ q, -1.0, 1.0)
                score[rid[a:b] == own] = -np.inf
                best = np.flatnonzero(score >= np.partition(score, b - a - k)[b - a - k]) if b - a > k else np.arange(b - a)
                best = best[np.lexsort((rid[a:b][best], low[a:b][best], -score[best]))][:k]
                best = best[np.isfinite(score[best])]
                out.append((own, b - a, rid[a:b][best], low[a:b][best], score[best]))
        n = [max(len(f), 1) for _, _, f, _, _ in out]           # a row without a find says what was scored
        rows = pd.DataFrame({"rid": np.repeat([o for o, *_ in out], n).astype(np.int64)})
        rows["scored"] = [x for _, m, f, _, _ in out for x in [m] + [0] * (max(len(f), 1) - 1)]
        for c, name in ((2, "found"), (3, "low"), (4, "score")):
            rows[name] = pd.Series([v for o in out for v in (o[c] if len(o[2]) else [None])], dtype=object)
        return rows

    near = materialize(stored.unionByName(searched).groupBy("curve", "slab", "block")
                       .applyInPandas(best, f"rid bigint, scored bigint, found bigint, low {id_type}, score double"))
    work = near.groupBy("rid").agg(F.sum("scored").alias("scored"))
    top = Window.partitionBy("rid").orderBy(F.desc("score"), "low", "found")
    near = (near.where("found is not null").groupBy("rid", "found", "low").agg(F.max("score").alias("score"))
            .withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k).select("rid", "found", "score"))
    same = asking.select("rid").distinct().select("rid", F.col("rid").alias("found"), F.lit(1.0).alias("score"))
    ids = near.unionByName(same).join(members.withColumnRenamed("rid", "found"), "found")
    by_query = Window.partitionBy("query_id", "rid").orderBy(F.desc("score"), "id")
    return (asking.join(ids, "rid").join(work, "rid", "left").where(F.col("id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score",
                    F.coalesce("scored", F.lit(0).cast("long")).alias("scored")))
