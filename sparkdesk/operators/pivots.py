"""Exact k nearest vectors by squared L2 that leaves far vectors unread.

Vectors are put into cells by their nearest pivot and stored with their
distance to it; the store serves any number of searches.  For a query q, a
pivot p and a vector x of p's cell, |d(q, p) - d(x, p)| <= d(q, x), so once q
has k hits within distance u, only cells whose ring of distances comes within
u of d(q, p) can hold closer ones, and in such a cell only the vectors in that
ring.  A query first searches the cells nearest to it that hold k vectors,
which gives u, then whatever the bound leaves.  Nothing is approximated: where
the bound rules nothing out, all vectors are compared.

A cell is cut into blocks of vectors and of queries by hash, so a cell that
holds most rows, or that most queries visit, is many groups.  The driver sees
the pivots (``pivots`` vectors, a parameter) and one row per cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, DoubleType, StructField, StructType

from sparkdesk.functions import patterns as P
from sparkdesk.operators.retrieval import QUERY_ROWS, VECTOR_ROWS, finite
from sparkdesk.session import materialize

PIVOTS = 256                     # cells of a store
SLACK = 1e-9                     # relative, far above the rounding of a distance

FOUND = "query_id long, id long, distance double, compared long"


@dataclass(frozen=True)
class PivotStore:
    rows: DataFrame              # id, vec (array<double>), cell, near (distance to the cell's pivot)
    pivots: np.ndarray           # one row per cell
    count: np.ndarray            # vectors, smallest and largest distance to the pivot, by cell
    low: np.ndarray
    high: np.ndarray


def _doubles(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.where(finite(vec_col)).select(F.col(id_col).cast("long").alias("id"),
                                            F.col(vec_col).cast("array<double>").alias("vec"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.array(column.to_list(), np.float64).reshape(len(column), -1)
    if len(column) and out.shape[1] != dim:
        raise ValueError(f"vector dimension {out.shape[1]} differs from {dim}")
    return out


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to every pivot, summed as differences (no cancellation)."""
    out = np.empty((len(x), len(pivots)))
    for c, p in enumerate(pivots):
        out[:, c] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def store_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  pivots: int = PIVOTS) -> PivotStore:
    """Write the vectors with their cells.  Pivots are ``pivots`` different vectors, those of the
    smallest hash; vectors that are null or not finite take no part."""
    rows = _doubles(vectors, id_col, vec_col)
    chosen = (rows.select("vec", F.xxhash64("vec").alias("h")).groupBy("h").agg(F.min("vec").alias("vec"))
              .orderBy("h").limit(pivots).collect())
    if not chosen:
        empty = rows.withColumns({"cell": F.lit(0), "near": F.lit(0.0)})
        return PivotStore(empty, np.empty((0, 0)), *(np.empty(0) for _ in range(3)))
    centres = np.array([r.vec for r in chosen], np.float64)

    def assign(batches):
        for pdf in batches:
            d = _to_pivots(_matrix(pdf["vec"], centres.shape[1]), centres)
            cell = d.argmin(axis=1) if len(pdf) else np.empty(0, int)
            yield pdf.assign(cell=cell.astype(np.int32), near=d[np.arange(len(pdf)), cell])

    schema = StructType(rows.schema.fields + [StructField("cell", IntegerType()), StructField("near", DoubleType())])
    stored = materialize(rows.mapInPandas(assign, schema))
    n, low, high = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("low"),
                                        F.max("near").alias("high")).collect():
        n[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    return PivotStore(stored, centres, n, low, high)


def _search_group(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Best k of every query of a block among the vectors of a block that its ring leaves, and one
    row without an id that says how many vectors were compared."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        have, asks = group[~group["asks"]].sort_values(["near", "id"]), group[group["asks"]]
        if not len(have) or not len(asks):
            return pd.DataFrame({"query_id": [], "id": [], "distance": [], "compared": []})
        x = np.array(have["vec"].to_list(), np.float64)
        ids, near, out = have["id"].to_numpy(), have["near"].to_numpy(), []
        for qid, vec, at, reach in zip(asks["id"], asks["vec"], asks["near"], asks["reach"]):
            slack = SLACK * (1.0 + at + near[-1])
            lo = np.searchsorted(near, at - reach - slack, "left")
            hi = np.searchsorted(near, at + reach + slack, "right")
            d = ((x[lo:hi] - np.asarray(vec, np.float64)) ** 2).sum(axis=1)
            best = np.arange(len(d))
            if len(d) > k:
                best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            best = best[np.lexsort((ids[lo:hi][best], d[best]))][:k]
            out.append(pd.DataFrame({"query_id": qid, "id": pd.array([None, *ids[lo:hi][best]], "Int64"),
                                     "distance": [np.nan, *d[best]], "compared": [hi - lo] + [0] * len(best)}))
        return pd.concat(out)
    return run


def _visit(store: PivotStore, visits: DataFrame, k: int, vector_rows: int, query_rows: int) -> DataFrame:
    """Search the cells that queries visit (``id, vec, cell, near, reach``)."""
    block = lambda n: F.pmod(F.xxhash64("id", "vec"), n).cast("int")                    # noqa: E731
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))                            # noqa: E731
    by_cell = lambda v: F.element_at(F.array(*[F.lit(int(i)) for i in v]), F.col("cell") + 1)      # noqa: E731
    vector_blocks = by_cell(np.maximum(1, -(-store.count // vector_rows)))
    asked = np.zeros(len(store.pivots), np.int64)
    for r in visits.groupBy("cell").count().collect():          # a row per cell
        asked[r["cell"]] = -(-r["count"] // query_rows)
    query_blocks = by_cell(np.maximum(1, asked))
    open_cells = by_cell(asked) > 0
    cells = (store.rows.where(open_cells)
             .select("cell", block(vector_blocks).alias("vb"), "id", "vec", "near", query_blocks.alias("n"))
             .select("cell", "vb", every(F.col("n")).alias("qb"), F.lit(False).alias("asks"), "id", "vec", "near",
                     F.lit(None).cast("double").alias("reach"))
             .unionByName(visits.select("cell", block(query_blocks).alias("qb"), "id", "vec", "near", "reach",
                                        vector_blocks.alias("n"))
                          .select("cell", every(F.col("n")).alias("vb"), "qb", F.lit(True).alias("asks"), "id", "vec",
                                  "near", "reach")))
    return cells.groupBy("cell", "vb", "qb").applyInPandas(_search_group(k), FOUND)


def _plan_visits(store: PivotStore, k: int, first: bool):
    """Cells a query visits: first the nearest ones that hold ``k`` vectors together, afterwards
    all others that its ``reach`` (distance of its k-th hit so far) leaves."""
    centres, count, low, high = store.pivots, store.count, store.low, store.high

    def run(batches):
        for pdf in batches:
            d = _to_pivots(_matrix(pdf["vec"], centres.shape[1]), centres)
            order = np.argsort(d, axis=1, kind="stable")
            got = np.cumsum(count[order], axis=1)
            head = np.zeros(d.shape, bool)
            np.put_along_axis(head, order, np.concatenate(
                [np.ones((len(d), 1), bool), got[:, :-1] < k], axis=1), axis=1)
            if first:
                go = head & (count > 0)
                reach = np.full(len(d), np.inf)
            else:
                reach = pdf["reach"].to_numpy(np.float64)
                gap = np.maximum(np.maximum(low - d, d - high), 0.0)
                go = ~head & (count > 0) & (gap <= (reach[:, None] + SLACK * (1.0 + d + high)))
            q, c = np.nonzero(go)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[q], "vec": pdf["vec"].to_numpy()[q], "cell": c.astype(np.int32),
                                "near": d[q, c], "reach": reach[q]})
    return run


VISITS = "id long, vec array<double>, cell int, near double, reach double"


def search(store: PivotStore, queries: DataFrame, k: int = P.TOP_K, qid: str = "query_id", qvec: str = "embedding",
           vector_rows: int = VECTOR_ROWS, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(query_id, rank, id, distance)``, ties to the smaller id and fewer than k rows where the
    store is small, and ``(query_id, compared)``: the vectors each query was compared with.
    Query ids must be different; queries that are null or not finite take no part."""
    spark = queries.sparkSession
    asks = materialize(_doubles(queries, qid, qvec))
    if not len(store.pivots):
        none = spark.createDataFrame([], FOUND)
        return none.select("query_id", F.lit(0).cast("long").alias("rank"), "id", "distance"), none.select("query_id", "compared")
    visits = materialize(asks.mapInPandas(_plan_visits(store, k, True), VISITS))
    one = materialize(_visit(store, visits, k, vector_rows, query_rows))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = lambda df: (df.where("id is not null").withColumn("rank", F.row_number().over(w).cast("long"))
                         .where(F.col("rank") <= k))
    kth = ranked(one).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt("distance").alias("reach"))
    far = asks.join(kth, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    visits = materialize(far.mapInPandas(_plan_visits(store, k, False), VISITS))
    found = materialize(one.unionByName(_visit(store, visits, k, vector_rows, query_rows)))
    return (ranked(found).select("query_id", "rank", "id", "distance"),
            found.groupBy("query_id").agg(F.sum("compared").alias("compared")))
