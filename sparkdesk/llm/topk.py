"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights.  All candidates are cut by hash
into blocks of about ``ROWS`` and all queries into blocks of about
``QUERIES``; each pair of blocks is one bounded group.  In a group the
candidates become postings by term, and each term of the queries scatters its
products into dense arrays of scores, one per query.  A partition selection on
(score, order of id) takes each query's ``k`` best, and the best of all groups
are merged by a window whose per-group limit works before the shuffle.

The work is the product of queries and candidates, as an exhaustive search is;
nothing larger than a block is held by a task, and no pair leaves it but the
``k`` best per query and block.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id; an all-zero vector scores 0 with
everything; repeated rows (same id and vector) count once; a query never finds
a row of its own id; one id with several vectors is searched once per vector;
fewer candidates than ``k`` are all returned; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.llm.common import bounded_batches
from sparkdesk.session import materialize

ROWS = 8192
QUERIES = 2048
CHUNK = 16                      # queries whose score arrays are filled together


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """``(id, terms, weights)``: the non-zero components of floor(scale * x) of every row
    that takes part."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vec, lambda x, i: F.struct(
        i.alias("term"), F.floor(F.lit(scale) * x.cast("double")).alias("weight")))
    rows = (vectors.where(F.col(id_col).isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(True)))
            .select(F.col(id_col).alias("id"), F.filter(whole, lambda e: e["weight"] != 0).alias("e")))
    return rows.select("id", F.col("e.term").alias("terms"), F.col("e.weight").alias("weights")).distinct()


def _postings(rows: pd.DataFrame) -> dict:
    """For each term its candidates and their weights; a term that a quarter of the
    candidates hold has its weights laid out for all of them (candidates None)."""
    size = rows["terms"].map(len).to_numpy()
    if not size.sum():
        return {}
    term = np.concatenate(rows["terms"].to_list())
    weight = np.concatenate(rows["weights"].to_list()).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(term, kind="stable")
    names, first = np.unique(term[order], return_index=True)
    cuts, out = np.append(first, len(order)), {}
    for t, a, b in zip(names.tolist(), cuts, cuts[1:]):
        held = order[a:b]
        if 4 * len(held) >= len(rows):
            column = np.zeros(len(rows), np.int64)
            column[at[held]] = weight[held]
            out[t] = (None, column)
        else:
            out[t] = (at[held], weight[held])
    return out


def _narrowed(postings: dict, largest: int) -> dict:
    """Postings in 32 bits where no score of queries up to ``largest`` can leave them."""
    bound = sum(int(np.abs(w).max(initial=0)) for _, w in postings.values()) * largest
    if bound >= 1 << 31:
        return postings
    return {t: (at, w.astype(np.int32)) for t, (at, w) in postings.items()}


def _scores(postings: dict, rows: int, queries: pd.DataFrame) -> np.ndarray:
    """Dense scores (queries x candidates), accumulated a term at a time."""
    asked: dict[int, tuple[list[int], list[int]]] = {}
    for q, (terms, weights) in enumerate(zip(queries["terms"], queries["weights"])):
        for t, w in zip(terms.tolist(), weights.tolist()):
            lists = asked.setdefault(t, ([], []))
            lists[0].append(q)
            lists[1].append(w)
    kind = next((w.dtype for _, w in postings.values()), np.dtype(np.int64))
    out, product = np.zeros((len(queries), rows), kind), np.empty((len(queries), rows), kind)
    for t, (q, w) in asked.items():
        if t not in postings:
            continue
        at, weight = postings[t]
        if at is None:
            column = np.zeros((len(queries), 1), kind)
            column[q, 0] = w
            out += np.multiply(column, weight, out=product)
        else:
            out[np.ix_(q, at)] += np.multiply.outer(np.array(w, kind), weight)
    return out


def _select(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, ties to the earlier column."""
    n = score.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(score), 1))
    if max(-int(score.min(initial=0)), int(score.max(initial=0))) < (1 << 62) // n:
        key = score.astype(np.int64) * n - np.arange(n)
        return np.argpartition(key, n - k, axis=1)[:, n - k:]
    return np.argsort(-score.astype(object), axis=1, kind="stable")[:, :k]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = 20, scale: float = 64.0) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` rows of highest inner product of every
    row that ``is_query`` (an expression over ``id_col``) holds for, ties to the smaller id."""
    bounded_batches(vectors.sparkSession)
    asks = vectors.where(F.coalesce(is_query, F.lit(False)))
    rows = materialize(integer_rows(vectors, id_col, vec_col, scale))
    asks = materialize(integer_rows(asks, id_col, vec_col, scale))
    row_blocks = max(1, -(-rows.count() // ROWS))
    query_blocks = max(1, -(-asks.count() // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("id", "terms", "weights"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))                         # noqa: E731
    cells = (rows.select("*", block(row_blocks).alias("rb"), every(query_blocks).alias("qb"), F.lit(False).alias("asks"))
             .unionByName(asks.select("*", block(query_blocks).alias("qb"), every(row_blocks).alias("rb"),
                                      F.lit(True).alias("asks"))))
    id_type = rows.schema["id"].dataType.simpleString()

    def best(group: pd.DataFrame) -> pd.DataFrame:
        have, asks = group[~group["asks"]].sort_values("id", kind="stable"), group[group["asks"]]
        ids, out = have["id"].to_numpy(), []
        largest = max((int(np.abs(w).max(initial=0)) for w in asks["weights"]), default=0)
        postings = _narrowed(_postings(have), largest)
        for at in range(0, len(asks) if len(ids) else 0, CHUNK):
            part = asks.iloc[at:at + CHUNK]
            score = _scores(postings, len(ids), part)
            own = part["id"].to_numpy()[:, None]
            # at most as many more as rows of the query's own id, which are taken out after
            extra = int((np.searchsorted(ids, own[:, 0], "right") - np.searchsorted(ids, own[:, 0])).max())
            chosen = _select(score, k + extra)
            q, c = np.nonzero(ids[chosen] != own)
            out.append(pd.DataFrame({"query_id": own[q, 0], "ask": part["ask"].to_numpy()[q],
                                     "id": ids[chosen[q, c]], "score": score[q, chosen[q, c]]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "ask": [], "id": [], "score": []})

    cells = cells.withColumn("ask", F.xxhash64("terms", "weights"))
    found = (cells.groupBy("rb", "qb")
             .applyInPandas(best, f"query_id {id_type}, ask bigint, id {id_type}, score bigint"))
    top = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


#: DuckDB twin over the table ``embeddings``.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_inner_product(list_transform(q.w, lambda x: x::DOUBLE), list_transform(c.w, lambda x: x::DOUBLE))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
