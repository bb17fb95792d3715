"""Document chunking, exact nearest-neighbour search, context and prompt
assembly, answer routing and an idempotent chunk store.

Chunking is one regex pass + ``transform`` + ``posexplode`` (JVM only).
Search never forms query x vector pairs as a join: vectors and queries are
cut into blocks, each pair of blocks is one bounded group whose distances
numpy computes and of which the best k per query are kept, and a per-query
window keeps the global best k out of (k x blocks) candidates.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from sparkdesk.functions import patterns as P
from sparkdesk.operators import numbering
from sparkdesk.session import materialize, spread

VECTOR_ROWS = 16_384             # vectors of a block, in expectation
QUERY_ROWS = 4_096               # queries of a block
QUERY_CHUNK = 128                # queries compared with a block at once


# T4 + W8 + X16 + D3: overlapping fixed-size chunks by code point
def chunk_text(df: DataFrame, text: str = "text", size: int = P.CHUNK_SIZE,
               overlap: int = P.CHUNK_OVERLAP, keep: Sequence[str] = ("doc_id",),
               out: str = "chunk") -> DataFrame:
    if not (0 <= overlap < size):
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    # one pass cuts the text into steps; a chunk is a step and the start of what follows it
    # (substr for every chunk would walk the text from its start each time)
    steps = F.col("_steps")
    more = -(-overlap // step)
    follow = lambda i: F.substring(F.array_join(F.slice(steps, i + 2, F.lit(more)), ""), 1, overlap)
    whole = F.transform(steps, lambda s, i: F.concat(s, follow(i))) if overlap else steps
    cut = spread(df).select(*keep, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_steps"))
    return (cut.select(*keep, F.posexplode(whole).alias("chunk_no", out))
            .withColumn("chunk_no", F.col("chunk_no").cast("long")))


# Attach vectors with a user batch function (list[str] -> n x dim)
def embed(df: DataFrame, fn: Callable[[list[str]], np.ndarray], dim: int, text: str = "text",
          out: str = "embedding") -> DataFrame:
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(FloatType()))])

    def run(batches):
        for pdf in batches:
            vecs = np.asarray(fn(pdf[text].fillna("").tolist()), dtype=np.float32)
            if vecs.shape != (len(pdf), dim):
                raise ValueError(f"embedding function returned {vecs.shape}, want {(len(pdf), dim)}")
            pdf[out] = list(vecs)
            yield pdf
    return spread(df).mapInPandas(run, schema)


def hashed_bag_of_words(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Deterministic test embedding: token counts hashed into ``dim`` slots, L2-normalised."""
    tok = re.compile(r"\w+", re.UNICODE)

    def fn(texts: list[str]) -> np.ndarray:
        m = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in tok.findall(t.lower()):
                m[i, zlib.crc32(w.encode("utf-8")) % dim] += 1.0
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms == 0, 1.0, norms)
    return fn


# Per-group centroid of float32 vectors (element-wise mean, cast back to float32)
def centroids(df: DataFrame, group: str, vec: str = "embedding", out: str = "embedding") -> DataFrame:
    parts = df.select(group, F.posexplode(vec).alias("_i", "_x"))
    avg = parts.groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).cast("float").alias("_m"))
    return avg.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))


def _block_topk(k: int):
    """Best k (exact squared L2, ties by id) of every query of a block among its vectors.

    Candidates come from one matrix product, |x|^2 - 2 x.q + |q|^2; every
    vector within a tolerance of the k-th value is kept (the tolerance is far
    above the expansion's rounding error), then all candidates get the exact
    distance sum((x - q)^2) together.  So the result equals a full exact sort.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        have, asks, out = group[~group["asks"]], group[group["asks"]], []
        x = np.array(have["vec"].to_list(), np.float64)
        ids, xn = have["id"].to_numpy(), (x ** 2).sum(axis=1) if len(have) else None
        for lo in range(0, len(asks) if len(have) else 0, QUERY_CHUNK):
            part = asks.iloc[lo:lo + QUERY_CHUNK]
            q = np.array(part["vec"].to_list(), np.float64)
            if q.shape[1:] != x.shape[1:]:
                raise ValueError(f"vector dimension {x.shape[1:]} differs from the query dimension {q.shape[1:]}")
            qn = (q ** 2).sum(axis=1)
            approx = qn[:, None] - 2.0 * (q @ x.T) + xn
            kk = min(k, len(ids))
            kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
            tol = 1e-9 * (xn.max() + qn) + 1e-12
            j, i = np.nonzero(approx <= (kth + tol)[:, None])
            d = ((x[i] - q[j]) ** 2).sum(axis=1)
            order = np.lexsort((ids[i], d, j))              # query, distance, id
            j, i, d = j[order], i[order], d[order]
            nth = np.arange(len(j)) - np.searchsorted(j, j)
            out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[j], "id": ids[i], "distance": d})[nth < k])
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": []})
    return run


def finite(vec: str):
    """Whether a vector can be compared: not null, all components finite."""
    return F.col(vec).isNotNull() & ~F.coalesce(F.exists(
        vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))


# T7 (J7, W7, X36, O7): exact k nearest vectors per query by squared L2
def nearest(vectors: DataFrame, queries: DataFrame, k: int = P.TOP_K, id_col: str = "vec_id",
            vec_col: str = "embedding", qid: str = "query_id", qvec: str = "embedding", **blocks) -> DataFrame:
    """(query_id, rank, id, distance); fewer than k rows when the store is small
    (never padded).  At most (#queries x k) rows, written once so later
    lookups reuse them."""
    return materialize(nearest_plan(vectors, queries, k, id_col, vec_col, qid, qvec, **blocks))


def nearest_plan(vectors: DataFrame, queries: DataFrame, k: int = P.TOP_K, id_col: str = "vec_id",
                 vec_col: str = "embedding", qid: str = "query_id", qvec: str = "embedding",
                 vector_rows: int = VECTOR_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The lazy search plan behind ``nearest``.

    Vectors and queries are cut into blocks by hash, and each pair of blocks is
    one bounded group: a single scan of the vectors whatever the number of
    queries, and no query passes through the driver.  Vectors and queries
    that are null or not finite take no part.
    """
    store = vectors.where(finite(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    asks = materialize(queries.where(finite(qvec)).select(F.col(qid).alias("id"), F.col(qvec).alias("vec")))
    vector_blocks = max(1, -(-store.count() // vector_rows))
    query_blocks = max(1, -(-asks.count() // query_rows))
    block = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")             # noqa: E731
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))                     # noqa: E731
    cells = (store.select("*", block(vector_blocks).alias("vb"), every(query_blocks).alias("qb"),
                          F.lit(False).alias("asks"))
             .unionByName(asks.select("*", block(query_blocks).alias("qb"), every(vector_blocks).alias("vb"),
                                      F.lit(True).alias("asks"))))
    found = (cells.groupBy("vb", "qb").applyInPandas(_block_topk(k), "query_id long, id long, distance double")
             .withColumnRenamed("id", id_col))
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


# Ids -> stored texts; a hit whose text is missing stays, with a null text
def attach_texts(hits: DataFrame, texts: DataFrame, id_col: str = "vec_id", text: str = "text") -> DataFrame:
    return hits.join(texts.select(id_col, text), id_col, "left")


# A18 + T8 + T9: context per query in rank order, prompt, and route
def prompts(questions: DataFrame, hits_with_text: DataFrame, qid: str = "query_id",
            question: str = "question", text: str = "text", max_distance: float | None = None,
            template: str = P.RAG_PROMPT) -> DataFrame:
    h = hits_with_text
    if max_distance is not None:
        h = h.where(F.col("distance") <= max_distance)
    ctx = h.groupBy(qid).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda s: s[text]),
                     "\n").alias("context"))
    head, rest = template.split("{context}")
    mid, tail = rest.split("{query}")
    j = questions.join(ctx, qid, "left")
    n = F.coalesce(F.col("n_hits"), F.lit(0)).cast("long")
    return j.select(
        qid, question, n.alias("n_hits"),
        F.when(n > 0, F.lit("rag")).otherwise(F.lit("direct")).alias("route"),
        F.when(n > 0, F.concat(F.lit(head), F.col("context"), F.lit(mid), F.col(question), F.lit(tail)))
        .otherwise(F.col(question)).alias("prompt"))


# T6 (second form): vectors by key; a vector of another dimension is an error
def attach_vectors(chunks: DataFrame, vectors: DataFrame, on: Sequence[str], dim: int,
                   vec: str = "embedding") -> DataFrame:
    right = vectors.select(*on, F.when(F.col(vec).isNull() | (F.size(vec) == dim), F.col(vec)).otherwise(
        F.raise_error(F.lit(f"vector dimension differs from {dim}"))).alias(vec))
    return chunks.join(right, list(on), "left")


# T5 + K8 + U2: append chunks to a store keyed by chunk_id; texts already
# stored (same sha2) or repeated inside the batch are skipped, so re-ingest
# is idempotent.  ``keep`` names the columns stored with each chunk (its text,
# its vector); ``order_by`` is the key of a chunk within the batch.
def ingest_chunks(store: DataFrame | None, chunks: DataFrame, text: str = "chunk",
                  order_by: Sequence[str] = ("doc_id", "chunk_no"), keep: Sequence[str] = ()) -> DataFrame:
    order_by, keep = list(order_by), list(keep)
    h = chunks.select(*order_by, F.sha2(F.col(text), 256).alias("text_hash"))
    first = h.groupBy("text_hash").agg(F.min(F.struct(*order_by)).alias("_f")).select(
        "text_hash", *[F.col(f"_f.{c}").alias(c) for c in order_by])
    if store is not None:
        first = first.join(store.select("text_hash"), "text_hash", "left_anti")
        mark = F.coalesce(store.agg(F.max("chunk_id")).scalar(), F.lit(0).cast("long"))
    else:
        mark = F.lit(0).cast("long")
    cols = ["chunk_id", *order_by, "text_hash", *keep]
    new = numbering.number_rows(first, order_by, out="_k").withColumn("chunk_id", mark + F.col("_k"))
    if keep:                    # texts and vectors travel once, for the new chunks only
        new = new.join(chunks.select(*order_by, *keep), order_by)
    return new.select(*cols) if store is None else store.select(*cols).unionByName(new.select(*cols))
