"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a document are hashed to 128 bits.  A window
found more than once anywhere keeps its first occurrence (smallest key, then
text hash, then line); the lines of every later occurrence are covered, and a
document loses the union of its covered lines.  A later occurrence that
overlaps the first one inside the same document covers only the lines beyond
it, so the first occurrence stays whole.

Plan: one pass writes the window hashes (48 bytes each, no text) to the shared
checkpoint folder; one aggregate with map-side combine finds repeated windows;
their join with the occurrences can be split by adaptive execution where one
passage holds a large share of the rows; covered lines are gathered per
document (bounded by its own lines) and joined back to the texts.

Defined results: null text stays null; texts of fewer than three lines have no
window and stay as they are; a text whose lines are all covered becomes empty;
repeated rows (same key and text) are one document and get the same result;
rows with a null key come first in order and are told apart by their text; an
empty table gives an empty result; extra columns pass through, whatever their
names (a column to add whose name is taken is an error).  Lines are cut at
``\\n`` and compared exactly; very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkdesk.llm.common import free_names
from sparkdesk.session import materialize

WINDOW = 3


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, pos, h1, h2)``: every window of every text, ``pos`` its first line from 0."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                        F.split(F.col(text_col), "\n", -1).alias("lines"))

    def window(i):
        a, b, c = (F.get("lines", i + k) for k in range(WINDOW))
        return F.struct(F.xxhash64(a, b, c).alias("h1"),
                        F.xxhash64(c, F.lit(WINDOW), b, a).alias("h2"))

    return (lines.where(F.size("lines") >= WINDOW)
            .select("id", "th", F.posexplode(F.transform(
                F.sequence(F.lit(0), F.size("lines") - WINDOW), window)).alias("pos", "h"))
            .select("id", "th", "pos", "h.h1", "h.h2"))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, gone)``: the covered line numbers of every document that has any."""
    found = materialize(occurrences(docs, id_col, text_col))
    place = F.struct("id", "th", "pos")
    repeated = (found.groupBy("h1", "h2")
                .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("h1", "h2", "first"))
    same_doc = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = (found.join(repeated, ["h1", "h2"])
             .where(~place.eqNullSafe(F.col("first")))
             .select("id", "th", F.col("pos").alias("until"), F.when(
                 same_doc, F.greatest(F.col("pos"), F.col("first.pos") + WINDOW))
                 .otherwise(F.col("pos")).alias("since"))
             .withColumn("until", F.col("until") + (WINDOW - 1)).where("since <= until"))
    return (later.groupBy("id", "th")
            .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("since", "until")))).alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lines_col: str | None = None, removed_col: str | None = None) -> DataFrame:
    """``docs`` with the covered lines cut from ``text_col``; optionally the number of
    lines before and of lines removed, as longs."""
    added = [c for c in (lines_col, removed_col) if c]
    if len({c.lower() for c in [*docs.columns, *added]}) < len(docs.columns) + len(added):
        raise ValueError(f"the columns to add are taken: {added}")
    hashed, key, gone_hash, gone_at, parts = free_names(docs, ["_th", "_id", "_gone_th", "_gone", "_lines"], added)
    gone = covered_lines(docs, id_col, text_col).toDF(key, gone_hash, gone_at)
    left = docs.withColumn(hashed, F.xxhash64(text_col))
    joined = left.join(gone, F.col(id_col).eqNullSafe(F.col(key))
                       & (F.col(hashed) == F.col(gone_hash)), "left")
    cut = joined.withColumn(parts, F.split(F.col(text_col), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_at))
    text = F.when(F.col(gone_at).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    extra = []
    if lines_col:
        extra.append(F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(parts)), F.lit(0))
                     .cast("long").alias(lines_col))
    if removed_col:
        extra.append(F.coalesce(F.when(F.col(gone_at).isNotNull(), F.size(gone_at)), F.lit(0))
                     .cast("long").alias(removed_col))
    return cut.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)


#: DuckDB twin over the table ``documents``: window texts in place of hashes.
ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3)),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp
      FROM w WINDOW o AS (PARTITION BY win ORDER BY doc_id, pos)),
c AS (SELECT DISTINCT doc_id, unnest(range(
        CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS line
      FROM f WHERE NOT (doc_id = fd AND pos = fp)),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS body FROM d),
k AS (SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.line) AS kept, count(*) AS n
      FROM l ANTI JOIN c ON l.doc_id = c.doc_id AND l.line = c.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       coalesce(len(d.ls), 0)::BIGINT AS n_lines,
       (coalesce(len(d.ls), 0) - coalesce(k.n, 0))::BIGINT AS n_removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
