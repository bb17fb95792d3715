"""Text assembly and clean-up over text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkdesk.functions import exprs as X
from sparkdesk.functions import patterns as P
from sparkdesk.session import spread

PAGE_BLOCK = 1024


def _join_sorted(key: str, val: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, val))),
                                    lambda s: s[val]), "")


# Pages concatenated in page order, no separator, null page -> "".
# Two levels: pages are first joined per (doc, page block), so a document
# with millions of pages is spread over many tasks before the last concat.
def assemble_pages(df: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text",
                   block: int = PAGE_BLOCK) -> DataFrame:
    pages = df.select(doc, page, F.coalesce(F.col(text), F.lit("")).alias("_t"),
                      F.floor(F.col(page) / block).alias("_blk"))
    parts = pages.groupBy(doc, "_blk").agg(_join_sorted(page, "_t").alias("_part"),
                                           F.count(F.lit(1)).alias("_n"))
    return parts.groupBy(doc).agg(_join_sorted("_blk", "_part").alias(text),
                                  F.sum("_n").alias("n_pages"))


# X5 + X37 + T15: stripped text, or null text plus a message when blank
def clean_transcripts(df: DataFrame, text: str = "text", keep=("doc_id",),
                      message: str = P.BLANK_TRANSCRIPT_MESSAGE) -> DataFrame:
    s = X.py_strip(text)
    blank = F.col(text).isNull() | (s == "")
    return spread(df).select(*keep, F.when(~blank, s).alias(text),
                     F.when(blank, F.lit(message)).alias("message"))
