"""Picking attachments out of a message table (subject word, file suffix,
newest message first, first attachment in list order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparkdesk.functions import patterns as P


def _suffix_in(c, suffixes: Sequence[str]):
    low = F.lower(c)
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | low.endswith(s.lower())
    return cond


# F7 + X1-X3: messages whose subject mentions the word, one row per
# attachment with an accepted suffix (any case), with its list position
def valid_attachments(messages: DataFrame, word: str = P.ATTACHMENT_WORD,
                      suffixes: Sequence[str] = P.ATTACHMENT_SUFFIXES,
                      keep: Sequence[str] = ("msg_id", "user_id", "subject", "received")) -> DataFrame:
    m = messages.where(F.coalesce(F.lower("subject").contains(word.lower()), F.lit(False))
                       & (F.size("attachments") > 0))
    e = m.select(*keep, F.posexplode("attachments").alias("pos", "_a"))
    e = e.select(*keep, F.col("pos").cast("long").alias("pos"), F.col("_a.file_name").alias("file_name"))
    # F8: which reader a landed file goes to
    reader = F.when(_suffix_in(F.col("file_name"), [".xlsx", ".xls"]), F.lit("excel")).otherwise(F.lit("csv"))
    return e.where(_suffix_in(F.col("file_name"), suffixes)).withColumn("reader", reader)


# S9 + O4 + O6: the single newest accepted attachment
def latest(valid: DataFrame) -> DataFrame:
    return valid.orderBy(F.desc("received"), F.asc("msg_id"), F.asc("pos")).limit(1)


# per-group form: newest accepted attachment per group, as an aggregate
def latest_per(valid: DataFrame, group: str = "user_id") -> DataFrame:
    others = [c for c in valid.columns if c != group]
    best = valid.groupBy(group).agg(F.max_by(F.struct(*others),
                                             F.struct(F.col("received"), -F.col("msg_id"), -F.col("pos"))).alias("_b"))
    return best.select(group, *[F.col(f"_b.{c}").alias(c) for c in others])
