"""Ordered chat transcripts per conversation.

Per-conversation facts (first turn, last turn) are aggregates joined back,
not windows, so one enormous conversation combines map-side and the join
is split by AQE skew handling instead of sorting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkdesk.operators import numbering
from sparkdesk.operators.joins import join_null_safe


# T14 + F10: transcript with the leading system message hidden.
# hide="first_system" hides the first turn only when it is a system message;
# hide="first" hides the first turn whatever its role (positional rule).
def transcript(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               hide: str = "first_system") -> DataFrame:
    if hide not in ("first_system", "first", "none"):
        raise ValueError("hide must be first_system, first or none")
    if hide == "none":
        return df
    first = df.groupBy(conv).agg(F.min(turn).alias("_first"))
    j = join_null_safe(df, first, [conv], "inner")
    hidden = F.col(turn) == F.col("_first")
    if hide == "first_system":
        hidden = hidden & (F.col(role) == "system")
    return j.where(~F.coalesce(hidden, F.lit(False))).drop("_first")


# Append messages after the last turn of each conversation, in order
def append_messages(log: DataFrame, new: DataFrame, order_by: str = "src_turn",
                    conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    last = log.groupBy(conv).agg(F.max(turn).alias("_last"))
    numbered = numbering.number_rows(new, [order_by], partition_by=[conv], out="_k")
    added = join_null_safe(numbered, last, [conv], "left").select(
        conv, (F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_k")).cast("long").alias(turn),
        *[c for c in log.columns if c not in (conv, turn)])
    return log.unionByName(added)
