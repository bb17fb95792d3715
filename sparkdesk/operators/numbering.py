"""Ordered numbering, running sums and previous-row values without a one-partition window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task, and a group that holds a third of the rows does the same within its
group.  Here, at every size, the rows are range-partitioned by group and sort
key, sorted inside the partitions and written once to the shared checkpoint
folder with ``_mid`` (partition number and place in it).  What a partition
needs from the ones before it - a row count, a running sum, the last value -
is one small row per partition, and only for the groups that a partition
boundary cuts, of which there are fewer than partitions.

Sort keys that are not unique are spread by a hash of the row, and equal rows by
their place in the input, so equal keys do not meet in one partition;
their order among themselves is that hash's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sparkdesk.functions.exprs import row_hash
from sparkdesk.operators import pages
from sparkdesk.operators.joins import join_null_safe
from sparkdesk.session import materialize


def _names(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _ordered(df: DataFrame, groups: list[str], order_by: list[str]) -> DataFrame:
    """``df`` written in order with ``_mid`` (ascending in that order) and ``_part``."""
    keys = [*groups, *order_by, "_tie", "_salt"]
    rows = df.withColumn("_tie", row_hash(df)).withColumn("_salt", F.monotonically_increasing_id())
    return materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_salt")
                       .withColumn("_mid", F.monotonically_increasing_id())
                       .withColumn("_part", F.shiftright("_mid", 33)))


def _cut_groups(rows: DataFrame, groups: list[str], *aggs) -> DataFrame:
    """One row per partition and group, of the groups that lie in several partitions."""
    per = rows.groupBy(*groups, "_part").agg(*aggs)
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups)) if groups else F.lit(2)
    return per.withColumn("_parts", n).where("_parts > 1").drop("_parts")


def _with_carry(rows: DataFrame, carry: DataFrame, groups: list[str]) -> DataFrame:
    """Join what earlier partitions leave to each row; the carry has two rows for a partition
    at most (its first and its last group), so it is sent to every task."""
    return join_null_safe(rows, F.broadcast(carry), [*groups, "_part"], "left")


def _before(groups: list[str]):
    w = Window.partitionBy(*groups) if groups else Window.partitionBy()
    return w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, value: str, order_by: Sequence[str] | str, out: str,
                partition_by: Sequence[str] | str = ()) -> DataFrame:
    """Add ``out``: the sum of ``value`` (a long) up to and with each row, in order."""
    order_by, groups = _names(order_by), _names(partition_by)
    rows = _ordered(df, groups, order_by)
    cut = _cut_groups(rows, groups, F.sum(value).alias("_s"))
    carry = cut.select(*groups, "_part", F.coalesce(F.sum("_s").over(_before(groups)), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*groups, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (_with_carry(rows, carry, groups)
            .withColumn(out, (F.sum(value).over(inner) + F.coalesce("_off", F.lit(0))).cast("long"))
            .select(*df.columns, out))


def number_rows(df: DataFrame, order_by: Sequence[str] | str, out: str = "row_no",
                partition_by: Sequence[str] | str = ()) -> DataFrame:
    """1-based row number in ascending ``order_by`` (per group if given).

    Give a unique tie-break in ``order_by`` for a total order.
    """
    order_by, groups = _names(order_by), _names(partition_by)
    return _numbered(_ordered(df, groups, order_by), groups, out).select(*df.columns, out)


def _numbered(rows: DataFrame, groups: list[str], out: str) -> DataFrame:
    counts = (F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    cut = _cut_groups(rows, groups, *counts)
    carry = cut.select(*groups, "_part", (F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)))
                       .alias("_off"), "_first")
    joined = _with_carry(rows, carry, groups)
    if not groups:              # the place in the partition is in _mid: no window needed
        return joined.withColumn(out, (F.col("_mid") - F.col("_first") + F.col("_off") + 1).cast("long")).drop(
            "_off", "_first")
    inner = Window.partitionBy(*groups, "_part").orderBy("_mid")
    return joined.withColumn(out, (F.row_number().over(inner) + F.coalesce("_off", F.lit(0))).cast("long")).drop(
        "_off", "_first")


def previous_values(df: DataFrame, value: str, order_by: Sequence[str] | str,
                    partition_by: Sequence[str] | str = (), fill: str = "pad",
                    number: str | None = None) -> DataFrame:
    """Add ``_cur`` and ``_prev`` for a change computation in row order.

    ``fill='pad'`` forward-fills nulls first (pandas ``pct_change`` default),
    so ``_cur``/``_prev`` are the padded current and previous values;
    ``fill='none'`` uses the raw value and the raw previous row.  ``number``
    adds the row number too, from the same written rows.
    """
    if fill not in ("pad", "none"):
        raise ValueError("fill must be 'pad' or 'none'")
    order_by, groups = _names(order_by), _names(partition_by)
    v = F.col(value)
    rows = _ordered(df, groups, order_by)
    if number:
        rows = _numbered(rows, groups, number)
    inner = Window.partitionBy(*groups, "_part").orderBy("_mid")
    by_part = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("_part")
    if fill == "none":
        # a partition's first row looks at the row before, the last of an earlier partition
        cut = _cut_groups(rows, groups, F.max_by(F.struct(v.alias("v")), "_mid").alias("_last"))
        carry = cut.select(*groups, "_part", F.lag("_last").over(by_part)["v"].alias("_carry"))
        out = _with_carry(rows, carry, groups).withColumn("_cur", v).withColumn(
            "_prev", F.when(F.row_number().over(inner) == 1, F.col("_carry")).otherwise(F.lag(v).over(inner)))
    else:
        # the last value that is not null (max_by skips null orderings), of the nearest
        # earlier partition that has one
        cut = _cut_groups(rows, groups, F.max_by(v, F.when(v.isNotNull(), F.col("_mid"))).alias("_last"))
        carry = cut.select(*groups, "_part", F.last("_last", ignorenulls=True).over(_before(groups)).alias("_carry"))
        upto = inner.rowsBetween(Window.unboundedPreceding, 0)
        out = _with_carry(rows, carry, groups).withColumn(
            "_cur", F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col("_carry")))
        out = out.withColumn("_prev", F.coalesce(F.lag("_cur").over(inner), F.col("_carry")))
    return out.select(*df.columns, *([number] if number else []), "_cur", "_prev")


def slice_rows(df: DataFrame, order_by: Sequence[str] | str, lo: int, hi: int,
               out: str = "row_no") -> DataFrame:
    """Rows at 1-based positions ``lo..hi`` (inclusive) in ``order_by``: a stored order
    (``pages.store``) of which the parts that hold them are read.  For many pages of one
    table keep the store."""
    return pages.store(df, order_by).rows(max(lo, 1), hi, out)
