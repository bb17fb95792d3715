"""Read side of a contacts table: KPIs, frequencies, growth, search, facets,
labels and pages.  Every function is DataFrame -> DataFrame.
"""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.operators import numbering


# A1-A3: total rows, distinct non-null cities, latest id (0 when empty)
def contact_kpis(df: DataFrame, key: str = "id", facet: str = "city") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_contacts"),
                  F.count_distinct(facet).alias("cities"),
                  F.coalesce(F.max(key), F.lit(0)).cast("long").alias("latest_id"))


# A5 + O8: value counts, nulls dropped, count descending (ties by value)
def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.desc(out), F.asc(col)))


# Share of total over the aggregated rows (one per key), which are read once
def share_of_total(df: DataFrame, key: str, value: str, out: str = "share") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy()).cast("double")
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total))   # 0 total -> null


# Rows per calendar day; unparseable or null times dropped
def growth_by_day(df: DataFrame, ts: str = "created_at", out: str = "contacts") -> DataFrame:
    t = F.col(ts)
    if dict(df.dtypes)[ts] == "string":
        t = F.try_to_timestamp(t)
    return (df.select(F.to_date(t).alias(ts)).where(F.col(ts).isNotNull())
            .groupBy(ts).agg(F.count(F.lit(1)).alias(out)).orderBy(ts))


# letter case and classes as in Python's str patterns, not ASCII only
REGEX_FLAGS = "(?iuU)"


def _check_regex(spark, pattern: str) -> None:
    """Compile the pattern where it will run, before any job starts."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(REGEX_FLAGS + pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"bad search pattern {pattern!r}: {e}") from None


# case-insensitive regex (or literal) search; empty = all rows; null names drop
def search(df: DataFrame, text: str | None, col: str = "name", literal: bool = False) -> DataFrame:
    if not text:
        return df
    c = F.col(col)
    if literal:
        cond = F.lower(c).contains(text.lower())
    else:
        _check_regex(df.sparkSession, text)
        cond = c.rlike(REGEX_FLAGS + text)
    return df.where(F.coalesce(cond, F.lit(False)))


# equality facet with an "All" bypass
def facet(df: DataFrame, col: str, value: str | None, all_value: str = "All") -> DataFrame:
    if value is None or value == all_value:
        return df
    return df.where(F.col(col) == value)


# A14 + U4: "All" then the sorted distinct values, with their display order
def facet_options(df: DataFrame, col: str, all_value: str = "All") -> DataFrame:
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).alias("option")).distinct()
    vals = numbering.number_rows(vals, ["option"], out="ord")
    head = df.sparkSession.range(1).select(F.lit(all_value).alias("option"), F.lit(0).cast("long").alias("ord"))
    return head.unionByName(vals)


# A14, second form: the distinct values in the order they were first seen, by the smallest
# position of each value (an aggregate with map-side combine)
def first_seen(df: DataFrame, col: str, position: str, out: str = "ord") -> DataFrame:
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("option")).agg(F.min(position).alias("_seen"))
    return numbering.number_rows(first, ["_seen", "option"], out=out).select("option", out)


# required fields present and non-empty; returns (accepted, rejected)
def require_fields(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    ok = fields_present(cols)
    return df.where(ok), df.where(~ok)


def fields_present(cols: list[str]) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return ok


# P8: "id : name" option label (null name -> null label, as string '+')
def option_label(df: DataFrame, key: str = "id", col: str = "name", sep: str = " : ",
                 out: str = "label") -> DataFrame:
    return df.withColumn(out, F.concat(F.col(key).cast("string"), F.lit(sep), F.col(col)))


# P8 f-string form: a null name prints as "None"
def option_label_fstring(df: DataFrame, key: str = "id", col: str = "name", sep: str = " - ",
                         out: str = "label") -> DataFrame:
    return df.withColumn(out, F.concat(F.col(key).cast("string"), F.lit(sep),
                                       F.coalesce(F.col(col), F.lit("None"))))


# P9 + X4: id parsed back from the label's first ":"-piece
def label_id(label_col: str = "label", sep: str = ":"):
    head = F.split(F.col(label_col), re.escape(sep)).getItem(0)
    return F.trim(head).try_cast("long")


# W1 + O1: serial number in key order, as the first column
def numbered(df: DataFrame, order_by: list[str] | str = "id", out: str = "s_no") -> DataFrame:
    out_df = numbering.number_rows(df, order_by, out=out)
    return out_df.select(out, *[c for c in df.columns])


# One page (1-based) of the rows in key order
def page(df: DataFrame, page_number: int, page_size: int, order_by: list[str] | str = "id",
         out: str = "s_no") -> DataFrame:
    if page_size <= 0 or page_number <= 0:
        raise ValueError("page_number and page_size must be positive")
    start = (page_number - 1) * page_size
    return numbering.slice_rows(df, order_by, start + 1, start + page_size, out=out)


# Page count per size; original rule max(1, n // size + 1) (an exact multiple
# gives an extra empty page), exact = ceiling
def page_counts(df: DataFrame, sizes: list[int]) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    s = F.explode(F.array(*[F.lit(int(x)) for x in sizes])).alias("page_size")
    n = n.select("rows", s)
    return n.select("rows", "page_size",
                    F.greatest(F.lit(1), F.floor(F.col("rows") / F.col("page_size")) + 1).cast("long").alias("page_count"),
                    F.greatest(F.lit(1), F.ceil(F.col("rows") / F.col("page_size"))).cast("long").alias("page_count_exact"))


# First n rows in order
def preview(df: DataFrame, order_by: list[str] | str, n: int = 5) -> DataFrame:
    return df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(n)
