"""Table profiling: counts, missing cells, numeric columns, summaries.

``describe`` reproduces pandas ``DataFrame.describe()`` (count, mean, sample
std, min, 25/50/75 % with linear interpolation, max) as a long table.  The
quantiles are exact: ``exact_quantiles`` places the order statistics by running
counts over the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from sparkdesk.functions import patterns as P
from sparkdesk.operators import numbering
from sparkdesk.operators.joins import join_null_safe

DESCRIBE_PROBS = [0.25, 0.5, 0.75]


# Numeric columns (booleans are not numeric in Spark, as in pandas)
def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


# A4 + S3: missing indicator per cell: null, NaN, or a pandas missing token
def missing_flag(df: DataFrame, col: str, tokens: Sequence[str] | None = P.MISSING_TOKENS) -> Column:
    c, t = F.col(col), df.schema[col].dataType
    flag = c.isNull()
    if isinstance(t, (DoubleType, FloatType)):
        flag = flag | F.isnan(c)
    if tokens is not None and isinstance(t, StringType):
        flag = flag | c.isin(list(tokens))
    return flag.cast("long")


def missing_cells(df: DataFrame, tokens: Sequence[str] | None = P.MISSING_TOKENS) -> Column:
    total = F.lit(0).cast("long")
    for c in df.columns:
        total = total + missing_flag(df, c, tokens)
    return F.sum(total)


# A19 + P7 + A1 + A4: one profile row, one pass over the data
def profile(df: DataFrame, tokens: Sequence[str] | None = P.MISSING_TOKENS) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).alias("columns"),
                  F.coalesce(missing_cells(df, tokens), F.lit(0)).cast("long").alias("missing"),
                  F.lit(",".join(numeric_columns(df))).alias("numeric_columns"),
                  F.lit(",".join(df.columns)).alias("column_names"))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_m")
    ).select("_m.metric", "_m.v")


def exact_quantiles(long_df: DataFrame, probs: Sequence[float] = DESCRIBE_PROBS,
                    group: str = "metric", value: str = "v") -> DataFrame:
    """Exact linear-interpolated quantiles per group: (group, p, q).

    Nulls and NaN are skipped, as pandas does.  Equal values are counted
    first (with map-side combine), so a value that most rows share is one
    row; running counts over the distinct values then place every rank.
    """
    base = long_df.select(group, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = base.groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = numbering.running_sum(counts, "_n", "_v", "_upto", partition_by=group)
    total = placed.groupBy(group).agg(F.max("_upto").alias("_total"))
    # target ranks (0-based) below and above p*(N-1) for every group and p
    tg = total.select(group, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"), "_total")
    tg = tg.select(group, "p", (F.col("p") * (F.col("_total") - 1)).alias("_pos"))
    tg = tg.select(group, "p", "_pos", F.explode(F.array_distinct(F.array(
        F.floor("_pos").cast("long"), F.ceil("_pos").cast("long")))).alias("_r"))
    # a group has as many targets as probabilities, twice
    wanted = tg.groupBy(group).agg(F.collect_set(F.struct("p", "_pos", "_r")).alias("_t"))
    hits = join_null_safe(placed, wanted, [group], "inner").select(group, "_v", F.explode(F.filter(
        "_t", lambda t: (t["_r"] < F.col("_upto")) & (t["_r"] >= F.col("_upto") - F.col("_n")))).alias("_t"))
    vals = hits.select(group, "_t.*", F.col("_v").alias("_val"))
    return (vals.groupBy(group, "p").agg(
        F.first("_pos").alias("_pos"), F.min_by("_val", "_r").alias("_a"), F.max_by("_val", "_r").alias("_b"),
        F.min("_r").alias("_ra"))
        .select(group, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_ra"))).alias("q")))


def _pct_name(p: float) -> str:
    s = f"{p * 100:g}"
    return f"{s}%"


# Pandas describe() of numeric columns as (metric, stat, value)
def describe(df: DataFrame, cols: Sequence[str] | None = None, probs: Sequence[float] = DESCRIBE_PROBS) -> DataFrame:
    cols = list(cols) if cols else numeric_columns(df)
    long_df = _long(df, cols)
    # values are masked, not filtered: an all-null column still reports count 0
    v = F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.col("v"))
    agg = long_df.groupBy("metric").agg(
        F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    basic = agg.select("metric", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).alias("value"))
        for s in ["count", "mean", "std", "min", "max"]])).alias("_s")).select("metric", "_s.stat", "_s.value")
    names = F.create_map(*[x for p in probs for x in (F.lit(float(p)), F.lit(_pct_name(p)))])
    qs = exact_quantiles(long_df, probs).select(
        "metric", F.try_element_at(names, F.col("p")).alias("stat"), F.col("q").alias("value"))
    return basic.unionByName(qs)


# describe() of text columns: count, unique, top, freq (ties by value)
def describe_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols else string_columns(df)
    long_df = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("_m")
    ).select("_m.column", "_m.v").where(F.col("v").isNotNull())
    freq = long_df.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_f"))
    return freq.groupBy("column").agg(
        F.sum("_f").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct(-F.col("_f"), F.col("v"))).alias("top"),
        F.max("_f").alias("freq"))


STAT_ORDER = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


# T13 + A18 + X19: the describe() table as ordered text lines, then the
# analysis prompt.  The summary is a handful of rows (metrics x stats).
def summary_prompt(described: DataFrame, template: str = P.ANALYSIS_PROMPT) -> DataFrame:
    order = F.create_map(*[x for i, s in enumerate(STAT_ORDER) for x in (F.lit(s), F.lit(i))])
    lines = described.select(
        "metric", F.coalesce(F.try_element_at(order, F.col("stat")), F.lit(99)).alias("_o"),
        F.concat_ws(" ", "metric", "stat",
                    F.coalesce(F.format_string("%.6f", "value"), F.lit("NaN"))).alias("_line"))
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", "_o", "_line"))),
                                              lambda s: s["_line"]), "\n").alias("summary"))
    head, tail = template.split("{summary}")
    return text.select("summary", F.concat(F.lit(head), F.col("summary"), F.lit(tail)).alias("prompt"))


# A19 with the file side: rows, columns, missing cells, bytes on disk and an
# ingest status (S12) for a set of landed files, in one pass
def profile_files(df: DataFrame, tokens: Sequence[str] | None = P.MISSING_TOKENS) -> DataFrame:
    cols = [c for c in df.columns]
    sized = df.select(*cols, F.col("_metadata.file_path").alias("_path"),
                      F.col("_metadata.file_size").alias("_size"))
    per_file = sized.groupBy("_path").agg(F.first("_size").alias("_size"), F.count(F.lit(1)).alias("_rows"),
                                          F.sum(F.lit(0).cast("long") + sum(
                                              (missing_flag(df, c, tokens) for c in cols), F.lit(0).cast("long")))
                                          .alias("_missing"))
    return per_file.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("rows"),
        F.lit(len(cols)).alias("columns"),
        F.coalesce(F.sum("_missing"), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.sum("_size"), F.lit(0)).cast("long").alias("file_bytes"),
        F.count(F.lit(1)).alias("files"),
        F.when(F.count(F.lit(1)) == 0, F.lit("none found"))
        .when(F.coalesce(F.sum("_rows"), F.lit(0)) == 0, F.lit("empty")).otherwise(F.lit("ok")).alias("status"))
