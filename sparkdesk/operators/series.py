"""Measurement tables (first column is the x axis): KPIs, alerts, slices,
series, wide-to-long, single-column repair, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sparkdesk.functions import exprs as X
from sparkdesk.functions import patterns as P
from sparkdesk.operators import numbering


# A9 + P11 + X29: rounded averages, only for columns that exist
def kpis(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    aggs = []
    if "heart_rate" in cols:
        aggs.append(X.py_round(F.avg("heart_rate"), 1).alias("avg_heart_rate"))
    if "steps" in cols:
        aggs.append(F.avg("steps").cast("long").alias("avg_steps"))   # int(): truncation
    if "sleep_hours" in cols:
        aggs.append(X.py_round(F.avg("sleep_hours"), 1).alias("avg_sleep"))
    if not aggs:
        return df.sparkSession.range(0).select(F.lit(None).alias("none"))
    return df.agg(*aggs)


RULE_SCHEMA = StructType([StructField("metric", StringType()), StructField("op", StringType()),
                          StructField("limit", DoubleType()), StructField("message", StringType())])


# A10: strict threshold rules on column averages -> one row per firing rule
def alerts(df: DataFrame, rules: Sequence[tuple] = P.HEALTH_ALERTS) -> DataFrame:
    live = [r for r in rules if r[0] in df.columns]           # P11
    spark = df.sparkSession
    if not live:
        return spark.createDataFrame([], RULE_SCHEMA).select("metric", F.lit(None).cast("double").alias("average"),
                                                             "limit", "message")
    metrics = sorted({r[0] for r in live})
    avgs = df.agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    long_ = avgs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("average"))
                                            for m in metrics])).alias("_a")).select("_a.*")
    # the rule table is a fixed literal of a few rows
    rule_df = F.broadcast(spark.createDataFrame([tuple(r[:2]) + (float(r[2]), r[3]) for r in live], RULE_SCHEMA))
    j = long_.join(rule_df, "metric")
    fire = (((F.col("op") == ">") & (F.col("average") > F.col("limit")))
            | ((F.col("op") == "<") & (F.col("average") < F.col("limit"))))
    return j.where(fire).select("metric", F.round("average", 6).alias("average"), "limit", "message")


# inclusive positional slice [start, end] (0-based) in x order
def position_slice(df: DataFrame, start: int, end: int, order_by: Sequence[str] | str | None = None,
                   out: str = "pos") -> DataFrame:
    order_by = order_by or df.columns[0]
    s = numbering.slice_rows(df, order_by, start + 1, end + 1, out="_rn")
    return s.select((F.col("_rn") - 1).alias(out), *df.columns)


# One metric against the x axis (first column)
def metric_series(df: DataFrame, metric: str, x: str | None = None) -> DataFrame:
    x = x or df.columns[0]
    return df.select(x, metric).orderBy(x)


# P5: wide -> long for several metrics, values as double; nulls kept
def to_long(df: DataFrame, metrics: Sequence[str], x: str | None = None) -> DataFrame:
    x = x or df.columns[0]
    wide = df.select(x, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot([x], list(metrics), "variable", "value")


# P6 + X20: a one-column comma-joined table split into typed named columns;
# a wrong field count gives a row with only ``error`` set
def repair_single_column(df: DataFrame, line: str, names: Sequence[str] = P.HEALTH_COLUMNS,
                         types: Sequence[str] = ("date", "double", "long", "double", "long")) -> DataFrame:
    parts = F.split(F.col(line), ",")
    ok = F.size(parts) == len(names)
    parse = {"double": X.lenient_double, "long": X.lenient_long}

    def typed(i, t):
        raw = parts.getItem(i)
        return parse[t](raw) if t in parse else F.trim(raw).try_cast(t)
    cols = [F.when(ok, typed(i, t)).alias(n) for i, (n, t) in enumerate(zip(names, types))]
    err = F.when(~ok, F.concat(F.lit(f"expected {len(names)} fields, got "), F.size(parts).cast("string")))
    return df.select(*cols, err.alias("error"))


def join_single_column(df: DataFrame, out: str = "line") -> DataFrame:
    """The broken-CSV shape: every row as one comma-joined string (width kept)."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
                     .alias(out))
