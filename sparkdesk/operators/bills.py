"""Bill intelligence: fields from bill text, month/year, change and anomaly
labels, KPIs, chart tables and insight messages.

All of it is built-in expressions, aggregates and the bucketed ordered
operators of ``numbering``; no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sparkdesk.functions import exprs as X
from sparkdesk.functions import patterns as P
from sparkdesk.operators import numbering
from sparkdesk.session import materialize, spread

FIELDS = ["email", "phone", "plan", "account_id", "statement_date",
          "statement_period", "amount", "due_date"]


# T1 (X8-X14, X35): one row of fields per bill text; a missing field is null
def extract_fields(df: DataFrame, text: str = "text", keep: Sequence[str] = ("file",),
                   plan_prefix: str = P.PLAN_PREFIX, currency: str = P.CURRENCY) -> DataFrame:
    df = spread(df)
    t = F.col(text)
    dates = X.all_matches(t, P.DATE)
    runs = X.all_matches(t, P.DIGIT_RUN_JAVA)      # one scan serves phone and account id
    return df.select(
        *keep,
        X.first_match(t, P.EMAIL_JAVA).alias("email"),
        F.get(F.filter(runs, lambda r: F.length(r) == 10), 0).alias("phone"),
        X.first_match(t, P.plan_java(plan_prefix)).alias("plan"),
        F.get(F.filter(runs, lambda r: F.length(r) >= 12), 0).alias("account_id"),
        F.get(dates, 0).alias("statement_date"),
        X.first_match(t, P.PERIOD).alias("statement_period"),
        X.money_amount(t, currency).alias("amount"),
        F.when(F.size(dates) >= 2, F.element_at(dates, -1)).alias("due_date"))


# first row per file name in input order (aggregate, not a window, so a
# file name repeated a billion times still combines map-side)
def first_per_key(df: DataFrame, key: str = "file", order_by: str = "pos") -> DataFrame:
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order_by)).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


# X15 + X31: month of period end (Jan..Dec, else null) and year at the end
def with_month_year(df: DataFrame, period: str = "statement_period") -> DataFrame:
    m = F.regexp_extract(F.col(period), P.MONTH_OF_PERIOD, 1)     # '' when absent
    return (df.withColumn("month_ord", X.category_ord(m, P.MONTHS))
            .withColumn("month", X.category_member(m, P.MONTHS))
            .withColumn("year", X.first_match(period, P.YEAR_AT_END_JAVA, 1)))


# W2/W4 + X30: percent change in the given order (forward fill by default),
# then Spike / Drop / Normal
def with_change(df: DataFrame, value: str = "amount", order_by: Sequence[str] | str = "pos",
                partition_by: Sequence[str] | str = (), fill: str = "pad",
                out: str = "pct_change", label: str = "anomaly", number: str | None = None) -> DataFrame:
    prev = numbering.previous_values(df, value, order_by, partition_by, fill, number)
    return (prev.withColumn(out, X.pct_change_expr("_cur", "_prev"))
            .withColumn(label, X.change_label(F.col(out)))
            .drop("_cur", "_prev"))


# Fields -> amount, month, year, change and label in file order
def enrich(fields: DataFrame, order_by: Sequence[str] | str = "pos",
           partition_by: Sequence[str] | str = (), fill: str = "pad") -> DataFrame:
    return with_change(with_month_year(fields), "amount", order_by, partition_by, fill)


# month multiselect; default = every non-null month (null never passes)
def month_filter(df: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    if months is None:
        return df.where(F.col("month").isNotNull())
    return df.where(F.col("month").isin(list(months)))


# KPI row; sum of nothing is 0 as in pandas
def kpis(df: DataFrame, currency: str = P.CURRENCY) -> DataFrame:
    k = df.agg(F.count(F.lit(1)).alias("bills"),
               F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_spend"),
               F.avg("amount").alias("avg_bill"), F.max("amount").alias("max_bill"))
    # money sums are exact to the cent; rounding to cents hides summation order
    return k.select("bills", F.round("total_spend", 2).alias("total_spend"),
                    F.round("avg_bill", 6).alias("avg_bill"), F.round("max_bill", 2).alias("max_bill"))


# Share of spend per month (pie)
def month_share(df: DataFrame) -> DataFrame:
    g = df.groupBy("month", "month_ord").agg(F.sum("amount").alias("amount"))
    total = F.sum("amount").over(Window.partitionBy())      # of a row per month
    return g.select("month", "month_ord", F.round("amount", 2).alias("amount"),
                    F.round(F.try_divide(F.col("amount"), total), 6).alias("share"))


# Spend per (month, anomaly): stacked bars
def month_anomaly(df: DataFrame) -> DataFrame:
    return df.groupBy("month", "month_ord", "anomaly").agg(
        F.round(F.sum("amount"), 2).alias("amount"), F.count(F.lit(1)).alias("bills"))


def _fill(template: str, **cols):
    """concat() of a ``{name}`` template with columns in place of the names."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[cols[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def _fmt1(c):
    return F.when(F.col(c) == float("inf"), F.lit("inf")).when(
        F.col(c) == float("-inf"), F.lit("-inf")).otherwise(X.py_fixed(c, 1))


# T3 (A13, A15, W3, X18, O2): insight messages over month-ordered rows.
# seq: 0 trend (or "not enough data"), row number for spikes/drops,
# n+1 highest, n+2 lowest.  With ``partition_by`` (e.g. the account) every
# group gets its own report; the ordered steps stay skew-safe (numbering.py).
def insights(df: DataFrame, by_year: bool = False, currency: str = P.CURRENCY,
             partition_by: Sequence[str] | str = ()) -> DataFrame:
    groups = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    order = ["year", "month_ord", "pos"] if by_year else ["month_ord", "year", "pos"]
    # several passes follow over the numbered rows with their changes, written once
    df = df.select(*groups, "pos", "amount", "month", "month_ord", "year")
    rows = materialize(with_change(df, "amount", order, groups, "pad", number="seq"))
    okey = F.col("seq")
    has = F.col("amount").isNotNull()
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count("amount").alias("_vals"),
            F.min_by("amount", F.when(has, okey)).alias("first"),
            F.max_by("amount", F.when(has, okey)).alias("last"),
            F.max_by(F.struct("amount", "month"), F.when(has, F.struct(F.col("amount"), -okey))).alias("hi"),
            F.min_by(F.struct("amount", "month"), F.when(has, F.struct(F.col("amount"), okey))).alias("lo")]
    stats = rows.groupBy(*groups).agg(*aggs) if groups else rows.agg(*aggs)
    enough = F.col("_vals") >= 2
    not_enough = stats.where(~enough).select(*groups, F.lit(0).cast("long").alias("seq"),
                                             F.lit(P.NO_DATA_INSIGHT).alias("message"))
    trend = stats.where(enough & (F.col("last") != F.col("first"))).select(
        *groups, F.lit(0).cast("long").alias("seq"),
        F.when(F.col("last") > F.col("first"), F.lit(P.TREND_UP))
        .otherwise(F.lit(P.TREND_DOWN)).alias("message"))
    # with fewer than two amounts every padded change is null or 0 %, so no
    # spike or drop can appear: no need to filter those groups here
    moves = rows.where((F.col("pct_change") > P.SPIKE_LIMIT) | (F.col("pct_change") < P.DROP_LIMIT)).select(
        *groups, "seq",
        F.when(F.col("pct_change") > P.SPIKE_LIMIT,
               _fill(P.SPIKE_MSG, change=_fmt1("pct_change"), month=F.col("month")))
        .otherwise(_fill(P.DROP_MSG, change=_fmt1("pct_change"), month=F.col("month")))
        .alias("message"))
    ext = stats.where(enough).select(*groups, F.explode(F.array(
        F.struct((F.col("_rows") + 1).cast("long").alias("seq"),
                 _fill(P.HIGHEST_MSG, currency=F.lit(currency), amount=F.format_number("hi.amount", 2),
                       month=F.col("hi.month")).alias("message")),
        F.struct((F.col("_rows") + 2).cast("long").alias("seq"),
                 _fill(P.LOWEST_MSG, currency=F.lit(currency), amount=F.format_number("lo.amount", 2),
                       month=F.col("lo.month")).alias("message")))).alias("_m")).select(*groups, "_m.*")
    return not_enough.unionByName(trend).unionByName(moves).unionByName(ext)
