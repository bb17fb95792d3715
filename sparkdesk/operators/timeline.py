"""Office-holder timelines from statement tables.

The graph query (person -> statement -> office, start qualifier, optional end
qualifier, English label) becomes equi-joins over edge tables keyed by
statement; the tenure clean-up becomes column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sparkdesk.functions import exprs as X
from sparkdesk.operators.joins import join_skipping_null_keys


def _ts(run_ts) -> Column:
    if run_ts is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return run_ts if isinstance(run_ts, Column) else F.lit(run_ts).cast("timestamp_ntz")


# T10 (F12, X1, X2, X4, X5, X6): question -> (role, country) or nulls
def parse_question(df: DataFrame, text: str = "question") -> DataFrame:
    t = F.lower(F.col(text))
    role = (F.when(t.contains("prime minister"), F.lit("Prime Minister"))
            .when(t.contains("president"), F.lit("President")))
    ok = role.isNotNull() & t.contains("of")
    country = X.py_title(X.py_strip(F.element_at(F.split(t, "of"), -1)))
    return (df.withColumn("role", F.when(ok, role))
            .withColumn("country", F.when(ok, country))
            .withColumn("search_term", F.concat(F.col("role"), F.lit(" of "), F.col("country"))))


# S11 + J9: first search hit per term from an office dimension (qid, label, rank)
def lookup_office(parsed: DataFrame, offices: DataFrame, term: str = "search_term",
                  out: str = "office_qid") -> DataFrame:
    first = (offices.groupBy(F.lower("label").alias("_term"))
             .agg(F.min_by("qid", F.struct("rank", "qid")).alias(out)))
    q = parsed.withColumn("_term", F.lower(F.col(term)))
    return join_skipping_null_keys(q, first, ["_term"], "left").drop("_term")


# T11 (J2, J3, J4): holders of an office (all offices when None)
def office_holders(statements: DataFrame, starts: DataFrame, ends: DataFrame,
                   labels: DataFrame, office: str | None = None, lang: str = "en") -> DataFrame:
    st = statements if office is None else statements.where(F.col("office") == office)
    j = (st.join(starts.select("stmt", F.col("value").alias("start_value")), "stmt")
         .join(ends.select("stmt", F.col("value").alias("end_value")), "stmt", "left"))
    lab = labels.where(F.col("lang") == lang).select(F.col("qid").alias("person"), "label")
    j = j.join(lab, "person", "left")
    return j.select("office", "stmt", "person",
                    F.coalesce(F.col("label"), F.concat(F.lit("Q"), F.col("person").cast("string"))).alias("leader"),
                    "start_value", "end_value")


def _parse_iso(c: Column) -> Column:
    # X7 + X21 + X22: drop '+', lenient parse, UTC instant -> zone-less
    return F.replace(c, F.lit("+"), F.lit("")).try_cast("timestamp").cast("timestamp_ntz")


# Tenure table: parse, default end = run time, drop bad starts, years
def tenure(holders: DataFrame, run_ts=None, sort: bool = True) -> DataFrame:
    t = holders.select("office", "stmt", "leader",
                       _parse_iso(F.col("start_value")).alias("start"),
                       F.coalesce(_parse_iso(F.col("end_value")), _ts(run_ts)).alias("end"))
    t = t.where(F.col("start").isNotNull())
    t = t.select("*", F.year("start").alias("start_year"), F.year("end").alias("end_year"))
    t = t.select("*", F.concat(F.col("start_year").cast("string"), F.lit("-"),
                               F.col("end_year").cast("string")).alias("tenure_label"),
                 (F.col("end_year") - F.col("start_year")).alias("years_served"))
    return t.orderBy("office", "start_year", "start", "leader", "stmt") if sort else t


# Years served per leader (terms stack)
def years_per_leader(tenure_df: DataFrame) -> DataFrame:
    return tenure_df.groupBy("office", "leader").agg(
        F.sum("years_served").cast("long").alias("years_served"),
        F.count(F.lit(1)).alias("terms"))


BINDINGS_SCHEMA = StructType([StructField("results", StructType([StructField("bindings", ArrayType(
    StructType([StructField(n, StructType([StructField("value", StringType())]))
                for n in ["personLabel", "start", "end"]])))]))])


# S10 + X34 + X26: SPARQL JSON results -> rows; a missing end is the run time
def flatten_bindings(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ("event_id",),
                     run_ts=None) -> DataFrame:
    parsed = df.select(*keep, F.from_json(F.col(body), BINDINGS_SCHEMA).alias("_j"))
    rows = parsed.select(*keep, F.posexplode("_j.results.bindings").alias("pos", "_b"))
    now = F.date_format(_ts(run_ts), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(*keep, F.col("pos").cast("long").alias("pos"),
                       F.col("_b.personLabel.value").alias("person"),
                       F.col("_b.start.value").alias("start"),
                       F.coalesce(F.col("_b.end.value"), now).alias("end"))
