"""CSV read with missing tokens and narrowest column types.

Missing tokens become null first.  Then one aggregate over all rows tells for
every column and type whether all remaining values fit; the answers are
conjunctions, so they combine map-side and the driver sees one row of flags.
The column gets the narrowest type that fits:

    null  <  boolean
    null  <  bigint  <  double
    null  <  date    <  timestamp_ntz
    anything else    <  string

``join_types`` is the join of two parts' types, so files typed one by one agree
with files typed together.  A column without any value is a string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkdesk.functions import patterns as P
from sparkdesk.functions.exprs import named
from sparkdesk.sources.files import normalize_missing, read_csv_strings

TYPES = ["boolean", "bigint", "double", "date", "timestamp_ntz"]
WIDER = {("bigint", "double"): "double", ("date", "timestamp_ntz"): "timestamp_ntz"}
# what a value of each type looks like, in both ASCII-only engines
LOOKS = {
    "boolean": r"^(true|false|True|False|TRUE|FALSE)$",
    "bigint": r"^[+-]?[0-9]{1,18}$",
    "double": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?$",
}


def fits(value: Column, kind: str) -> Column:
    """Whether a string can be read as ``kind``; null for null."""
    looks = value.rlike(LOOKS[kind])
    if kind in ("date", "timestamp_ntz"):          # the calendar decides, too
        looks = looks & value.try_cast(kind).isNotNull()
    return F.when(value.isNotNull(), looks)


def column_types(strings: DataFrame) -> dict[str, str]:
    """Narrowest type of every string column, from one pass over all rows."""
    flags = [F.coalesce(F.bool_and(fits(named(c), t)), F.lit(False)).alias(f"{i}_{t}")
             for i, c in enumerate(strings.columns) for t in TYPES]
    row = strings.agg(*flags).first() if flags else {}
    return {c: next((t for t in TYPES if row[f"{i}_{t}"]), "string") for i, c in enumerate(strings.columns)}


def join_types(a: str | None, b: str | None) -> str:
    """Narrowest type for the values of two parts; None stands for a part without values."""
    if a is None or b is None or a == b:
        return a or b or "string"
    return WIDER.get((a, b)) or WIDER.get((b, a)) or "string"


def typed(strings: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns cast to their types."""
    return strings.select(*[named(c).try_cast(types[c]).alias(c) for c in strings.columns])


def read_csv_typed(spark: SparkSession, paths: str | Sequence[str], tokens: Sequence[str] = P.MISSING_TOKENS,
                   multiline: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, missing tokens as null, every column of its narrowest type."""
    strings = normalize_missing(read_csv_strings(spark, paths, multiline=multiline, encoding=encoding), tokens)
    return typed(strings, column_types(strings))
