"""Column helpers: small scalar building blocks, all built-in Spark expressions.

Nothing here runs Python per row; each helper returns a ``Column`` that stays
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from sparkdesk.functions import patterns as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python str.strip() (Unicode whitespace at both ends; trim() only drops blanks)
# in one pass from either end, however long the run of blanks
def py_strip(c) -> Column:
    return F.btrim(_c(c), F.lit(P.SPACE_CHARS))


# Python str.title(): capital after any non-letter, rest lower-case
def py_title(c) -> Column:
    runs = F.regexp_extract_all(_c(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                             F.lower(F.substring(r, 2, 1 << 30)))),
        "")


# First regex match or null.  The match is referenced once: a
# nullif(...) form would be expanded into two evaluations wherever the
# optimizer inlines it (e.g. a filter pushed below the projection).
def first_match(c, pattern: str, group: int = 0) -> Column:
    hit = F.array_remove(F.array(F.regexp_extract(_c(c), pattern, group)), F.lit(""))
    return F.get(hit, 0)


def all_matches(c, pattern: str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), 0)


def bounded_digits(c, spec: str) -> Column:
    """``\\b\\d{spec}\\b`` with Python's Unicode word boundary."""
    return first_match(c, P.bounded_digits_java(spec))


# Amount after the currency sign, commas dropped, as double
def money_amount(c, currency: str = P.CURRENCY) -> Column:
    raw = first_match(c, P.amount_pattern(currency), 1)
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


# Lenient number parse; Spark alone would also take '1d' or '1f'
def lenient_double(c) -> Column:
    s = F.trim(_c(c).cast("string"))
    ok = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | s.rlike(r"^[+-]?(?i)(inf|infinity|nan)$")
    return F.when(ok, s.try_cast("double"))


def lenient_long(c) -> Column:
    s = F.trim(_c(c).cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))


# Ordered-category position (1-based), non-members -> null
def category_ord(c, categories: Sequence[str]) -> Column:
    m = F.create_map(*[x for i, v in enumerate(categories) for x in (F.lit(v), F.lit(i + 1))])
    return F.try_element_at(m, _c(c)).cast("int")


def category_member(c, categories: Sequence[str]) -> Column:
    """The value itself when it is a category, else null (one reference)."""
    m = F.create_map(*[x for v in categories for x in (F.lit(v), F.lit(v))])
    return F.try_element_at(m, _c(c))


# Three-way change label, null change -> Normal; NaN never reaches here
def change_label(change) -> Column:
    ch = _c(change)
    return (F.when(ch > P.SPIKE_LIMIT, F.lit(P.SPIKE_LABEL))
            .when(ch < P.DROP_LIMIT, F.lit(P.DROP_LABEL))
            .otherwise(F.lit(P.NORMAL_LABEL)))


def pct_change_expr(cur, prev) -> Column:
    """W2 arithmetic: (cur/prev - 1) * 100; by zero gives +/-inf (by the sign of the zero,
    too, as in pandas), 0/0 null."""
    cur, prev = _c(cur), _c(prev)
    inf = F.lit(float("inf"))
    return (F.when(prev.isNull() | cur.isNull(), F.lit(None).cast("double"))
            .when(prev != 0, (cur / prev - 1.0) * 100.0)
            .when(cur != 0, F.when((cur > 0) != (prev.cast("double").cast("string") == "-0.0"), inf).otherwise(-inf))
            .otherwise(F.lit(None).cast("double")))


# Python's round(x, n) and f"{x:.nf}" round the exact binary value
# (round(0.15, 1) == 0.1); bround rounds the shortest decimal form (0.2).
# Java's DecimalFormat, behind format_number, also rounds the exact value.
def py_fixed(c, digits: int) -> Column:
    """f"{x:.{digits}f}" for finite x (no grouping separators)."""
    x = _c(c)
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def py_round(c, digits: int) -> Column:
    x = _c(c)
    special = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(special, x).otherwise(py_fixed(x, digits).try_cast("double"))


def named(column: str) -> Column:
    """The column of exactly this name, whatever marks it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """Hash of the row: the last sort key where others tie."""
    return F.xxhash64(*[named(f.name) for f in df.schema.fields if not isinstance(f.dataType, MapType)])
