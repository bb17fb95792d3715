"""Equi-joins whose null keys bypass the shuffle.

A key with a null never equals anything, but the rows still travel through
the join exchange and all hash to the same partition; if a third of the rows
have a null name that partition holds a third of the data.  Here those rows
skip the join and are added back with the result they are known to have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _all_set(keys):
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def join_skipping_null_keys(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    ok = _all_set(on)
    r = right.where(ok)
    if how in ("left_semi", "left_anti"):
        # only key existence matters: a key repeated a billion times on the
        # right collapses map-side to one row before the join shuffle
        r = r.select(*on).dropDuplicates()
    matched = left.where(ok).join(r, on, how)
    if how in ("inner", "left_semi"):
        return matched
    rest = left.where(~ok)
    return matched.unionByName(rest, allowMissingColumns=(how == "left"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null (a null group is a group, as
    in ``Window.partitionBy``); the right-hand key columns are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
