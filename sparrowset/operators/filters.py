"""Projection, predicates and validity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowset.functions.ring import reconstruct_bool

COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
}
#: What SQL and the Python API call validity when it is carried instead of applied.
VALID = "_valid"


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist; df itself if the list is empty or none exists."""
    named = [f"`{c}`" for c in columns if c in df.columns]
    return df.select(*named) if named else df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def compare(column: str | Column, op: str, value) -> Column:
    """column op value, with value a constant or a Column."""
    if op not in COMPARE:
        raise ValueError(f"Unknown comparison: {op}")
    return COMPARE[op](F.col(column) if isinstance(column, str) else column, value)


def condition(columns: Sequence[str], ops: Sequence[str], values: Sequence) -> Column:
    """The AND of all comparisons; true for none."""
    return reduce(lambda a, b: a & b, [compare(c, o, v) for c, o, v in zip(columns, ops, values, strict=True)], F.lit(True))


def filter_and(df: DataFrame, columns: Sequence[str], ops: Sequence[str], values: Sequence, keep_invalid: bool = False) -> DataFrame:
    """Rows that meet all comparisons. keep_invalid: all rows stay, and VALID says which ones count, together with
    what it said before; null comparisons don't count."""
    test = condition(columns, ops, values)
    if not keep_invalid:
        return compact(df).filter(test) if VALID in df.columns else df.filter(test)
    before = F.col(VALID) if VALID in df.columns else F.lit(True)
    return df.withColumn(VALID, before & F.coalesce(test, F.lit(False)))


def filter_shared(df: DataFrame, columns: Sequence[str], ops: Sequence[str], shares: Sequence[tuple[int, int]]) -> DataFrame:
    """filter_and with constants that come as two XOR shares each. They are folded into one literal before the scan, so
    the comparison is pushed down like any other."""
    return filter_and(df, columns, ops, [reconstruct_bool(F.lit(a), F.lit(b)) for a, b in shares])


def between(df: DataFrame, column: str, low, high, closed: bool = False) -> DataFrame:
    """low <= column < high, or <= high if closed."""
    return df.filter(compare(column, ">=", low) & compare(column, "<=" if closed else "<", high))


def compact(df: DataFrame) -> DataFrame:
    """The valid rows, without the mark."""
    return df.filter(VALID).drop(VALID) if VALID in df.columns else df
