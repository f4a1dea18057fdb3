"""Aggregation, distinct rows, and rows seen beside their neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.functions.ring import wrap_sum


def keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The groups themselves."""
    return df.select(*by).distinct()


def count(df: DataFrame, by: Sequence[str], name: str = "cnt", match: str | None = None) -> DataFrame:
    """Rows per group; with `match`, only those where it is 1 (what a left outer join matched)."""
    return df.groupBy(*by).agg((F.count("*") if match is None else F.count_if(F.col(match) == 1)).alias(name))


def minimum(df: DataFrame, by: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(F.min(column).alias(name or f"min_{column}"))


def maximum(df: DataFrame, by: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(F.max(column).alias(name or f"max_{column}"))


def min_and_max(df: DataFrame, by: Sequence[str], min_of: str, max_of: str | None = None, min_name: str | None = None, max_name: str | None = None) -> DataFrame:
    """Both in one aggregation."""
    max_of = max_of or min_of
    return df.groupBy(*by).agg(F.min(min_of).alias(min_name or f"min_{min_of}"), F.max(max_of).alias(max_name or f"max_{max_of}"))


def distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def total(df: DataFrame, value: str | Column, name: str = "s") -> DataFrame:
    """One row: the sum modulo 2^64, 0 for no rows."""
    return df.agg(wrap_sum(value).alias(name))


def total_count(df: DataFrame, name: str = "cnt") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def having_repeats(df: DataFrame, by: Sequence[str], give: Sequence[str]) -> DataFrame:
    """`give` of each group with more than one row."""
    return df.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").select(*give)


def histogram(df: DataFrame, by: Sequence[str], count_name: str = "c_count", dist_name: str = "custdist") -> DataFrame:
    """How many groups there are of each size."""
    return count(df, by, count_name).groupBy(count_name).agg(F.count("*").alias(dist_name))


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], give: Sequence[str] | None = None) -> DataFrame:
    """The first row of each group, by one aggregation with partial results: a hot key isn't sorted or gathered.
    Columns in `order` are ascending; make it total, else any of the first rows is taken."""
    give = list(give or df.columns)
    row = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*by).agg(F.min_by(F.struct(*give), row).alias("_row")).select("_row.*")


def next_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Each row with the value of `column` in the row after it, null for the last."""
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*by).orderBy(*order)))


def first_and_last(df: DataFrame, by: Sequence[str], column: str, first_when: Column, last_when: Column, first: str, last: str) -> DataFrame:
    """Per group the least value of the rows that meet first_when and the largest of those that meet last_when, in one
    scan and one aggregation; null where no row does."""
    return df.filter(first_when | last_when).groupBy(*by).agg(F.min(F.when(first_when, F.col(column))).alias(first), F.max(F.when(last_when, F.col(column))).alias(last))


def gaps_within(df: DataFrame, by: str, time: str, low_days: int, high_days: int) -> DataFrame:
    """Keys with two neighbouring times t, t' such that t + low_days <= t' <= t + high_days; 0 < low_days.

    Neighbours in one span of low_days are nearer than that, so only the first and the last time of each span count:
    rows are aggregated by (key, span), with partial results, before the spans of a key are set side by side. A hot key
    gives no more rows than there are spans.
    """
    if low_days < 1:
        raise ValueError("low_days must be at least 1")
    span = F.floor(F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")) / low_days)
    ends = df.filter(F.col(time).isNotNull()).groupBy(F.col(by), span.alias("_span")).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    after = F.lead("_first").over(Window.partitionBy(by).orderBy("_span"))
    days = lambda n: F.make_dt_interval(F.lit(n))
    seen = ends.withColumn("_next", after)
    return seen.filter((F.col("_next") >= F.col("_last") + days(low_days)) & (F.col("_next") <= F.col("_last") + days(high_days))).select(by).distinct()


def histogram_with_zeros(members: DataFrame, key: str, df: DataFrame, by: str, count_name: str = "c_count", dist_name: str = "custdist") -> DataFrame:
    """How many keys there are of each count, keys of `members` without a row in df counting 0 (a row even if there is
    no such key). df is read once; members meet its counts, not its rows. members: one row for each key."""
    counts = count(df, [by], "_n").select(F.col(by).alias("_by"), "_n")
    both = members.select(F.col(key).alias("_key")).join(counts, F.col("_key") == F.col("_by"), "full")
    sizes = both.groupBy(F.coalesce("_n", F.lit(0).cast("long")).alias(count_name)).agg(F.count("*").alias("_k"))
    none = df.sparkSession.range(1).select(F.lit(0).cast("long").alias(count_name), F.lit(0).cast("long").alias("_k"))
    return sizes.unionByName(none).groupBy(count_name).agg(F.sum("_k").alias(dist_name))
