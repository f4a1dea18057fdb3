"""Sorting, top-k, slices and union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.functions.ring import unsigned


def sort(df: DataFrame, columns: Sequence[str], ascending: Sequence[bool] | bool = True, as_unsigned: bool = False) -> DataFrame:
    """By the columns in turn, each in its direction; as_unsigned: longs in the order of their unsigned values."""
    ups = [ascending] * len(columns) if isinstance(ascending, bool) else ascending
    by = [unsigned(c) if as_unsigned else F.col(c) for c in columns]
    return df.orderBy(*[c.asc() if up else c.desc() for c, up in zip(by, ups, strict=True)])


def top_k(df: DataFrame, columns: Sequence[str], ascending: Sequence[bool] | bool, k: int) -> DataFrame:
    """The first k rows in that order: each task keeps k, and only those meet."""
    return sort(df, columns, ascending).limit(k)


#: Slices that end at up to so many rows come from a sorted head; farther ones are found by ranks.
HEAD_ROWS = 100_000


def slice_rows(df: DataFrame, columns: Sequence[str], offset: int, n: int, head_rows: int = HEAD_ROWS) -> DataFrame:
    """n rows from `offset` on, in the order of the columns (null first); rows that are equal there are in any order.

    A far slice never gathers the rows before it: rows are dealt out by ranges, the driver gets one count for each
    partition, and only the partitions that the slice touches are numbered. Rows keep their order in the result.
    """
    if offset + n <= head_rows:
        return sort(df, columns).offset(offset).limit(n)
    part, rank = "_slice_part", "_slice_rank"
    by = [F.col(c).asc() for c in columns]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, so that both jobs deal out alike
    dealt = df.repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id())
    counts = {r[part]: r["n"] for r in dealt.groupBy(part).agg(F.count("*").alias("n")).collect()}
    bases, before = [], 0
    for p in sorted(counts):
        if before < offset + n and before + counts[p] > offset:
            bases.append((p, before))
        before += counts[p]
    if not bases:
        return df.limit(0)
    base = F.element_at(F.create_map(*[F.lit(x) for pair in bases for x in pair]), F.col(part))
    ranked = dealt.filter(F.col(part).isin([p for p, _ in bases])).withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*by)) - 1 + base)
    return ranked.filter((F.col(rank) >= offset) & (F.col(rank) < offset + n)).orderBy(rank).drop(part, rank)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, columns by position, under the first one's names."""
    for df in others:
        first = first.unionAll(df.toDF(*first.columns))
    return first
