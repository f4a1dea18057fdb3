"""Equi-joins on one pair of columns, semi-joins, and the bucket hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As many as the bucket hash has by default; callers with more data ask for more.
BUCKETS = 32


def bucket_of(key: str | Column, buckets: int = BUCKETS) -> Column:
    """(31 * key + 17) % buckets, with the sign of the number divided."""
    c = F.col(key) if isinstance(key, str) else key
    return ((c.cast("long") * 31 + 17) % buckets).cast("long")


def to_buckets(df: DataFrame, key: str, buckets: int = BUCKETS, tag: str = "tag") -> DataFrame:
    """df dealt out by the bucket of its key, which becomes a column: rows of a bucket are in one of the session's shuffle
    partitions. To count or sum by bucket, use bucket_of and group, which combines before it shuffles."""
    return df.withColumn(tag, bucket_of(key, buckets)).repartition(tag)


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, strategy: str = "auto") -> DataFrame:
    """Rows with equal keys; nulls match nothing. Columns of both sides must have different names (see prefixed()).

    auto: Catalyst and adaptive execution pick, by the sizes they know or measure, and split hot keys. hash, merge: that
    kind of shuffled join. nested_loop: compare all pairs, which is only for small inputs.
    """
    hints = {"auto": None, "hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}
    if hints[strategy]:
        right = right.hint(hints[strategy])
    return left.join(right, F.col(left_on) == F.col(right_on), "inner")


def join_chain(first: DataFrame, *others: tuple[DataFrame, str, str], strategy: str = "auto") -> DataFrame:
    """Left-deep joins with each (table, column of what came before, its own column)."""
    for df, left_on, right_on in others:
        first = join(first, df, left_on, right_on, strategy)
    return first


def left_outer(left: DataFrame, right: DataFrame, left_on: str, right_on: str, match: str = "matched") -> DataFrame:
    """All left rows; where the right side has no row its numbers are 0 (other types null) and `match` is 0, else 1."""
    numbers = {c for c, kind in right.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")}
    out = left.join(right.withColumn(match, F.lit(1)), F.col(left_on) == F.col(right_on), "left")
    return out.select(*[f"`{c}`" for c in left.columns], *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in numbers else F.col(f"`{c}`") for c in right.columns], F.coalesce(match, F.lit(0)).alias(match))


def semi_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Left rows whose key is among the right keys (IN, EXISTS)."""
    return left.join(_keys(right, right_on), F.col(left_on) == F.col("_key"), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Left rows whose key is not among the right keys; null keys stay (NOT EXISTS)."""
    return left.join(_keys(right, right_on), F.col(left_on) == F.col("_key"), "left_anti")


def in_flag(left: DataFrame, right: DataFrame, left_on: str, right_on: str, flag: str = "flag") -> DataFrame:
    """Every left row once, with 1 where its key is among the right keys, else 0."""
    keys = _keys(right, right_on).distinct().withColumn(flag, F.lit(1))
    return left.join(keys, F.col(left_on) == F.col("_key"), "left").drop("_key").withColumn(flag, F.coalesce(flag, F.lit(0)))


def _keys(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.select(F.col(on).alias("_key"))
