"""Filters and grouped counts over a table whose files arrive over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowset.operators.filters import filter_and


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_step: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_step).parquet(folder)


def filtered(stream: DataFrame, columns: Sequence[str], ops: Sequence[str], values: Sequence) -> DataFrame:
    """The same conjunctive filter as on a table; it keeps no state."""
    return filter_and(stream, columns, ops, values)


def windowed_count(stream: DataFrame, time: str, window: str, by: Sequence[str], late: str, name: str = "cnt") -> DataFrame:
    """Rows per window of time and group; rows later than `late` are left out, so old windows' state goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias(name))
