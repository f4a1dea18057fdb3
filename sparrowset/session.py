"""A Spark session with the settings this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Fixed settings; sizes follow the cluster and stay Spark's or the caller's.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(app: str = "sparrowset", buckets: int | None = None, **conf: str) -> SparkSession:
    """buckets: the number of shuffle partitions. conf: further settings, dots written as underscores."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("_", "."): v for k, v in conf.items()})
    if buckets:
        builder = builder.config("spark.sql.shuffle.partitions", str(buckets))
    return builder.getOrCreate()
