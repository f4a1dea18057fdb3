"""Pieces that several operators share: words, the shared work folder, checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: ASCII space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 10_000


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """array<string> of the maximal runs without SPACE; empty text gives an empty array."""
    bare = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where the context has its checkpoints, or, in
    local mode only, a new temporary one."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = sc.getCheckpointDir()
        if not shared:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="sparrowset-")
            sc.setCheckpointDir(shared)
            shared = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors lose nothing, and later plans start there."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it was counted at no more than `rows`; otherwise df, which the join then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tie_numbers(df: DataFrame, id_col: str, same: Sequence[Column], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2 ... among the rows that are equal in `same` (which has the id in it).

    Ids are counted first, without reading other columns; rows whose id is neither null twice nor repeated have 0. The
    others are kept in the shared folder with the partition they were read in, and are numbered within it behind the
    counts of the partitions before: so no task gathers all rows of a key, were they a third of the table. Which of
    several rows that are equal in `same` but not elsewhere has which number follows the partitions.
    """
    taken = list(df.columns)
    again, key, part, base = (taken.append(c) or c for c in (fresh(c, taken) for c in ("tie_id", "tie_key", "tie_part", "tie_base")))
    ident = F.col(f"`{id_col}`")
    ids = checkpointed(df.groupBy(ident.alias(again)).agg(F.count("*").alias("n")).filter("n > 1").select(again))
    if ids.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    ids = small_or_shuffled(ids)
    hit = ident.eqNullSafe(F.col(again))
    once = df.join(ids, hit, "left_anti").withColumn(name, F.lit(0).cast("long"))
    many = checkpointed(df.withColumns({key: F.xxhash64(*same), part: F.spark_partition_id()}).join(ids, hit, "left_semi"))
    bases = many.groupBy(F.col(key).alias("k"), F.col(part).alias("p")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    bases = bases.select(F.col("k"), F.col("p"), F.coalesce(before, F.lit(0)).alias(base))
    place = F.row_number().over(Window.partitionBy(key, part).orderBy(key)) - 1
    numbered = many.withColumn(name, place).join(bases, (F.col(key) == F.col("k")) & (F.col(part) == F.col("p"))).withColumn(name, (F.col(name) + F.col(base)).cast("long"))
    return once.unionByName(numbered.select(*[f"`{c}`" for c in once.columns]))


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores added until no column has it (column names compare without case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name
