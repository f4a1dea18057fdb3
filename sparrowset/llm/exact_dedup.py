"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. locally: each task combines its equal texts before anything is shuffled (partial aggregation);
2. salted: rows meet by (digest, salt, text), so that a text with a third of all rows is dealt to `salts` tasks;
3. globally: at most `salts` winners of a text meet by (digest, text).

The digest only steers rows to partitions and to their group's answer. Every stage groups by the whole text beside it,
so two texts with one digest are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed, text_of

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _salted(df: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    """id, t, digest, salt of each row. The salt follows the row's id, so a rerun deals rows out alike."""
    t = text_of(text_col)
    return df.select(F.col(id_col).alias("id"), t.alias("t"), digest(t).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"))


def dedup_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept.

    Null text equals empty text. keep_id is the largest id of the equal texts (null only where all their ids are null).
    Of rows that share that id and text, one is kept. An empty table gives no rows; other columns are not read.

    Texts are shuffled twice (salted, global); the answer then goes back along the same two steps with digests only.
    Where one digest stands for several texts, the row's answer is found by its text instead.
    """
    rows = _salted(df, id_col, text_col, salts, digest)
    winners = rows.groupBy("digest", "salt", "t").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    groups = winners.groupBy("digest", "t").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    # collect_list would gather all texts of a digest; first() and a count do not
    by_digest = checkpointed(groups.groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")))

    # the answer of a digest, copied to its salts: a row then needs (digest, salt), whose share of a hot group is 1 / salts
    single = by_digest.filter("texts = 1").drop("texts")
    used = rows.groupBy("digest", "salt").agg(F.lit(1).alias("_")).drop("_")
    found = rows.select("id", "digest", "salt").join(used.join(single, "digest"), ["digest", "salt"])

    shared = by_digest.filter("texts > 1").select("digest")
    if not shared.isEmpty():
        own = groups.join(shared, "digest", "left_semi").withColumnRenamed("digest", "d")
        found = found.unionByName(rows.join(own.withColumnRenamed("t", "u"), (F.col("digest") == F.col("d")) & (F.col("t") == F.col("u"))).select("digest", "salt", "id", "keep_id", "group_size"))
    first = F.row_number().over(Window.partitionBy("digest", "salt", "keep_id", "id").orderBy("group_size"))
    return found.select(
        "id",
        "digest",
        "keep_id",
        "group_size",
        ((F.col("id").eqNullSafe(F.col("keep_id"))) & (first == 1)).alias("kept"),
    )


def dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """The kept rows with all their columns, one per text; nulls, ties and empty tables as in dedup_groups.

    Rows with the same largest id are told apart by a hash of their other columns, so a rerun keeps the same one.
    The columns ride along with each stage's winner; no join brings them back. Columns of any name are allowed.
    """
    names = df.columns
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    t = text_of(text_col)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col], F.col(f"`{text_col}`").isNull().alias("no_text"))
    order = F.struct(F.col(id_col).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("h"))
    rows = df.select(t.alias("t"), digest(t).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"), order.alias("o"), row.alias("r"))
    winners = rows.groupBy("digest", "salt", "t").agg(F.max_by("r", "o").alias("r"), F.max("o").alias("o"))
    kept = winners.groupBy("digest", "t").agg(F.max_by("r", "o").alias("r"))
    return kept.select(*[F.when(F.col("r.no_text"), F.lit(None)).otherwise(F.col("t")).cast(df.schema[c].dataType).alias(c) if c == text_col else F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])
