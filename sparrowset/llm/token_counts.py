"""Token counts: an exact histogram of encoded lengths, and suffix sums over it that answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed
from sparrowset.llm.tokenizing import default_tokenizer, encoder, groups

#: Lengths are summed in blocks of this many, then the blocks: no window gathers the whole histogram in one task.
BLOCK = 1024


def encoded_lengths(df: DataFrame, text_col: str = "text", tokenizer: str | None = None, end_ids: int = 1, added_as_text: bool = False) -> DataFrame:
    """length: the number of ids of each row's whole text, plus end_ids. Null text has none of its own; repeated rows
    count each; an empty table gives no rows; other columns aren't read."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa

        enc = encoder(path, added_as_text)
        for batch in batches:
            for _, texts in groups(batch.column(0), 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 + end_ids for x in enc.ids(texts)], pa.int64())], ["length"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "length long")


def length_table(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs: length, n_docs, n_tokens, docs_from (documents of at least this length),
    tokens_from (their tokens), rank_from (documents shorter than this), and truncated: all tokens left if every
    document is cut to this length. Null lengths are left out; an empty table gives no rows.

    Documents meet in one aggregation by length. The suffix sums then run by blocks of lengths; the blocks themselves
    number the longest document's length / BLOCK.
    """
    hist = checkpointed(lengths.filter("length is not null").groupBy("length").agg(F.count("*").alias("n_docs"))).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    beyond, every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d_beyond"), F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t_beyond"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    here = Window.partitionBy("block").orderBy(F.col("length").desc())
    tokens = F.col("n_docs") * F.col("length")
    out = hist.join(blocks, "block").select("length", "n_docs", tokens.alias("n_tokens"), (F.sum("n_docs").over(here) + F.col("d_beyond")).alias("docs_from"), (F.sum(tokens).over(here) + F.col("t_beyond")).alias("tokens_from"), "d_all", "t_all")
    return out.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", (F.col("d_all") - F.col("docs_from")).alias("rank_from"), (F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """total: tokens left if every document is cut to `limit`, for any limit; 0 for an empty table."""
    return table.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("total"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """length: the smallest length with at least the share q of documents at or below it; null for an empty table."""
    enough = F.col("rank_from") + F.col("n_docs") >= F.lit(q) * (F.col("rank_from") + F.col("docs_from"))
    return table.filter(enough).agg(F.min("length").alias("length"))
