"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source, the sums give each source's target and repetition rate, and every document is emitted
floor(rate) times plus one more time with probability rate - floor(rate), drawn from a hash of its id, text, number among
its equals and a seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed, fresh, small_or_shuffled, text_of, tie_numbers, words

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 20


def n_words(text_col: str = "text") -> Column:
    return F.size(words(text_of(text_col))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target, rate per source, from rows (source, size).

    Sources by code point, null last, get the weights in turn. Targets share 100% of all sizes by weight, but stop at
    max_repeats times the source's own size; the excess goes to the others by weight, again and again. The end of that
    rule is target = min(cap, level * weight) for one level, and sources reach their caps in the order of cap / weight:
    so prefix sums in that order find the level without a loop. Sources without words get target 0 and rate 0.
    The table has one row per source; its two orderings run over that table alone.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = total.withColumn("level", left / weight_left)
    # the first source in that order whose cap is above its level sets the level of all that follow
    open_level = F.first(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(F.col("open_level").isNull(), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("w"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    return level.withColumn("open_level", open_level).withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(ident: Column, text: Column, tie: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of "id:MD5 of the text:tie:seed"; a null id counts as empty."""
    name = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), F.md5(text), F.lit(":"), tie.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """df with five more columns: size, source_size, target, rate, copies (0 to max_repeats), and the names they got.

    Null text has no words; null sources are one source; an empty table stays empty. Each row has a draw of its own:
    rows with null or repeated ids are told apart by their texts, and rows with one id, text and source are numbered.
    The names get underscores where df has them already.
    The table of sources is broadcast if it was counted as small; else it is joined by shuffle, where Spark splits the
    partitions of hot sources.
    """
    names: dict[str, str] = {}
    for c in ("size", "source_size", "target", "rate", "copies"):
        names[c] = fresh(c, [*df.columns, *names.values()])
    key = fresh("mix_source", [*df.columns, *names.values()])
    tie = fresh("mix_tie", [*df.columns, *names.values(), key])
    ident, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    targets = checkpointed(source_targets(df.select(source.alias("source"), n_words(text_col).alias("size")), weights, max_repeats))
    targets = targets.select(F.col("source").alias(key), *[F.col(c).alias(names[c]) for c in ("source_size", "target", "rate")])
    rows = tie_numbers(df, id_col, [ident, text_of(text_col), source], tie)
    out = rows.withColumn(names["size"], n_words(text_col)).join(small_or_shuffled(targets), source.eqNullSafe(F.col(key))).drop(key)
    whole = F.floor(names["rate"])
    copies = whole + F.when(draw(ident, text_of(text_col), F.col(tie), seed) < F.col(names["rate"]) - whole, 1).otherwise(0)
    return out.withColumn(names["copies"], copies.cast("int")).drop(tie), names


def mix_rows(df: DataFrame, **params) -> DataFrame:
    """The mix itself: each row of df as often as mix_plan says, with df's columns; all cases as there."""
    planned, names = mix_plan(df, **params)
    taken = planned.filter(F.col(names["copies"]) > 0)
    copy = fresh("copy", planned.columns)
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(names["copies"])))).select(*[f"`{c}`" for c in df.columns])
