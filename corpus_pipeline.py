"""The corpus pipeline: documents through quality rules, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result as Parquet to the shared work folder and gives it to the next stage as read from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowset.llm import exact_dedup, jaccard, mixing, packing, quality
from sparrowset.llm.common import remove, work_dir
from sparrowset.llm.tokenizing import SMALL_MEMO


#: Bits in which two fingerprints of the near-duplicate stage may differ; op10's query has its own.
NEAR_BITS = jaccard.DISTANCE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the thresholds of their stratum reject go; null texts have no words and go."""
    judged, names = quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter(F.col(names["kept"])).select(*[f"`{c}`" for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty), the document with the largest doc_id stays, a null id only where all are."""
    return exact_dedup.dedup_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the
    smallest doc_id stays: one row of each group, also where ids are null or repeated, and every row without such a
    neighbour.

    SimHash, over five words and with NEAR_BITS, links first, and its links are checked on the shingles. The pairs that
    need more bits than fingerprints can be searched for (see README) are then searched exactly.
    """
    return jaccard.one_of_each(docs, distance=NEAR_BITS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks; rows with null or repeated ids are drawn apart."""
    return mixing.mix_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document, repeats included, lies in the training sequences."""
    return packing.pack(docs, memo=SMALL_MEMO)


#: All stages take empty tables, further columns of any name, and texts of any length.
STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", source_mix),
    ("packing", best_fit_packing),
]

#: SQL cannot state the near-duplicate fingerprints and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    read = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(out), out
    return docs
