"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``.  ``run`` writes each
stage's result as Parquet to the shared folder and reads it again for the next one.

1. toxicity: documents that the factorization machine gives 0.5 or more go; labels teach it only
   outside its held-out fold.
2. near_dedup: of each component of near-duplicates the document with the smallest doc_id stays.
3. decontamination: documents that hold 75 % or more of a benchmark item's five-word shingles go.
4. mixing: every source is repeated or thinned to its water-filling target, in whole documents.
5. sharding: doc_id, size, shard and slot of every row that is left, a row for each repetition.

Empty tables pass through as empty results; documents with null or empty texts are clean, unlike any
other, and cost the mix nothing, so they are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import fold, settle
from factloom.llm.decontamination import remove_contaminated
from factloom.llm.mixing import repeat_rows
from factloom.llm.near_dedup import remove_near_duplicates
from factloom.llm.sharding import shard_documents
from factloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learns=fold("doc_id") != 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, shards=16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The machine's arithmetic and hash orders have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
