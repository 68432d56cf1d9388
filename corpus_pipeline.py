"""A training corpus from raw documents: filtered, deduplicated, mixed and packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents.  ``run`` writes each stage's result as Parquet to the shared folder
that ``spark.checkpoint.dir`` names and reads it as the next one's input, so a lost executor costs
no more than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodgelake.llm import minhash, mixing, packing, quality, repeats
from lodgelake.llm.common import ship, table
from lodgelake.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near enough to their language's histograms; null and empty texts go."""
    ship(spark)
    return quality.kept_documents(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts are told apart by row, so an id with two texts loses neither."""
    ship(spark)
    return minhash.deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat a 50-byte string of a document with a smaller id; empty texts stay."""
    ship(spark)
    return repeats.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a document taken more than once is repeated rows."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences; every token of every row in exactly one piece."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has no tokenizer and no seeded hash of this kind; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents that the stages keep, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
