"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import decontaminate, mixing, quality, sharding, simhash
from hirelake.session import checkpoint_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.3 or more, the threshold of ``op3``."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, quality.train(docs, labels), threshold=0.3).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (3-word shingles, at most 2 bits): that with the smallest doc_id."""
    return simhash.one_of_each(docs, shingle_words=3, max_distance=2).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: the words of 10-word windows go, and documents that are mostly such words."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    return decontaminate.remove_contamination(docs, bench, n=10).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights: a document as often as its source's target takes it, at most twice."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 40 and slot."""
    return sharding.shard(docs, shards=40, keep=COLUMNS)


STAGES = [("quality classifier", quality_stage), ("simhash near-dedup", simhash_stage),
          ("benchmark decontamination", decontamination_stage), ("mixing to target weights", mixing_stage),
          ("sharding", sharding_stage)]

#: SQL cannot express the classifier, the fingerprints or the packing; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*[F.col(c) for c in COLUMNS])
    base = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
