"""Incremental consolidation (T4): keep-first dedup over postings that arrive in
micro-batches, equal to one full run when arrival order is ``seq`` order.

State = urls and fuzzy keys of postings kept by earlier batches, read back from
the decided output (one folder per batch in the checkpoint folder). Per batch: rows whose url or key is already kept are
duplicates (a semi-join, no shuffle of the state beyond the join keys); the rest
go through the keep-first rounds of ``hirelake.operators.keepfirst``; the keys
of newly kept rows are appended to the state.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.plans import left_join_nonnull
from hirelake.operators.keepfirst import DUPLICATE, EXACT_URL, FUZZY_MATCH, UNIQUE, keep_first_status, with_keys


def _kept_state(spark, out_path: str, before_batch: int) -> DataFrame | None:
    """Urls and keys of postings kept by earlier batches (read from the decided output)."""
    try:
        prior = spark.read.parquet(out_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":   # only the first batch finds nothing decided yet
            raise
        return None
    kept = prior.where((F.col("batch") < before_batch) & (F.col("status") == UNIQUE))
    return (kept.select(F.lit("url").alias("kind"), F.col("url_key").alias("key")).where(F.col("key").isNotNull())
            .unionByName(kept.select(F.lit("key").alias("kind"), F.col("fuzzy_key").alias("key"))
                         .where(F.col("key").isNotNull())))


def decide_batch(batch: DataFrame, kept_state: DataFrame | None) -> DataFrame:
    """Decides one batch of keyed postings ``(seq, url_key, fuzzy_key)`` against kept state
    ``(kind, key)``; returns ``(seq, status, duplicate_reason, url_key, fuzzy_key)``."""
    rows = batch.select("seq", "url_key", "fuzzy_key")
    if kept_state is not None:
        ku = kept_state.where(F.col("kind") == "url").select(F.col("key").alias("url_key"), F.lit(True).alias("_su"))
        kk = kept_state.where(F.col("kind") == "key").select(F.col("key").alias("fuzzy_key"), F.lit(True).alias("_sk"))
        rows = left_join_nonnull(left_join_nonnull(rows, ku, "url_key"), kk, "fuzzy_key")
    else:
        rows = rows.withColumn("_su", F.lit(None).cast("boolean")).withColumn("_sk", F.lit(None).cast("boolean"))
    pre = rows.where(F.col("_su").isNotNull() | F.col("_sk").isNotNull())
    rest = rows.where(F.col("_su").isNull() & F.col("_sk").isNull()).select("seq", "url_key", "fuzzy_key")
    status, _ = keep_first_status(rest)
    kept_url = (status.where((F.col("state") == UNIQUE) & F.col("url_key").isNotNull())
                .select("url_key", F.col("seq").alias("_kseq")))
    decided = (left_join_nonnull(status, kept_url, "url_key")
               .select("seq", "url_key", "fuzzy_key", F.col("state").alias("status"),
                       F.when(F.col("state") == UNIQUE, F.lit(None).cast("string"))
                       .when(F.col("_kseq") < F.col("seq"), F.lit(EXACT_URL)).otherwise(F.lit(FUZZY_MATCH))
                       .alias("duplicate_reason")))
    # a pre-decided row is an exact-url duplicate if its url was kept earlier, in an
    # earlier batch or by a lower seq of this one
    pre_d = left_join_nonnull(pre, kept_url, "url_key").select(
        "seq", "url_key", "fuzzy_key", F.lit(DUPLICATE).alias("status"),
        F.when(F.col("_su").isNotNull() | (F.col("_kseq") < F.col("seq")), F.lit(EXACT_URL))
        .otherwise(F.lit(FUZZY_MATCH)).alias("duplicate_reason"))
    return decided.unionByName(pre_d)


def fold_batch(out_path: str):
    """foreachBatch function; each batch overwrites its own ``batch=<id>`` folder, so a
    replayed batch (at-least-once delivery) does not duplicate rows."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        decided = decide_batch(with_keys(batch), _kept_state(spark, out_path, batch_id))
        decided.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))
    return run


def run_consolidation_stream(postings_stream: DataFrame, base: str) -> DataFrame:
    """Runs the stream to completion (availableNow); returns the decided rows."""
    out, ckpt = os.path.join(base, "decided"), os.path.join(base, "checkpoint")
    q = (postings_stream.writeStream.foreachBatch(fold_batch(out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return postings_stream.sparkSession.read.parquet(out)
