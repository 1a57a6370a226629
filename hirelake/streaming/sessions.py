"""Session JSON as a stream (S11, T4): files that arrive over time are numbered as one run over all of them would.

Each micro-batch of whole files is parsed and projected like a batch ingest. Its *ledger* -- rows per (session, file), and whether the file is an api
array -- is stored in the batch's own folder; ``seq`` starts behind the rows of all earlier ledgers, so arrival in the order of a sorted
session tree gives the numbers of one ``ingest`` run, and a replayed batch (its folders are overwritten) the same ones again. An api file
replaces the job files of its session that arrive with it or later.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.session import cut_lineage
from hirelake.sources.ingest import ingest, parse_files, without_replaced

LEDGER = "session string, source_file string, from_api boolean, n bigint"


def session_file_stream(spark: SparkSession, root: str, files_per_batch: int = 1_000) -> DataFrame:
    """``(path, value)``: whole files below ``root`` as they arrive."""
    return (spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
            .option("maxFilesPerTrigger", files_per_batch).text(root).select(F.col("_metadata.file_path").alias("path"), "value"))


def earlier_ledger(spark: SparkSession, base: str, batch_id: int) -> DataFrame:
    """The ledgers of all batches before ``batch_id``."""
    try:
        return spark.read.schema(f"{LEDGER}, batch bigint").parquet(os.path.join(base, "ledger")).where(F.col("batch") < batch_id)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":   # only the first batch finds no ledger
            raise
        return spark.createDataFrame([], f"{LEDGER}, batch bigint")


def fold_batch(base: str, then: Callable[[DataFrame, int], None] | None = None, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = parse_files):
    """foreachBatch function: the batch's postings, rejects and ledger below ``base``, in folders of its own. ``then`` gets the stored postings and the
    batch id. ``parse`` makes raw rows and rejects of a batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, rejects = parse(batch)
        rows = cut_lineage(rows)
        ledger = earlier_ledger(spark, base, batch_id)
        arrays = ledger.where("from_api").select("session").unionByName(rows.where("from_api").select("session"))
        rows = without_replaced(rows, arrays)
        counts = rows.groupBy("session", "source_file", "from_api").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(os.path.join(base, "ledger", f"batch={batch_id}"))
        ahead = ledger.agg(F.sum("n")).first()[0] or 0   # one number
        postings = ingest(rows, start=ahead + 1)
        at = os.path.join(base, "postings", f"batch={batch_id}")
        postings.write.mode("overwrite").parquet(at)
        rejects.write.mode("overwrite").parquet(os.path.join(base, "rejects", f"batch={batch_id}"))
        if then is not None:
            then(spark.read.parquet(at), batch_id)
    return run


def run_session_stream(files: DataFrame, base: str, then: Callable[[DataFrame, int], None] | None = None,
                       parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = parse_files) -> DataFrame:
    """Runs the stream over what is there (availableNow); returns all postings read so far."""
    query = (files.writeStream.foreachBatch(fold_batch(base, then, parse)).option("checkpointLocation", os.path.join(base, "checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return files.sparkSession.read.parquet(os.path.join(base, "postings"))
