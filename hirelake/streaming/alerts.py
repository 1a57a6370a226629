"""Saved-search alerts (T3): each micro-batch of new postings is matched against saved searches.

A table of searches goes through its predicate index (``hirelake.operators.searches``). A few searches by name (one ``Criteria``
each) are configuration: one projection tests each of them and explodes the ids of those that match, so a batch is read
once and inactive criteria never enter the plan. Matches are written per batch (overwrite of the batch's own folder, so a replayed batch does not duplicate alerts).
"""

from __future__ import annotations

import os
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import searches as table_form
from hirelake.operators.filters import Criteria, predicates


def match_searches(postings: DataFrame, searches: dict[str, Criteria] | DataFrame, as_of: datetime) -> DataFrame:
    """``(search_id, seq, id, title, company, match_score)``: a row per posting and saved search that it matches."""
    if isinstance(searches, DataFrame):
        return table_form.match_searches(postings, searches, as_of)
    hits = []
    for search_id, criteria in searches.items():
        keep = reduce(lambda a, b: a & b, [p for _, _, p in predicates(postings, criteria, as_of)], F.lit(True))
        # F9 is all or nothing: what is kept meets every active criterion
        hits.append(F.when(keep, F.struct(F.lit(search_id).alias("search_id"), F.lit(100).alias("match_score"))))
    found = (F.array_compact(F.array(*hits)) if hits
             else F.array().cast("array<struct<search_id:string,match_score:int>>"))
    return (postings.select("seq", "id", "title", "company", F.explode(found).alias("hit"))
            .select("hit.search_id", "seq", "id", "title", "company", "hit.match_score"))


def fold_batch(out_path: str, searches: dict[str, Criteria] | DataFrame, as_of: datetime):
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            match_searches(batch, searches, as_of).write.mode("overwrite").parquet(
                os.path.join(out_path, f"batch={batch_id}"))
        finally:
            batch.unpersist()
    return run


def run_alert_stream(postings_stream: DataFrame, searches: dict[str, Criteria] | DataFrame, as_of: datetime,
                     base: str) -> DataFrame:
    out, ckpt = os.path.join(base, "alerts"), os.path.join(base, "checkpoint")
    q = (postings_stream.writeStream.foreachBatch(fold_batch(out, searches, as_of))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return postings_stream.sparkSession.read.parquet(out).drop("batch")
