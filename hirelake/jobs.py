"""The reference's entry points as Spark jobs: consolidate, deduplicate, filter, track.

Each job reads its input, runs the operators and writes its outputs; nothing
but small report rows reaches the driver.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators import dedup, filters, keepfirst, tracker
from hirelake.operators.index import index_entries
from hirelake.sinks import writers
from hirelake.sources.ingest import flattened, ingest, read_sessions, session_files, session_stats


def consolidate(spark: SparkSession, sessions_root: str, out: str) -> DataFrame:
    """Entry 1: session folders -> keep-first master, duplicates, CSV, stats, index, rejects."""
    raw, rejects = read_sessions(spark, sessions_root)
    postings = ingest(raw).persist()
    decided = keepfirst.keep_first(postings).persist()
    unique = decided.where(F.col("status") == keepfirst.UNIQUE)
    dups = decided.where(F.col("status") == keepfirst.DUPLICATE)
    writers.write_master(unique, f"{out}/master")
    writers.write_duplicates(dups.select("seq", "id", "url", "title", "company", "location", "session",
                                         "duplicate_reason", "fuzzy_key", F.to_json("raw").alias("raw")), f"{out}/duplicates")
    writers.write_csv(unique, f"{out}/master_csv")
    files = session_files(spark, sessions_root)
    writers.write_stats(keepfirst.consolidation_stats(decided), session_stats(raw, files.select("session"), files), f"{out}/stats")
    writers.write_index(index_entries(postings), f"{out}/index")
    writers.write_rejects(rejects, f"{out}/rejects")
    return postings


def deduplicate(postings: DataFrame, out: str, fuzzy: bool = True, threshold: int = dedup.MERGE_THRESHOLD) -> str:
    """Entry 2: three-stage entity resolution, merge, review queue, report. Postings that still carry their
    ``raw`` record are resolved on the flattened record."""
    if "raw" in postings.columns:
        postings = flattened(postings).drop("raw", "extraction_metadata").persist()
    edges = dedup.detect_duplicates(postings, fuzzy=fuzzy).persist()
    merged = dedup.merge_duplicates(postings, edges, threshold)
    writers.write_dedup_outputs(merged["unique"].drop("raw"), edges, merged["review"], out, merged["values"])
    report = writers.render_dedup_report(dedup.dedup_summary(postings, merged), dedup.strategy_stats(postings, merged),
                                         dedup.quality_improvement(merged), dedup.review_reasons(merged["review"]))
    postings.sparkSession.createDataFrame([(report,)], "report string").coalesce(1).write.mode("overwrite") \
        .text(f"{out}/report")
    return report


def filter_postings(postings: DataFrame, criteria: dict, out: str, as_of: datetime | None = None,
                    filter_id: str | None = None, source: str | None = None) -> DataFrame:
    """Entry 3: criteria filter, breakdown report (with ``criteria`` and ``source``) and top matches."""
    as_of = as_of or datetime.now()
    filter_id = filter_id or as_of.strftime("filter_%Y%m%d_%H%M%S")
    c = filters.Criteria.from_dict(criteria)
    flagged = postings.persist()
    matched = filters.apply_filters(flagged, c, as_of)
    writers.write_filter_outputs(matched, filters.cascade_breakdown(flagged, c, as_of),
                                 filters.filter_summary(flagged, c, as_of), filters.top_matches(matched), out, filter_id, criteria, source, as_of)
    return matched


def track(events: DataFrame, out: str) -> DataFrame:
    """Entry 4: append tracker events, return the derived state."""
    writers.append_tracker_events(events, f"{out}/events")
    return tracker.tracker_state(events.sparkSession.read.parquet(f"{out}/events"))
