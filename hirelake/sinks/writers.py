"""Writers for every output of the reference.

Parquet is the system of record; JSON / CSV are exports. Each writer is one
Spark write (distributed, no driver-side assembly); reports are small metric
DataFrames. Paths may be any Hadoop-compatible URI.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASTER_CSV_COLUMNS = ["id", "url", "title", "company", "location", "session"]


def write_master(unique: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: unique postings, partitioned by session (parquet) or as JSON lines."""
    w = unique.write.mode("overwrite")
    if fmt == "parquet":
        w.partitionBy("session").parquet(path)
    else:
        w.json(path)


def write_duplicates(duplicates: DataFrame, path: str) -> None:
    """K2: duplicate postings with ``duplicate_reason`` (and ``fuzzy_key``)."""
    duplicates.write.mode("overwrite").json(path)


def write_csv(unique: DataFrame, path: str) -> bool:
    """K3: six columns with a header; extra columns ignored; skipped when empty."""
    if unique.limit(1).count() == 0:
        return False
    unique.select(*[F.col(c).cast("string") for c in MASTER_CSV_COLUMNS]).write.mode("overwrite") \
        .option("header", True).csv(path)
    return True


def write_stats(stats: DataFrame, per_session: DataFrame, path: str) -> None:
    """K4: consolidation totals and per-session counts as JSON."""
    stats.write.mode("overwrite").json(f"{path}/totals")
    per_session.write.mode("overwrite").json(f"{path}/sessions")


def write_session_master(master: DataFrame, path: str, run_ts: str) -> None:
    """K5: the session master under a ``run_ts=...`` partition (one write; earlier runs stay)."""
    master.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(path)


def write_index(entries: DataFrame, path: str) -> None:
    """K6: the tall index (index_name, key, seq, master_id), partitioned by index name."""
    entries.write.mode("overwrite").partitionBy("index_name").parquet(path)


def write_dedup_outputs(unique: DataFrame, edges: DataFrame, review: DataFrame, path: str, values: DataFrame | None = None) -> None:
    """K7: unique postings, duplicate edges, the review queue, and the urls, sessions and original ids of merged postings (tall)."""
    if values is not None:
        values.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/merged_values")
    unique.write.mode("overwrite").parquet(f"{path}/unique")
    edges.write.mode("overwrite").parquet(f"{path}/duplicates")
    review.write.mode("overwrite").json(f"{path}/review_queue")


def write_filter_outputs(filtered: DataFrame, breakdown: DataFrame, summary: DataFrame, top: DataFrame,
                         path: str, filter_id: str, criteria: dict | None = None, source: str | None = None, created_at: datetime | None = None) -> None:
    """K8: filtered postings (an untyped ``raw`` as JSON text) and the filter report, under ``filter_id=...``. The report's head names the filter, its
    criteria as given and the source."""
    base = f"{path}/filter_id={filter_id}"
    if "raw" in filtered.columns:
        filtered = filtered.withColumn("raw", F.to_json("raw"))
    filtered.write.mode("overwrite").json(f"{base}/postings")
    head = [(filter_id, created_at, source, json.dumps(criteria or {}, ensure_ascii=False, default=str))]
    (summary.sparkSession.createDataFrame(head, "filter_id string, created_at timestamp, source_database string, criteria string").coalesce(1)
     .write.mode("overwrite").json(f"{base}/report/head"))
    breakdown.write.mode("overwrite").json(f"{base}/report/filter_breakdown")
    summary.write.mode("overwrite").json(f"{base}/report/results")
    top.write.mode("overwrite").json(f"{base}/report/top_matches")


def append_tracker_events(events: DataFrame, path: str) -> None:
    """K9: tracker changes are appended as events; the state is derived."""
    events.write.mode("append").partitionBy("session").parquet(path)


def render_dedup_report(summary: DataFrame, strategies: DataFrame, quality: DataFrame,
                        reasons: DataFrame) -> str:
    """The markdown report, formatted from the few rows of the metric frames."""
    s = summary.first()
    out = ["# Entity resolution", "", "One line per figure; shares in percent.", "", "| figure | value |", "| --- | ---: |"]
    out += [f"| {name} | {s[name]} |" for name in summary.columns]
    out += ["", "## Strategies", "", "| strategy | matches | avg_confidence | pct_of_duplicates |", "| --- | ---: | ---: | ---: |"]
    out += [f"| {r['strategy']} | {r['matches']} | {r['avg_confidence']:.1f} | {r['pct_of_duplicates']:.1f} |"
            for r in strategies.collect()]   # one row per strategy (at most three)
    rows = quality.collect()                 # five metric rows
    out += ["", "## Filled fields", "", "| metric | before | after | change | below 60 |", "| --- | ---: | ---: | ---: | --- |"]
    out += [f"| {r['metric']} | {r['before']:.1f} | {r['after']:.1f} | {r['improvement']:+.1f} | "
            f"{'yes' if r['improvement_target'] else ''} |" for r in rows]
    out += ["", "## Left for review", "", "| reason | items |", "| --- | ---: |"]
    out += [f"| {r['reason']} | {r['items']} |" for r in reasons.collect()]   # at most two reasons
    return "\n".join(out) + "\n"


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Records that could not be read, partitioned by session."""
    rejects.withColumn("failed_at", F.current_timestamp()).write.mode("overwrite").partitionBy("session").json(path)


def write_failed_urls(failed: DataFrame, path: str) -> None:
    """Queue entries that failed (see ``sources.queue.failed_urls``)."""
    failed.write.mode("overwrite").json(path)
