"""Tracker in Structured Streaming (T1/T2 stream form).

Each micro-batch is reduced to the associative per-job partial rows of
``hirelake.operators.tracker`` and merged into a Parquet state table in
the shared checkpoint folder. The state is dealt into hash buckets of its job (or session): a batch reads and writes the buckets it
touches only, in a folder of its own version, and its *manifest* says for every bucket which version holds it. So what a batch
writes grows with the batch, not with the state. Folders that neither the last nor the previous manifest names are dropped.

The merge is a max over structs and starts from the manifest before the batch's own version, so replaying a batch after a failure writes the same
state again, and the resolved state equals the batch ``tracker_state`` of all events read so far.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators import tracker as trk

#: Buckets of a state; a state keeps the number it began with.
BUCKETS = 64
#: Per table: its partial rows of a batch, how two sets of them merge, and what deals it into buckets.
_PARTIALS = {"jobs": (trk.job_partials, trk.merge_partials, ["session", "job_id"]),
             "extras": (trk.extra_partials, trk.merge_extra_partials, ["session", "job_id"]),
             "opens": (trk.open_partials, trk.merge_open_partials, ["session"])}
_MANIFEST = "name string, bucket int, buckets int, version string"


def _published(spark: SparkSession, path: str) -> list[str]:
    """Versions published, in order; none before the first. Any other failure to read is raised, so that a passing
    fault cannot pass for an empty state."""
    try:
        return sorted({r["value"] for r in spark.read.text(os.path.join(path, "published")).collect()})   # one short line per batch kept
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _manifest(spark: SparkSession, path: str, version: str | None) -> dict[tuple[str, int], str]:
    """Which version holds each bucket that has rows: at most tables x buckets entries."""
    if version is None:
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(os.path.join(path, "manifest", version)).collect()
    return {(r["name"], r["bucket"]): r["version"] for r in rows if r["bucket"] is not None} | {("", 0): str(rows[0]["buckets"])}


def _read(spark: SparkSession, path: str, held: dict[tuple[str, int], str], name: str, schema, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a table's buckets (all, or some) at the versions that hold them."""
    at = [os.path.join(path, name, v, f"bucket={b}") for (n, b), v in held.items() if n == name and (buckets is None or b in buckets)]
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def _drop(spark: SparkSession, path: str, used: set[tuple[str, str]], before: str) -> None:
    """Deletes the version folders older than ``before`` that hold no bucket in use."""
    jvm = spark.sparkContext._jvm
    for name in _PARTIALS:
        folder = jvm.org.apache.hadoop.fs.Path(os.path.join(path, name))
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            version = status.getPath().getName()
            if version < before and (name, version) not in used:
                fs.delete(status.getPath(), True)


def fold_batch(state_path: str, buckets: int = BUCKETS):
    """foreachBatch function merging one micro-batch of tracker events into the state. All buckets of a version are
    written before its manifest, and that before its one marker, which is appended and never rewritten."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, f"v{batch_id:09d}"
        earlier = [v for v in _published(spark, state_path) if v < version]
        previous = earlier[-1] if earlier else None
        held = _manifest(spark, state_path, previous)
        n = int(held.pop(("", 0), buckets))
        batch = batch.persist()
        now = dict(held)
        try:
            for name, (partials, merge, key) in _PARTIALS.items():
                bucket = F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
                fresh = partials(batch).persist()
                schema = fresh.schema
                touched = {r[0] for r in fresh.select(bucket).distinct().collect()}   # at most the number of buckets
                if touched:
                    merged = merge(_read(spark, state_path, held, name, schema, touched), fresh)
                    (merged.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn("bucket", bucket).repartition("bucket")
                     .write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(state_path, name, version)))
                    now |= {(name, b): version for b in touched}
                fresh.unpersist()
        finally:
            batch.unpersist()
        rows = [(name, b, n, v) for (name, b), v in now.items()] or [("", None, n, version)]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(os.path.join(state_path, "manifest", version))
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("append").text(os.path.join(state_path, "published"))
        used = {(name, v) for held_by in (now, held) for (name, _), v in held_by.items()}
        _drop(spark, state_path, used, version)
    return run


def run_tracker_stream(events_stream: DataFrame, state_path: str, checkpoint: str,
                       available_now: bool = True, buckets: int = BUCKETS):
    """Starts (and with ``available_now`` waits for) the tracker stream."""
    writer = (events_stream.writeStream.foreachBatch(fold_batch(state_path, buckets))
              .option("checkpointLocation", checkpoint))
    q = writer.trigger(availableNow=True).start() if available_now else writer.start()
    if available_now:
        q.awaitTermination()
    return q


#: Partial rows of no events: the schemas of the state's tables.
_EVENTS = ("session string, seq bigint, ts timestamp, kind string, job_id string, company string, title string, status string, directory string, "
           "extra map<string,string>")


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """Resolved tracker entries from the current state."""
    versions = _published(spark, state_path)
    if not versions:
        raise FileNotFoundError(f"no tracker state under {state_path}")
    held = _manifest(spark, state_path, versions[-1])
    empty = spark.createDataFrame([], _EVENTS)
    tables = {name: _read(spark, state_path, held, name, partials(empty).schema) for name, (partials, _, _) in _PARTIALS.items()}
    return trk.resolve(tables["jobs"], tables["extras"], tables["opens"])
