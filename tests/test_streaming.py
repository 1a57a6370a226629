"""Stream = batch: tracker and keep-first consolidation run as availableNow streams
over split files equal their batch results."""

import os
import tempfile

from conftest import SF0001

from hirelake.operators.keepfirst import keep_first
from hirelake.operators.tracker import tracker_state
from hirelake.sources.views import events_to_tracker, postings_v1
from hirelake.sources.tables import table
from hirelake.streaming.consolidate import run_consolidation_stream
from hirelake.streaming.tracker import read_state, run_tracker_stream


def _split(df, col, parts, base):
    ranged = df.repartitionByRange(parts, col)
    for i in range(parts):
        ranged.where(f"spark_partition_id() = {i}").coalesce(1).write.parquet(os.path.join(base, f"{i:05d}"))


def test_tracker_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="hirelake-stream-")
    events = table(spark, SF0001, "events")
    # events are split into four arrival files out of order of event_id within a file
    _split(events, "user_id", 4, os.path.join(base, "in"))
    stream = events_to_tracker(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
                               .option("recursiveFileLookup", "true").parquet(os.path.join(base, "in")))
    run_tracker_stream(stream, os.path.join(base, "state"), os.path.join(base, "ckpt"))
    cols = ["session", "job_id", "company", "title", "status", "directory", "created_at", "updated_at"]
    got = sorted(tuple(r) for r in read_state(spark, os.path.join(base, "state")).select(*cols).collect())
    want = sorted(tuple(r) for r in tracker_state(events_to_tracker(events)).select(*cols).collect())
    assert got == want and len(got) > 0


def test_a_batch_rewrites_only_the_buckets_it_touches(spark):
    from hirelake.streaming.tracker import fold_batch
    base = tempfile.mkdtemp(prefix="hirelake-state-")
    schema = ("session string, seq bigint, ts timestamp, kind string, job_id string, company string, title string, status string, directory string, "
              "extra map<string,string>")
    event = lambda seq, kind, job, status: ("s", seq, None, kind, job, "c", "t", status, "d", {"k": str(seq)})
    batches = [[event(i, "add", f"j{i}", "in_progress") for i in range(200)], [event(300, "update", "j7", "completed")], [],
               [event(301, "update", "j8", "failed"), event(302, "update", "unknown", "failed")], [event(303, "add", "j7", "in_progress")]]
    run = fold_batch(base, buckets=32)
    kinds = ("jobs", "extras", "opens")
    written = lambda v: sum(len(os.listdir(os.path.join(base, k, v))) for k in kinds if os.path.isdir(os.path.join(base, k, v)))
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema)
        run(frame, n)
        if n in (1, 3):
            before = sorted(map(str, read_state(spark, base).collect()))
            run(frame, n)   # replayed
            assert sorted(map(str, read_state(spark, base).collect())) == before
            folders = [f for k in kinds if os.path.isdir(os.path.join(base, k, f"v{n:09d}")) for f in os.listdir(os.path.join(base, k, f"v{n:09d}")) if f.startswith("bucket=")]
            assert 0 < len(folders) <= 4
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    key = lambda df: sorted((r["job_id"], r["status"], r["add_seq"], str(r["extra"])) for r in df.collect())
    assert key(read_state(spark, base)) == key(tracker_state(everything)) and written("v000000000") > 10
    # a version whose buckets have all been rewritten is dropped
    for n in range(5, 8):
        run(spark.createDataFrame([event(400 + n, "update", "j7", "completed")], schema), n)
    assert not os.path.isdir(os.path.join(base, "jobs", "v000000001")) and os.path.isdir(os.path.join(base, "jobs", "v000000000"))


def test_keepfirst_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="hirelake-stream-")
    postings = postings_v1(spark, SF0001)
    _split(postings, "seq", 3, os.path.join(base, "in"))
    stream = (spark.readStream.schema(postings.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(base, "in")))
    got = {(r["seq"], r["status"], r["duplicate_reason"])
           for r in run_consolidation_stream(stream, os.path.join(base, "run")).collect()}
    want = {(r["seq"], r["status"], r["duplicate_reason"]) for r in keep_first(postings).collect()}
    assert got == want
