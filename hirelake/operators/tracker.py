"""Application tracker (T1, T2, T5, A14, A15, F16) over an append-only event table.

Events: ``(session, seq, ts, kind, job_id, company, title, status, directory,
extra MAP<STRING,STRING>)`` with kind in ``session_open | add | update |
session_close``.

Semantics: an ``add`` replaces the whole entry of its job (earlier fields are
lost); an ``update`` patches the entry that exists at that time (status,
``updated_at``, extra keys) and is a no-op for an unknown job; ``session_open``
resets the session. An update without a status (ours: extra-only patches) keeps
the status.

Because "latest add" and "latest update after it" are both max-by-``seq``
values, the state of a job is one associative aggregate: the last add, the last
status-carrying update, the last update, and per extra key its last value --
each with its seq -- resolved by comparing seqs. No join, combined map-side (a
job with a third of all events is still one partial row per task), and the
same partial rows can be merged incrementally (see ``hirelake.streaming``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.plans import left_join_nonnull

COMPLETED, FAILED, IN_PROGRESS = "completed", "failed", "in_progress"


def open_partials(events: DataFrame) -> DataFrame:
    """Per session the seq of its last ``session_open`` (a reset); merge = max."""
    return (events.where(F.col("kind") == "session_open").groupBy("session")
            .agg(F.max("seq").alias("open_seq")))


def merge_open_partials(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("session").agg(F.max("open_seq").alias("open_seq"))


def job_partials(events: DataFrame) -> DataFrame:
    """Associative per-job partial state (merge = max of each struct)."""
    e = events.where(F.col("kind").isin("add", "update") & F.col("job_id").isNotNull())
    add = F.when(F.col("kind") == "add", F.struct("seq", "ts", "company", "title", "status", "directory"))
    status = F.when((F.col("kind") == "update") & F.col("status").isNotNull(), F.struct("seq", "status"))
    upd = F.when(F.col("kind") == "update", F.struct("seq", "ts"))
    return e.groupBy("session", "job_id").agg(F.max(add).alias("last_add"), F.max(status).alias("last_status"),
                                              F.max(upd).alias("last_update"))


def extra_partials(events: DataFrame) -> DataFrame:
    """Per (job, extra key): its last value with the seq it was set at."""
    e = events.where(F.col("kind").isin("add", "update") & F.col("extra").isNotNull())
    x = e.select("session", "job_id", "seq", "kind", F.explode("extra").alias("key", "value"))
    return x.groupBy("session", "job_id", "key").agg(F.max(F.struct("seq", "value", "kind")).alias("last_value"))


def merge_partials(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merges two job-partial tables (incremental fold)."""
    return a.unionByName(b).groupBy("session", "job_id").agg(
        F.max("last_add").alias("last_add"), F.max("last_status").alias("last_status"),
        F.max("last_update").alias("last_update"))


def merge_extra_partials(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("session", "job_id", "key").agg(F.max("last_value").alias("last_value"))


def resolve(partials: DataFrame, extras: DataFrame | None = None, opens: DataFrame | None = None) -> DataFrame:
    """Final entries: jobs that have an add; fields of the last add patched by later updates.
    With ``opens``, an entry lives only if its last add is later than its session's last open."""
    p = partials.where(F.col("last_add").isNotNull())
    if opens is not None:
        p = (p.join(opens, "session", "left")
             .where(F.col("open_seq").isNull() | (F.col("last_add.seq") > F.col("open_seq"))).drop("open_seq"))
    add_seq = F.col("last_add.seq")
    out = p.select(
        "session", "job_id",
        F.col("last_add.company").alias("company"), F.col("last_add.title").alias("title"),
        F.when(F.col("last_status.seq") > add_seq, F.col("last_status.status"))
        .otherwise(F.col("last_add.status")).alias("status"),
        F.col("last_add.directory").alias("directory"),
        F.col("last_add.ts").alias("created_at"),
        F.when(F.col("last_update.seq") > add_seq, F.col("last_update.ts")).alias("updated_at"),
        add_seq.alias("add_seq"))
    if extras is not None:
        x = (extras.join(p.select("session", "job_id", add_seq.alias("add_seq")), ["session", "job_id"])
             .where((F.col("last_value.seq") > F.col("add_seq"))
                    | ((F.col("last_value.seq") == F.col("add_seq")) & (F.col("last_value.kind") == "add")))
             .groupBy("session", "job_id")
             .agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("last_value.value")))).alias("extra")))
        out = out.join(x, ["session", "job_id"], "left")
    return out


def tracker_state(events: DataFrame) -> DataFrame:
    """T1 batch form: the latest entry per job of each session."""
    return resolve(job_partials(events), extra_partials(events), open_partials(events))


def session_statistics(state: DataFrame, sessions: DataFrame) -> DataFrame:
    """A14 + A15: counters per session and completion rate = round(successful / total_jobs x 100, 2),
    0.0 when total_jobs is 0. ``sessions`` gives ``(session, total_jobs)``; one group-by over
    the union of both inputs, sessions without entries included."""
    a = sessions.select("session", F.col("total_jobs").cast("bigint").alias("total_jobs"),
                        F.lit(None).cast("string").alias("status"), F.lit(True).alias("_listed"))
    b = state.select("session", F.lit(None).cast("bigint").alias("total_jobs"), "status",
                     F.lit(False).alias("_listed"))
    out = a.unionByName(b).groupBy("session").agg(
        F.max("total_jobs").alias("total_jobs"), F.max("_listed").alias("_listed"),
        F.count_if(F.col("status") == COMPLETED).alias("successful"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.count_if(F.col("status") == IN_PROGRESS).alias("in_progress")).where(F.col("_listed"))
    rate = F.when(F.col("total_jobs") > 0, F.bround(F.col("successful") / F.col("total_jobs") * 100.0, 2)) \
        .otherwise(F.lit(0.0))
    return out.select("session", "total_jobs", "successful", "failed", "in_progress", rate.alias("completion_rate"))


def session_lifecycle(events: DataFrame) -> DataFrame:
    """started_at (last open), completed_at (last close after it), source filter and total jobs."""
    opens = events.where(F.col("kind") == "session_open").groupBy("session").agg(
        F.max(F.struct("seq", "ts", F.col("extra")["source_filter"].alias("source_filter"),
                       F.col("extra")["total_jobs"].alias("total_jobs"))).alias("o"))
    closes = events.where(F.col("kind") == "session_close").groupBy("session").agg(
        F.max(F.struct("seq", "ts")).alias("c"))
    j = opens.join(closes, "session", "left")
    return j.select("session", F.col("o.ts").alias("started_at"),
                    F.when(F.col("c.seq") > F.col("o.seq"), F.col("c.ts")).alias("completed_at"),
                    F.col("o.source_filter").alias("source_filter"),
                    F.col("o.total_jobs").cast("bigint").alias("total_jobs"))


def failed_applications(state: DataFrame) -> DataFrame:
    """F16: entries with status ``failed``."""
    return state.where(F.col("status") == FAILED)


def retry_list(state: DataFrame) -> DataFrame:
    """T5 (documented, ours): failed entries whose extra ``retry_possible`` is true."""
    return failed_applications(state).where(F.lower(F.col("extra")["retry_possible"]) == "true")


def with_tracker(filtered: DataFrame, state: DataFrame) -> DataFrame:
    """Filtered postings left-joined to their tracker entry (on ``id = job_id``)."""
    st = state.select(F.col("job_id").alias("id"), F.col("status").alias("application_status"),
                      F.col("directory").alias("application_directory"),
                      F.col("created_at").alias("application_created_at"))
    return left_join_nonnull(filtered, st, "id")
