"""Outputs read back: the filter report, merged values, failed urls, the session master and the url queue."""

import json
import os
import tempfile
from datetime import datetime

from conftest import SF0001

from hirelake import jobs
from hirelake.sinks import writers
from hirelake.sources.queue import failed_urls, read_url_queue
from hirelake.sources.views import postings_v1

AS_OF = datetime(2001, 8, 1)


def test_the_filter_report_names_its_criteria(spark):
    out = tempfile.mkdtemp(prefix="hirelake-out-")
    criteria = {"job_types": ["Full-time"], "salary_min": 1000}
    matched = jobs.filter_postings(postings_v1(spark, SF0001), criteria, out, AS_OF, filter_id="f1", source="jobs_master")
    head = spark.read.json(os.path.join(out, "filter_id=f1", "report", "head")).first()
    assert head["filter_id"] == "f1" and head["source_database"] == "jobs_master" and json.loads(head["criteria"]) == criteria
    assert spark.read.json(os.path.join(out, "filter_id=f1", "postings")).count() == matched.count()


def test_merged_values_are_written(spark):
    out = tempfile.mkdtemp(prefix="hirelake-out-")
    jobs.deduplicate(postings_v1(spark, SF0001), out, fuzzy=False)
    values = spark.read.parquet(os.path.join(out, "merged_values"))
    unique = spark.read.parquet(os.path.join(out, "unique")).where("duplicate_metadata is not null")
    assert {r["kind"] for r in values.select("kind").distinct().collect()} == {"url", "session", "original_id"}
    assert values.where("kind = 'original_id'").count() == unique.selectExpr("sum(duplicate_metadata.n_original_ids) as n").first()["n"]


def test_queue_and_failed_urls(spark):
    out = tempfile.mkdtemp(prefix="hirelake-out-")
    with open(os.path.join(out, "queue.json"), "w") as f:
        json.dump({"urls": [{"position": i, "url": f"u{i}", "title": f"t{i}", "company": None if i == 2 else "c"} for i in range(1, 4)]}, f, indent=1)
    queue = read_url_queue(spark, os.path.join(out, "queue.json"))
    assert [tuple(r) for r in queue.orderBy("position").collect()] == [(1, "u1", "t1", "c"), (2, "u2", "t2", None), (3, "u3", "t3", "c")]
    errors = spark.createDataFrame([("u2", "404"), ("u2", "500"), (None, "x"), ("u9", "404")], "url string, error string")
    writers.write_failed_urls(failed_urls(queue, errors, AS_OF), os.path.join(out, "failed"))
    rows = spark.read.json(os.path.join(out, "failed")).collect()
    assert [(r["position"], r["url"], r["title"], r["error"], r["failed_at"][:10]) for r in rows] == [(2, "u2", "t2", "404", "2001-08-01")]


def test_session_master_keeps_earlier_runs(spark):
    out = tempfile.mkdtemp(prefix="hirelake-out-")
    postings = postings_v1(spark, SF0001).select("seq", "id")
    writers.write_session_master(postings, out, "20240101T000000")
    writers.write_session_master(postings.limit(3), out, "20240102T000000")
    counts = {str(r["run_ts"]): r["count"] for r in spark.read.parquet(out).groupBy("run_ts").count().collect()}
    assert len(counts) == 2 and min(counts.values()) == 3


def test_one_key_with_a_third_of_all_postings(spark):
    """A composite key held by 20,000 postings: tall edges and values, numbers in order, nothing collected into a row."""
    from hirelake.operators import dedup
    from hirelake.sources.schema import conform
    rows = spark.range(1, 60_001).selectExpr(
        "id as seq", "concat('m', id) as master_id", "concat('o', id) as original_id", "concat('s', id % 7) as session", "cast(null as string) as url",
        "if(id % 3 = 0, 'Acme', concat('c', id)) as company_name", "if(id % 3 = 0, 'Analyst', concat('t', id)) as title", "concat('text of ', id % 5) as description")
    postings = conform(rows).persist()
    edges = dedup.detect_duplicates(postings)
    merged = dedup.merge_duplicates(postings, edges)
    assert edges.count() == 19_999 and merged["unique"].count() == 60_000 - 19_999
    head = merged["unique"].where("duplicate_metadata is not null").selectExpr("duplicate_metadata.*").first()
    assert (head["duplicate_count"], head["n_urls"], head["n_sessions"], head["n_original_ids"]) == (1, 1, 1, 2)   # the last group of the canonical
    urls = conform(rows.withColumn("url", rows["company_name"])).persist()
    merged = dedup.merge_duplicates(urls, dedup.detect_duplicates(urls))
    values = merged["values"].where("kind = 'original_id'").selectExpr("count(*) as n", "max(position) as top", "count(distinct position) as places").first()
    assert (values["n"], values["top"], values["places"]) == (20_000, 19_999, 20_000)
