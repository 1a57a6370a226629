"""Three sessions, one of each record shape, through consolidate -> dedup -> filter -> track."""

import os
import tempfile
from datetime import datetime

from test_ingest import _fixture, _write

from hirelake import jobs


def test_end_to_end(spark):
    root = _fixture()
    # a second copy of the nested posting in a later session: a keep-first duplicate by url
    _write(os.path.join(root, "session_scrape_20251122_090000", "jobs", "k1.json"),
           {"job": {"id": "n1b", "url": "https://x/1", "title": "Dev", "company": "TechCorp",
                    "location": {"city": "Wien"}, "remotePolicy": "hybrid"}})
    out = tempfile.mkdtemp(prefix="hirelake-e2e-")
    postings = jobs.consolidate(spark, root, f"{out}/consolidated")
    master = spark.read.parquet(f"{out}/consolidated/master")
    dups = spark.read.json(f"{out}/consolidated/duplicates")
    assert master.count() == 4 and dups.count() == 1
    assert "raw" in master.columns and "techcorp" in dups.first()["raw"].lower()
    assert dups.first()["duplicate_reason"] == "exact_url"
    csv = spark.read.option("header", True).csv(f"{out}/consolidated/master_csv")
    assert csv.columns == ["id", "url", "title", "company", "location", "session"]
    assert spark.read.json(f"{out}/consolidated/rejects").count() == 1

    report = jobs.deduplicate(postings, f"{out}/dedup", fuzzy=True)
    assert "# Entity resolution" in report and "| exact_url |" in report
    assert spark.read.parquet(f"{out}/dedup/unique").count() == 4

    matched = jobs.filter_postings(postings, {"job_types": ["Full-time"], "salary_min": 40000},
                                   f"{out}/filtered", as_of=datetime(2025, 11, 22), filter_id="f1")
    assert [r["id"] for r in matched.collect()] == ["n1"]
    breakdown = {r["filter_name"]: (r["passed"], r["failed"])
                 for r in spark.read.json(f"{out}/filtered/filter_id=f1/report/filter_breakdown").collect()}
    assert breakdown["job_type"] == (1, 4) and breakdown["salary_range"] == (1, 0)

    events = spark.createDataFrame(
        [("p1", 1, datetime(2025, 11, 22, 10), "add", "n1", "TechCorp", "Dev", "in_progress", "apps/n1", None),
         ("p1", 2, datetime(2025, 11, 22, 11), "update", "n1", None, None, "completed", None, None)],
        "session string, seq bigint, ts timestamp, kind string, job_id string, company string, title string, "
        "status string, directory string, extra map<string,string>")
    state = jobs.track(events, f"{out}/tracker").collect()
    assert [(r["job_id"], r["status"]) for r in state] == [("n1", "completed")]
