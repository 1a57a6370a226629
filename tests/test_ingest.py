"""Ingest of session folders (S1-S5, P1-P6) on hand-made records written to a temp folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from hirelake.operators.dedup import completeness
from hirelake.sources.ingest import (PARITY_DATE_PREFIX, flattened, ingest, raw_from_strings, read_master, read_sessions,
                                     session_metadata)


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def _fixture():
    root = tempfile.mkdtemp(prefix="hirelake-sessions-")
    a = os.path.join(root, "session_scrape_20251120_184825")
    _write(os.path.join(a, "jobs", "j1.json"), {"job": {"id": "n1", "url": "https://x/1", "title": "Dev",
                                                        "company": {"name": "TechCorp GmbH"},
                                                        "location": {"city": "Wien", "type": "hybrid"},
                                                        "jobType": {"value": "Full-time", "confidence": 90},
                                                        "salary": {"min": 4000, "period": "monthly"}}})
    _write(os.path.join(a, "jobs", "j2.json"), {"job_id": "d1", "url": "https://x/2",
                                                "data": {"title": {"value": "Analyst", "confidence": 88},
                                                         "company": {"value": "Acme", "confidence": 91},
                                                         "location": {"value": "Graz", "confidence": 80},
                                                         "contactEmail": {"value": "a@b.at", "confidence": 75}}})
    _write(os.path.join(a, "jobs", "j3.json"), "{not json")
    b = os.path.join(root, "data_analyst_session_scrape_20251121_123159")
    _write(os.path.join(b, "api_response_all.json"), [
        {"uid": "u1", "application_url": "https://x/3", "slug": "data-analyst", "company": {"name": "Beta"},
         "location": {"city": "Linz"}},
        {"id": 0, "uid": "u2", "application_url": "https://x/4", "slug": "bi-dev", "company": "Gamma",
         "location": "Salzburg"}])
    _write(os.path.join(b, "jobs", "ignored.json"), {"job": {"id": "zz"}})   # replaced by the api array
    os.makedirs(os.path.join(root, "session_empty_20251122_000000"), exist_ok=True)
    return root


def test_read_and_project(spark):
    root = _fixture()
    raw, rejects = read_sessions(spark, root)
    assert [(r["session"], r["source_file"]) for r in rejects.collect()] == [
        ("session_scrape_20251120_184825", "j3.json")]
    rows = {r["id"]: r for r in ingest(raw).collect()}
    assert set(rows) == {"n1", "d1", "u1", "u2"}
    n1 = rows["n1"]
    assert (n1["shape"], n1["company"], n1["location"], n1["job_type"]) == ("nested_job", "TechCorp GmbH", "Wien",
                                                                            "Full-time")
    assert (n1["salary_min"], n1["salary_period"], n1["location_type"], n1["original_id"]) == (4000.0, "monthly",
                                                                                               "hybrid", "j1")
    d1 = rows["d1"]
    assert (d1["shape"], d1["title"], d1["company"], d1["contact_email"], d1["url"]) == (
        "data_fields", "Analyst", "Acme", "a@b.at", "https://x/2")
    assert (rows["u1"]["title"], rows["u1"]["company"], rows["u1"]["location"]) == ("data-analyst", "Beta", "Linz")
    assert rows["u2"]["company"] == "Gamma" and rows["u2"]["original_id"] == "u2"   # id 0 is falsy
    # load order: sessions sorted, then file, then array position
    order = [r["id"] for r in ingest(raw).orderBy("seq").collect()]
    assert order == ["u1", "u2", "n1", "d1"]
    assert [r["master_id"] for r in ingest(raw).orderBy("seq").collect()] == [
        "master_00001", "master_00002", "master_00003", "master_00004"]


def test_session_metadata(spark):
    names = ["data_analysis_session_scrape_20251121_192443", "data_analyst_session_scrape_20251120_182316",
             "session_scrape_20251120_184825", "session_x_20251120", "session_20241120_101010"]
    df = spark.createDataFrame([(n,) for n in names], "session string")
    got = {r["session"]: (r["session_date"], r["session_type"]) for r in session_metadata(df).collect()}
    assert got["data_analysis_session_scrape_20251121_192443"] == ("2025-11-21T19:24:43Z", "filtered_search_data_analysis")
    assert got["data_analyst_session_scrape_20251120_182316"] == ("2025-11-20T18:23:16Z", "filtered_search_data_analyst")
    assert got["session_scrape_20251120_184825"] == ("2025-11-20T18:48:25Z", "general_search")
    assert got["session_x_20251120"] == (None, "general_search")
    parity = {r["session"]: r["session_date"] for r in session_metadata(df, PARITY_DATE_PREFIX).collect()}
    assert parity["session_20241120_101010"] is None
    assert got["session_20241120_101010"][0] == "2024-11-20T10:10:10Z"


def test_ingest_plan_is_one_scan_stage(spark):
    root = _fixture()
    raw, _ = read_sessions(spark, root)
    from hirelake.sources.ingest import project
    plan = project(raw).select("id", "title")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert F is not None


def test_session_stats_and_structure(spark):
    from hirelake.sources.ingest import session_stats, session_structure
    root = _fixture()
    raw, _ = read_sessions(spark, root)
    listed = spark.createDataFrame([(n,) for n in sorted(os.listdir(root))], "session string")
    st = {r["session"]: (r["jobs_count"], r["structure_type"]) for r in session_structure(raw, listed).collect()}
    assert st == {"data_analyst_session_scrape_20251121_123159": (2, "api_response"),
                  "session_empty_20251122_000000": (0, "unknown"),
                  "session_scrape_20251120_184825": (2, "jobs_directory")}
    stats = {r["session"]: (r["jobs_contributed"], r["status"], r["session_type"])
             for r in session_stats(raw, listed).collect()}
    assert stats["session_empty_20251122_000000"] == (0, "no_jobs_directory", "general_search")
    assert stats["data_analyst_session_scrape_20251121_123159"] == (2, "success", "filtered_search_data_analyst")


def test_writers_csv_skip_and_compact_index(spark):
    import tempfile as tf

    from hirelake.operators.index import compact_index
    from hirelake.sinks.writers import write_csv
    empty = spark.createDataFrame([], "id string, url string, title string, company string, location string, "
                                      "session string, extra string")
    assert write_csv(empty, tf.mkdtemp(prefix="hirelake-csv-") + "/out") is False
    entries = spark.createDataFrame([("by_company", "acme", 2, "m2"), ("by_company", "acme", 1, "m1")],
                                    "index_name string, key string, seq bigint, master_id string")
    assert compact_index(entries).first()["master_ids"] == ["m1", "m2"]


def test_api_files_empty_broken_or_no_array(spark, tmp_path):
    from hirelake.sources.ingest import read_sessions, session_files, session_stats
    for session, api, job in (("session_a", "[]", "{}"), ("session_b", '{"id": 1}', "{}"), ("session_c", '[{"id": 1}, {"id": "x"}]', None),
                              ("session_d", None, "{broken"), ("session_e", '[{"id": 1}, {"id"', "{}")):
        folder = tmp_path / session
        (folder / "jobs").mkdir(parents=True)
        if api is not None:
            (folder / "api_response_all.json").write_text(api)
        if job is not None:
            (folder / "jobs" / "1.json").write_text(job)
    raw, rejects = read_sessions(spark, str(tmp_path))
    assert sorted((r["session"], r["pos"]) for r in raw.select("session", "pos").collect()) == [("session_c", 0), ("session_c", 1)]
    assert sorted((r["session"], r["error"]) for r in rejects.collect()) == [
        ("session_b", "not a JSON array"), ("session_d", "invalid JSON"), ("session_e", "invalid JSON")]
    files = session_files(spark, str(tmp_path))
    stats = {r["session"]: (r["status"], r["jobs_contributed"], r["structure_type"])
             for r in session_stats(raw, files.select("session"), files).collect()}
    assert stats["session_a"] == ("success", 0, "api_response") and stats["session_d"] == ("success", 0, "jobs_directory")
    assert stats["session_c"][1] == 2


def test_label_values_end_at_the_line_or_the_next_label(spark):
    from pyspark.sql import functions as F

    from hirelake.operators.quality import alias_fields, audit, strip_tags
    long = "x" * 200
    html = f"<div><p>Position: Data Analyst Unternehmen: ACME GmbH</p>Beschreibung: {long}<br>[{'a' * 58}]</div>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string").select("page_id", strip_tags(F.col("html")).alias("text"))
    got = {r["field"]: r["value"] for r in alias_fields(pages, "page_id", "text").collect()}
    assert got["title"] == "Data Analyst" and got["company"] == "ACME GmbH" and got["description"] == long
    assert {r["issue"]: r["occurrences"] for r in audit(pages, "page_id", "text").collect()}["placeholder"] == 1


def _flat(spark, *records):
    rows = spark.createDataFrame([("s", f"{i:03d}.json", 0, r) for i, r in enumerate(records)],
                                 "session string, source_file string, pos int, value string")
    return flattened(ingest(raw_from_strings(rows)))


def test_flattened_record_of_each_shape(spark):
    out = _flat(
        spark,
        '{"title": "Root", "source_url": "u0", "url": "", "company": {"name": "Acme"}, "location": {"city": "Paris", "country": "FR"}, "salary": 5}',
        '{"url": "root", "data": {"title": {"value": "Cell", "confidence": 9}, "requirements": {"value": ["a", "b"]}, "location": {"city": "Paris", "country": "FR"},'
        ' "salary": {"min": 10, "max": 20}, "description": {"confidence": 9}}}',
        '{"job": {"title": "Job", "link": "u2", "location": "Graz", "benefits": [], "requirements": "one", "contactEmail": "a@b.co", "salary": {"value": {"min": 1}}}}',
        '{"data": 7, "title": 3, "location": {"value": "Linz", "confidence": 9}, "benefits": ["x"]}')
    rows = {r["source_file"]: r for r in out.withColumn("share", completeness(out)).collect()}
    root, data, job, odd = (rows[f"{i:03d}.json"] for i in range(4))
    assert [r["url"] for r in (root, data, job, odd)] == ["u0", "root", "u2", None]
    assert [r["title"] for r in (root, data, job, odd)] == ["Root", "Cell", "Job", "3"]
    assert (root["location_city"], root["location_country"], root["location_is_object"]) == ("Paris", "FR", True)
    assert (data["location_city"], data["location_country"], data["location_is_object"]) == ("Paris", "FR", True)
    assert (job["location_text"], odd["location_text"], odd["location_is_object"]) == ("Graz", "Linz", False)
    assert (data["requirements"], job["requirements"], odd["benefits"]) == (["a", "b"], ["one"], ["x"])
    assert (data["salary_min"], data["salary_max"], job["salary_min"]) == (10, 20, 1)
    # a number is not a filled salary or title, an empty list or cell not a filled field
    assert [r["share"] for r in (root, data, job, odd)] == [37.5, 50.0, 62.5, 25.0]


def test_flattened_root_url_is_a_switch(spark):
    rows = spark.createDataFrame([("s", "a.json", 0, '{"url": "root", "data": {"title": "t"}}')],
                                 "session string, source_file string, pos int, value string")
    assert flattened(ingest(raw_from_strings(rows)), carry_root_url=False).first()["url"] is None


def test_master_lists_with_and_without_envelope(spark, tmp_path):
    (tmp_path / "flat.json").write_text('[{"id": "1"}, {"id": "2", "session_source": "s9"}]')
    (tmp_path / "wrapped.json").write_text('{"total": 1, "jobs": [{"id": "3"}]}')
    (tmp_path / "other.json").write_text('{"total": 1}')
    (tmp_path / "empty.json").write_text('{"jobs": []}')
    rows, rejects = read_master(spark, str(tmp_path / "*.json"))
    got = {(r["id"], r["session"], r["seq"]) for r in ingest(rows).collect()}
    assert got == {("1", "flat.json", 1), ("2", "s9", 2), ("3", "wrapped.json", 3)}
    assert [r["source_file"] for r in rejects.collect()] == ["other.json"]
