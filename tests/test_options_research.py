"""Documented-only options (ours) and research helpers."""

from datetime import datetime

from test_filters import passes, postings

from hirelake.operators import filters as flt
from hirelake.operators.relevance import infer_experience, keyword_relevance, required_skills
from hirelake.operators.research import progress_summary, research_quality, tech_stack_overlap


def test_city_aliases(spark):
    rows = [{"seq": 1, "location_is_object": True, "location_present": True, "location_city": "Wien"},
            {"seq": 2, "location_is_object": False, "location_present": True, "location_text": "München, DE"}]
    assert passes(spark, rows, cities=["Vienna", "Munich"]) == []
    assert passes(spark, rows, cities=["Vienna", "Munich"], expand_city_aliases=True) == [1, 2]


def test_keyword_similarity_option(spark):
    rows = [{"seq": 1, "job_title": "data analysts"}, {"seq": 2, "job_title": "datta analyst"},
            {"seq": 3, "job_title": "baker"}]
    assert passes(spark, rows, keywords=["data analyst"]) == [1]
    assert passes(spark, rows, keywords=["data analyst"], keyword_similarity=True) == [1, 2]


def test_required_skills(spark):
    df = postings(spark, [{"seq": 1, "job_description": "We use Python, SQL and Power-BI daily."},
                          {"seq": 2, "job_description": "Python only"}])
    got = {r["seq"]: (r["skills_confidence"], r["skills_ok"])
           for r in required_skills(df, ["Python", "SQL", "Power BI"]).collect()}
    assert got == {1: (100, True), 2: (33, False)}


def test_infer_experience(spark):
    df = postings(spark, [{"seq": 1, "job_title": "Senior Data Engineer"},
                          {"seq": 2, "job_title": "Analyst", "job_description": "3+ years of SQL"},
                          {"seq": 3, "job_title": "Analyst", "experience_level": "Junior"}])
    got = {r["seq"]: (r["experience_inferred"], r["experience_source"]) for r in infer_experience(df).collect()}
    assert got == {1: ("Senior", "title"), 2: ("Mid-Level", "years"), 3: ("Junior", "given")}


def test_relevance_prefers_rare_terms(spark):
    df = postings(spark, [{"seq": 1, "job_title": "data analyst"}, {"seq": 2, "job_title": "data engineer"},
                          {"seq": 3, "job_title": "data analyst analyst"}, {"seq": 4, "job_title": "cook"}])
    got = {r["seq"]: r["relevance"] for r in keyword_relevance(df, "data analyst", min_score=1e-9).collect()}
    assert set(got) == {1, 2, 3} and got[3] > got[1] > got[2]


def test_research_quality_and_overlap(spark):
    research = spark.createDataFrame(
        [("TechCorp GmbH", ["Python", "Spark"], ["n1", "n2", "n3", "n4"], 2),
         ("Acme", ["Go"], ["n1"], 1), ("Zed", [], [], 0)],
        "company string, tech_stack array<string>, recent_news array<string>, hooks int")
    levels = {r["company"]: r["research_quality"] for r in research_quality(research).collect()}
    assert levels == {"TechCorp GmbH": "high", "Acme": "low", "Zed": "none"}
    df = postings(spark, [{"seq": 1, "company_name": "techcorp", "description": "We love python and spark."}])
    got = tech_stack_overlap(df, research).collect()
    assert [(r["seq"], r["overlap_count"]) for r in got] == [(1, 2)]


def test_progress_summary(spark):
    state = spark.createDataFrame([("s", "j1", "completed"), ("s", "j2", "failed"), ("s", "j3", "in_progress"),
                                   ("s", "j4", "completed")], "session string, job_id string, status string")
    got = {r["metric"]: (r["value"], r["share_pct"]) for r in progress_summary(state).collect()}
    assert got == {"successful": (2, 50.0), "failed": (1, 25.0)}
    assert flt.Criteria().total == 0 and isinstance(datetime.now(), datetime)


def test_parse_schema_date(spark):
    from pyspark.sql import functions as F

    from hirelake.functions.text import parse_schema_date
    df = spark.createDataFrame([("2025-11-20",), ("posted 20/11/2025",), ("1/2/2025",), ("soon",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_schema_date(F.col("s")).cast("string")).collect()]
    assert got == ["2025-11-20", "2025-11-20", "2025-02-01", None, None]


def test_session_lifecycle(spark):
    from datetime import datetime as dt

    from hirelake.operators.tracker import session_lifecycle, tracker_state
    ev = spark.createDataFrame([
        ("p", 1, dt(2025, 11, 22, 9), "session_open", None, None, None, None, None,
         {"source_filter": "filter_1", "total_jobs": "2"}),
        ("p", 2, dt(2025, 11, 22, 10), "add", "j1", "C", "T", "in_progress", "d", None),
        ("p", 3, dt(2025, 11, 22, 11), "session_close", None, None, None, None, None, None),
        ("p", 4, dt(2025, 11, 23, 9), "session_open", None, None, None, None, None, {"total_jobs": "1"}),
        ("p", 5, dt(2025, 11, 23, 10), "add", "j2", "C", "T", "in_progress", "d", None)],
        "session string, seq bigint, ts timestamp, kind string, job_id string, company string, title string, "
        "status string, directory string, extra map<string,string>")
    life = session_lifecycle(ev).first()
    assert (life["started_at"], life["completed_at"], life["total_jobs"]) == (dt(2025, 11, 23, 9), None, 1)
    assert [r["job_id"] for r in tracker_state(ev).collect()] == ["j2"]   # reopening resets the session


def test_sequence_plan_has_no_single_partition_window(spark):
    from hirelake.plans.sequence import assign_sequence
    df = spark.range(0, 1000).selectExpr("id * 7 % 1000 as k")
    out = assign_sequence(df, ["k"], name="seq")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    rows = out.collect()
    assert sorted(r["seq"] for r in rows) == list(range(1, 1001))
    assert all(r["seq"] == r["k"] + 1 for r in rows)


def test_user_schema_file_gives_rules_and_labels(spark, tmp_path):
    import json

    from hirelake.operators.quality import alias_fields, conformance, load_rules, rules_table
    schema = {"extraction_schema": {
        "required": {"title": {"type": "string", "aliases": ["posición (título)"], "min_confidence": 80}},
        "custom_fields": {"visa": {"type": "string", "aliases": ["visa"], "values": ["yes", "no"], "min_confidence": 50},
                          "plain": {"type": "number"}}}}
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(schema, indent=1, ensure_ascii=False), encoding="utf-8")
    rules = load_rules(spark, str(path))
    assert [(r[0], r[1], r[3]) for r in rules] == [("required", "title", 80), ("optional", "visa", 50), ("optional", "plain", 0)]
    raw = spark.createDataFrame([(1, '{"title": "Cook", "visa": "maybe", "salary": 3}'), (2, '{"visa": "no", "plain": 7}')],
                                "seq bigint, j string").selectExpr("seq", "parse_json(j) as raw")
    got = {(r["seq"], r["field"], r["reason"]) for r in conformance(raw, rules_table(spark, rules)).collect()}
    assert got == {(1, "title", "ok"), (1, "visa", "enum"), (2, "visa", "ok"), (2, "plain", "ok")}
    texts = spark.createDataFrame([(1, "Posición (título): Cook Visa: yes")], "id int, t string")
    found = {(r["field"], r["value"]) for r in alias_fields(texts, "id", "t", rules).collect()}
    assert found == {("title", "Cook"), ("visa", "yes")}


def test_a_posting_alerts_every_search_it_matches(spark):
    from hirelake.catalog.queries import AS_OF
    from hirelake.operators.filters import Criteria
    from hirelake.sources.views import postings_v1
    from hirelake.streaming.alerts import match_searches
    v1 = postings_v1(spark, "/root/testdata/sf0.001")
    n = v1.count()
    none = match_searches(v1, {}, AS_OF)
    assert none.count() == 0 and none.columns == ["search_id", "seq", "id", "title", "company", "match_score"]
    got = match_searches(v1, {"all": Criteria(), "no": Criteria(company_contains="nowhere"), "again": Criteria()}, AS_OF)
    assert {r["search_id"]: r["count"] for r in got.groupBy("search_id").count().collect()} == {"all": n, "again": n}
