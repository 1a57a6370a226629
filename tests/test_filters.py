"""Criteria filter: golden cases (FIXTURES A3) and the fixture's survivor counts."""

from datetime import datetime

import pytest
from conftest import SF001

from hirelake.operators import filters as flt
from hirelake.sources.schema import conform

AS_OF = datetime(2025, 11, 22, 12, 0, 0)


def postings(spark, rows):
    cols = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows],
                               ", ".join(f"{c} {_type(c)}" for c in cols))
    return conform(df)


def _type(c):
    return {"seq": "bigint", "salary_min": "double", "salary_max": "double", "salary_present": "boolean",
            "location_is_object": "boolean", "location_present": "boolean"}.get(c, "string")


def passes(spark, rows, **criteria):
    df = postings(spark, rows)
    out = flt.apply_filters(df, flt.Criteria(**criteria), AS_OF)
    return sorted(r["seq"] for r in out.select("seq").collect())


def sal(seq, lo, hi, cur="EUR", period="annual"):
    lo, hi = (None if lo is None else float(lo)), (None if hi is None else float(hi))
    return {"seq": seq, "salary_present": True, "salary_min": lo, "salary_max": hi, "salary_currency": cur,
            "salary_period": period}


def test_salary_overlap_golden(spark):
    rows = [sal(1, 50000, 70000), sal(2, 30000, 45000), sal(3, 75000, 95000), sal(4, 20000, 35000),
            sal(5, 90000, 120000)]
    assert passes(spark, rows, salary_min=40000, salary_max=80000) == [1, 2, 3]


def test_salary_period_and_missing(spark):
    rows = [sal(1, 4000, None, period="monthly"),     # 48,000 a year
            sal(2, 30, None, period="hourly"),         # 62,400 a year
            {"seq": 3},                                # no salary
            sal(4, 10, 20, cur="USD"),                 # other currency passes
            sal(5, 0, None),                           # 0 is missing
            sal(6, 1000, None)]
    assert passes(spark, rows, salary_min=45000) == [1, 2, 3, 4, 5]
    assert passes(spark, rows, salary_max=50000) == [1, 3, 4, 5, 6]


def test_job_type_case_sensitive_experience_not(spark):
    rows = [{"seq": 1, "job_type": "full-time"}, {"seq": 2, "job_type": " Full-time "},
            {"seq": 3, "experience_level": "senior"}]
    assert passes(spark, rows, job_types=["Full-time"]) == [2]
    assert passes(spark, rows, experience_levels=["Senior"]) == [3]


def test_posted_date(spark):
    rows = [{"seq": 1, "posted_date": "20/11/2025"}, {"seq": 2}, {"seq": 3, "posted_date": "2025-11-20T10:00:00Z"},
            {"seq": 4, "posted_date": "2025-01-01"}, {"seq": 5, "posted_date": "2025-11-21 08:00:00"}]
    assert passes(spark, rows, posted_days=7) == [1, 2, 3, 5]


def test_keywords_words_apart_and_description(spark):
    rows = [{"seq": 1, "job_title": "gear, dark red"}, {"seq": 2, "job_title": "blue gear"},
            {"seq": 3, "job_title": "x", "job_description": "we need a RED GEAR person"}]
    assert passes(spark, rows, keywords=["red gear"]) == [1, 3]


def test_cities_equality_on_city_substring_on_value(spark):
    rows = [{"seq": 1, "location_is_object": True, "location_present": True, "location_city": "Vienna West"},
            {"seq": 2, "location_is_object": True, "location_present": True, "location_city": "vienna"},
            {"seq": 3, "location_is_object": False, "location_present": True, "location_text": "Greater Vienna"},
            {"seq": 4, "location_is_object": True, "location_present": True, "location_city": "X",
             "location_text": "near Vienna"}]
    assert passes(spark, rows, cities=["Vienna"]) == [2, 3, 4]


def test_no_criteria_passes_with_score_100(spark):
    df = postings(spark, [{"seq": 1}, {"seq": 2, "title": "x"}])
    out = flt.apply_filters(df, flt.Criteria(), AS_OF).collect()
    assert [r["filter_match"]["match_score"] for r in out] == [100, 100]


def test_location_type_falls_back_to_object_type(spark):
    rows = [{"seq": 1, "location_is_object": True, "location_type": "Remote"}, {"seq": 2, "remote_policy": "hybrid"},
            {"seq": 3, "location_is_object": False, "location_type": "remote"}]
    assert passes(spark, rows, location_type=["remote"]) == [1]


@pytest.mark.parametrize("stage,expected", [(0, 1001), (1, 427), (2, 213), (3, 132), (4, 18), (5, 13)])
def test_fixture_survivors_by_stage(spark, stage, expected):
    from hirelake.catalog.queries import AS_OF as FIX_AS_OF, SAMPLE_SEARCH
    from hirelake.sources.views import postings_v1
    df = postings_v1(spark, SF001)
    preds = flt.predicates(df, SAMPLE_SEARCH, FIX_AS_OF)
    cond = preds[0][2]
    for _, _, p in preds[1:stage + 1]:
        cond = cond & p
    assert df.where(cond).count() == expected


def test_filter_plan_has_no_exchange(spark):
    from hirelake.catalog.queries import AS_OF as FIX_AS_OF, SAMPLE_SEARCH
    df = postings(spark, [{"seq": 1}])
    plan = flt.apply_filters(df, SAMPLE_SEARCH, FIX_AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
