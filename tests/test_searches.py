"""Saved searches as a table: the index against the filter, one search at a time."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hirelake.operators import filters, searches
from hirelake.sources.schema import conform

AS_OF = datetime(2024, 6, 1, 12, 30)
WORDS = ["red", "gear", "gears", "Ring", "x", "Übung", "data analyst", "ana", "c++", ""]


def _postings(spark, rnd, n=60):
    pick = lambda *v: rnd.choice([None, "", *v])
    rows = []
    for i in range(1, n + 1):
        title = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 3))) if rnd.random() > 0.1 else None
        is_object = rnd.random() < 0.5
        rows.append((i, f"p{i}", title, "Acme", title, pick("we build Gearboxes", "ring the  bell", "analysts"), pick(" Full-time ", "Contract"),
                     pick("Senior", "junior"), pick("Remote", "hybrid"), pick("on-site"), is_object, rnd.random() < 0.8, pick("Wien", "Graz") if is_object else None,
                     pick("Wien, Austria", "Linz"), pick("Acme GmbH", "ACME", "Globex"), pick("2024-05-31T10:00", "2024-05-01", "1999-01-01", "soon", "2024-06-01 12:29:00"),
                     rnd.random() < 0.7, rnd.choice([None, 0.0, 3000.0, 50000.0]), rnd.choice([None, 0.0, 6000.0, 90000.0]), pick("EUR", "usd"), pick("monthly", "annual")))
    return conform(spark.createDataFrame(rows, (
        "seq bigint, id string, title string, company string, job_title string, job_description string, job_type string, experience_level string, "
        "remote_policy string, location_type string, location_is_object boolean, location_present boolean, location_city string, location_text string, "
        "company_text string, posted_date string, salary_present boolean, salary_min double, salary_max double, salary_currency string, salary_period string")))


def _criteria(rnd):
    some = lambda p, v: v if rnd.random() < p else None
    sample = lambda *v: rnd.sample(v, rnd.randint(1, len(v)))
    return filters.Criteria(
        keywords=some(0.5, rnd.sample(WORDS[:-1], rnd.randint(1, 2)) + ([" "] if rnd.random() < 0.1 else [])) or [],
        location_type=some(0.3, sample("remote", "On-site")) or [], salary_min=some(0.3, 40000), salary_max=some(0.3, 80000),
        salary_currency=rnd.choice(["EUR", "usd"]), experience_levels=some(0.3, sample("SENIOR", "junior")) or [],
        job_types=some(0.3, sample("Full-time", "Contract")) or [], cities=some(0.3, sample("wien", "Graz", "aust", "")) or [],
        company_contains=some(0.3, rnd.choice(["acme", "GmbH", "zzz", "o"])), posted_days=some(0.3, rnd.choice([1, 2, 40, 20000])),
        expand_city_aliases=rnd.random() < 0.3)


def test_the_index_finds_what_the_filter_finds(spark):
    rnd = random.Random(4)
    postings = _postings(spark, rnd).cache()
    named = {f"s{i}": _criteria(rnd) for i in range(40)} | {"all": filters.Criteria(), "paid": filters.Criteria(salary_min=40000)}
    got = searches.match_searches(postings, searches.searches_table(spark, named), AS_OF).collect()
    assert len(got) == len({(r["search_id"], r["seq"]) for r in got})
    found = {name: {r["seq"] for r in got if r["search_id"] == name} for name in named}
    flags = [F.expr("true").alias("_")]
    for name, c in named.items():
        keep = F.lit(True)
        for _, _, p in filters.predicates(postings, c, AS_OF):
            keep = keep & p
        flags.append(keep.alias(name))
    rows = postings.select("seq", *flags).collect()
    want = {name: {r["seq"] for r in rows if r[name]} for name in named}
    assert found == want
    assert len(want["all"]) == 60 and sum(0 < len(v) < 60 for v in want.values()) > 15


def test_substrings_are_found_by_their_rarest_gram(spark):
    rnd = random.Random(2)
    hays = sorted({"".join(rnd.choice("abcä ") for _ in range(rnd.randint(0, 9))) for _ in range(200)})
    needles = sorted({"".join(rnd.choice("abcä ") for _ in range(rnd.randint(0, 5))) for _ in range(80)})
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "s string")
    got = {(r["needle"], r["hay"]) for r in searches.substring_pairs(frame(needles), frame(hays)).collect()}
    assert got == {(n, h) for n in needles for h in hays if n and n in h}


def test_no_searches_no_postings_and_the_option_without_a_table_form(spark):
    postings = _postings(spark, random.Random(1), 3)
    table = searches.searches_table(spark, {"a": filters.Criteria(keywords=["red"])})
    assert searches.match_searches(postings, table.limit(0), AS_OF).count() == 0
    assert searches.match_searches(postings.limit(0), table, AS_OF).count() == 0
    only_ids = spark.createDataFrame([("x",)], "search_id string")
    assert searches.match_searches(postings, only_ids, AS_OF).count() == 3
    with pytest.raises(ValueError):
        searches.searches_table(spark, {"a": filters.Criteria(keywords=["red"], keyword_similarity=True)})
