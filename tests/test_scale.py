"""Steps that must not grow faster than their input."""

import glob
import json
import random
import re
from datetime import datetime
from difflib import SequenceMatcher

from pyspark.sql import functions as F
from test_searches import _criteria, _postings

from hirelake.catalog import queries
from hirelake.functions.similarity import char_profile
from hirelake.operators import dedup, quality, relevance, searches, simjoin
from hirelake.sources import ingest
from hirelake.sources.schema import conform

AS_OF = datetime(2024, 6, 1)


def test_titles_meet_as_rows_and_no_similar_pair_is_lost(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "TITLE_BLOCK", 4)
    rnd = random.Random(3)
    stems = ["senior data engineer in wien 24", "straßenbahn fahrer graz", "cook", "c"]
    titles = sorted({"".join(ch for ch in rnd.choice(stems) if rnd.random() > 0.15) for _ in range(40)} - {""})
    ids = spark.createDataFrame(list(enumerate(titles)), "id bigint, s string")
    keys = [(i % 3, i) for i in range(len(titles))]
    companies = [(0, 0), (1, 1), (2, 2), (0, 1), (1, 0)]
    got = simjoin.title_candidates(spark.createDataFrame(keys, "cid bigint, tid bigint"), ids, spark.createDataFrame(companies, "x bigint, y bigint")).collect()
    found = {tuple(r) for r in got}
    want = {(*a, *b) for a in keys for b in keys if a < b and (a[0], b[0]) in companies
            and SequenceMatcher(None, titles[a[1]], titles[b[1]]).ratio() >= simjoin.TITLE_MIN}
    assert len(got) == len(found) and want <= found and len(want) > 10
    assert ids.select(F.aggregate(char_profile(F.col("s")), F.lit(0), lambda a, x: a + x) == F.length("s")).distinct().collect() == [(True,)]


def _edges(spark, edges):
    return spark.createDataFrame([(g, f"dup_{g:03d}", "fuzzy_match", 90, c, f"m{c}", d, f"m{d}", f"s{d}") for g, c, d in edges],
                                 "group_seq bigint, group_id string, strategy string, confidence int, canonical_seq bigint, canonical_id string, "
                                 "dup_seq bigint, dup_id string, dup_session string")


def test_merged_postings_list_their_urls_and_sessions(spark):
    postings = conform(spark.createDataFrame([(0, "m0", None, "s0"), (1, "m1", "u1", "s1"), (2, "m2", "u2", "s0")], "seq bigint, master_id string, url string, session string"))
    unique = queries._unique_out(dedup.merge_duplicates(postings, _edges(spark, [(1, 0, 1), (1, 0, 2)]))["unique"]).collect()
    assert [(r["seq"], r["duplicate_urls"], r["session_sources"], r["n_urls"]) for r in unique] == [(0, "<null>,u1,u2", "s0,s1", 3)]


def test_an_edge_is_settled_once(spark, monkeypatch):
    written = []
    cut = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: (lambda out: (written.append(out.count()), out)[1])(cut(df)))
    edges = [(i + 1, i + 1, i) for i in range(4)] + [(100 + i, 1000 + i, 2000 + i) for i in range(200)]   # a chain, and edges that wait for none
    own = spark.createDataFrame([(0, "a@x.at")], "seq bigint, own_contact_email string").select(
        "seq", *[F.col("own_contact_email") if f == "contact_email" else F.lit(None).cast("string").alias(f"own_{f}") for f in dedup.FILL_FIELDS])
    got = {r["c"]: r["first_contact_email"] for r in dedup.fold_fills(_edges(spark, edges), own).collect()}
    assert got[4]["v"] == "a@x.at" and len(got) == 204
    assert sum(written) == 204 + 204 + 3 + 2 + 1   # stored once, then only those that still wait


def test_arrivals_are_files_of_bounded_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "ARRIVAL_ROWS", 10)
    records = spark.createDataFrame([(s, f"{i:03d}.json", 0, json.dumps({"id": f"{s}{i}", "title": f"t{i}", "company": {"name": s}, "location": {"city": "Wien"}}))
                                     for s, n in (("a", 45), ("b", 3)) for i in range(n)], "session string, source_file string, pos int, value string")
    monkeypatch.setattr("hirelake.sources.views.raw_postings_v2", lambda *_: records)
    monkeypatch.setattr("hirelake.session.checkpoint_root", lambda _: str(tmp_path))
    rows = queries.ingest_stream(spark, "").collect()
    assert sorted((r["master_id"], r["id"]) for r in rows) == [(f"master_{n:05d}", i) for n, i in enumerate(
        [f"a{i}" for i in range(45)] + [f"b{i}" for i in range(3)], 1)]
    files = glob.glob(f"{tmp_path}/sessions-*/in/arrival=00000/part-*")
    assert len(files) == 5 and all(spark.read.parquet(f).count() <= 12 for f in files)


def test_a_page_is_stripped_once(spark):
    pages = spark.createDataFrame([(1, "<p>Position: cook</p>"), (2, None), (3, "<p>none</p>")], "page_id bigint, html string")
    fields = quality.alias_fields(pages.select("page_id", quality.strip_tags(F.col("html")).alias("text")), "page_id", "text")
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("(script|style)[^>]*>.*?") == 1
    assert {(r["page_id"], r["value"]) for r in fields.collect()} == {(1, "cook")}


def test_runs_of_words_are_matched_where_they_arise(spark, monkeypatch):
    texts = conform(spark.createDataFrame([(1, "red gear box and red"), (2, "box"), (3, None)], "seq bigint, job_description string"))
    skills = spark.createDataFrame([(1, "red"), (2, "red gear"), (3, "box and red"), (4, "gear box"), (5, "")], "skill_id int, skill string")
    found = relevance.skills_found(texts, skills)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    want = {(1, 2, 1), (1, 3, 1)}
    assert {tuple(r) for r in found.collect()} == want
    monkeypatch.setattr(relevance, "BROADCAST_PHRASES", 0)
    assert {tuple(r) for r in relevance.skills_found(texts, skills).collect()} == want


def test_no_text_meets_a_search_and_blocks_lose_none(spark, monkeypatch):
    rnd = random.Random(9)
    postings = _postings(spark, rnd, 30)
    table = searches.searches_table(spark, {f"s{i}": _criteria(rnd) for i in range(12)})
    whole = searches.match_searches(postings, table, AS_OF)
    assert "job_description" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(searches, "BLOCK", 2)
    blocks = searches.match_searches(postings, table, AS_OF)
    rows = lambda df: sorted((r["search_id"], r["seq"]) for r in df.collect())
    assert rows(whole) == rows(blocks) and len(rows(whole)) > 10


def test_word_sets_meet_as_rows_of_postings(spark, monkeypatch):
    monkeypatch.setattr(dedup, "OVERLAP_BLOCK", 4, raising=False)
    written = []
    cut = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: (lambda out: (written.append(out.count()), out)[1])(cut(df)))
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rnd.choices(words, k=rnd.randint(1, 40))) for i in range(42)} | {7: None, 8: "", 9: " .,- ", 41: None}
    pairs = [(i, 0) for i in range(1, 31)] + [(i, 31) for i in range(32, 36)] + [(40, 41)]   # 30 duplicates of one posting
    got = dedup.word_overlap(spark.createDataFrame(list(texts.items()), "seq bigint, description string"), spark.createDataFrame(pairs, "seq bigint, canon_seq bigint")).collect()

    def jaccard(a, b):
        a, b = (set((texts[i] or "").replace(".,-", " ").split()) for i in (a, b))
        return len(a & b) / len(a | b) if a & b else 0.0
    assert sorted((r["seq"], r["canon_seq"], round(r["similarity"], 12)) for r in got) == sorted((a, b, round(jaccard(a, b), 12)) for a, b in pairs)
    # a row per duplicate with a text, and per 4 duplicates of a canonical with one: none per word
    assert written == [len(pairs) - 2 + 8 + 1]


def test_a_view_text_is_stored_once(spark):
    postings = conform(spark.createDataFrame([(1, "t", "d"), (2, None, None)], "seq bigint, title string, description string").withColumns({"job_title": F.col("title"), "job_description": F.col("description")}))
    stored = queries._stored(postings, same={"job_title": "title", "job_description": "description"})
    assert stored.columns == postings.columns and stored.orderBy("seq").collect() == postings.orderBy("seq").collect()
    file = stored.inputFiles()[0].removeprefix("file:")
    assert "job_description" not in spark.read.parquet(file).columns


def test_merge_values_explodes_members_only(spark):
    postings = conform(spark.createDataFrame([(i, f"u{i}", f"s{i % 2}", f"o{i}") for i in range(6)], "seq bigint, url string, session string, original_id string"))
    values = dedup.merge_values(postings, spark.createDataFrame([(3, 1), (3, 2)], "canonical_seq bigint, dup_seq bigint")).collect()
    assert sorted((r["seq"], r["kind"], r["position"], r["value"]) for r in values) == [
        (3, "original_id", 0, "o3"), (3, "original_id", 1, "o1"), (3, "original_id", 2, "o2"),
        (3, "session", 0, "s1"), (3, "session", 1, "s0"), (3, "url", 0, "u3"), (3, "url", 1, "u1"), (3, "url", 2, "u2")]


def test_a_field_of_a_record_is_taken_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    rows = spark.createDataFrame([("s", "1.json", 0, '{"data": {"description": {"value": "x"}, "link": "u", "location": {"city": "c"}}, "url": "r"}'),
                                  ("s", "2.json", 0, '{"job": {"description": "y", "location": "l"}, "url": "r"}'), ("s", "3.json", 0, '{"description": "z", "location": null}')],
                                 "session string, source_file string, pos int, value string")
    raw = ingest.raw_from_strings(rows)
    flat = ingest.flattened(ingest.ingest(raw))
    assert [(r["description"], r["url"], r["location_city"], r["location_text"]) for r in flat.orderBy("seq").collect()] == [("x", "u", "c", None), ("y", "r", None, "l"), ("z", None, None, None)]
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("$.description") == 1 and plan.count("$.contactEmail") == 1


def test_quality_report_moves_no_texts(spark):
    rows = spark.createDataFrame([(i, f"m{i}", f"s{i % 2}", f"http://x/{i // 2}", "t", None if i % 3 else "some text", None if i % 2 else f"a{i}@x.org") for i in range(12)],
                                 "seq bigint, master_id string, session string, url string, title string, description string, contact_email string")
    postings = dedup.cut_lineage(conform(rows))
    merged = dedup.merge_duplicates(postings, dedup.detect_duplicates(postings))
    report = dedup.quality_improvement(merged)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.split("\n") if "Project [" in line and re.search(r"[\[ ]description#\d+[,\]]", line)]
    assert "description" in plan and not moved
    got = {r["metric"]: (r["before"], r["after"]) for r in report.collect()}
    # title, url groups of two: 4 of 12 described before; the first described of a pair, else the first, is kept; emails are filled
    assert got["contactEmail"] == (50.0, 100.0) and got["completeness"][0] == 22.9
    assert merged["unique"].columns == [c for c in merged["after"].columns if not c.endswith("_filled")]


def test_words_are_cut_where_they_meet(spark, monkeypatch):
    stored = []
    cut = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: (stored.extend(f.dataType.typeName() for f in df.schema.fields), cut(df))[1])
    texts = spark.createDataFrame([(1, "A b, c"), (1, "b d"), (2, "a\tB"), (3, "z"), (4, None)], "seq bigint, description string")   # a repeated key
    pairs = spark.createDataFrame([(2, 1), (2, 1), (3, 1), (3, 4), (None, 1), (3, None)], "seq bigint, canon_seq bigint")
    got = dedup.word_overlap(texts, pairs).collect()
    assert not {"array", "string"} & set(stored)   # counts only, neither texts nor their words
    # the words of 2 meet both texts of 1: 2 + 1 common, twice, of 2 and 3 + 2 words
    assert sorted((r["seq"] or 0, r["canon_seq"] or 0, r["similarity"]) for r in got) == [
        (0, 1, 0.0), (2, 1, 6.0), (2, 1, 6.0), (3, 0, 0.0), (3, 1, 0.0), (3, 4, 0.0)]


def test_words_of_a_text_in_one_pass(spark):
    from hirelake.functions.text import normalize_text, text_words, word_set
    odd = [None, "", " .,- ", "Word's under_score a-b a", "\u0130stanbul \u03a3\u0391\u03a3 1\u00bd \u2167", "x\x85y\x0bz\u200bq \u3001\u65e5\u672c ", "\U0001d7d8z \U0001F600 K."]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(text_words(F.col("t")).alias("a"), word_set(normalize_text(F.col("t"))).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[3]["a"] == ["word", "s", "under_score", "a", "b"]


def test_flattened_ingest_stores_no_records(spark, monkeypatch):
    stored = []
    cut = ingest.cut_lineage
    monkeypatch.setattr(ingest, "cut_lineage", lambda df: (stored.append(dict(df.dtypes)), cut(df))[1])
    texts = ['{"job": {"id": 1, "title": "a", "description": "d", "location": {"city": "x"}}}', '{"data": {"title": {"value": "b"}, "salary": {"min": 1}}, "url": "u"}',
             '{"uid": "z", "title": "c", "company": {"name": "n"}, "requirements": ["r"]}', "[1]", "no record"]
    rows = [("s", f"f{i}", 0, t) for i, t in enumerate(texts)] + [("s", "f0", 0, texts[0]), (None, None, 0, texts[2])]   # repeated and null keys
    raw = ingest.raw_from_strings(spark.createDataFrame(rows, "session string, source_file string, pos int, value string"))
    got = ingest.ingest_flattened(raw)
    assert len(stored) == 1 and "variant" not in stored[0].values()
    want = ingest.flattened(ingest.ingest(raw)).drop("raw", "extraction_metadata")
    assert sorted(got.dtypes) == sorted(want.dtypes)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
