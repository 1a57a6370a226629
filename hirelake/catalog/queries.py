"""Registered report queries: each is ``(spark, sf_dir) -> DataFrame`` over the
driver tables, with computed columns aliased to match the DuckDB oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators import filters as flt
from hirelake.sources.views import postings_v1

# Sample search of the fixtures (FIXTURES.md, part B).
SAMPLE_SEARCH = flt.Criteria(
    job_types=["Full-time", "Part-time", "Contract"],
    experience_levels=["Senior", "Mid-Level", "Lead"],
    location_type=["remote", "hybrid"],
    posted_days=1500,
    keywords=["widget", "red gear"],
    salary_min=40000.0,
    salary_max=500000.0,
    salary_currency="USD",
)
AS_OF = datetime(2001, 8, 1)

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ filtering

@register("filter_breakdown")
def filter_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt.cascade_breakdown(postings_v1(spark, sf_dir), SAMPLE_SEARCH, AS_OF)


@register("filter_matches")
def filter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flt.apply_filters(postings_v1(spark, sf_dir), SAMPLE_SEARCH, AS_OF)
    return out.select("seq", "id", "title", "company",
                      F.col("filter_match.match_score").alias("match_score"),
                      F.concat_ws(",", "filter_match.criteria_met").alias("criteria_met"))


@register("filter_summary")
def filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt.filter_summary(postings_v1(spark, sf_dir), SAMPLE_SEARCH, AS_OF)


@register("filter_top10")
def filter_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt.top_matches(flt.apply_filters(postings_v1(spark, sf_dir), SAMPLE_SEARCH, AS_OF), 10)


@register("filter_partial")
def filter_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flt.partial_matches(postings_v1(spark, sf_dir), SAMPLE_SEARCH, AS_OF, min_score=50)
    return out.select("seq", F.concat_ws(",", "criteria_met").alias("criteria_met"),
                      F.concat_ws(",", "criteria_failed").alias("criteria_failed"), "match_score")


# ------------------------------------------------------------------ keep-first consolidation

def _keepfirst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.keepfirst import keep_first
    return keep_first(postings_v1(spark, sf_dir))


@register("keepfirst_rows")
def keepfirst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keepfirst(spark, sf_dir).select("seq", "status", "duplicate_reason", "fuzzy_key")


@register("keepfirst_stats")
def keepfirst_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.keepfirst import consolidation_stats
    return consolidation_stats(_keepfirst(spark, sf_dir))


@register("keepfirst_by_reason")
def keepfirst_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.keepfirst import duplicates_by_reason
    return duplicates_by_reason(_keepfirst(spark, sf_dir))


@register("keepfirst_sessions")
def keepfirst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.keepfirst import session_counts
    return session_counts(postings_v1(spark, sf_dir))


# ------------------------------------------------------------------ entity resolution (J1 + J2 on V1)

def _stored(postings: DataFrame, same: dict[str, str] | None = None) -> DataFrame:
    """A fixture view as the stored posting table that a job reads. ``same``: columns that the view fills from another
    one; such a text is stored once."""
    from hirelake.session import cut_lineage
    same = same or {}
    stored = cut_lineage(postings.drop(*same))
    return stored.select(*[F.col(same.get(c, c)).alias(c) for c in postings.columns])


def _edges_v1(spark: SparkSession, sf_dir: str):
    from hirelake.operators import dedup
    postings = _stored(dedup.with_filled(postings_v1(spark, sf_dir)), same={"job_title": "title", "job_description": "description"})
    return postings, dedup.detect_duplicates(postings, fuzzy=False)


def _dedup_v1(spark: SparkSession, sf_dir: str):
    from hirelake.operators import dedup
    postings, edges = _edges_v1(spark, sf_dir)
    return postings, edges, dedup.merge_duplicates(postings, edges, as_of=AS_OF)


@register("dedup_groups")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _edges_v1(spark, sf_dir)
    return edges.select("group_id", "strategy", "canonical_id", "dup_id", "confidence", "description_similarity")


@register("dedup_matched_fields")
def dedup_matched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicates list: each duplicate with its session and the fields that matched."""
    from hirelake.operators.dedup import matched_fields
    _, edges = _edges_v1(spark, sf_dir)
    return edges.select("group_id", "dup_id", "dup_session", F.concat_ws(",", matched_fields(F.col("strategy"))).alias("matched_fields"))


@register("dedup_merge_values")
def dedup_merge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls, sessions and original ids of merged postings, in the order they are first seen."""
    return _dedup_v1(spark, sf_dir)[2]["values"]


@register("dedup_unique")
def dedup_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique_out(_dedup_v1(spark, sf_dir)[2]["unique"])


def _nulls_marked(c):
    return F.when(c.isNotNull(), F.concat_ws(",", F.transform(c, lambda x: F.coalesce(x, F.lit("<null>")))))


def _unique_out(u: DataFrame) -> DataFrame:
    m = F.col("duplicate_metadata")
    return u.select("seq", "master_id", "contact_email", "contact_email_source", "salary_present",
                    "salary_min", "salary_source",
                    m["duplicate_count"].cast("bigint").alias("duplicate_count"),
                    m["merge_strategy"].alias("merge_strategy"), m["merge_confidence"].alias("merge_confidence"),
                    m["merge_group_id"].alias("merge_group_id"), m["merge_date"].cast("string").alias("merge_date"),
                    _nulls_marked(m["duplicate_urls"]).alias("duplicate_urls"), _nulls_marked(m["session_sources"]).alias("session_sources"),
                    *[m[c].cast("bigint").alias(c) for c in ("n_urls", "n_sessions", "n_original_ids")])


@register("dedup_summary")
def dedup_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.dedup import dedup_summary
    postings, _, merged = _dedup_v1(spark, sf_dir)
    return dedup_summary(postings, merged)


@register("dedup_strategy")
def dedup_strategy_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.dedup import strategy_stats
    postings, _, merged = _dedup_v1(spark, sf_dir)
    return strategy_stats(postings, merged)


@register("dedup_quality")
def dedup_quality_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.dedup import quality_improvement
    _, _, merged = _dedup_v1(spark, sf_dir)
    return quality_improvement(merged)


# ------------------------------------------------------------------ entity resolution on text postings (V3)

def _dedup_v3(spark: SparkSession, sf_dir: str, fuzzy: bool):
    from hirelake.operators import dedup
    from hirelake.sources.views import text_postings_v3
    postings = _stored(text_postings_v3(spark, sf_dir))
    edges = dedup.detect_duplicates(postings, fuzzy=fuzzy)
    return postings, edges


@register("dedup_text_composite")
def dedup_text_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _dedup_v3(spark, sf_dir, fuzzy=False)
    return edges.select("group_id", "strategy", "canonical_id", "dup_id", "confidence", "description_similarity")


@register("dedup_fuzzy_groups")
def dedup_fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2 + J3 (blocked similarity join)."""
    _, edges = _dedup_v3(spark, sf_dir, fuzzy=True)
    return edges.select("group_id", "strategy", "canonical_id", "dup_id", "confidence", "description_similarity",
                        "sim_company", "sim_title", "sim_location")


def _dedup_sites(spark: SparkSession, sf_dir: str):
    """The fuzzy run over text postings of which those of two-digit sources name their site as the location."""
    from hirelake.operators import dedup
    from hirelake.sources.views import text_postings_v3
    site = F.when(F.length("session") == 4, F.col("location")).otherwise(F.col("session"))
    postings = _stored(text_postings_v3(spark, sf_dir).withColumns({"location": site, "location_text": site}))
    edges = dedup.detect_duplicates(postings, fuzzy=True)
    return dedup.review_queue(dedup.group_table(edges), edges=edges)


@register("dedup_fuzzy_review")
def dedup_fuzzy_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20 + W5: review queue of a fuzzy run (groups with 60 <= confidence < 85), with the ids of the duplicates."""
    return _dedup_sites(spark, sf_dir).drop("group_seq").withColumn("duplicate_ids", F.concat_ws(",", "duplicate_ids"))


@register("dedup_review_reasons")
def dedup_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items by reason."""
    from hirelake.operators.dedup import review_reasons
    return review_reasons(_dedup_sites(spark, sf_dir))


@register("dedup_fuzzy_summary")
def dedup_fuzzy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators import dedup
    postings, edges = _dedup_v3(spark, sf_dir, fuzzy=True)
    return dedup.dedup_summary(postings, dedup.merge_duplicates(postings, edges))


# ------------------------------------------------------------------ ingest of raw JSON records (V2)

def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.sources.ingest import ingest, raw_from_strings
    from hirelake.sources.views import raw_postings_v2
    return ingest(raw_from_strings(raw_postings_v2(spark, sf_dir)))


@register("ingest_postings")
def ingest_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 over the three record shapes must give back the V1 columns; P4 numbers in load order."""
    return _ingested(spark, sf_dir).select("master_id", "id", "url", "title", "company", "location", "session",
                                           "shape", "original_id")


@register("ingest_filter_fields")
def ingest_filter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's view of ingested records: only nested-job records carry ``raw.job``."""
    return flt.cascade_breakdown(_ingested(spark, sf_dir), SAMPLE_SEARCH, AS_OF)


def _dedup_ingested(spark: SparkSession, sf_dir: str):
    from hirelake.operators import dedup
    from hirelake.sources.ingest import ingest_flattened, raw_from_strings
    from hirelake.sources.views import raw_records_v2b
    postings = _stored(ingest_flattened(raw_from_strings(raw_records_v2b(spark, sf_dir))))
    edges = dedup.detect_duplicates(postings, fuzzy=False)
    return postings, edges


def _merged_ingested(spark: SparkSession, sf_dir: str):
    from hirelake.operators import dedup
    return dedup.merge_duplicates(*_dedup_ingested(spark, sf_dir), as_of=AS_OF)


@register("dedup_ingested_groups")
def dedup_ingested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2 over the flattened record of ingested JSON."""
    _, edges = _dedup_ingested(spark, sf_dir)
    return edges.select("group_id", "strategy", "canonical_id", "dup_id", "confidence", "description_similarity")


@register("dedup_ingested_unique")
def dedup_ingested_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique_out(_merged_ingested(spark, sf_dir)["unique"])


@register("dedup_ingested_merge_values")
def dedup_ingested_merge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 on ingested records: the url under any of its names (P7), original ids from the record or its file."""
    return _merged_ingested(spark, sf_dir)["values"]


# ------------------------------------------------------------------ session master indexes (A3-A5)

@register("index_entries")
def index_entries_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.index import index_entries
    return index_entries(_ingested(spark, sf_dir)).select("index_name", "key", "master_id")


@register("index_pages")
def index_pages_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 export: ids per key in load order, in pages of 25."""
    from hirelake.operators.index import compact_index, index_entries
    from hirelake.session import cut_lineage
    pages = compact_index(cut_lineage(index_entries(_ingested(spark, sf_dir))), page_size=25)
    return pages.select("index_name", "key", "page", "first_seq", F.concat_ws(",", "master_ids").alias("master_ids"))


@register("index_summary")
def index_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.index import index_entries, index_summary
    return index_summary(index_entries(_ingested(spark, sf_dir)))


@register("index_original_to_master")
def index_original_to_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.index import original_to_master
    return original_to_master(_ingested(spark, sf_dir))


@register("master_totals")
def master_totals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.index import master_totals
    from hirelake.sources.ingest import raw_from_strings, session_stats
    from hirelake.sources.views import raw_postings_v2
    raw = raw_from_strings(raw_postings_v2(spark, sf_dir))
    sessions = raw.select("session").distinct()
    return master_totals(session_stats(raw, sessions), _ingested(spark, sf_dir))


# ------------------------------------------------------------------ application tracker (V4)

def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.tracker import tracker_state
    from hirelake.sources.views import tracker_events_v4
    return tracker_state(tracker_events_v4(spark, sf_dir))


def _tracker_out(state: DataFrame) -> DataFrame:
    return state.select("session", "job_id", "company", "title", "status", "directory",
                        _ts(F.col("created_at")).alias("created_at"), _ts(F.col("updated_at")).alias("updated_at"),
                        F.col("extra")["k"].alias("extra_k"))


@register("tracker_state")
def tracker_state_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker_out(_tracker(spark, sf_dir))


@register("tracker_stats")
def tracker_stats_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.tracker import session_statistics
    from hirelake.sources.views import tracker_events_v4
    sessions = tracker_events_v4(spark, sf_dir).groupBy("session").agg(
        F.count_distinct("job_id").alias("total_jobs"))
    return session_statistics(_tracker(spark, sf_dir), sessions)


@register("tracker_failed")
def tracker_failed_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.tracker import failed_applications
    return _tracker_out(failed_applications(_tracker(spark, sf_dir)))


@register("tracker_stream_state")
def tracker_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 through Structured Streaming (availableNow over the events file, foreachBatch
    fold into a state table in the checkpoint folder); must equal the batch state."""
    import uuid

    from hirelake.session import checkpoint_root
    from hirelake.sources.views import events_to_tracker
    from hirelake.streaming.tracker import read_state, run_tracker_stream
    base = f"{checkpoint_root(spark).rstrip('/')}/tracker-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    _arrivals(events, "event_id", f"{base}/in", parts=3)
    stream = events_to_tracker(_arriving(spark, events.schema, f"{base}/in"))
    run_tracker_stream(stream, f"{base}/state", f"{base}/checkpoint", buckets=16)
    return _tracker_out(read_state(spark, f"{base}/state"))


# ------------------------------------------------------------------ streaming consolidation and alerts

#: Rows of a file of the staged arrivals: a task writes one file, so what it reads does not grow with the input.
ARRIVAL_ROWS = 50_000


def _arrivals(df: DataFrame, order: str, path: str, parts: int) -> None:
    """Writes ``df`` as ``parts`` arrivals one after the other, in ranges of ``order``. An arrival is as many files as its rows ask for; all arrivals
    have the same number, so that a trigger takes one arrival."""
    cuts = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    files = max(1, -(-df.count() // (parts * ARRIVAL_ROWS)))
    edges = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        some = df if low is None else df.where(F.col(order) > low)
        some = some if high is None else some.where(F.col(order) <= high)
        some.repartition(files).write.parquet(f"{path}/files={files}/arrival={i:05d}")


def _arriving(spark: SparkSession, schema, path: str) -> DataFrame:
    """The arrivals as a stream, one to a batch."""
    files = int(spark.read.parquet(path).select("files").first()[0])
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path))


def _postings_stream(spark: SparkSession, sf_dir: str, parts: int = 4):
    """V1 postings as a file stream in ``parts`` arrivals, in seq order."""
    import uuid

    from hirelake.session import checkpoint_root
    base = f"{checkpoint_root(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    v1 = _stored(postings_v1(spark, sf_dir))
    _arrivals(v1, "seq", f"{base}/arrivals", parts)
    return _arriving(spark, v1.schema, f"{base}/arrivals"), base


@register("keepfirst_stream")
def keepfirst_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: keep-first over micro-batches equals the one-shot run."""
    from hirelake.streaming.consolidate import run_consolidation_stream
    stream, base = _postings_stream(spark, sf_dir)
    decided = run_consolidation_stream(stream, f"{base}/run")
    return decided.select("seq", "status", "duplicate_reason", "fuzzy_key")


@register("ingest_stream")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 + T4: JSON records arriving in sorted parts, numbered over all parts by the ledger; the kept ones decided part by part."""
    import uuid

    from hirelake.session import checkpoint_root
    from hirelake.sources.ingest import raw_from_strings
    from hirelake.sources.views import raw_postings_v2
    from hirelake.streaming import consolidate, sessions
    base = f"{checkpoint_root(spark).rstrip('/')}/sessions-{uuid.uuid4().hex}"
    records = _stored(raw_postings_v2(spark, sf_dir))
    cuts = records.groupBy("session").count().orderBy("session").collect()   # one arrival per session, in order

    def parse(batch: DataFrame):
        rows = raw_from_strings(batch)
        return rows, rows.select("session", "source_file", F.lit("").alias("error")).limit(0)
    decide = consolidate.fold_batch(f"{base}/decided")
    for i, r in enumerate(cuts):   # the stream takes up each arrival, of as many files as its rows ask for, before the next one comes
        some = records.where(F.col("session") == r["session"]).repartition(max(1, -(-r["count"] // ARRIVAL_ROWS)))
        some.write.parquet(f"{base}/in/arrival={i:05d}")
        stream = spark.readStream.schema(records.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        postings = sessions.run_session_stream(stream, f"{base}/run", decide, parse)
    decided = spark.read.parquet(f"{base}/decided").select("seq", "status")
    return postings.join(decided, "seq").select("master_id", "id", "url", "title", "company", "location", "session", "shape", "original_id", "status")


# A second saved search of the fixtures (city, company text and experience).
CITY_SEARCH = flt.Criteria(cities=["NATION_3"], company_contains="Brand#1", experience_levels=["junior", "senior"])


@register("saved_search_alerts")
def saved_search_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings arriving as a stream matched against two saved searches."""
    from hirelake.streaming.alerts import run_alert_stream
    stream, base = _postings_stream(spark, sf_dir)
    return run_alert_stream(stream, {"sample": SAMPLE_SEARCH, "city": CITY_SEARCH}, AS_OF, f"{base}/alerts")


@register("searches_matches")
def searches_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + T3: a table of saved searches (one per customer) matched against all postings."""
    from hirelake.operators.searches import match_searches
    from hirelake.sources.views import saved_searches
    return match_searches(postings_v1(spark, sf_dir), saved_searches(spark, sf_dir), AS_OF).select("search_id", "seq", "match_score")


# ------------------------------------------------------------------ data quality (V2 records, pages, documents)

def _checked(spark: SparkSession, sf_dir: str):
    from hirelake.operators.quality import conformance, rules_table
    records = _ingested(spark, sf_dir).select("seq", "id", "raw")
    return records, conformance(records, rules_table(spark))


@register("quality_conformance")
def quality_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.quality import conformance_summary
    _, checked = _checked(spark, sf_dir)
    return conformance_summary(checked)


@register("quality_grades")
def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.quality import grade_distribution, grades, rules_table
    records, checked = _checked(spark, sf_dir)
    return grade_distribution(grades(checked, records, rules_table(spark)))


@register("quality_extraction")
def quality_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.quality import extraction_quality, grades, rules_table
    records, checked = _checked(spark, sf_dir)
    return extraction_quality(grades(checked, records, rules_table(spark)))


@register("quality_field_stats")
def quality_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.quality import field_statistics
    records, checked = _checked(spark, sf_dir)
    return field_statistics(checked, records)


@register("pages_classified")
def pages_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.quality import classify_pages
    from hirelake.sources.tables import table
    return classify_pages(table(spark, sf_dir, "pages", ["page_id", "url", "html"])).drop("url")


@register("pages_links")
def pages_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.quality import extract_links
    from hirelake.sources.tables import table
    return extract_links(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


@register("pages_link_forms")
def pages_link_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 over pages with links of every form (quotes, case, dots, query only, other schemes, a base)."""
    from hirelake.operators.quality import extract_links
    from hirelake.sources.views import linked_pages
    return extract_links(linked_pages(spark, sf_dir))


@register("quality_structure")
def quality_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 for the members of object fields (salary, contact person)."""
    from hirelake.operators.quality import structure_conformance
    from hirelake.sources.ingest import ingest, raw_from_strings
    from hirelake.sources.views import raw_structured
    return structure_conformance(ingest(raw_from_strings(raw_structured(spark, sf_dir))))


@register("pages_alias_fields")
def pages_alias_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6 over the raw pages and the labelled pages of V5b."""
    from hirelake.operators.quality import alias_fields, strip_tags
    from hirelake.sources.tables import table
    from hirelake.sources.views import labelled_pages
    pages = table(spark, sf_dir, "pages", ["page_id", "html"]).withColumn("origin", F.lit("pages"))
    both = pages.unionByName(labelled_pages(spark, sf_dir).withColumn("origin", F.lit("labelled")))
    texts = both.select(F.concat_ws(":", "origin", "page_id").alias("page"), strip_tags(F.col("html")).alias("text"))
    return alias_fields(texts, "page", "text")


@register("documents_audit")
def documents_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.quality import audit
    from hirelake.sources.tables import table
    return audit(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


# ------------------------------------------------------------------ documented options (ours), queue, J10

SKILLS = ["the", "and", "of the"]
RELEVANCE_QUERY = "widget red gear"


@register("filter_skills_table")
def filter_skills_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 with a skills table: phrases from the documents found in the postings, longest first."""
    from hirelake.operators.relevance import skills_found
    from hirelake.sources.views import skills_from_texts
    return skills_found(postings_v1(spark, sf_dir), skills_from_texts(spark, sf_dir))


@register("filter_skills")
def filter_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """required-skill phrases found in the posting text (>= 70 % kept)."""
    from hirelake.operators.relevance import required_skills
    out = required_skills(postings_v1(spark, sf_dir), SKILLS)
    return out.select("seq", F.concat_ws(",", "skills_matched").alias("skills_matched"), "skills_confidence",
                      "skills_ok")


@register("filter_experience_inferred")
def filter_experience_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experience level, inferred from title, years phrase or salary band when missing."""
    from hirelake.operators.relevance import infer_experience
    return infer_experience(postings_v1(spark, sf_dir)).select("seq", "experience_inferred", "experience_source")


@register("filter_relevance")
def filter_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF relevance of the query terms, postings with a positive score."""
    from hirelake.operators.relevance import keyword_relevance
    out = keyword_relevance(postings_v1(spark, sf_dir), RELEVANCE_QUERY, min_score=1e-12)
    return out.select("seq", F.round("relevance", 6).alias("relevance"))


@register("filter_keyword_similarity")
def filter_keyword_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword test with the title-similarity option."""
    c = flt.Criteria(keywords=["red widget", "gear"], keyword_similarity=True)
    return flt.apply_filters(postings_v1(spark, sf_dir), c, AS_OF).select("seq", "title")


@register("url_queue_first_n")
def url_queue_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8/V5 + O6: the first 20 entries of the page-derived url queue."""
    from hirelake.sources.queue import first_n, queue_from_pages
    from hirelake.sources.tables import table
    return first_n(queue_from_pages(table(spark, sf_dir, "pages", ["page_id", "url", "html"])), 20)


@register("failed_urls")
def failed_urls_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue entries that failed, here those whose url carries tracking parameters."""
    from hirelake.sources.queue import failed_urls, queue_from_pages
    from hirelake.sources.tables import table
    queue = queue_from_pages(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    errors = queue.where(F.contains("url", F.lit("utm_"))).select("url", F.lit("tracking parameters").alias("error"))
    return failed_urls(queue, errors, AS_OF).withColumn("failed_at", F.col("failed_at").cast("string"))


@register("filtered_with_tracker")
def filtered_with_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial matches (score >= 50) joined to the tracker state of V4."""
    from hirelake.operators.tracker import with_tracker
    matched = flt.partial_matches(postings_v1(spark, sf_dir), SAMPLE_SEARCH, AS_OF, min_score=50)
    return with_tracker(matched, _tracker(spark, sf_dir)).select("seq", "id", "match_score", "application_status")


@register("filter_missing_fields")
def filter_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per posting, the fields an active criterion of the sample search needed but it lacks."""
    out = flt.missing_fields(postings_v1(spark, sf_dir), SAMPLE_SEARCH)
    return out.select("seq", F.concat_ws(",", "missing_fields").alias("missing_fields"))


@register("dedup_fill_chain")
def dedup_fill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 over chains of merges (V6): what each canonical is filled with, and from which session."""
    from hirelake.operators.dedup import fold_fills
    from hirelake.sources.views import merge_chains
    edges, own = merge_chains(spark, sf_dir)
    out = fold_fills(edges, own)
    return out.select(F.col("c").alias("canonical_seq"), F.col("first_contact_email.v").alias("contact_email"),
                      F.col("first_contact_email.src").alias("contact_email_source"),
                      F.col("first_salary.v").alias("salary"), F.concat_ws(",", "first_benefits.v").alias("benefits"))


# A third saved search: a city by its other name.
ALIAS_SEARCH = flt.Criteria(cities=["NATION_3", "Munich"], expand_city_aliases=True)


@register("filter_city_aliases")
def filter_city_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city filter with the alias table, over V1 with every seventh posting moved to an aliased city."""
    v1 = postings_v1(spark, sf_dir)
    moved = F.when(F.col("seq") % 7 == 0, F.lit("M\u00fcnchen")).otherwise(F.col("location_city"))
    return flt.apply_filters(v1.withColumn("location_city", moved), ALIAS_SEARCH, AS_OF).select("seq", "location_city")


@register("tracker_lifecycle")
def tracker_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 over V4b: each opened session with its live entries, those added after its last open."""
    from hirelake.operators.tracker import session_lifecycle, tracker_state
    from hirelake.sources.views import tracker_sessions_v4
    events = tracker_sessions_v4(spark, sf_dir)
    live = tracker_state(events).groupBy("session").agg(F.count(F.lit(1)).alias("live"))
    out = session_lifecycle(events).join(live, "session", "left")
    return out.select("session", _ts(F.col("started_at")).alias("started_at"), _ts(F.col("completed_at")).alias("completed_at"),
                      "source_filter", "total_jobs", F.coalesce("live", F.lit(0)).cast("bigint").alias("live"))


@register("tracker_retry")
def tracker_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 over V4b: live failed entries that may be tried again."""
    from hirelake.operators.tracker import retry_list, tracker_state
    from hirelake.sources.views import tracker_sessions_v4
    return retry_list(tracker_state(tracker_sessions_v4(spark, sf_dir))).select("session", "job_id", "title", "status")


# ------------------------------------------------------------------ research rows, progress, dates

@register("research_quality")
def research_quality_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.operators.research import research_quality
    from hirelake.sources.views import brand_research
    return research_quality(brand_research(spark, sf_dir)).select("company", "research_quality")


@register("research_stack_overlap")
def research_stack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: the researched stack named in each posting's text."""
    from hirelake.operators.research import tech_stack_overlap
    from hirelake.sources.views import brand_research
    out = tech_stack_overlap(postings_v1(spark, sf_dir), brand_research(spark, sf_dir))
    return out.select("seq", F.concat_ws(",", "stack_overlap").alias("stack_overlap"), "overlap_count")


@register("research_progress")
def research_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 over the tracker state and the research rows."""
    from hirelake.operators.research import progress_summary
    from hirelake.sources.views import brand_research
    return progress_summary(_tracker(spark, sf_dir), brand_research(spark, sf_dir))


@register("session_metadata")
def session_metadata_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: date and type from session names."""
    from hirelake.sources.ingest import session_metadata
    from hirelake.sources.views import dated_sessions
    return session_metadata(dated_sessions(spark, sf_dir)).select("o_orderkey", "session", "session_date", "session_type")


@register("posting_dates")
def posting_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting date in either of the schema's two forms."""
    from hirelake.functions.text import parse_schema_date
    return postings_v1(spark, sf_dir).select("seq", parse_schema_date(F.col("posted_date")).cast("string").alias("posted_on"))
