"""Fixture views over the driver tables (V1, V3, V4) and their DuckDB twins.

The reference ships no data; these views give its record shapes realistic
volume. Each Spark view has a SQL twin (``*_SQL``) used by the DuckDB oracles,
so that both engines start from the same rows. The mapping of a view row to a
posting record is ours and documented per view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.functions.text import EMAIL_PATTERN, first_email
from hirelake.sources.schema import conform
from hirelake.sources.tables import table

# Fixed as-of date of the fixtures (latest o_orderdate).
AS_OF = "2001-08-01"


def postings_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one posting per part, shaped like a ``{"job": {...}}`` record.

    Nulls stand for absent keys (a JSON writer drops them). The location is an
    object ``{city}``; the salary object exists when it has an amount; the
    contact email is the first address in the description.
    """
    p = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
    g = table(spark, sf_dir, "pages", ["page_id", "url"])
    n = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    k = F.col("p_partkey")
    j = (p.join(g, F.floor(k / 10) == g.page_id, "left")
         .join(n, (F.col("p_size") % 5) == n.n_nationkey, "left")
         .join(d, k == d.doc_id, "left")
         .join(o, k == o.o_orderkey, "left"))
    suffix = (F.when(k % 4 == 0, " GmbH").when(k % 4 == 1, " Inc.").when(k % 4 == 2, "").otherwise(" LLC"))
    sal_min = F.when(k % 7 != 0, F.col("p_retailprice") * 40)
    sal_max = F.when(k % 11 != 0, F.col("p_retailprice") * 60)
    company = F.concat(F.col("p_brand"), suffix)
    email = first_email(F.col("text"))
    out = j.select(
        k.cast("bigint").alias("seq"),
        k.cast("string").alias("id"),
        F.format_string("master_%05d", k + 1).alias("master_id"),
        k.cast("string").alias("original_id"),
        F.concat(F.lit("session_"), (k % 3).cast("string")).alias("session"),
        F.when(k % 5 == 0, F.col("url")).alias("url"),
        F.col("p_name").alias("title"),
        company.alias("company"),
        F.col("n_name").alias("location"),
        F.col("text").alias("description"),
        F.col("p_name").alias("job_title"),
        F.col("text").alias("job_description"),
        F.when(k % 6 == 0, "Full-time").when(k % 6 == 1, "Part-time").when(k % 6 == 2, "Contract")
        .when(k % 6 == 3, "Temporary").when(k % 6 == 4, "Internship").alias("job_type"),
        F.when(k % 7 == 0, "Entry Level").when(k % 7 == 1, "Junior").when(k % 7 == 2, "Mid-Level")
        .when(k % 7 == 3, "Senior").when(k % 7 == 4, "Lead").when(k % 7 == 5, "Executive")
        .alias("experience_level"),
        F.when(k % 4 == 0, "remote").when(k % 4 == 1, "hybrid").when(k % 4 == 2, "on-site")
        .alias("remote_policy"),
        F.when(k % 13 == 0, F.lit("31/12/2025"))
        .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("posted_date"),
        company.alias("company_text"),
        company.alias("company_name"),
        F.lit(True).alias("location_is_object"),
        F.col("n_name").isNotNull().alias("location_present"),
        F.col("n_name").alias("location_city"),
        (sal_min.isNotNull() | sal_max.isNotNull()).alias("salary_present"),
        sal_min.alias("salary_min"),
        sal_max.alias("salary_max"),
        F.when(k % 4 == 0, "USD").when(k % 4 == 1, "EUR").when(k % 4 == 2, "GBP").otherwise("")
        .alias("salary_currency"),
        F.when(k % 3 == 0, "annual").when(k % 3 == 1, "monthly").otherwise("hourly").alias("salary_period"),
        email.alias("contact_email"),
    )
    return conform(out)


# DuckDB twin of ``postings_v1`` (same columns that the oracles use).
POSTINGS_V1_SQL = f"""
select p.p_partkey::bigint as seq,
  cast(p.p_partkey as varchar) as id,
  printf('master_%05d', p.p_partkey + 1) as master_id,
  cast(p.p_partkey as varchar) as original_id,
  'session_' || cast(p.p_partkey % 3 as varchar) as session,
  case when p.p_partkey % 5 = 0 then g.url end as url,
  p.p_name as title,
  p.p_brand || case p.p_partkey % 4 when 0 then ' GmbH' when 1 then ' Inc.' when 2 then '' else ' LLC' end as company,
  n.n_name as location,
  n.n_name as location_city,
  d.text as description,
  case when p.p_partkey % 7 = 0 then null else p.p_retailprice * 40 end as salary_min,
  case when p.p_partkey % 11 = 0 then null else p.p_retailprice * 60 end as salary_max,
  case p.p_partkey % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' else '' end as salary_currency,
  case p.p_partkey % 3 when 0 then 'annual' when 1 then 'monthly' else 'hourly' end as salary_period,
  case p.p_partkey % 6 when 0 then 'Full-time' when 1 then 'Part-time' when 2 then 'Contract'
                       when 3 then 'Temporary' when 4 then 'Internship' end as job_type,
  case p.p_partkey % 7 when 0 then 'Entry Level' when 1 then 'Junior' when 2 then 'Mid-Level'
                       when 3 then 'Senior' when 4 then 'Lead' when 5 then 'Executive' end as experience_level,
  case p.p_partkey % 4 when 0 then 'remote' when 1 then 'hybrid' when 2 then 'on-site' end as remote_policy,
  case when p.p_partkey % 13 = 0 then '31/12/2025' else cast(cast(o.o_orderdate as date) as varchar) end as posted_date,
  nullif(regexp_extract(d.text, '{EMAIL_PATTERN}', 0), '') as contact_email
from part p
left join pages g on g.page_id = floor(p.p_partkey / 10)
left join nation n on n.n_nationkey = p.p_size % 5
left join documents d on d.doc_id = p.p_partkey
left join orders o on o.o_orderkey = p.p_partkey
"""


def text_postings_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one posting per document: title = first line, company = first two
    words, location = language (a scalar), description = the text, contact
    email = the first address in the text."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    email = first_email(F.col("text"))
    company = F.concat(F.split_part(F.col("text"), F.lit(" "), F.lit(1)), F.lit(" "),
                       F.split_part(F.col("text"), F.lit(" "), F.lit(2)))
    out = d.select(
        F.col("doc_id").cast("bigint").alias("seq"),
        F.col("doc_id").cast("string").alias("id"),
        F.format_string("master_%05d", F.col("doc_id") + 1).alias("master_id"),
        F.col("doc_id").cast("string").alias("original_id"),
        F.col("source").alias("session"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        company.alias("company"),
        company.alias("company_text"),
        company.alias("company_name"),
        F.col("lang").alias("location"),
        F.col("lang").alias("location_text"),
        F.lit(False).alias("location_is_object"),
        (F.coalesce(F.length("lang"), F.lit(0)) > 0).alias("location_present"),
        F.col("text").alias("description"),
        email.alias("contact_email"),
    )
    return conform(out)


TEXT_POSTINGS_V3_SQL = f"""
select doc_id::bigint as seq, printf('master_%05d', doc_id + 1) as master_id, doc_id::varchar as original_id, source as session,
  split_part(text, chr(10), 1) as title,
  split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) as company, lang as location, text as description,
  nullif(regexp_extract(text, '{EMAIL_PATTERN}', 0), '') as contact_email
from documents
"""


def tracker_events_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: application-tracker events from ``events`` (one tracker session ``s0``).

    signup -> add (in_progress); view -> update in_progress; purchase -> update
    completed; error -> update failed; click -> update carrying only
    ``extra = {k: props.k}`` (status unchanged).
    """
    return events_to_tracker(table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"]))


def events_to_tracker(e: DataFrame) -> DataFrame:
    """The V4 mapping on any (batch or streaming) ``events`` DataFrame."""
    return e.select(events_to_tracker_columns()).select("v.*").filter(F.col("kind").isNotNull())


def events_to_tracker_columns() -> Column:
    """The V4 mapping as one struct ``v``; its ``kind`` is NULL for events that are no tracker events."""
    et = F.col("event_type")
    kind = F.when(et == "signup", "add").when(et.isin("view", "purchase", "error", "click"), "update")
    status = (F.when(et.isin("signup", "view"), "in_progress").when(et == "purchase", "completed")
              .when(et == "error", "failed"))
    k = F.get_json_object(F.col("props"), "$.k")
    return F.struct(
        F.lit("s0").alias("session"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.col("user_id").cast("string").alias("job_id"),
        F.when(et == "signup", F.concat(F.lit("company_"), (F.col("user_id") % 25).cast("string"))).alias("company"),
        F.when(et == "signup", F.concat(F.lit("title_"), F.col("user_id").cast("string"))).alias("title"),
        status.alias("status"),
        F.when(et == "signup", F.concat(F.lit("applications/"), F.col("user_id").cast("string"))).alias("directory"),
        F.when((et == "click") & k.isNotNull(), F.create_map(F.lit("k"), k)).alias("extra")).alias("v")


TRACKER_EVENTS_V4_SQL = """
select 's0' as session, event_id::bigint as seq, ts,
  case when event_type = 'signup' then 'add' else 'update' end as kind,
  cast(user_id as varchar) as job_id,
  case when event_type = 'signup' then 'company_' || cast(user_id % 25 as varchar) end as company,
  case when event_type = 'signup' then 'title_' || cast(user_id as varchar) end as title,
  case when event_type in ('signup', 'view') then 'in_progress' when event_type = 'purchase' then 'completed'
       when event_type = 'error' then 'failed' end as status,
  case when event_type = 'signup' then 'applications/' || cast(user_id as varchar) end as directory,
  case when event_type = 'click' then json_extract_string(props, '$.k') end as extra_k
from events
where event_type in ('signup', 'view', 'purchase', 'error', 'click')
"""


def raw_postings_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: each V1 posting as a JSON document in one of the three record shapes
    (by ``seq % 3``: api response, nested job, extraction fields), with the
    session name, a file name and the position -- the raw input of ingest."""
    v = postings_v1(spark, sf_dir)
    cell = lambda c: F.struct(F.col(c).alias("value"), F.lit(90).alias("confidence"))
    salary = F.when(F.col("salary_present"), F.struct(
        F.col("salary_min").alias("min"), F.col("salary_max").alias("max"),
        F.col("salary_currency").alias("currency"), F.col("salary_period").alias("period")))
    api = F.to_json(F.struct(F.col("id").alias("id"), F.col("url").alias("application_url"),
                             F.col("title").alias("slug"), F.struct(F.col("company").alias("name")).alias("company"),
                             F.struct(F.col("location").alias("city")).alias("location")))
    nested = F.to_json(F.struct(F.struct(
        F.col("id").alias("id"), F.col("url").alias("url"), F.col("title").alias("title"),
        F.col("company").alias("company"), F.struct(F.col("location_city").alias("city")).alias("location"),
        F.col("description").alias("description"), salary.alias("salary"), F.col("job_type").alias("jobType"),
        F.col("experience_level").alias("experienceLevel"), F.col("remote_policy").alias("remotePolicy"),
        F.col("posted_date").alias("postedDate")).alias("job")))
    data = F.to_json(F.struct(
        F.col("id").alias("job_id"), F.col("url").alias("url"),
        F.struct(cell("title").alias("title"), cell("company").alias("company"), cell("location").alias("location"),
                 cell("description").alias("description"), cell("contact_email").alias("contactEmail")).alias("data")))
    k = F.col("seq") % 3
    return v.select(
        "session", F.format_string("%06d.json", F.col("seq")).alias("source_file"), F.lit(0).alias("pos"),
        F.when(k == 0, api).when(k == 1, nested).otherwise(data).alias("value"))


def raw_records_v2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The V1 postings as records that differ in what the flattened record must bridge, by ``seq % 4``: root keys
    with objects; ``data`` cells with a cell list and a cell salary; a nested job; root keys with a scalar location and
    a numeric salary, which counts for nothing. The url stands under one of five names, or at the root beside ``data``."""
    v = postings_v1(spark, sf_dir).withColumn("country", F.concat(F.lit("Country "), (F.col("seq") % 2).cast("string")))
    k, nth = F.col("seq"), F.floor(F.col("seq") / 5) % 5
    cell = lambda c: F.struct(c.alias("value"), F.lit(90).alias("confidence"))
    col = lambda c, name: F.col(c).alias(name)
    urls = [F.when(nth == i, F.col("url")).alias(name) for i, name in enumerate(["url", "source_url", "applicationUrl", "job_url", "link"])]
    place = F.struct(col("location_city", "city"), "country").alias("location")
    named = F.struct(col("company", "name")).alias("company")
    salary = F.when(F.col("salary_present"), F.struct(col("salary_min", "min"), col("salary_max", "max"),
                                                      col("salary_currency", "currency"), col("salary_period", "period")))
    wants = F.array_compact(F.array("job_type", "experience_level"))
    gives = F.array("remote_policy")
    shapes = [
        F.struct("id", *urls, "title", named, place, "description", salary.alias("salary"), wants.alias("requirements"),
                 F.when(k % 3 == 0, gives).alias("benefits")),
        F.struct(col("id", "job_id"), F.when(nth % 2 == 0, F.col("url")).alias("url"), F.struct(
            F.when(nth % 2 == 1, F.col("url")).alias("link"), cell(F.col("title")).alias("title"), named, place,
            cell(F.col("description")).alias("description"), cell(salary).alias("salary"), cell(wants).alias("requirements"),
            cell(F.col("contact_email")).alias("contactEmail")).alias("data")),
        F.struct(F.struct("id", "url", "title", "company", place, "description", salary.alias("salary"), gives.alias("benefits"),
                          col("contact_email", "contactEmail")).alias("job")),
        F.struct(col("id", "uid"), *urls, "title", "company", F.concat_ws(", ", "location_city", "country").alias("location"),
                 "description", F.lit(5000).alias("salary")),
    ]
    text = F.when(k % 4 == 0, F.to_json(shapes[0])).when(k % 4 == 1, F.to_json(shapes[1])).when(k % 4 == 2, F.to_json(shapes[2]))
    return v.select("session", F.format_string("%06d.json", k).alias("source_file"), F.lit(0).alias("pos"),
                    text.otherwise(F.to_json(shapes[3])).alias("value"))


# DuckDB twin: the columns that the flattened records must give.
RECORDS_V2B_SQL = f"""
select row_number() over (order by session, printf('%06d.json', seq)) as seq,
  printf('master_%05d', row_number() over (order by session, printf('%06d.json', seq))) as master_id, session, url, title, company,
  case when seq % 4 in (0, 3) then id else printf('%06d', seq) end as original_id,
  description, location_city, 'Country ' || seq % 2 as country,
  case when seq % 4 in (1, 2) then contact_email end as contact_email,
  case when seq % 4 <> 3 then salary_min end as salary_min, case when seq % 4 <> 3 then salary_max end as salary_max,
  seq % 4 in (0, 1) and (job_type is not null or experience_level is not null) as has_requirements,
  seq % 12 = 0 or seq % 4 = 2 as has_benefits
from ({POSTINGS_V1_SQL})"""


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, html)`` of a posting page per part, with labelled fields: two labels in one line, a long
    value, an entity, a label without a following space, and one inside a comment (not visible)."""
    # parts are a few bytes each, their pages long: dealt out before the pages are made, or one file's pages are one task
    p = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    text = F.concat(F.lit("<html><style>role: none</style><body><h1>Position: "), F.col("p_name"),
                    F.lit("</h1><p>Unternehmen: "), F.col("p_brand"), F.lit(" Gehalt: "), F.col("p_size").cast("string"),
                    F.lit("000 EUR<br>Beschreibung: "), F.repeat(F.concat(F.col("p_name"), F.lit(" &amp; more. ")), F.lit(20)),
                    F.lit("</p><!-- Niveau: hidden --><div>HOMEOFFICE:"), F.col("p_type"), F.lit("</div></body></html>"))
    return p.select(F.col("p_partkey").alias("page_id"), text.alias("html"))


LABELLED_PAGES_SQL = """
select p_partkey as page_id, '<html><style>role: none</style><body><h1>Position: ' || p_name || '</h1><p>Unternehmen: ' || p_brand
  || ' Gehalt: ' || p_size || '000 EUR<br>Beschreibung: ' || repeat(p_name || ' &amp; more. ', 20)
  || '</p><!-- Niveau: hidden --><div>HOMEOFFICE:' || p_type || '</div></body></html>' as html
from part"""


def brand_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: company research, a row per brand of ``part``: the stack names words from its documents, up to two types are its
    news, and its number of parts gives the hooks."""
    p = table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size"])
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    word = lambda i: F.split_part(F.col("text"), F.lit(" "), F.lit(i))
    return p.join(d, p["p_partkey"] == d["doc_id"], "left").groupBy(F.col("p_brand").alias("company")).agg(
        F.array_compact(F.array(F.min(word(1)), F.max(word(2)), F.min(word(3)))).alias("tech_stack"),
        F.slice(F.array(F.min("p_type"), F.max("p_type")), F.lit(1), F.min("p_size") % 3).alias("recent_news"),
        (F.count(F.lit(1)) % 6).cast("int").alias("hooks"))


BRAND_RESEARCH_SQL = """
select p_brand as company, list_filter([min(split_part(text, ' ', 1)), max(split_part(text, ' ', 2)), min(split_part(text, ' ', 3))],
    lambda x: x is not null) as tech_stack,
  min(p_size) % 3 + count(*) % 6 as signals
from part left join documents on doc_id = p_partkey group by p_brand"""


def dated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: session names made of orders: three types, the order date, and for two in three a time part."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "data_analyst").when(k % 4 == 1, "data_analysis").otherwise("session")
    time = F.when(k % 3 != 0, F.lpad((k % 240000).cast("string"), 6, "0"))
    return o.select("o_orderkey", F.concat_ws("_", kind, F.lit("scrape"), F.date_format("o_orderdate", "yyyyMMdd"), time).alias("session"))


def merge_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """V6: merge edges in chains, and the postings' own fill values. Each order is merged into its customer's next
    one, so a customer with 25 orders is a chain of 24 edges; every fifth edge is merged after all the others. A value
    is own to some orders only, and must travel down the chain as far as the merge order lets it."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    key = F.col("o_orderkey")
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = (o.select(later.alias("canonical_seq"), key.alias("dup_seq"), F.col("o_orderpriority").alias("dup_session"))
             .where(F.col("canonical_seq").isNotNull())
             .withColumn("group_seq", F.col("canonical_seq") + F.when(F.col("canonical_seq") % 5 == 0, 10**12).otherwise(0)))
    own = o.select(key.alias("seq"),
                   F.when(key % 3 == 0, F.concat(F.lit("o"), key.cast("string"), F.lit("@example.org"))).alias("own_contact_email"),
                   F.when(key % 7 == 0, F.col("o_totalprice")).alias("own_salary"),
                   F.when(key % 4 == 1, F.array("o_orderpriority")).alias("own_benefits"),
                   F.lit(None).cast("array<string>").alias("own_requirements"))
    return edges, own


def tracker_sessions_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker events dealt over five sessions, with opens (errors whose id 400 divides), closes (purchases
    whose id 100 divides) and a ``retry_possible`` flag on clicks."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    opened = (F.col("event_type") == "error") & (F.col("event_id") % 400 == 0)
    closed = (F.col("event_type") == "purchase") & (F.col("event_id") % 100 == 0)
    flag = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    t = e.withColumns({"opened": opened, "closed": closed, "flag": flag})
    t = t.select(events_to_tracker_columns(), "opened", "closed", "flag", F.col("user_id").alias("user"),
                 F.col("event_type").alias("et")).select("v.*", "opened", "closed", "flag", "user", "et").where(F.col("kind").isNotNull())
    extra = (F.when(F.col("opened"), F.create_map(F.lit("source_filter"), F.lit("all"), F.lit("total_jobs"), F.col("user").cast("string")))
             .when(F.col("et") == "click", F.create_map(F.lit("retry_possible"), F.col("flag"))))
    return t.select(F.concat(F.lit("s"), (F.col("user") % 5).cast("string")).alias("session"), "seq", "ts",
                    F.when(F.col("opened"), "session_open").when(F.col("closed"), "session_close").otherwise(F.col("kind")).alias("kind"),
                    F.when(~F.col("opened") & ~F.col("closed"), F.col("job_id")).alias("job_id"),
                    "company", "title", "status", "directory", extra.alias("extra"))


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved search per customer, with criteria from the customer, their nation and the part of the same number; which are
    on follows from the customer's number (none for every 97th)."""
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    p = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
    n = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    j = c.join(p, F.col("c_custkey") == F.col("p_partkey")).join(n, (F.col("p_size") % 7) == F.col("n_nationkey"), "left")
    k, on = F.col("c_custkey"), F.col("c_custkey") % 97 != 0
    strings = "array<string>"
    return j.select(
        F.concat(F.lit("search_"), k.cast("string")).alias("search_id"),
        F.when(on & (k % 3 == 0), F.array("p_name", F.when(k % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))))).cast(strings).alias("keywords"),
        F.when(on & (k % 5 == 3), F.array(F.lit("Remote"), F.lit("hybrid"))).cast(strings).alias("location_type"),
        F.when(on & (k % 4 == 2), F.col("p_retailprice") * 45).alias("salary_min"),
        F.when(on & (k % 7 == 1), F.col("p_retailprice") * 600).alias("salary_max"),
        F.when(k % 4 == 0, "usd").when(k % 4 == 1, "GBP").alias("salary_currency"),
        F.when(on & (k % 4 == 1), F.array(F.lit("senior"), F.lit("Lead"))).cast(strings).alias("experience_levels"),
        F.when(on & (k % 3 == 1), F.array(F.lit("Full-time"), F.lit("Contract"))).cast(strings).alias("job_types"),
        F.when(on & (k % 5 == 1), F.array(F.col("n_name"), F.lit(""))).when(on & (k % 5 == 2), F.array("n_name")).cast(strings).alias("cities"),
        F.when(on & (k % 6 == 4), F.upper("p_brand")).when(k % 6 == 5, "").alias("company_contains"),
        F.when(on & (k % 4 == 3), F.lit(900) + k).cast("int").alias("posted_days"))


SAVED_SEARCHES_SQL = """
select 'search_' || k as search_id,
  case when live and k % 3 = 0 then list_filter([p_name, case when k % 2 = 0 then split_part(p_name, ' ', 2) end], lambda x: x is not null) end as keywords,
  case when live and k % 5 = 3 then ['remote', 'hybrid'] end as location_type,
  case when live and k % 4 = 2 then p_retailprice * 45 end as lo, case when live and k % 7 = 1 then p_retailprice * 600 end as hi,
  case k % 4 when 0 then 'USD' when 1 then 'GBP' else 'EUR' end as asked,
  case when live and k % 4 = 1 then ['senior', 'lead'] end as experience_levels,
  case when live and k % 3 = 1 then ['Full-time', 'Contract'] end as job_types,
  case when live and k % 5 = 1 then [n_name, ''] when live and k % 5 = 2 then [n_name] end as cities,
  case when live and k % 6 = 4 then lower(p_brand) end as company_contains,
  case when live and k % 4 = 3 then 900 + k end as posted_days
from (select c_custkey as k, c_custkey % 97 <> 0 as live, p.*, n_name from customer join part p on c_custkey = p_partkey
      left join nation on p_size % 7 = n_nationkey)
"""


def raw_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 postings as records with object fields, by ``seq % 3`` at the root, under ``job`` or as ``data`` cells: a salary whose ``max`` is text for
    every fourth and whose ``period`` is a list for every fifth, and a contact person whose ``title`` is a number for every sixth."""
    k = F.col("seq")
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    member = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), c))
    salary = F.concat(F.lit("{"), F.concat_ws(",", member("min", F.col("salary_min").cast("string")),
                                              member("max", F.when(k % 4 == 0, text(F.col("salary_max"))).otherwise(F.col("salary_max").cast("string"))),
                                              member("currency", F.when(F.col("salary_currency") != "", text(F.col("salary_currency")))),
                                              member("period", F.when(k % 5 == 0, F.concat(F.lit("["), text(F.col("salary_period")), F.lit("]")))
                                                     .otherwise(text(F.col("salary_period"))))), F.lit("}"))
    person = F.concat(F.lit("{"), F.concat_ws(",", member("name", text(F.col("title"))), member("title", F.when(k % 6 == 0, k.cast("string"))
                                                                                               .when(k % 6 < 3, text(F.col("company"))))), F.lit("}"))
    both = lambda s, p: F.concat(F.lit('{"salary":'), s, F.lit(',"contactPerson":'), p, F.lit("}"))
    cell = lambda c: F.concat(F.lit('{"value":'), c, F.lit(',"confidence":80}'))
    value = (F.when(k % 3 == 0, both(salary, person)).when(k % 3 == 1, F.concat(F.lit('{"job":'), both(salary, person), F.lit("}")))
             .otherwise(F.concat(F.lit('{"data":'), both(cell(salary), cell(person)), F.lit("}"))))
    return postings_v1(spark, sf_dir).select("session", F.format_string("%06d.json", k).alias("source_file"), F.lit(0).alias("pos"), value.alias("value"))


STRUCTURED_SQL = f"""
select row_number() over (order by session, printf('%06d.json', seq)) as seq, seq as k, salary_min, salary_max, salary_currency, salary_period
from ({POSTINGS_V1_SQL})"""


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with links of every form: both quotes and none, upper case, relative with dots, query only, other schemes,
    fragments, an encoded ampersand, and for every third page a base."""
    p = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    n = F.col("page_id").cast("string")
    links = F.concat(F.lit("<a href='?page="), n, F.lit("'>n</a><A HREF=\"../up/"), n, F.lit("\">u</A><a class=x href=./here/../there/"), n,
                     F.lit(">t</a><a href='mailto:a"), n, F.lit("@b.org'>m</a><a data-href='no' href='#top'>f</a><a href='//cdn.example.org/./x/..'>c</a>"
                     "<a title='href' href=\" /a/b/../../c?q=1&amp;r=2#z \">q</a><link rel=next HREF='HTTPS://o.example.org/a/./b'><a href='..'>d</a>"))
    base = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<base href='/root/"), n, F.lit("/dir/index.html'>"))).otherwise(F.lit(""))
    return p.select("page_id", "url", F.concat(F.lit("<head>"), base, F.lit("</head>"), links, F.col("html")).alias("html"))


LINKED_PAGES_SQL = """
select page_id, url, '<head>' || case when page_id % 3 = 0 then '<base href=''/root/' || page_id || '/dir/index.html''>' else '' end || '</head>'
  || '<a href=''?page=' || page_id || '''>n</a><A HREF="../up/' || page_id || '">u</A><a class=x href=./here/../there/' || page_id
  || '>t</a><a href=''mailto:a' || page_id || '@b.org''>m</a><a data-href=''no'' href=''#top''>f</a><a href=''//cdn.example.org/./x/..''>c</a>'
  || '<a title=''href'' href=" /a/b/../../c?q=1&amp;r=2#z ">q</a><link rel=next HREF=''HTTPS://o.example.org/a/./b''><a href=''..''>d</a>' || html as html
from pages"""


def skills_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skills table ``(skill_id, skill)``: the first one, two and three words of every document."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    n = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")
    return d.select("doc_id", "text", n).select((F.col("doc_id") * 3 + F.col("n")).alias("skill_id"), F.call_function("substring_index", F.col("text"), F.lit(" "), F.col("n")).alias("skill"))


SKILLS_SQL = """
select doc_id * 3 + n as skill_id, array_to_string(string_split(text, ' ')[1:n], ' ') as skill from documents, (select unnest([1, 2, 3]) as n)"""
