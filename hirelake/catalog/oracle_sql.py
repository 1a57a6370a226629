"""DuckDB twins of the registered queries (the correctness oracle).

Written as plain SQL against the driver's views. Regex classes are spelled out
the same way as the Spark side (see ``hirelake.functions.text``) because DuckDB's
``\\w`` / ``\\s`` are ASCII-only.
"""

from __future__ import annotations

from hirelake.catalog.seqmatch_sql import ratio_ctes
from hirelake.functions.text import EMAIL_PATTERN, PHONE_PATTERN
from hirelake.sources.views import (BRAND_RESEARCH_SQL, LABELLED_PAGES_SQL, LINKED_PAGES_SQL, POSTINGS_V1_SQL, RECORDS_V2B_SQL, SAVED_SEARCHES_SQL, SKILLS_SQL, STRUCTURED_SQL, TEXT_POSTINGS_V3_SQL,
                                    TRACKER_EVENTS_V4_SQL)

WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
NONWORD = r"[^\p{L}\p{N}_\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def norm_text(e: str) -> str:
    """P9 in DuckDB."""
    s = f"regexp_replace(lower(coalesce({e}, '')), '{NONWORD}', ' ', 'g')"
    return strip(f"regexp_replace({s}, '{WS}+', ' ', 'g')")


def norm_company(e: str) -> str:
    """P10 in DuckDB: whole-word suffix removal on the space-separated words of P9."""
    words = f"string_split({norm_text(e)}, ' ')"
    kept = (f"list_transform({words}, lambda w: case when w in ('gmbh','inc','llc','ltd','ag','corp',"
            f"'corporation','company') then '' else w end)")
    return strip(f"array_to_string({kept}, ' ')")


def norm_string(e: str) -> str:
    """P8 in DuckDB (ASCII fixtures: RE2's \\b is enough)."""
    s = strip(f"lower(coalesce({e}, ''))")
    s = f"regexp_replace({s}, '\\b(gmbh|ag|ltd|inc|llc|corp|corporation)\\b', '', 'g')"
    s = f"regexp_replace({s}, '\\(m/w/d\\)|\\(w/m/d\\)', '', 'g')"
    return strip(f"regexp_replace({s}, '{WS}+', ' ', 'g')")


V1 = f"v1 as ({POSTINGS_V1_SQL})"
V3 = f"v3 as ({TEXT_POSTINGS_V3_SQL})"
V4 = f"v4 as ({TRACKER_EVENTS_V4_SQL})"

# Sample search of the fixtures: as_of 2001-08-01, 1,500 days.
_SAL_MIN = "case when salary_min <> 0 then salary_min * (case lower(coalesce(salary_period, 'annual')) " \
           "when 'monthly' then 12 when 'hourly' then 2080 else 1 end) end"
_SAL_MAX = _SAL_MIN.replace("salary_min", "salary_max")

FLAGS = f"""
flags as (
  select *,
    {strip("coalesce(job_type, '')")} in ('Full-time', 'Part-time', 'Contract') as ok_job_type,
    lower({strip("coalesce(experience_level, '')")}) in ('senior', 'mid-level', 'lead') as ok_experience_level,
    lower({strip("coalesce(remote_policy, '')")}) in ('remote', 'hybrid') as ok_location_type,
    case when coalesce(posted_date, '') = '' then true
         else coalesce(try_strptime(split_part(posted_date, 'T', 1), '%Y-%m-%d')
                       >= timestamp '2001-08-01 00:00:00' - interval 1500 day, true) end as ok_posted_date,
    (contains(lower(coalesce(title, '')), 'widget') or contains(lower(coalesce(description, '')), 'widget')
     or contains(lower(coalesce(title, '')), 'red gear')
     or (contains(lower(coalesce(title, '')), 'red') and contains(lower(coalesce(title, '')), 'gear'))
     or contains(lower(coalesce(description, '')), 'red gear')) as ok_job_title_keyword,
    (salary_min is null and salary_max is null)
     or (upper(coalesce(salary_currency, '')) <> '' and upper(coalesce(salary_currency, '')) <> 'USD')
     or ({_SAL_MIN} is null and {_SAL_MAX} is null)
     or (coalesce({_SAL_MAX}, {_SAL_MIN}) >= 40000.0 and coalesce({_SAL_MIN}, {_SAL_MAX}) <= 500000.0)
       as ok_salary_range
  from v1
)"""

_PREFIX = ["ok_job_type", "ok_experience_level", "ok_location_type", "ok_posted_date",
           "ok_job_title_keyword", "ok_salary_range"]
_ALL = " and ".join(_PREFIX)


def _breakdown() -> str:
    aggs, rows, prefix = [], [], "true"
    names = {"ok_job_type": "job_type", "ok_experience_level": "experience_level",
             "ok_location_type": "location_type", "ok_posted_date": "posted_date",
             "ok_job_title_keyword": "job_title_keyword", "ok_salary_range": "salary_range"}
    for c in _PREFIX:
        n = names[c]
        aggs.append(f"count_if({prefix} and {c})::bigint as {n}_p, count_if({prefix} and not {c})::bigint as {n}_f")
        prefix = f"{prefix} and {c}"
    order = ["job_title_keyword", "location_type", "salary_range", "experience_level", "job_type",
             "city_location", "company", "posted_date"]
    for n in order:
        if n in names.values():
            rows.append(f"select '{n}' as filter_name, {n}_p as passed, {n}_f as failed, 0::bigint as missing_data from a")
        else:
            rows.append(f"select '{n}', 0::bigint, 0::bigint, 0::bigint from a")
    return f"with {V1}, {FLAGS[1:]}, a as (select {', '.join(aggs)} from flags)\n" + "\nunion all\n".join(rows)


ORACLES: dict[str, str] = {}

ORACLES["filter_breakdown"] = _breakdown()

ORACLES["filter_matches"] = f"""
with {V1}, {FLAGS[1:]}
select seq, id, title, company, 100 as match_score,
  'job_type,experience_level,location_type,posted_date,job_title,salary_range' as criteria_met
from flags where {_ALL}
"""

ORACLES["filter_summary"] = f"""
with {V1}, {FLAGS[1:]}
select count(*)::bigint as total_scanned, count_if({_ALL})::bigint as total_matched,
  round_even(count_if({_ALL}) / count(*) * 100.0, 2) as match_rate_percent, 0::bigint as ai_classified_count
from flags
"""

ORACLES["filter_top10"] = f"""
with {V1}, {FLAGS[1:]}
select id as job_id, title, company, location, 100 as match_score
from flags where {_ALL} order by seq limit 10
"""

_MET = ", ".join(f"case when {c} then '{m}' end" for c, m in [
    ("ok_job_type", "job_type"), ("ok_experience_level", "experience_level"),
    ("ok_location_type", "location_type"), ("ok_posted_date", "posted_date"),
    ("ok_job_title_keyword", "job_title"), ("ok_salary_range", "salary_range")])
_FAILED = _MET.replace("case when ok_", "case when not ok_")

ORACLES["filter_partial"] = f"""
with {V1}, {FLAGS[1:]}, s as (
  select seq, list_filter([{_MET}], lambda x: x is not null) as met,
              list_filter([{_FAILED}], lambda x: x is not null) as failed from flags)
select seq, array_to_string(met, ',') as criteria_met, array_to_string(failed, ',') as criteria_failed,
  floor(len(met) / 6 * 100)::integer as match_score
from s where floor(len(met) / 6 * 100) >= 50
"""


# Keep-first as the plain sequential rule: a recursive walk in seq order that
# carries the url and key sets of kept rows.
_KF = f"""with recursive {V1},
b as (select row_number() over (order by seq) as rn, seq, nullif(url, '') as u,
        nullif({norm_string('company')} || '|' || {norm_string('title')} || '|' || {norm_string('location')}, '||') as k
      from v1),
r(rn, seq, u, k, st, seen_u, seen_k) as (
  select 0::bigint, null::bigint, null::varchar, null::varchar, null::varchar, []::varchar[], []::varchar[]
  union all
  select b.rn, b.seq, b.u, b.k, x.st,
    case when x.st = 'unique' and b.u is not null then list_append(r.seen_u, b.u) else r.seen_u end,
    case when x.st = 'unique' and b.k is not null then list_append(r.seen_k, b.k) else r.seen_k end
  from r join b on b.rn = r.rn + 1,
  lateral (select case when b.u is not null and list_contains(r.seen_u, b.u) then 'exact_url'
                       when b.k is not null and list_contains(r.seen_k, b.k) then 'fuzzy_match'
                       else 'unique' end as st) x
),
kf as (select seq, case when st = 'unique' then 'unique' else 'duplicate' end as status,
          case when st <> 'unique' then st end as duplicate_reason, k as fuzzy_key, v1.session
       from r join v1 using (seq) where rn > 0)"""

ORACLES["keepfirst_rows"] = _KF + "\nselect seq, status, duplicate_reason, fuzzy_key from kf"
ORACLES["keepfirst_stats"] = _KF + """
select count(*)::bigint as total_jobs, count_if(status = 'unique')::bigint as unique_jobs,
  count_if(status = 'duplicate')::bigint as duplicates,
  round_even(count_if(status = 'duplicate') / count(*) * 100.0, 2) as duplicate_rate from kf"""
ORACLES["keepfirst_by_reason"] = _KF + """
select duplicate_reason, count(*)::bigint as duplicates from kf where status = 'duplicate' group by 1"""
ORACLES["keepfirst_sessions"] = f"with {V1} select session, count(*)::bigint as jobs_count from v1 group by 1"


# Entity resolution, exact url + composite key, written as plain group-by SQL.
_WORDS = (f"case when coalesce(length(description), 0) > 0 then list_distinct(list_filter("
          f"string_split({norm_text('description')}, ' '), lambda w: w <> '')) else []::varchar[] end")
_COMPL = ("((case when coalesce(length(title), 0) > 0 then 1 else 0 end) + (case when coalesce(length(company), 0) > 0 "
          "then 1 else 0 end) + (case when location_city is not null then 1 else 0 end) + (case when "
          "coalesce(length(description), 0) > 0 then 1 else 0 end) + (case when salary_min is not null or salary_max "
          "is not null then 1 else 0 end) + (case when coalesce(length(contact_email), 0) > 0 then 1 else 0 end)) "
          "/ 8.0 * 100.0")
_JAC = ("case when len(cwords) = 0 or len(words) = 0 then 0.0 else len(list_intersect(cwords, words)) / "
        "(len(cwords) + len(words) - len(list_intersect(cwords, words)))::double end")
#: J3 + W3 in SQL: similar companies, titles inside them, locations; each later posting's pairs end at its first more complete one.
_FUZZY = f"""
fz as (select seq, master_id, session, compl, {norm_text('cn')} as fc, tn, {norm_text('ln')} as fl from r1
       where cn <> '' and coalesce(length(title), 0) > 0 and seq not in (select dseq from e2)),
chars as (select s, ch, count(*) as n from (select s, unnest(string_split(s, '')) as ch from
          (select fc as s from fz union select tn from fz where tn <> '')) group by all),
cpair as (select a, b from (select x.s as a, y.s as b, sum(least(x.n, y.n)) as m from chars x join chars y using (ch)
          where x.s in (select fc from fz) and y.s in (select fc from fz) group by all) where 2.0 * m >= 0.8 * (length(a) + length(b)) - 1e-6),
{ratio_ctes('cpair', 'cr')},
keys as (select distinct fc, tn from fz),
tkeys as (select distinct x.tn as a, y.tn as b from cr join keys x on x.fc = cr.a join keys y on y.fc = cr.b where cr.r >= 0.8),
tpair as (select a, b from (select a, b, sum(least(x.n, y.n)) as m from tkeys join chars x on x.s = a join chars y on y.s = b and y.ch = x.ch group by all)
          where 2.0 * m >= 0.75 * (length(a) + length(b)) - 1e-6 union select a, b from tkeys where a = b),
{ratio_ctes('tpair', 'tr')},
lpair as (select distinct x.fl as a, y.fl as b from fz x, fz y where x.fl <> '' and y.fl <> ''),
{ratio_ctes('lpair', 'lr')},
fm as (select x.seq as i, y.seq as j, x.compl as ci, y.compl as cj, x.master_id as idi, y.master_id as idj, x.session as si, y.session as sj,
         cr.r as c, tr.r as t, coalesce(lr.r, 0.0) as l
       from fz x join cr on cr.a = x.fc and cr.r >= 0.8 join fz y on y.fc = cr.b and y.seq > x.seq
       join tr on tr.a = x.tn and tr.b = y.tn and tr.r >= 0.75 left join lr on lr.a = x.fl and lr.b = y.fl),
fc75 as (select *, (c * 0.4 + t * 0.4 + l * 0.2) * 100.0 as conf from fm where (c * 0.4 + t * 0.4 + l * 0.2) * 100.0 >= 75.0),
fstop as (select j, min(i) filter (ci > cj) as stop from fc75 group by j),
e3 as (select 'fuzzy_match' as strategy, 3 as srank, i as o1, j as o2, floor(conf)::integer as confidence,
         case when ci > cj then i else j end as cseq, case when ci > cj then idi else idj end as cid,
         case when ci > cj then j else i end as dseq, case when ci > cj then idj else idi end as did,
         case when ci > cj then sj else si end as dsession, null::double as description_similarity,
         round_even(c * 100.0, 1) as sim_company, round_even(t * 100.0, 1) as sim_title, round_even(l * 100.0, 1) as sim_location
       from fc75 join fstop using (j) where stop is null or i <= stop),"""


def _dedup_sql(view: str, src: str, compl: str, loc: str, fuzzy: bool = False) -> str:
    no_sims = ", null::double as sim_company, null::double as sim_title, null::double as sim_location" if fuzzy else ""
    e3 = " union all select * from e3" if fuzzy else ""
    return f"""with {"recursive " if fuzzy else ""}{view},
p as (select seq, master_id, session, original_id, nullif(url, '') as url_key, url, contact_email, salary_min, salary_max,
        location_city, description, title, company, {compl} as compl,
        {norm_company('company')} as cn, {norm_text('title')} as tn,
        {loc} as ln, {_WORDS} as words from {src}),
u as (select * from p where url_key is not null),
ug as (select url_key, min(seq) as first_seq, first(seq order by compl desc, seq) as cseq,
         first(master_id order by compl desc, seq) as cid from u group by url_key having count(*) > 1),
e1 as (select 'exact_url' as strategy, 1 as srank, ug.first_seq as o1, 0::bigint as o2, 99 as confidence,
         ug.cseq, ug.cid, u.seq as dseq, u.master_id as did, u.session as dsession, null::double as description_similarity
       from u join ug using (url_key) where u.seq <> ug.cseq),
m1 as (select u.seq from u join ug using (url_key)),
r1 as (select *, case when cn <> '' and tn <> '' then cn || '|' || tn || '|' || ln end as ckey
       from p where seq not in (select seq from m1)),
kg as (select ckey, min(seq) as first_seq, first(seq order by compl desc, seq) as cseq,
         first(master_id order by compl desc, seq) as cid from r1 where ckey is not null group by ckey having count(*) > 1),
cw as (select r1.ckey, r1.words as cwords from r1 join kg on r1.ckey = kg.ckey and r1.seq = kg.cseq),
e2 as (select 'normalized_composite' as strategy, 2 as srank, kg.first_seq as o1, r1.seq as o2,
         floor(85.0 + ({_JAC}) * 10.0)::integer as confidence, kg.cseq, kg.cid, r1.seq as dseq, r1.master_id as did,
         r1.session as dsession, round_even(({_JAC}) * 100.0, 1) as description_similarity
       from r1 join kg using (ckey) join cw using (ckey) where r1.seq <> kg.cseq),{_FUZZY if fuzzy else ""}
e as (select *, dense_rank() over (order by srank, o1, o2) as gseq from (select *{no_sims} from e1 union all select *{no_sims} from e2{e3})),
eg as (select *, printf('dup_%03d', gseq) as group_id from e),
g as (select gseq, group_id, strategy, confidence, cseq, count(*) as dcount from eg group by all),
fill_email as (select cseq, first(p.contact_email order by eg.gseq, eg.dseq) as v,
                 first(eg.dsession order by eg.gseq, eg.dseq) as src
               from eg join p on p.seq = eg.dseq where coalesce(length(p.contact_email), 0) > 0 group by cseq),
fill_sal as (select cseq, first(p.salary_min order by eg.gseq, eg.dseq) as smin,
               first(eg.dsession order by eg.gseq, eg.dseq) as src
             from eg join p on p.seq = eg.dseq where p.salary_min is not null or p.salary_max is not null group by cseq),
lastg as (select cseq, max(gseq) as gseq from g where confidence >= 85 group by cseq),
lastd as (select eg.cseq, eg.dseq from eg join lastg using (cseq, gseq)),
vals as (select cseq, kind, value, min(pos) as pos from (
    select l.cseq, l.dseq as pos, 'url' as kind, nullif(p.url, '') as value from lastd l join p on p.seq = l.dseq where coalesce(p.url, '') <> ''
    union all select l.cseq, l.dseq, 'session', p.session from lastd l join p on p.seq = l.dseq
    union all select l.cseq, l.dseq, 'original_id', p.original_id from lastd l join p on p.seq = l.dseq
    union all select p.seq, -1, 'url', nullif(p.url, '') from p where p.seq in (select cseq from lastd)
    union all select p.seq, -1, 'session', p.session from p where p.seq in (select cseq from lastd)
    union all select p.seq, -1, 'original_id', p.original_id from p where p.seq in (select cseq from lastd)) group by all),
lists as (select cseq, string_agg(coalesce(value, '<null>'), ',' order by pos, value) filter (kind = 'url') as urls,
            string_agg(coalesce(value, '<null>'), ',' order by pos, value) filter (kind = 'session') as sessions from vals group by cseq),
meta as (select lastg.cseq, g.dcount, g.strategy, g.confidence, g.group_id,
           (select count(*) from vals v where v.cseq = lastg.cseq and kind = 'url') as n_urls,
           (select count(*) from vals v where v.cseq = lastg.cseq and kind = 'session') as n_sessions,
           (select count(*) from vals v where v.cseq = lastg.cseq and kind = 'original_id') as n_original_ids, ls.urls, ls.sessions
         from lastg join g on g.gseq = lastg.gseq join lists ls on ls.cseq = lastg.cseq),
removed as (select distinct dseq as seq from eg where confidence >= 85),
filled as (select p.*,
             case when coalesce(length(p.contact_email), 0) > 0 then p.contact_email else fe.v end as f_email,
             case when coalesce(length(p.contact_email), 0) > 0 then null else fe.src end as email_src,
             (p.salary_min is not null or p.salary_max is not null) or fs.cseq is not null as f_sal_present,
             case when p.salary_min is not null or p.salary_max is not null then p.salary_min else fs.smin end as f_sal_min,
             case when p.salary_min is not null or p.salary_max is not null then null else fs.src end as sal_src
           from p left join fill_email fe on fe.cseq = p.seq left join fill_sal fs on fs.cseq = p.seq),
uniq as (select * from filled where seq not in (select seq from removed))"""


_DEDUP = _dedup_sql(V1, "v1", _COMPL, norm_text("coalesce(location_city, '') || ' '"))

ORACLES["dedup_groups"] = _DEDUP + """
select group_id, strategy, cid as canonical_id, did as dup_id, confidence, description_similarity from eg"""

ORACLES["dedup_matched_fields"] = _DEDUP + """
select group_id, did as dup_id, dsession as dup_session, case strategy when 'exact_url' then 'url' else 'company,title,location' end as matched_fields from eg"""

_VALUES = """
select cseq as seq, kind, row_number() over (partition by cseq, kind order by pos, value) - 1 as position, value from vals"""
ORACLES["dedup_merge_values"] = _DEDUP + _VALUES

_UNIQUE = """
select u.seq, u.master_id, u.f_email as contact_email, u.email_src as contact_email_source,
  u.f_sal_present as salary_present, u.f_sal_min as salary_min, u.sal_src as salary_source,
  m.dcount as duplicate_count, m.strategy as merge_strategy, m.confidence as merge_confidence,
  m.group_id as merge_group_id, case when m.cseq is not null then '2001-08-01 00:00:00' end as merge_date, m.n_urls, m.n_sessions, m.n_original_ids,
  m.urls as duplicate_urls, m.sessions as session_sources
from uniq u left join meta m on m.cseq = u.seq"""
ORACLES["dedup_unique"] = _DEDUP + _UNIQUE

# The flattened record of ingested JSON: the country is part of the key, lists count for the completeness.
_COMPL2 = _COMPL.replace("/ 8.0", "+ has_requirements::int + has_benefits::int) / 8.0").replace("((case", "(((case", 1)
_DEDUP2 = _dedup_sql(f"v2b as ({RECORDS_V2B_SQL})", "v2b", _COMPL2, norm_text("location_city || ' ' || country"))
ORACLES["dedup_ingested_groups"] = _DEDUP2 + """
select group_id, strategy, cid as canonical_id, did as dup_id, confidence, description_similarity from eg"""
ORACLES["dedup_ingested_unique"] = _DEDUP2 + _UNIQUE
ORACLES["dedup_ingested_merge_values"] = _DEDUP2 + _VALUES

ORACLES["dedup_summary"] = _DEDUP + """
select (select count(*) from p) as total_jobs, (select count(*) from uniq) as unique_jobs,
  (select count(*) from p) - (select count(*) from uniq) as duplicates,
  round_even(((select count(*) from p) - (select count(*) from uniq)) / (select count(*) from p) * 100.0, 1) as duplicate_rate,
  (select count(*) from g) as duplicate_groups, 0::bigint as flagged_for_review"""

ORACLES["dedup_strategy"] = _DEDUP + """
select strategy, sum(dcount)::bigint as matches, round(avg(confidence), 4) as avg_confidence,
  round(sum(dcount) / ((select count(*) from p) - (select count(*) from uniq)) * 100.0, 4) as pct_of_duplicates
from g group by strategy"""

_COV = """avg(case when {c} then 100.0 else 0.0 end)"""
ORACLES["dedup_quality"] = _DEDUP + """,
cf as (select *, ((case when coalesce(length(title), 0) > 0 then 1 else 0 end) + (case when coalesce(length(company), 0) > 0
        then 1 else 0 end) + (case when location_city is not null then 1 else 0 end) + (case when
        coalesce(length(description), 0) > 0 then 1 else 0 end) + (case when f_sal_present then 1 else 0 end)
        + (case when coalesce(length(f_email), 0) > 0 then 1 else 0 end)) / 8.0 * 100.0 as fcompl from filled),
b as (select avg(compl) as completeness, avg(case when salary_min is not null or salary_max is not null then 100.0 else 0.0 end) as salary,
        avg(case when coalesce(length(contact_email), 0) > 0 then 100.0 else 0.0 end) as "contactEmail",
        0.0::double as benefits, 0.0::double as requirements from p),
a as (select avg(fcompl) as completeness, avg(case when f_sal_present then 100.0 else 0.0 end) as salary,
        avg(case when coalesce(length(f_email), 0) > 0 then 100.0 else 0.0 end) as "contactEmail",
        0.0::double as benefits, 0.0::double as requirements from cf where seq not in (select seq from removed)),
tb as (unpivot b on completeness, salary, "contactEmail", benefits, requirements into name metric value before_raw),
ta as (unpivot a on completeness, salary, "contactEmail", benefits, requirements into name metric value after_raw)
select metric, round_even(before_raw, 1) as before, round_even(after_raw, 1) as after,
  round_even(after_raw - before_raw, 1) as improvement,
  metric <> 'completeness' and round_even(after_raw, 1) < 60 as improvement_target
from tb join ta using (metric)"""

# The same two stages over the text postings (Unicode normalisation on real prose).
_V3P = ("v3p as (select seq, master_id, session, original_id, null::varchar as url, contact_email, null::double as salary_min, "
        "null::double as salary_max, location as location_city, description, title, company from v3)")
_COMPL3 = ("((case when coalesce(length(title), 0) > 0 then 1 else 0 end) + (case when coalesce(length(company), 0) > 0 "
           "then 1 else 0 end) + (case when coalesce(length(location_city), 0) > 0 then 1 else 0 end) + (case when "
           "coalesce(length(description), 0) > 0 then 1 else 0 end) + (case when coalesce(length(contact_email), 0) > 0 "
           "then 1 else 0 end)) / 8.0 * 100.0")
ORACLES["dedup_text_composite"] = _dedup_sql(f"{V3}, {_V3P}", "v3p", _COMPL3, norm_text("location_city")) + """
select group_id, strategy, cid as canonical_id, did as dup_id, confidence, description_similarity from eg"""

# All three stages; the review queue over postings of which some name a site as their location.
_FUZZY3 = _dedup_sql(f"{V3}, {_V3P}", "v3p", _COMPL3, norm_text("location_city"), fuzzy=True)
ORACLES["dedup_fuzzy_groups"] = _FUZZY3 + """
select group_id, strategy, cid as canonical_id, did as dup_id, confidence, description_similarity, sim_company, sim_title, sim_location from eg"""
ORACLES["dedup_fuzzy_summary"] = _FUZZY3 + """,
n as (select (select count(*) from p) as total, (select count(*) from p where seq not in (select seq from removed)) as kept)
select total as total_jobs, kept as unique_jobs, total - kept as duplicates, round_even((total - kept) / total * 100.0, 1) as duplicate_rate,
  (select count(*) from g) as duplicate_groups, (select count(*) from g where confidence >= 60 and confidence < 85) as flagged_for_review from n"""

_REVIEW = _dedup_sql(f"{V3}, {_V3P.replace('location as', 'case when length(session) = 4 then location else session end as')}", "v3p", _COMPL3,
                     norm_text("location_city"), fuzzy=True) + """,
rv as (select g.*, row_number() over (order by gseq) as n from g where confidence >= 60 and confidence < 85)"""
ORACLES["dedup_fuzzy_review"] = _REVIEW + """
select printf('review_%03d', n) as review_id, case when confidence >= 70 then 'medium' else 'high' end as priority, group_id,
  'low_confidence_match' as reason, confidence, rv.cid as canonical_job_id, strategy,
  (select string_agg(did, ',') from eg where eg.gseq = rv.gseq) as duplicate_ids
from (select rv.*, (select any_value(cid) from eg where eg.gseq = rv.gseq) as cid from rv) rv"""
ORACLES["dedup_review_reasons"] = _REVIEW + """
select case when confidence < 75 then 'Low confidence match (60-75%)' else 'Other' end as reason, count(*) as items from rv group by 1"""


ORACLES["ingest_postings"] = f"""with {V1}
select printf('master_%05d', row_number() over (order by session, printf('%06d.json', seq))) as master_id,
  id, url, title, company, location, session,
  case seq % 3 when 0 then 'api_response' when 1 then 'nested_job' else 'data_fields' end as shape,
  case when seq % 3 = 0 then id else printf('%06d', seq) end as original_id
from v1"""

# Only nested-job records (seq % 3 = 1) carry raw.job; the others miss every field.
ORACLES["ingest_filter_fields"] = _breakdown().replace(
    "a as (select", "a as (select").replace(
    "from flags)", "from (select * exclude (ok_job_type), ok_job_type and seq % 3 = 1 as ok_job_type from flags))")


# Session master indexes over the V2 records: api rows carry root company {name} and
# location {city}; data rows carry data.company / data.location {value, confidence}
# (an object without name -> 'unknown'; without city -> no location entry);
# nested rows carry neither at the root.
_IDX = f"""with {V1},
m as (select printf('master_%05d', row_number() over (order by session, printf('%06d.json', seq))) as master_id,
        seq, session, company, location, id from v1),
e as (
  select 'by_session' as index_name, session as key, master_id, seq from m
  union all
  select 'by_company', case when seq % 3 = 0 then lower(company) else 'unknown' end, master_id, seq
  from m where seq % 3 in (0, 2)
  union all
  select 'by_location', lower(location), master_id, seq from m where seq % 3 = 0 and coalesce(length(location), 0) > 0)"""
ORACLES["index_entries"] = _IDX + "\nselect index_name, key, master_id from e"
ORACLES["index_summary"] = _IDX + """
select index_name, key, count(*)::bigint as n_ids, arg_min(master_id, seq) as first_id, arg_max(master_id, seq) as last_id
from e group by all"""
ORACLES["index_original_to_master"] = f"""with {V1},
m as (select printf('master_%05d', row_number() over (order by session, printf('%06d.json', seq))) as master_id,
        case when seq % 3 = 0 then id else printf('%06d', seq) end as original_id, session, seq from v1)
select original_id, arg_max(master_id, master_id) as master_id from m group by original_id"""
ORACLES["master_totals"] = f"""with {V1}
select count(distinct session)::bigint as sessions_consolidated, null::varchar as earliest, null::varchar as latest,
  count(*)::bigint as total_jobs from v1"""


# Tracker: last add per job, patched by the updates after it.
_TRK = f"""with {V4},
a as (select session, job_id, max(seq) as aseq from v4 where kind = 'add' group by all),
ad as (select v4.* from v4 join a on v4.session = a.session and v4.job_id = a.job_id and v4.seq = a.aseq),
up as (select v4.* from v4 join a on v4.session = a.session and v4.job_id = a.job_id
       where v4.kind = 'update' and v4.seq > a.aseq),
st as (select session, job_id, arg_max(status, seq) as status from up where status is not null group by all),
ut as (select session, job_id, arg_max(ts, seq) as uts from up group by all),
xk as (select session, job_id, arg_max(extra_k, seq) as extra_k from up where extra_k is not null group by all),
state as (
  select ad.session, ad.job_id, ad.company, ad.title, coalesce(st.status, ad.status) as status, ad.directory,
    strftime(ad.ts, '%Y-%m-%d %H:%M:%S.%f') as created_at, strftime(ut.uts, '%Y-%m-%d %H:%M:%S.%f') as updated_at,
    xk.extra_k
  from ad left join st using (session, job_id) left join ut using (session, job_id) left join xk using (session, job_id))"""
ORACLES["tracker_state"] = _TRK + "\nselect * from state"
ORACLES["tracker_failed"] = _TRK + "\nselect * from state where status = 'failed'"
ORACLES["tracker_stats"] = _TRK + """,
tot as (select session, count(distinct job_id)::bigint as total_jobs from v4 group by all)
select tot.session, tot.total_jobs, count_if(status = 'completed')::bigint as successful,
  count_if(status = 'failed')::bigint as failed, count_if(status = 'in_progress')::bigint as in_progress,
  round_even(count_if(status = 'completed') / any_value(tot.total_jobs) * 100.0, 2) as completion_rate
from tot left join state using (session) group by tot.session, tot.total_jobs"""
ORACLES["tracker_stream_state"] = ORACLES["tracker_state"]
ORACLES["keepfirst_stream"] = ORACLES["keepfirst_rows"]
ORACLES["saved_search_alerts"] = f"""with {V1}, {FLAGS[1:]}
select 'sample' as search_id, seq, id, title, company, 100 as match_score from flags where {_ALL}
union all
select 'city', seq, id, title, company, 100 from v1
where lower({strip("coalesce(experience_level, '')")}) in ('junior', 'senior')
  and location_city is not null and lower(location_city) = 'nation_3'
  and contains(lower(coalesce(company, '')), 'brand#1')"""


# ------------------------------------------------------------------ data quality
# Fields each V2 record carries (api: root company/location objects; nested: job.*;
# extraction: data.* cells with confidence 90 -- a cell whose value was null is an
# object without value).
_CELLS = f"""with {V1},
cells as (
  select seq, 'company' as field, null::varchar as value, null::double as confidence, 'object' as value_type from v1 where seq % 3 = 0
  union all select seq, 'location', null, null, 'object' from v1 where seq % 3 = 0
  union all select seq, 'title', title, null, 'string' from v1 where seq % 3 = 1 and title is not null
  union all select seq, 'company', company, null, 'string' from v1 where seq % 3 = 1 and company is not null
  union all select seq, 'location', null, null, 'object' from v1 where seq % 3 = 1
  union all select seq, 'description', description, null, 'string' from v1 where seq % 3 = 1 and description is not null
  union all select seq, 'salary', null, null, 'object' from v1 where seq % 3 = 1 and (salary_min is not null or salary_max is not null)
  union all select seq, 'jobType', job_type, null, 'string' from v1 where seq % 3 = 1 and job_type is not null
  union all select seq, 'experienceLevel', experience_level, null, 'string' from v1 where seq % 3 = 1 and experience_level is not null
  union all select seq, 'remotePolicy', remote_policy, null, 'string' from v1 where seq % 3 = 1 and remote_policy is not null
  union all select seq, 'postedDate', posted_date, null, 'string' from v1 where seq % 3 = 1 and posted_date is not null
  union all select seq, 'title', title, 90.0, case when title is null then 'object' else 'string' end from v1 where seq % 3 = 2
  union all select seq, 'company', company, 90.0, case when company is null then 'object' else 'string' end from v1 where seq % 3 = 2
  union all select seq, 'location', location, 90.0, case when location is null then 'object' else 'string' end from v1 where seq % 3 = 2
  union all select seq, 'description', description, case when description is null then null else 90.0 end,
    case when description is null then 'object' else 'string' end from v1 where seq % 3 = 2
  union all select seq, 'contactEmail', contact_email, case when contact_email is null then null else 90.0 end,
    case when contact_email is null then 'object' else 'string' end from v1 where seq % 3 = 2
),
rules(field, tier, type, min_confidence, pattern, allowed, weight) as (values
  ('title', 'required', 'string', 80, null, null, 3.0), ('company', 'required', 'string', 70, null, null, 3.0),
  ('location', 'required', 'string', 70, null, null, 3.0), ('salary', 'high_priority', 'object', 60, null, null, 2.0),
  ('description', 'high_priority', 'string', 70, null, null, 2.0),
  ('contactEmail', 'high_priority', 'email', 70, '{EMAIL_PATTERN}', null, 2.0),
  ('requirements', 'medium_priority', 'array', 60, null, null, 1.0),
  ('responsibilities', 'medium_priority', 'array', 60, null, null, 1.0),
  ('jobType', 'medium_priority', 'string', 60, null, ['Full-time', 'Part-time', 'Contract', 'Temporary', 'Internship'], 1.0),
  ('experienceLevel', 'medium_priority', 'string', 50, null,
   ['Entry Level', 'Junior', 'Mid-Level', 'Senior', 'Lead', 'Executive'], 1.0),
  ('benefits', 'optional', 'array', 50, null, null, 0.5),
  ('remotePolicy', 'optional', 'string', 60, null, ['remote', 'hybrid', 'on-site'], 0.5),
  ('companyDescription', 'optional', 'string', 50, null, null, 0.5),
  ('contactPhone', 'optional', 'phone', 60, '{PHONE_PATTERN}', null, 0.5),
  ('contactPerson', 'optional', 'object', 50, null, null, 0.5),
  ('postedDate', 'optional', 'date', 60, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}', null, 0.5)),
checked as (
  select c.*, r.weight,
    case when not (case when r.type in ('string', 'email', 'phone', 'date') then value_type = 'string'
                        when r.type = 'array' then value_type = 'array' when r.type = 'object' then value_type = 'object'
                        else true end) then 'type'
         when r.pattern is not null and not coalesce(regexp_matches(value, r.pattern), false) then 'pattern'
         when r.allowed is not null and not coalesce(list_contains(r.allowed, value), false) then 'enum'
         when confidence is not null and confidence < r.min_confidence then 'low_confidence'
         else 'ok' end as reason
  from cells c join rules r using (field)),
graded as (
  select v1.seq, count_if(reason = 'ok')::bigint as fields_found,
    round(coalesce(sum(case when reason = 'ok' then weight else 0 end), 0) / 22.0 * 100.0, 4) as data_completeness,
    avg(confidence) as avg_confidence
  from v1 left join checked using (seq) group by v1.seq)"""

ORACLES["quality_conformance"] = _CELLS + "\nselect field, reason, count(*)::bigint as postings from checked group by all"
ORACLES["quality_grades"] = _CELLS + """
select case when data_completeness >= 85 then 'A' when data_completeness >= 70 then 'B'
            when data_completeness >= 55 then 'C' when data_completeness >= 40 then 'D' else 'F' end as quality_grade,
  count(*)::bigint as postings from graded group by all"""
ORACLES["quality_extraction"] = _CELLS + """
select round(avg(data_completeness), 4) as avg_completeness, round(avg(avg_confidence), 4) as avg_confidence from graded"""
ORACLES["quality_field_stats"] = _CELLS + """
select field, round(count(*) / (select count(*) from v1) * 100.0, 4) as presence_pct,
  round(count_if(reason = 'ok') / (select count(*) from v1) * 100.0, 4) as valid_pct,
  round(avg(confidence), 4) as mean_confidence
from checked group by field"""

ORACLES["pages_classified"] = r"""
select page_id, len(regexp_extract_all(html, '<a\s'))::integer as n_links,
  len(regexp_extract_all(html, '<article[\s>]'))::integer as n_articles,
  len(regexp_extract_all(html, '<h1[\s>]'))::integer as n_headings,
  case when len(regexp_extract_all(html, '<article[\s>]')) = 1 and len(regexp_extract_all(html, '<h1[\s>]')) >= 1 then 'detail'
       when len(regexp_extract_all(html, '<article[\s>]')) >= 2 or len(regexp_extract_all(html, '<a\s')) >= 20 then 'list'
       else 'other' end as page_type
from pages"""

_TAG, _BASE_TAG = "<[a-zA-Z][^>]*>", r"(?i)<base[\s/][^>]*>"
_HREF = r"""(?i)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
_SCHEME = "^([a-zA-Z][a-zA-Z0-9+.-]*):"


def _href(tag: str) -> str:
    return f"""replace(trim(regexp_replace(regexp_extract({tag}, '{_HREF}', 1), '^["'']|["'']$', '', 'g')), '&amp;', '&')"""


def _undot(path: str) -> str:
    """Path without dot segments: a fold over its segments."""
    segs = f"string_split(substr({path}, 2), '/')"
    kept = (f"list_reduce(list_transform({segs}, lambda s: [s]), lambda acc, x: case when x[1] = '..' then acc[1:len(acc) - 1] when x[1] = '.' then acc "
            f"else acc || x end, []::varchar[])")
    return (f"case when starts_with({path}, '/') then '/' || array_to_string({kept}, '/') || case when {segs}[-1] in ('.', '..') "
            f"and len({kept}) > 0 then '/' else '' end else {path} end")


def _resolve_ctes(pairs: str, name: str) -> str:
    """``name(id, base, ref, url)`` for ``pairs(id, base, ref)``: references resolved part by part."""
    def parts(u: str, x: str) -> str:
        rest = f"regexp_replace(regexp_replace({u}, '#.*$', ''), '{_SCHEME}', '')"
        return (f"regexp_extract({u}, '{_SCHEME}', 1) as s{x}, regexp_extract({rest}, '^(//[^/?]*)', 1) as a{x}, "
                f"regexp_extract({rest}, '^(?://[^/?]*)?([^?]*)', 1) as p{x}, regexp_extract({rest}, '^[^?]*(\\?.*)$', 1) as q{x}")
    return f"""
{name}_parts as (select *, coalesce(nullif(regexp_extract(pb, '^(.*/)', 1), ''), '/') || pr as merged
  from (select *, {parts('base', 'b')}, {parts('ref', 'r')} from {pairs})),
{name} as (select id, base, ref, case when sr <> '' then sr || ':' || ar || {_undot('pr')} || qr
    when ar <> '' then sb || ':' || ar || {_undot('pr')} || qr
    when pr = '' then sb || ':' || ab || pb || case when qr <> '' then qr else qb end
    when starts_with(pr, '/') then sb || ':' || ab || {_undot('pr')} || qr
    else sb || ':' || ab || {_undot('merged')} || qr end as url from {name}_parts)"""


def _links_sql(pages: str) -> str:
    return f"""with pg as ({pages}),
bt as (select page_id as id, url as base, {_href(f"regexp_extract(html, '{_BASE_TAG}', 0)")} as ref from pg),
{_resolve_ctes('bt', 'rb')},
tags as (select page_id, url, unnest(regexp_extract_all(html, '{_TAG}', 0)) as tag from pg),
pairs as (select t.page_id as id, case when rb.ref <> '' then rb.url else regexp_replace(t.url, '#.*$', '') end as base, {_href('tag')} as ref
  from tags t join rb on rb.id = t.page_id where regexp_matches(tag, '{_HREF}') and not regexp_matches(tag, '{_BASE_TAG}')),
{_resolve_ctes('pairs', 'rl')}
select distinct id as page_id, url as link from rl"""


ORACLES["pages_links"] = _links_sql("select page_id, url, html from pages")
ORACLES["pages_link_forms"] = _links_sql(LINKED_PAGES_SQL)

_AUDIT = [("placeholder", r"\[[A-Za-z][^\]\n]*\]"), ("html_comment", "<!--"),
          ("email", EMAIL_PATTERN), ("phone", PHONE_PATTERN)]
ORACLES["documents_audit"] = "\nunion all\n".join(
    f"select '{name}' as issue, count_if(len(regexp_extract_all(text, '{pat}')) > 0)::bigint as documents, "
    f"sum(len(regexp_extract_all(text, '{pat}')))::bigint as occurrences from documents"
    for name, pat in _AUDIT)


# ------------------------------------------------------------------ documented options (ours), queue, J10
_PADDED = f"(' ' || {norm_text('description')} || ' ')"
ORACLES["filter_skills"] = f"""with {V1},
s as (select seq, list_filter(['the', 'and', 'of the'], lambda k: contains({_PADDED}, ' ' || k || ' ')) as m from v1)
select seq, array_to_string(m, ',') as skills_matched, floor(len(m) / 3.0 * 100.0)::integer as skills_confidence,
  floor(len(m) / 3.0 * 100.0) >= 70 as skills_ok from s"""

_AMOUNT = "coalesce(case when salary_max <> 0 then salary_max end, case when salary_min <> 0 then salary_min end)"
_ANNUAL = (f"case when salary_min is not null or salary_max is not null then {_AMOUNT} * (case lower(coalesce("
           f"salary_period, 'annual')) when 'monthly' then 12 when 'hourly' then 2080 else 1 end) end")
_TITLE = f"(' ' || {norm_text('title')} || ' ')"
ORACLES["filter_experience_inferred"] = f"""with {V1},
x as (select seq,
  case when length(trim(coalesce(experience_level, ''))) > 0 then experience_level end as given,
  case when contains({_TITLE}, ' intern ') then 'Entry Level' when contains({_TITLE}, ' trainee ') then 'Entry Level'
       when contains({_TITLE}, ' junior ') then 'Junior' when contains({_TITLE}, ' senior ') then 'Senior'
       when contains({_TITLE}, ' lead ') then 'Lead' when contains({_TITLE}, ' principal ') then 'Lead'
       when contains({_TITLE}, ' head ') then 'Executive' when contains({_TITLE}, ' director ') then 'Executive' end as by_title,
  try_cast(nullif(regexp_extract(lower(coalesce(description, '')), '(\\d{{1,2}})\\+?\\s*(?:years|jahre|ans|años)', 1), '') as integer) as yrs,
  {_ANNUAL} as annual from v1),
y as (select *, case when yrs >= 8 then 'Lead' when yrs >= 5 then 'Senior' when yrs >= 2 then 'Mid-Level'
                     when yrs >= 1 then 'Junior' when yrs >= 0 then 'Entry Level' end as by_years,
        case when annual >= 120000 then 'Lead' when annual >= 80000 then 'Senior' when annual >= 50000 then 'Mid-Level'
             when annual >= 30000 then 'Junior' end as by_salary from x)
select seq, coalesce(given, by_title, by_years, by_salary) as experience_inferred,
  case when given is not null then 'given' when by_title is not null then 'title' when by_years is not null then 'years'
       when by_salary is not null then 'salary' end as experience_source
from y"""

ORACLES["filter_relevance"] = f"""with {V1},
w as (select seq, string_split({norm_text("concat_ws(' ', coalesce(title, ''), coalesce(description, ''))")}, ' ') as words from v1),
t as (select seq, len(list_filter(words, lambda x: x = 'widget')) as t0, len(list_filter(words, lambda x: x = 'red')) as t1,
        len(list_filter(words, lambda x: x = 'gear')) as t2 from w),
d as (select count(*) as n, count_if(t0 > 0) as d0, count_if(t1 > 0) as d1, count_if(t2 > 0) as d2 from t),
s as (select seq, (case when d0 > 0 then t0 * ln(n / d0) else 0 end) + (case when d1 > 0 then t1 * ln(n / d1) else 0 end)
        + (case when d2 > 0 then t2 * ln(n / d2) else 0 end) as relevance from t, d)
select seq, round(relevance, 6) as relevance from s where relevance >= 1e-12"""

ORACLES["url_queue_first_n"] = r"""
select page_id::integer as position, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) as company
from pages order by page_id limit 20"""

ORACLES["filtered_with_tracker"] = _TRK.replace(f"with {V4},", f"with {V4}, {V1}, {FLAGS[1:]},") + f""",
s as (select seq, id, list_filter([{_MET}], lambda x: x is not null) as met from flags)
select s.seq, s.id, floor(len(s.met) / 6 * 100)::integer as match_score, state.status as application_status
from s left join state on state.job_id = s.id where floor(len(s.met) / 6 * 100) >= 50"""

ORACLES["filter_missing_fields"] = f"""with {V1}
select seq, array_to_string(list_filter([
  case when job_type is null then 'job_type' end,
  case when experience_level is null then 'experience_level' end,
  case when remote_policy is null then 'remote_policy' end,
  case when posted_date is null then 'posted_date' end,
  case when title is null then 'title' end,
  case when salary_min is null and salary_max is null then 'salary' end], lambda x: x is not null), ',') as missing_fields
from v1"""


def _alias_sql() -> str:
    from hirelake.operators.quality import RULES

    def alternatives(aliases) -> str:
        return "|".join(a.replace("'", "''") for a in aliases)
    entities = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")]
    text = "s0"
    for entity, char in entities:
        text = f"replace({text}, '{entity}', '{char}')"
    label = "|".join(alternatives(r[-1]) for r in RULES)
    parts = []
    for _, field, *_rest, aliases in RULES:
        value = (f"trim(regexp_replace(regexp_extract(t, '(?i)(?:^|[^\\p{{L}}])(?:{alternatives(aliases)})[ ]*:[ ]*([^\\n]+)', 1), "
                 f"'(?i)(?:^|[^\\p{{L}}])(?:{label})\\s*:.*$', ''))")
        parts.append(f"select page, '{field}' as field, {value} as value, 90 as confidence from tx where {value} <> ''")
    return rf"""with h as (select 'pages:' || page_id as page, html from pages
  union all select 'labelled:' || page_id, html from ({LABELLED_PAGES_SQL})),
a as (select page, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') as s0 from h),
b as (select page, regexp_replace(s0, '(?s)<!--.*?-->', ' ', 'g') as s0 from a),
c as (select page, regexp_replace(s0, '(?i)</?(p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|dt|dd|title)\b[^>]*>|<br\s*/?>', chr(10), 'g') as s0 from b),
d as (select page, regexp_replace(s0, '<[^>]*>', ' ', 'g') as s0 from c),
e as (select page, {text} as s0 from d),
f as (select page, regexp_replace(s0, '[ \t\r\f]+', ' ', 'g') as s0 from e),
tx as (select page, regexp_replace(regexp_replace(s0, ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from f)
""" + "\nunion all\n".join(parts)


ORACLES["pages_alias_fields"] = _alias_sql()

# V6 chains: edge n of a customer carries the order's own value, else what edge n - 1 carried if it was merged earlier.
_OWN = [("contact_email", "case when o_orderkey % 3 = 0 then 'o' || o_orderkey || '@example.org' end"),
        ("salary", "case when o_orderkey % 7 = 0 then o_totalprice end"),
        ("benefits", "case when o_orderkey % 4 = 1 then o_orderpriority end")]
ORACLES["dedup_fill_chain"] = f"""with recursive o as (
  select o_custkey as ck, o_orderkey as k, o_orderpriority as ses, {', '.join(f'{sql} as {f}' for f, sql in _OWN)},
    row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
e as (select c.ck, c.n, c.k, c.k + case when c.k % 5 = 0 then 1000000000000 else 0 end as g, d.ses,
    {', '.join(f'd.{f}' for f, _ in _OWN)} from o c join o d on c.ck = d.ck and d.n = c.n - 1),
r as (select * from e where n = 2
  union all
  select e.ck, e.n, e.k, e.g, e.ses, {', '.join(f'coalesce(e.{f}, case when r.g < e.g then r.{f} end)' for f, _ in _OWN)}
  from r join e on e.ck = r.ck and e.n = r.n + 1)
select k as canonical_seq, contact_email, case when contact_email is not null then ses end as contact_email_source, salary,
  coalesce(benefits, '') as benefits from r"""

ORACLES["filter_city_aliases"] = f"""with {V1},
m as (select seq, case when seq % 7 = 0 then 'München' else location_city end as location_city, location_city is not null as present from v1)
select seq, location_city from m where present and lower(location_city) in ('nation_3', 'munich', 'münchen')"""

_SESSIONS = """with w as (
  select 's' || (user_id % 5) as session, event_id as seq, ts, user_id, event_type as et,
    event_type = 'error' and event_id % 400 = 0 as opened, event_type = 'purchase' and event_id % 100 = 0 as closed
  from events where event_type in ('signup', 'view', 'purchase', 'error', 'click')),
op as (select session, max(seq) as oseq, arg_max(ts, seq) as ots, arg_max(user_id, seq) as total from w where opened group by 1),
cl as (select session, max(seq) as cseq, arg_max(ts, seq) as cts from w where closed group by 1),
a as (select session, user_id, max(seq) as aseq from w where et = 'signup' group by 1, 2),
live as (select a.* from a left join op using (session) where oseq is null or aseq > oseq)"""
ORACLES["tracker_lifecycle"] = _SESSIONS + """
select op.session, strftime(ots, '%Y-%m-%d %H:%M:%S.%f') as started_at,
  case when cseq > oseq then strftime(cts, '%Y-%m-%d %H:%M:%S.%f') end as completed_at, 'all' as source_filter, total::bigint as total_jobs,
  (select count(*) from live where live.session = op.session) as live
from op left join cl on cl.session = op.session"""
ORACLES["tracker_retry"] = _SESSIONS + """,
u as (select l.session, l.user_id,
    arg_max(w.et, w.seq) filter (w.et in ('view', 'purchase', 'error')) as last_et,
    arg_max(w.seq % 2, w.seq) filter (w.et = 'click') as flag
  from live l join w on w.session = l.session and w.user_id = l.user_id and w.seq > l.aseq and not w.opened and not w.closed group by 1, 2)
select session, user_id::varchar as job_id, 'title_' || user_id as title, 'failed' as status from u where last_et = 'error' and flag = 0"""


# ------------------------------------------------------------------ research rows, progress, dates
_V7 = f"v7 as ({BRAND_RESEARCH_SQL})"
_LEVEL = "case when signals >= 6 then 'high' when signals >= 3 then 'medium' when signals >= 1 then 'low' else 'none' end"
ORACLES["research_quality"] = f"with {_V7} select company, {_LEVEL} as research_quality from v7"

ORACLES["research_stack_overlap"] = f"""with {V1}, {_V7},
p as (select seq, {norm_company('company')} as cn, ' ' || {norm_text('description')} || ' ' as padded from v1),
r as (select {norm_company('company')} as cn, tech_stack from v7),
item as (select cn, unnest(tech_stack) as word, generate_subscripts(tech_stack, 1) as i from r),
hit as (select p.seq, word, i from p join item using (cn) where contains(padded, ' ' || {norm_text('word')} || ' '))
select p.seq, coalesce(string_agg(word, ',' order by i), '') as stack_overlap, count(word)::integer as overlap_count
from p join r using (cn) left join hit on hit.seq = p.seq group by p.seq"""

ORACLES["research_progress"] = _TRK + f""", {_V7},
lv as (select {_LEVEL} as level from v7)
select 'successful' as metric, count_if(status = 'completed')::bigint as value,
  round(count_if(status = 'completed') / count(*) * 100, 2) as share_pct from state
union all select 'failed', count_if(status = 'failed')::bigint, round(count_if(status = 'failed') / count(*) * 100, 2) from state
union all select 'research_' || level, count(*)::bigint, round(count(*) / (select count(*) from lv) * 100, 2) from lv group by level"""

ORACLES["session_metadata"] = """
with s as (select o_orderkey, o_orderkey % 4 as kind, strftime(o_orderdate, '%Y%m%d') as day,
             case when o_orderkey % 3 <> 0 then lpad(cast(o_orderkey % 240000 as varchar), 6, '0') end as t from orders),
n as (select *, concat_ws('_', case kind when 0 then 'data_analyst' when 1 then 'data_analysis' else 'session' end, 'scrape', day, t) as session from s)
select o_orderkey, session,
  case when starts_with(day, '20') and t is not null then day[1:4] || '-' || day[5:6] || '-' || day[7:8] || 'T' || t[1:2] || ':' || t[3:4]
    || ':' || t[5:6] || 'Z' end as session_date,
  case kind when 0 then 'filtered_search_data_analyst' when 1 then 'filtered_search_data_analysis' else 'general_search' end as session_type
from n"""

ORACLES["posting_dates"] = f"""with {V1}
select seq, cast(cast(coalesce(try_strptime(posted_date, '%Y-%m-%d'), try_strptime(posted_date, '%d/%m/%Y')) as date) as varchar) as posted_on from v1"""


# Every posting against every saved search, criterion by criterion.
ORACLES["searches_matches"] = f"""with {V1}, s as ({SAVED_SEARCHES_SQL}),
p as (select seq, {strip("coalesce(job_type, '')")} as jt, lower({strip("coalesce(experience_level, '')")}) as ex,
        lower({strip("coalesce(remote_policy, '')")}) as lt, lower(coalesce(title, '')) as title, lower(coalesce(description, '')) as text,
        posted_date, lower(coalesce(location_city, '')) as city, location_city is not null as placed, lower(coalesce(company, '')) as company,
        salary_min is not null or salary_max is not null as paid, {_SAL_MIN} as low, {_SAL_MAX} as high, upper(coalesce(salary_currency, '')) as cur from v1)
select search_id, seq, 100 as match_score from p, s
where (job_types is null or list_contains(job_types, jt)) and (experience_levels is null or list_contains(experience_levels, ex))
  and (location_type is null or list_contains(location_type, lt))
  and (posted_days is null or coalesce(posted_date, '') = '' or coalesce(try_strptime(split_part(posted_date, 'T', 1), '%Y-%m-%d')
       >= timestamp '2001-08-01 00:00:00' - to_days(posted_days::integer), true))
  and (keywords is null or len(list_filter(keywords, lambda k: contains(title, k) or contains(text, k)
       or len(list_filter(string_split(k, ' '), lambda w: not contains(title, w))) = 0)) > 0)
  and ((lo is null and hi is null) or not paid or (cur <> '' and cur <> asked)
       or coalesce((lo is null or coalesce(high, low) >= lo) and (hi is null or coalesce(low, high) <= hi), true))
  and (cities is null or (placed and len(list_filter(cities, lambda c: city = lower(c) or c = '')) > 0))
  and (company_contains is null or contains(company, company_contains))"""

# Members of object fields: what the records were given.
ORACLES["quality_structure"] = f"""with r as ({STRUCTURED_SQL}),
m as (select seq, 'salary' as field, 'min' as path, 'number' as expected, case when salary_min is null then 'null' else 'number' end as value_type from r
  union all select seq, 'salary', 'max', 'number', case when salary_max is null then 'null' when k % 4 = 0 then 'string' else 'number' end from r
  union all select seq, 'salary', 'currency', 'string', case when coalesce(salary_currency, '') = '' then 'null' else 'string' end from r
  union all select seq, 'salary', 'period', 'string', case when salary_period is null then 'null' when k % 5 = 0 then 'array' else 'string' end from r
  union all select seq, 'contactPerson', 'name', 'string', 'string' from r
  union all select seq, 'contactPerson', 'title', 'string', case when k % 6 = 0 then 'number' when k % 6 < 3 then 'string' else 'null' end from r)
select *, case when value_type = 'null' then 'missing' when value_type <> expected then 'type' else 'ok' end as reason from m"""

# Ids of a key by pages of 25; phrases of the skills table, the earliest and longest first.
ORACLES["index_pages"] = _IDX + """,
g as (select seq, row_number() over (order by session, printf('%06d.json', seq)) as n from v1),
r as (select index_name, key, master_id, n, row_number() over (partition by index_name, key order by n) - 1 as rank from e join g using (seq))
select index_name, key, rank // 25 as page, min(n) as first_seq, string_agg(master_id, ',' order by rank) as master_ids from r group by all"""
ORACLES["filter_skills_table"] = f"""with recursive {V1},
sk as (select skill_id, {norm_text('skill')} as phrase from ({SKILLS_SQL})),
ph as (select distinct phrase, len(string_split(phrase, ' ')) as n from sk where phrase <> ''),
w as (select seq, string_split({norm_text('description')}, ' ') as w from v1),
runs as (select seq, i, n, array_to_string(w[i:i + n - 1], ' ') as phrase from (select seq, w, unnest(range(1, len(w) + 1)) as i from w), (select distinct n from ph)
         where i + n - 1 <= len(w)),
spans as (select runs.seq, i, runs.n, phrase from runs join ph using (phrase)),
best as (select seq, i, max(n) as n, arg_max(phrase, n) as phrase from spans group by seq, i),
steps(seq, stop, phrase) as (
  select distinct seq, 0::bigint, null::varchar from best
  union all
  select seq, m.i + m.n, m.phrase from (select s.seq, min(struct_pack(i := b.i, n := b.n, phrase := b.phrase)) as m from steps s
    join best b on b.seq = s.seq and b.i >= s.stop group by s.seq, s.stop))
select s.seq, sk.skill_id, count(*) as hits from steps s join sk using (phrase) group by all"""

# Records in load order; the keep-first decision in that order.
ORACLES["ingest_stream"] = _KF.replace("row_number() over (order by seq) as rn", "row_number() over (order by session, printf('%06d.json', seq)) as rn") + """
select printf('master_%05d', row_number() over (order by v1.session, printf('%06d.json', v1.seq))) as master_id, v1.id, v1.url, v1.title, v1.company, v1.location, v1.session,
  case v1.seq % 3 when 0 then 'api_response' when 1 then 'nested_job' else 'data_fields' end as shape,
  case when v1.seq % 3 = 0 then v1.id else printf('%06d', v1.seq) end as original_id, kf.status
from v1 join kf on kf.seq = v1.seq"""

# The keyword test with the similarity of the title as a last chance.
ORACLES["filter_keyword_similarity"] = f"""with recursive {V1},
kp as (select distinct k as a, lower(coalesce(title, '')) as b from v1, (select unnest(['red widget', 'gear']) as k)),
{ratio_ctes('kp', 'kr')}
select seq, title from v1 where len(list_filter(['red widget', 'gear'], lambda k: contains(lower(coalesce(title, '')), k) or contains(lower(coalesce(description, '')), k)
    or len(list_filter(string_split(k, ' '), lambda w: not contains(lower(coalesce(title, '')), w))) = 0)) > 0
  or exists (select 1 from kr where kr.b = lower(coalesce(title, '')) and kr.r > 0.8)"""

ORACLES["failed_urls"] = r"""
select page_id::integer as position, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) as company, 'tracking parameters' as error, '2001-08-01 00:00:00' as failed_at
from pages where contains(url, 'utm_')"""
