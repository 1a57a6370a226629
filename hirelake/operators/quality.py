"""Data-quality and text jobs over postings, pages and documents.

The reference names these as agent skills without code; the table forms and
their rules below are ours, built on the reference's extraction schema (field
tiers, types, minimum confidences, patterns, enumerations and aliases).

* Q1 conformance: each posting is exploded to one ``(seq, field, value,
  confidence, value_type)`` row per schema field it carries, joined to the
  15-row rules table (a fixed-size broadcast), and checked.
* Q2 grade: tier-weighted share of conforming fields; grade cut points are ours.
* Q4-Q6 run on stored HTML with native regex only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.text import DATE_PATTERN, EMAIL_PATTERN, PHONE_PATTERN

# ---------------------------------------------------------------------------
# The extraction schema of the reference
# (tier, field, type, min_confidence, pattern, allowed values, aliases)
# ---------------------------------------------------------------------------
RULES = [
    ("required", "title", "string", 80, None, None,
     ["job title", "position", "role", "stelle", "titel", "poste"]),
    ("required", "company", "string", 70, None, None,
     ["employer", "organization", "company name", "unternehmen", "société", "empresa"]),
    ("required", "location", "string", 70, None, None,
     ["standort", "location", "lieu", "ciudad", "ubicación"]),
    ("high_priority", "salary", "object", 60, None, None,
     ["compensation", "pay", "gehalt", "salaire", "salario", "vergütung"]),
    ("high_priority", "description", "string", 70, None, None,
     ["job description", "about the role", "beschreibung", "description du poste"]),
    ("high_priority", "contactEmail", "email", 70, EMAIL_PATTERN, None,
     ["email", "contact email", "e-mail", "kontakt"]),
    ("medium_priority", "requirements", "array", 60, None, None,
     ["qualifications", "what we're looking for", "anforderungen", "exigences", "requisitos"]),
    ("medium_priority", "responsibilities", "array", 60, None, None,
     ["your tasks", "what you'll do", "aufgaben", "responsabilités", "responsabilidades"]),
    ("medium_priority", "jobType", "string", 60, None, ["Full-time", "Part-time", "Contract", "Temporary", "Internship"],
     ["employment type", "job type", "arbeitszeit", "type de contrat"]),
    ("medium_priority", "experienceLevel", "string", 50, None,
     ["Entry Level", "Junior", "Mid-Level", "Senior", "Lead", "Executive"],
     ["level", "seniority", "experience", "erfahrung", "niveau"]),
    ("optional", "benefits", "array", 50, None, None,
     ["perks", "what we offer", "benefits package", "vorteile", "avantages"]),
    ("optional", "remotePolicy", "string", 60, None, ["remote", "hybrid", "on-site"],
     ["work location", "location type", "remote work", "homeoffice", "télétravail"]),
    ("optional", "companyDescription", "string", 50, None, None,
     ["about us", "about the company", "über uns", "à propos"]),
    ("optional", "contactPhone", "phone", 60, PHONE_PATTERN, None,
     ["phone", "telephone", "telefon", "téléphone"]),
    ("optional", "contactPerson", "object", 50, None, None,
     ["hiring manager", "recruiter", "contact person", "ansprechpartner"]),
    ("optional", "postedDate", "date", 60, DATE_PATTERN, None,
     ["posted", "published", "veröffentlicht", "publié"]),
]
# What an object field is made of: member and type.
STRUCTURES = {"salary": {"min": "number", "max": "number", "currency": "string", "period": "string"},
              "contactPerson": {"name": "string", "title": "string"}}
INCLUDE_LOW_CONFIDENCE = False
# ---------------------------------------------------------------------------

# Ours: tier weights for the completeness score and grade cut points.
TIER_WEIGHT = {"required": 3.0, "high_priority": 2.0, "medium_priority": 1.0, "optional": 0.5}
GRADE_CUTS = [(85.0, "A"), (70.0, "B"), (55.0, "C"), (40.0, "D")]


def load_rules(spark: SparkSession, path: str) -> list[tuple]:
    """Rules of a user's schema file (JSON with the tiers under ``extraction_schema``), in the form of ``RULES``.

    Fields of an unknown tier, such as ``custom_fields``, count as optional in the score. A configuration file: one
    object, read whole.
    """
    lines = spark.read.text(path, wholetext=True).collect()
    schema = json.loads(lines[0]["value"])["extraction_schema"]
    return [(tier if tier in TIER_WEIGHT else "optional", name, f.get("type", "string"), int(f.get("min_confidence", 0)),
             f.get("pattern"), f.get("values"), list(f.get("aliases", [])))
            for tier, fields in schema.items() for name, f in fields.items()]


def load_structures(spark: SparkSession, path: str) -> dict[str, dict]:
    """The ``structure`` of each object field of a user's schema file, by field."""
    schema = json.loads(spark.read.text(path, wholetext=True).collect()[0]["value"])["extraction_schema"]
    return {name: f["structure"] for fields in schema.values() for name, f in fields.items() if isinstance(f.get("structure"), dict)}


def structure_rules(structures: dict[str, dict] = STRUCTURES) -> list[tuple[str, str, str]]:
    """A rule ``(field, path, type)`` per member, members of members included (``a.b``)."""
    out = []

    def walk(field: str, prefix: str, members: dict) -> None:
        for name, kind in members.items():
            at = f"{prefix}.{name}" if prefix else name
            out.append((field, at, "object" if isinstance(kind, dict) else str(kind)))
            if isinstance(kind, dict):
                walk(field, at, kind)
    for field, members in structures.items():
        walk(field, "", members)
    return out


def rules_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """The extraction schema as a rules DataFrame."""
    rows = [(t, f, ty, mc, p, v, a, TIER_WEIGHT[t]) for t, f, ty, mc, p, v, a in rules]
    return spark.createDataFrame(rows, "tier string, field string, type string, min_confidence int, pattern string, "
                                       "allowed array<string>, aliases array<string>, weight double")


def _cell(raw: Column, path: str, field: str) -> Column:
    """One schema field of a record as a struct: value text, confidence and JSON type.
    A ``{value, confidence}`` cell is unwrapped; anything else is its own value."""
    v = F.try_variant_get(raw, path, "variant")
    t = F.schema_of_variant(v)
    is_cell = t.startswith("OBJECT") & F.try_variant_get(raw, f"{path}.value", "variant").isNotNull()
    inner = F.when(is_cell, F.try_variant_get(raw, f"{path}.value", "variant")).otherwise(v)
    it = F.schema_of_variant(inner)
    kind = (F.when(it == "STRING", "string").when(it.startswith("OBJECT"), "object")
            .when(it.startswith("ARRAY"), "array").when(it == "BOOLEAN", "boolean")
            .when(it.isin("VOID"), "null").otherwise("number"))
    text = F.when(kind.isin("string", "number", "boolean"), F.try_variant_get(inner, "$", "string"))
    conf = F.when(is_cell, F.try_variant_get(raw, f"{path}.confidence", "double"))
    return F.when(v.isNotNull(), F.struct(F.lit(field).alias("field"), text.alias("value"), conf.alias("confidence"),
                                          kind.alias("value_type")))


def field_cells(records: DataFrame, fields: list[str]) -> DataFrame:
    """Tall ``(seq, field, value, confidence, value_type)``: every schema field a record
    carries, from ``data.*`` (extraction records), ``job.*`` (nested jobs) or the root."""
    raw = F.col("raw")
    cells = []
    for field in fields:
        from_data = _cell(raw, f"$.data.{field}", field)
        from_job = _cell(raw, f"$.job.{field}", field)
        from_root = _cell(raw, f"$.{field}", field)
        cells.append(F.coalesce(from_data, from_job, from_root))
    exploded = records.select("seq", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return exploded.select("seq", "c.*")


def conformance(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Q1: one row per present field with ``valid`` and ``reason``
    (``type``, ``pattern``, ``enum``, ``low_confidence`` or ``ok``)."""
    fields = [r["field"] for r in rules.select("field").collect()]   # a schema's fields, some dozens
    c = field_cells(records, fields).join(F.broadcast(rules), "field")
    type_ok = (F.when(F.col("type").isin("string", "email", "phone", "date"), F.col("value_type") == "string")
               .when(F.col("type") == "number", F.col("value_type") == "number")
               .when(F.col("type") == "array", F.col("value_type") == "array")
               .when(F.col("type") == "object", F.col("value_type") == "object")
               .when(F.col("type") == "boolean", F.col("value_type") == "boolean")
               .otherwise(F.lit(True)))
    pattern_ok = F.when(F.col("pattern").isNull(), F.lit(True)).otherwise(
        F.coalesce(F.expr("value rlike pattern"), F.lit(False)))
    enum_ok = F.when(F.col("allowed").isNull(), F.lit(True)).otherwise(
        F.coalesce(F.array_contains(F.col("allowed"), F.col("value")), F.lit(False)))
    conf_ok = F.col("confidence").isNull() | (F.col("confidence") >= F.col("min_confidence"))
    reason = (F.when(~type_ok, "type").when(~pattern_ok, "pattern").when(~enum_ok, "enum")
              .when(~conf_ok, "low_confidence").otherwise("ok"))
    return c.select("seq", "field", "tier", "weight", "value", "confidence", "value_type",
                    (reason == "ok").alias("valid"), reason.alias("reason"),
                    ((reason == "ok") | ((reason == "low_confidence") & F.lit(INCLUDE_LOW_CONFIDENCE))).alias("kept"))


def _kind(v: Column) -> Column:
    """JSON type of a VARIANT (NULL: absent)."""
    t = F.schema_of_variant(v)
    return F.when(v.isNotNull(), F.when(t == "STRING", "string").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
                  .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number"))


def structure_conformance(records: DataFrame, structures: dict[str, dict] = STRUCTURES) -> DataFrame:
    """Q1 for members of object fields: ``(seq, field, path, expected, value_type, reason)``, a row for each member that the schema names of each
    object a record carries (from ``data``, ``job`` or the root, out of its cell); reason ``ok``, ``type`` or ``missing`` (absent or null).
    Email, phone and date members are strings."""
    raw, cells = F.col("raw"), []
    for field, path, kind in structure_rules(structures):
        want = "string" if kind in ("email", "phone", "date") else kind
        found = F.lit(None).cast("struct<value_type:string>")
        for root in (f"$.{field}", f"$.job.{field}", f"$.data.{field}"):   # the last that is there wins
            for at in (root, f"{root}.value"):
                owner = ".".join([at, *path.split(".")[:-1]])
                found = F.when(_kind(F.try_variant_get(raw, owner, "variant")) == "object",
                               F.when(_kind(F.try_variant_get(raw, f"{root}.value", "variant")).isNotNull() & F.lit(at == root), found)
                               .otherwise(F.struct(F.coalesce(_kind(F.try_variant_get(raw, f"{at}.{path}", "variant")), F.lit("null")).alias("value_type")))).otherwise(found)
        kind_found = found["value_type"]
        reason = F.when(kind_found == "null", "missing").when(kind_found != want, "type").otherwise("ok")
        cells.append(F.when(found.isNotNull(), F.struct(F.lit(field).alias("field"), F.lit(path).alias("path"), F.lit(kind).alias("expected"),
                                                        kind_found.alias("value_type"), reason.alias("reason"))))
    return records.select("seq", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("seq", "c.*")


def conformance_summary(checked: DataFrame) -> DataFrame:
    """Q1 report: per field and reason, the number of postings."""
    return checked.groupBy("field", "reason").agg(F.count(F.lit(1)).alias("postings"))


def grades(checked: DataFrame, records: DataFrame, rules: DataFrame) -> DataFrame:
    """Q2: per posting, fields found, tier-weighted completeness (kept fields) and grade A-F."""
    total_weight = rules.agg(F.sum("weight")).first()[0] or 1.0
    per = checked.groupBy("seq").agg(
        F.count_if("kept").alias("fields_found"),
        F.sum(F.when(F.col("kept"), F.col("weight")).otherwise(0.0)).alias("w"),
        F.avg("confidence").alias("avg_confidence"))
    per = records.select("seq").join(per, "seq", "left").fillna({"fields_found": 0, "w": 0.0})
    comp = F.round(F.col("w") / F.lit(total_weight) * 100.0, 4)
    grade = F.lit("F")
    for cut, g in reversed(GRADE_CUTS):
        grade = F.when(comp >= cut, F.lit(g)).otherwise(grade)
    return per.select("seq", F.col("fields_found").cast("bigint").alias("fields_found"),
                      comp.alias("data_completeness"), grade.alias("quality_grade"), "avg_confidence")


def grade_distribution(graded: DataFrame) -> DataFrame:
    """Q2 report: postings per grade."""
    return graded.groupBy("quality_grade").agg(F.count(F.lit(1)).alias("postings"))


def extraction_quality(graded: DataFrame) -> DataFrame:
    """Mean completeness and mean confidence over postings."""
    return graded.agg(F.round(F.avg("data_completeness"), 4).alias("avg_completeness"),
                      F.round(F.avg("avg_confidence"), 4).alias("avg_confidence"))


def field_statistics(checked: DataFrame, records: DataFrame) -> DataFrame:
    """Per field, presence share, valid share and mean confidence (percent of postings)."""
    n = float(records.count())   # one number
    per = checked.groupBy("field").agg(F.count(F.lit(1)).alias("present"), F.count_if("valid").alias("valid"),
                                       F.avg("confidence").alias("mean_confidence"))
    share = (lambda c: F.round(F.col(c) / F.lit(n) * 100.0, 4)) if n > 0 else (lambda c: F.lit(None).cast("double"))
    return per.select("field", share("present").alias("presence_pct"), share("valid").alias("valid_pct"),
                      F.round("mean_confidence", 4).alias("mean_confidence"))


# ------------------------------------------------------------------ pages and documents

def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def classify_pages(pages: DataFrame) -> DataFrame:
    """Q4 (ours): detail page = one article block with a heading; list page = several
    article blocks or at least 20 links; otherwise other."""
    h = F.col("html")
    out = pages.select("page_id", "url",
                       _count(h, r"<a\s").alias("n_links"),
                       _count(h, r"<article[\s>]").alias("n_articles"),
                       _count(h, r"<h1[\s>]").alias("n_headings"))
    kind = (F.when((F.col("n_articles") == 1) & (F.col("n_headings") >= 1), "detail")
            .when((F.col("n_articles") >= 2) | (F.col("n_links") >= 20), "list").otherwise("other"))
    return out.withColumn("page_type", kind)


_TAG = r"<[a-zA-Z][^>]*>"
_BASE_TAG = r"(?i)<base[\s/][^>]*>"
#: The href attribute of a tag, its value in either quote or none.
HREF = r"""(?i)[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _href(tag: Column) -> Column:
    """Value of the href attribute of a tag ('' if there is none): quotes and spaces around it removed, ``&amp;`` decoded."""
    raw = F.regexp_extract(tag, HREF, 1)
    return F.replace(F.trim(F.regexp_replace(raw, "^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&"))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments (RFC 3986, 5.2.4); a path that does not begin with a slash stays."""
    parts = F.split(F.substring(path, 2, 1_000_000_000), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                       .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    folder = F.element_at(parts, -1).isin(".", "..")   # names a folder: ends with a slash
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(F.when(folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """``ref`` resolved against the absolute url ``base`` (RFC 3986, 5.2.2), without its fragment."""
    scheme = lambda u: F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    rest = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    authority = lambda r: F.regexp_extract(r, "^(//[^/?]*)", 1)
    path = lambda r: F.regexp_extract(r, r"^(?://[^/?]*)?([^?]*)", 1)
    query = lambda r: F.regexp_extract(r, r"^[^?]*(\?.*)$", 1)
    b, r = rest(base), rest(ref)
    start = F.concat(scheme(base), F.lit(":"))
    folder = F.regexp_extract(path(b), "^(.*/)", 1)
    merged = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path(r))
    return (F.when(scheme(ref) != "", F.concat(scheme(ref), F.lit(":"), authority(r), without_dots(path(r)), query(r)))
            .when(authority(r) != "", F.concat(start, authority(r), without_dots(path(r)), query(r)))
            .when(path(r) == "", F.concat(start, authority(b), path(b), F.when(query(r) != "", query(r)).otherwise(query(b))))
            .when(path(r).startswith("/"), F.concat(start, authority(b), without_dots(path(r)), query(r)))
            .otherwise(F.concat(start, authority(b), without_dots(merged), query(r))))


def extract_links(pages: DataFrame) -> DataFrame:
    """Q5: every href of a page's tags resolved against the page's ``<base>`` (itself resolved against the page url) or, without
    one, its url; without fragments, distinct."""
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    own_base = _href(F.regexp_extract("html", _BASE_TAG, 0))
    base = F.when(own_base != "", resolve_url(F.col("url"), own_base)).otherwise(F.regexp_replace("url", "#.*$", ""))
    found = pages.select("page_id", base.alias("base"), F.explode(F.filter(tags, lambda t: t.rlike(HREF) & ~t.rlike(_BASE_TAG))).alias("tag"))
    return found.select("page_id", resolve_url(F.col("base"), _href(F.col("tag"))).alias("link")).distinct()


_BLOCK_TAG = r"(?i)<(?:/?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|dt|dd|title)\b[^>]*|br\s*/?)>"


def strip_tags(html: Column) -> Column:
    """Visible text: scripts and styles dropped, block tags to line ends, other tags to spaces, common entities decoded."""
    s = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, _BLOCK_TAG, "\n")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for ent, ch in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    s = F.regexp_replace(F.regexp_replace(s, r"[^\S\n]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def alias_fields(texts: DataFrame, id_col: str, text_col: str, rules: list[tuple] = RULES) -> DataFrame:
    """Q6 (ours): for each schema field, the first ``<alias>: value`` in the text; the value ends
    with its line or before the next known label, however long it is
    (aliases in en/de/fr/es, case-insensitive), with confidence 90 for a label
    followed by a colon. Tall output: ``(id, field, value, confidence)``."""
    def either(aliases) -> str:
        return "|".join(re.sub(r"([^\w\s'-])", r"\\\1", a) for a in aliases)
    next_label = rf"(?iu)(?:^|[^\p{{L}}])(?:{'|'.join(either(r[-1]) for r in rules if r[-1])})\s*:.*$"
    def cells(text: Column) -> Column:
        found = []
        for _, field, *_rest, aliases in rules:
            if not aliases:
                continue
            pat = rf"(?iu)(?:^|[^\p{{L}}])(?:{either(aliases)})[^\S\n]*:[^\S\n]*([^\n]+)"
            v = F.trim(F.regexp_replace(F.regexp_extract(text, pat, 1), next_label, ""))
            found.append(F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(90).alias("confidence")))
        return F.filter(F.array(*found), lambda c: c["value"] != "")
    # each text is made once and each pattern runs once over it: a bound variable is not inlined into its uses, and
    # an outer generator is not evaluated a second time as a filter on its size
    # a label and its value stand in one line, so only lines with a colon are searched
    lines = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line: F.contains(line, F.lit(":"))), "\n")
    once = F.flatten(F.transform(F.array(lines), cells))
    return (texts.select(id_col, F.explode_outer(once).alias("c")).where(F.col("c").isNotNull())
            .select(id_col, "c.field", "c.value", "c.confidence"))


AUDIT_RULES = [("placeholder", r"\[[A-Za-z][^\]\n]*\]"), ("html_comment", r"<!--"),
               ("email", EMAIL_PATTERN), ("phone", PHONE_PATTERN)]


def audit(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Q9 + M13/M14: per issue, documents affected and total occurrences."""
    counts = texts.select(*[_count(F.col(text_col), pat).alias(issue) for issue, pat in AUDIT_RULES])
    one = counts.agg(*[F.count_if(F.col(i) > 0).alias(f"{i}_docs") for i, _ in AUDIT_RULES],
                     *[F.sum(i).cast("bigint").alias(f"{i}_n") for i, _ in AUDIT_RULES])
    rows = F.array(*[F.struct(F.lit(i).alias("issue"), F.col(f"{i}_docs").alias("documents"),
                              F.col(f"{i}_n").alias("occurrences")) for i, _ in AUDIT_RULES])
    return one.select(F.inline(rows))
