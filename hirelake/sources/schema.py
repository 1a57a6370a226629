"""The typed posting table every operator reads.

One row per posting; ``seq`` is its position in load order. The raw record is
projected once (at ingest, or by a fixture view) into these columns, so that no
operator touches an untyped value.

=====================  ==========================================================
column                 meaning
=====================  ==========================================================
seq                    BIGINT load order (session, file, array position)
id                     STRING consolidated id (P1)
master_id              STRING ``master_%05d`` in load order (P4)
original_id            STRING id | uid | file name (P3)
session                STRING session name
url                    STRING first truthy url field (P1 / P7)
title, company,        STRING consolidated string forms (P1)
location
description            STRING (the flattened record's description)
job_title, job_description  STRING title / description of ``raw.job`` (filter input)
job_type, experience_level, remote_policy, posted_date   STRING (P6 unwrapped)
company_text           STRING company cell value (object -> value, scalar -> string)
company_name           STRING company object ``name`` (dedup's P10), else the scalar
location_is_object     BOOLEAN
location_present       BOOLEAN location truthy
location_city, location_country, location_type           STRING object fields
location_text          STRING object ``value``, or the scalar
salary_present         BOOLEAN salary is a non-empty object
salary_min, salary_max DOUBLE
salary_currency, salary_period                           STRING
contact_email          STRING
requirements, benefits, responsibilities                 ARRAY<STRING>
=====================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTING_COLUMNS: list[tuple[str, str]] = [
    ("seq", "bigint"), ("id", "string"), ("master_id", "string"), ("original_id", "string"),
    ("session", "string"), ("url", "string"), ("title", "string"), ("company", "string"),
    ("location", "string"), ("description", "string"), ("job_title", "string"),
    ("job_description", "string"), ("job_type", "string"),
    ("experience_level", "string"), ("remote_policy", "string"), ("posted_date", "string"),
    ("company_text", "string"), ("company_name", "string"), ("location_is_object", "boolean"),
    ("location_present", "boolean"), ("location_city", "string"), ("location_country", "string"),
    ("location_type", "string"), ("location_text", "string"), ("salary_present", "boolean"),
    ("salary_min", "double"), ("salary_max", "double"), ("salary_currency", "string"),
    ("salary_period", "string"), ("contact_email", "string"), ("requirements", "array<string>"),
    ("benefits", "array<string>"), ("responsibilities", "array<string>"),
]


def conform(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Selects the posting columns in order, adding missing ones as typed NULLs
    (plus the ``extra`` columns as they are)."""
    have = set(df.columns)
    cols = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in POSTING_COLUMNS]
    return df.select(*cols, *(extra or []))
