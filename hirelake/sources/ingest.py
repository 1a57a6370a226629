"""Posting ingest: session folders of JSON files -> VARIANT -> the typed posting table.

Sources (S1-S5): every sub-directory of ``root`` whose name contains ``session``
holds either ``api_response_all.json`` (a JSON array; when present it replaces the
session's ``jobs`` folder) or ``jobs/*.json`` (one object per file). Files are read
whole with ``_metadata.file_path``, parsed with ``try_parse_json`` (a broken file
becomes a reject row, never an abort) and exploded with their array position.

Projection (P1-P6): the record shape is probed per row -- key ``job`` -> nested
job, key ``data`` -> extraction fields, else api response -- and every typed
column is one ``try_variant_get`` expression, so the whole projection is a single
codegen'd stage. ``seq`` is the two-phase rank over (session, file, position) and
``master_id`` is ``master_%05d`` of it (P4).

A single api array file cannot be split (that is the format); postings landed as
one object per file or per line parallelise fully.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.text import nullif_empty
from hirelake.plans.sequence import assign_sequence
from hirelake.session import cut_lineage
from hirelake.sources.schema import conform

NESTED, DATA_FIELDS, API = "nested_job", "data_fields", "api_response"
# Session types and the date prefix of the reference's session names.
SESSION_TYPES = [("data_analyst", "filtered_search_data_analyst"),
                 ("data_analysis", "filtered_search_data_analysis")]
GENERAL_SEARCH = "general_search"
PARITY_DATE_PREFIX = "202511"
URL_FIELDS = ["url", "source_url", "applicationUrl", "job_url", "link"]


# ------------------------------------------------------------------ reading

def _read_whole(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Whole files matching ``pattern`` with their path; None when nothing matches."""
    try:
        df = spark.read.text(pattern, wholetext=True)
        df.schema  # resolves the glob
    except AnalysisException:
        return None
    return df.select(F.col("_metadata.file_path").alias("path"), "value")


_SESSION = r"/([^/]*session[^/]*)/(?:jobs/[^/]*|api_response_all\.json)$"


def _is_one_value(text: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it (the parsers read a value and ignore what follows): it must also
    parse as the member of an object."""
    return F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x").isNotNull()


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 + S3: whole files ``(path, value)`` of session folders to raw rows ``(session, source_file, pos, from_api, raw VARIANT)`` and rejects
    ``(session, source_file, error)``. Works on a batch of a stream as well; :func:`without_replaced` drops the job files that an api file replaces."""
    named = files.select(F.regexp_extract("path", _SESSION, 1).alias("session"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "value")
    from_api = F.col("source_file") == "api_response_all.json"
    # an array element by element: one VARIANT of the whole would be limited to 128 MiB
    is_array = F.col("value").rlike(r"^\s*\[")
    items = F.when(is_array & _is_one_value(F.col("value")), F.from_json("value", "array<variant>"))
    one = F.when(_is_one_value(F.col("value")), F.try_parse_json("value"))
    read = named.select("session", "source_file", from_api.alias("from_api"), is_array.alias("is_array"),
                        F.when(from_api, items).otherwise(F.when(one.isNotNull(), F.array(one))).alias("items"))
    error = F.when(F.col("from_api") & ~F.col("is_array"), F.lit("not a JSON array")).otherwise(F.lit("invalid JSON"))
    rejects = read.where(F.col("items").isNull()).select("session", "source_file", error.alias("error"))
    rows = read.where(F.col("items").isNotNull()).select("session", "source_file", F.posexplode("items").alias("pos", "raw"), "from_api")
    return rows.select("session", "source_file", "pos", "from_api", "raw"), rejects


def without_replaced(rows: DataFrame, api_sessions: DataFrame) -> DataFrame:
    """S3: an api file replaces its session's jobs folder, even an empty one."""
    replaced = rows.where(~F.col("from_api")).join(api_sessions.select("session").distinct(), "session", "left_anti")
    return rows.where("from_api").unionByName(replaced)


def read_sessions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows ``(session, source_file, pos, from_api, raw VARIANT)`` and rejects
    ``(session, source_file, error)``."""
    root = root.rstrip("/")
    found = [f for f in (_read_whole(spark, f"{root}/*session*/api_response_all.json"), _read_whole(spark, f"{root}/*session*/jobs/*.json")) if f is not None]
    if not found:
        raise FileNotFoundError(f"no session files under {root}")
    files = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    rows, rejects = parse_files(files)
    api = files.where(F.col("path").endswith("/api_response_all.json")).select(F.regexp_extract("path", _SESSION, 1).alias("session"))
    return without_replaced(rows, api), rejects


def session_folders(spark: SparkSession, root: str) -> DataFrame:
    """``session`` of every folder of ``root`` whose name holds "session", with or without files (names listed by the driver)."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*session*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return spark.createDataFrame([(s.getPath().getName(),) for s in found if s.isDirectory()], "session string")


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """A1 + S4: (session, structure_type) of every session folder: ``api_response`` if it holds an api file, else ``jobs_directory``
    if it holds job files, readable or not, else ``unknown``."""
    root = root.rstrip("/")
    folders = session_folders(spark, root)
    found = None
    for rank, (pattern, kind) in enumerate([("api_response_all.json", "api_response"), ("jobs/*.json", "jobs_directory")]):
        files = _read_whole(spark, f"{root}/*session*/{pattern}")
        if files is not None:
            part = files.select(F.regexp_extract("path", _SESSION, 1).alias("session"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return folders.withColumn("structure_type", F.lit("unknown"))
    kinds = found.groupBy("session").agg(F.min(F.struct("rank", "kind"))["kind"].alias("structure_type"))
    return folders.join(kinds, "session", "left").select("session", F.coalesce("structure_type", F.lit("unknown")).alias("structure_type"))


def read_master(spark: SparkSession, path: str, key: str = "jobs") -> tuple[DataFrame, DataFrame]:
    """S6 + S7: raw rows and rejects, as of :func:`read_sessions`, of JSON master files: an array of records, or an
    object whose ``key`` is one. A record's session is its ``session_source``, else the file's name."""
    files = _read_whole(spark, path)
    if files is None:
        raise FileNotFoundError(path)
    value = F.col("value")
    items = F.from_json(F.when(value.rlike(r"^\s*\["), value).otherwise(F.get_json_object(value, f"$.{key}")), "array<variant>")
    read = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), items.alias("items"))
    rejects = read.where(F.col("items").isNull()).select(F.col("source_file").alias("session"), "source_file",
                                                         F.lit("no record array").alias("error"))
    rows = read.where(F.col("items").isNotNull()).select("source_file", F.posexplode("items").alias("pos", "raw"))
    session = F.coalesce(nullif_empty(F.try_variant_get("raw", "$.session_source", "string")), F.col("source_file"))
    return rows.select(session.alias("session"), "source_file", "pos", F.lit(False).alias("from_api"), "raw"), rejects


def raw_from_strings(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Raw rows from a DataFrame of JSON strings (``session``, ``source_file``, ``pos`` given)."""
    return df.select("session", "source_file", F.col("pos").cast("int").alias("pos"),
                     F.lit(False).alias("from_api"), F.try_parse_json(value_col).alias("raw"))


# ------------------------------------------------------------------ projection helpers

def _v(raw: Column, path: str) -> Column:
    """A part as a value of its own: it is copied, so a part that several columns read is taken once, as a column, and read at ``$``."""
    return raw if path == "$" else F.try_variant_get(raw, path, "variant")


def _is_obj(raw: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_v(raw, path)).startswith("OBJECT"), F.lit(False))


def _s(raw: Column, path: str) -> Column:
    """Scalar as string (objects and arrays give NULL)."""
    return F.when(~F.coalesce(F.schema_of_variant(_v(raw, path)).rlike("^(OBJECT|ARRAY)"), F.lit(False)), F.try_variant_get(raw, path, "string"))


def _truthy_s(raw: Column, path: str) -> Column:
    """Scalar as string when truthy in Python's sense: '' , 0, false and null are not."""
    t = F.schema_of_variant(_v(raw, path))
    s = _s(raw, path)
    truthy = (F.when(t == "STRING", F.length(s) > 0)
              .when(t == "BOOLEAN", s == "true")
              .when(t == "VOID", F.lit(False))
              .otherwise(F.try_variant_get(raw, path, "double") != 0))
    return F.when(F.coalesce(truthy, F.lit(False)), s)


def _unwrap(raw: Column, path: str) -> Column:
    """Object -> its ``value`` (string), scalar -> the scalar as string."""
    return F.when(_is_obj(raw, path), F.try_variant_get(raw, f"{path}.value", "string")).otherwise(_s(raw, path))


def _obj_or_scalar(raw: Column, path: str, key: str) -> Column:
    """``x.get(key) if isinstance(x, dict) else x``."""
    return F.when(_is_obj(raw, path), F.try_variant_get(raw, f"{path}.{key}", "string")).otherwise(_s(raw, path))


def _str_array(raw: Column, path: str) -> Column:
    arr = F.try_variant_get(raw, path, "array<variant>")
    return F.transform(arr, lambda x: F.coalesce(F.try_variant_get(x, "$.value", "string"),
                                                 F.try_variant_get(x, "$", "string")))


def project(raw_rows: DataFrame, parity_company_name: bool = True) -> DataFrame:
    """P1 + P2 + P3 + P6: raw rows -> the typed posting table (without ``seq``).

    ``parity_company_name``: the dedup normaliser reads only ``company.name`` of an
    object (a ``{value}`` company is blank to it); False also accepts ``value``.
    """
    raw = F.col("raw")
    shape = (F.when(F.col("from_api"), F.lit(API)).when(_v(raw, "$.job").isNotNull(), F.lit(NESTED))
             .when(F.col("_data").isNotNull(), F.lit(DATA_FIELDS)).otherwise(F.lit(API)))
    df = raw_rows.withColumn("_data", _v(raw, "$.data")).withColumn("_data_obj", _is_obj(F.col("_data"), "$")).withColumn("shape", shape)
    # data.* when data is an object, else root keys
    df = df.withColumn("_flat", F.when(F.col("_data_obj"), F.col("_data")).otherwise(raw))
    sh, flat = F.col("shape"), F.col("_flat")

    # Consolidated id, url, title, company, location
    p1_id = (F.when(sh == NESTED, F.coalesce(_truthy_s(raw, "$.job.id"), _s(raw, "$.job.jobId")))
             .when(sh == DATA_FIELDS, _s(raw, "$.job_id"))
             .otherwise(F.coalesce(_truthy_s(raw, "$.id"), _s(raw, "$.uid"))))
    p1_url = (F.when(sh == NESTED, _s(raw, "$.job.url")).when(sh == DATA_FIELDS, _s(raw, "$.url"))
              .otherwise(_s(raw, "$.application_url")))
    p1_title = (F.when(sh == NESTED, _unwrap(raw, "$.job.title")).when(sh == DATA_FIELDS, _unwrap(raw, "$.data.title"))
                .otherwise(_s(raw, "$.slug")))

    def name_or_value(path: str) -> Column:   # P8 reads value, else name, of an object
        return F.when(_is_obj(raw, path), F.coalesce(nullif_empty(F.try_variant_get(raw, f"{path}.value", "string")),
                                                     F.try_variant_get(raw, f"{path}.name", "string")))\
            .otherwise(_s(raw, path))
    p1_company = (F.when(sh == NESTED, name_or_value("$.job.company"))
                  .when(sh == DATA_FIELDS, _unwrap(raw, "$.data.company"))
                  .otherwise(_obj_or_scalar(raw, "$.company", "name")))
    nested_loc = F.when(_is_obj(raw, "$.job.location"),
                        F.coalesce(_truthy_s(raw, "$.job.location.city"), _s(raw, "$.job.location.raw"))) \
        .otherwise(_s(raw, "$.job.location"))
    p1_location = (F.when(sh == NESTED, nested_loc).when(sh == DATA_FIELDS, _unwrap(raw, "$.data.location"))
                   .otherwise(_obj_or_scalar(raw, "$.location", "city")))

    # filter fields: the reference reads raw.job.* only
    j = "$.job"
    loc_obj = _is_obj(raw, f"{j}.location")
    sal_obj = _is_obj(raw, f"{j}.salary")
    sal_nonempty = sal_obj & F.coalesce(F.schema_of_variant(_v(raw, f"{j}.salary")) != "OBJECT<>", F.lit(False))

    # flattened session-record fields
    flat_company_name = F.when(sh == NESTED, _company_for_dedup(raw, "$.job.company", parity_company_name)) \
        .otherwise(_company_for_dedup(flat, "$.company", parity_company_name))
    url_any = F.coalesce(*[nullif_empty(_s(flat, f"$.{u}")) for u in URL_FIELDS])

    out = df.select(
        "session", "source_file", "pos", "shape", "raw",
        p1_id.alias("id"),
        F.coalesce(_truthy_s(raw, "$.id"), _truthy_s(raw, "$.uid"),
                   F.regexp_replace(F.col("source_file"), r"\.json", "")).alias("original_id"),
        p1_url.alias("url"), p1_title.alias("title"), p1_company.alias("company"), p1_location.alias("location"),
        _unwrap(raw, f"{j}.title").alias("job_title"),
        _unwrap(raw, f"{j}.description").alias("job_description"),
        _unwrap(raw, f"{j}.jobType").alias("job_type"),
        _unwrap(raw, f"{j}.experienceLevel").alias("experience_level"),
        _unwrap(raw, f"{j}.remotePolicy").alias("remote_policy"),
        _unwrap(raw, f"{j}.postedDate").alias("posted_date"),
        _unwrap(raw, f"{j}.company").alias("company_text"),
        loc_obj.alias("location_is_object"),
        F.when(loc_obj, F.coalesce(F.schema_of_variant(_v(raw, f"{j}.location")) != "OBJECT<>", F.lit(False)))
        .otherwise(F.coalesce(F.length(_s(raw, f"{j}.location")) > 0, F.lit(False))).alias("location_present"),
        F.when(loc_obj, F.try_variant_get(raw, f"{j}.location.city", "string")).alias("location_city"),
        F.when(loc_obj, F.try_variant_get(raw, f"{j}.location.country", "string")).alias("location_country"),
        F.when(loc_obj, F.try_variant_get(raw, f"{j}.location.type", "string")).alias("location_type"),
        F.when(loc_obj, F.try_variant_get(raw, f"{j}.location.value", "string"))
        .otherwise(_s(raw, f"{j}.location")).alias("location_text"),
        sal_nonempty.alias("salary_present"),
        F.try_variant_get(raw, f"{j}.salary.min", "double").alias("salary_min"),
        F.try_variant_get(raw, f"{j}.salary.max", "double").alias("salary_max"),
        F.try_variant_get(raw, f"{j}.salary.currency", "string").alias("salary_currency"),
        F.try_variant_get(raw, f"{j}.salary.period", "string").alias("salary_period"),
        flat_company_name.alias("company_name"),
        url_any.alias("any_url"),
        _unwrap(flat, "$.description").alias("flat_description"),
        _unwrap(flat, "$.contactEmail").alias("contact_email"),
        _str_array(flat, "$.requirements").alias("requirements"),
        _str_array(flat, "$.benefits").alias("benefits"),
        _str_array(flat, "$.responsibilities").alias("responsibilities"),
        F.when(F.col("_data_obj"), _v(raw, "$.metadata")).alias("extraction_metadata"),
    )
    return out


def _filled(rec: Column, path: str) -> Column:
    """A non-empty string, object or list; numbers and booleans do not count. An extraction cell
    (``{value, confidence}``) is filled when its value is."""
    def of(path: str) -> Column:
        t = F.schema_of_variant(_v(rec, path))
        return F.coalesce(F.when(t == "STRING", F.length(F.try_variant_get(rec, path, "string")) > 0)
                          .when(t.startswith("OBJECT"), t != "OBJECT<>")
                          .when(t.startswith("ARRAY"), F.size(F.try_variant_get(rec, path, "array<variant>")) > 0), F.lit(False))
    is_cell = _is_obj(rec, path) & (_v(rec, f"{path}.value").isNotNull() | _v(rec, f"{path}.confidence").isNotNull())
    return F.when(is_cell, of(f"{path}.value")).otherwise(of(path))


def _list(rec: Column, path: str) -> Column:
    """A list, or a cell's list, as strings; a lone filled string is a list of one."""
    one = nullif_empty(F.coalesce(F.try_variant_get(rec, f"{path}.value", "string"), _s(rec, path)))
    return F.coalesce(_str_array(rec, path), _str_array(rec, f"{path}.value"), F.when(one.isNotNull(), F.array(one)))


def flattened(postings: DataFrame, parity_company_name: bool = True, carry_root_url: bool = True) -> DataFrame:
    """P2 + P7 + P11 + P14: ingested postings with the columns that entity resolution reads taken from the flattened
    record: ``data`` where it is an object, else ``job``, else the root. The filter columns keep ``raw.job``, so
    the two readings are two tables. Location cells are unwrapped like titles. ``carry_root_url``: a
    record without a url of its own takes that of the root. ``*_filled`` say what P14 counts.
    """
    raw = F.col("raw")
    data, job = _v(raw, "$.data"), _v(raw, "$.job")
    rec = F.when(_is_obj(F.col("_data"), "$"), F.col("_data")).when(_is_obj(F.col("_job"), "$"), F.col("_job")).otherwise(raw)
    read = ["title", "company", "location", "description", "salary", "contactEmail", "requirements", "benefits", "responsibilities"]
    x = {f: F.col(f"_in_{f}") for f in read + URL_FIELDS}   # each field of the record, taken once
    urls = [_truthy_s(x[u], "$") for u in URL_FIELDS]
    if carry_root_url:
        urls += [_truthy_s(raw, f"$.{u}") for u in URL_FIELDS]

    def part(field: str, key: str, kind: str) -> Column:   # of an object or of a cell's object
        return F.coalesce(F.try_variant_get(x[field], f"$.{key}", kind), F.try_variant_get(x[field], f"$.value.{key}", kind))
    city, country = part("location", "city", "string"), part("location", "country", "string")
    place = _unwrap(x["location"], "$")
    new = {
        "url": F.coalesce(*urls),
        "title": _unwrap(x["title"], "$"),
        "company": F.coalesce(F.try_variant_get(x["company"], "$.name", "string"), _unwrap(x["company"], "$")),
        "company_name": _company_for_dedup(x["company"], "$", parity_company_name),
        "location": F.coalesce(place, city),
        "location_is_object": _is_obj(x["location"], "$") & (place.isNull() | city.isNotNull() | country.isNotNull()),
        "location_present": _filled(x["location"], "$"),
        "location_city": city, "location_country": country, "location_text": place,
        "description": _unwrap(x["description"], "$"),
        "salary_present": _filled(x["salary"], "$"),
        "salary_min": part("salary", "min", "double"), "salary_max": part("salary", "max", "double"),
        "salary_currency": part("salary", "currency", "string"), "salary_period": part("salary", "period", "string"),
        "contact_email": F.when(_filled(x["contactEmail"], "$"), _unwrap(x["contactEmail"], "$")),
        **{f: _list(x[f], "$") for f in ("requirements", "benefits", "responsibilities")},
        **{f"{f}_filled": _filled(x[f], "$") for f in ("title", "company", "location", "description")},
    }
    kept = [c for c in postings.columns if c not in new and c != "any_url"]
    records = postings.withColumns({"_data": data, "_job": job}).withColumn("_rec", rec)
    return (records.withColumns({f"_in_{f}": _v(F.col("_rec"), f"$.{f}") for f in x})
            .select(*kept, *[c.alias(n) for n, c in new.items()]))


def _company_for_dedup(raw: Column, path: str, parity: bool) -> Column:
    name = F.try_variant_get(raw, f"{path}.name", "string")
    value = F.try_variant_get(raw, f"{path}.value", "string")
    obj = F.coalesce(name, F.lit("")) if parity else F.coalesce(nullif_empty(name), value, F.lit(""))
    return F.when(_is_obj(raw, path), obj).otherwise(_s(raw, path))


def session_metadata(sessions: DataFrame, date_prefix: str = "20") -> DataFrame:
    """P5: ``session_date`` (ISO ``...Z`` when a date part and the following time part
    exist; the last date part wins) and ``session_type`` from the session name.

    The reference recognises only date parts starting ``202511``; ``date_prefix``
    generalises it (pass ``PARITY_DATE_PREFIX`` for the literal rule)."""
    parts = F.split(F.col("session"), "_")
    n = F.size(parts)
    idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    is_date = lambda i: parts[i].startswith(date_prefix) & (F.length(parts[i]) == 8)
    is_time = lambda i: (i + 1 < n) & parts[i + 1].rlike(r"^[0-9]{6}$")
    date_idx = F.array_max(F.filter(idx, lambda i: is_date(i)))
    time_idx = F.array_max(F.filter(idx, lambda i: is_date(i) & is_time(i)))
    d = parts[date_idx]
    t = parts[time_idx + 1]
    date_s = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2))
    time_s = F.concat(F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.substring(t, 5, 2))
    stype = F.lit(GENERAL_SEARCH)
    for needle, name in reversed(SESSION_TYPES):
        stype = F.when(F.col("session").contains(needle), F.lit(name)).otherwise(stype)
    return sessions.select(
        "*",
        F.when(date_idx.isNotNull() & time_idx.isNotNull(), F.concat(date_s, F.lit("T"), time_s, F.lit("Z")))
        .alias("session_date"),
        stype.alias("session_type"))


def ingest(raw_rows: DataFrame, parity_company_name: bool = True, start: int = 1) -> DataFrame:
    """Raw rows -> typed postings with ``seq`` (two-phase rank over session, file,
    position, from ``start``) and ``master_id``; the raw VARIANT stays available as ``raw``.

    The projection is materialised once (checkpoint). Only the keys are ranked; the numbers are joined
    back by a row number, and later steps shuffle in that join only the columns they read."""
    return conform(_numbered(_described(project(raw_rows, parity_company_name)), start),
                   extra=["shape", "source_file", "any_url", "extraction_metadata", "raw"])


def ingest_flattened(raw_rows: DataFrame, parity_company_name: bool = True, carry_root_url: bool = True, start: int = 1) -> DataFrame:
    """:func:`flattened` of :func:`ingest` without ``raw`` and ``extraction_metadata``, which are read where a record is projected:
    the records are neither stored nor moved beside their columns, and what flattening replaces is not taken out of them."""
    postings = flattened(_described(project(raw_rows, parity_company_name)), parity_company_name, carry_root_url).drop("raw", "extraction_metadata")
    filled = [c for c in postings.columns if c.endswith("_filled")]
    return conform(_numbered(postings, start), extra=["shape", "source_file", *filled])


def _described(typed: DataFrame) -> DataFrame:
    return typed.withColumn("description", F.coalesce("flat_description", "job_description")).drop("flat_description")


def _numbered(typed: DataFrame, start: int) -> DataFrame:
    """Stored postings with ``seq`` and ``master_id``."""
    typed = cut_lineage(typed.withColumn("_row", F.monotonically_increasing_id()))
    order = ["session", "source_file", "pos"]
    numbers = assign_sequence(typed.select("_row", *order), order, name="seq", start=start).select("_row", "seq")
    return typed.join(numbers, "_row").drop("_row").withColumn("master_id", F.format_string("master_%05d", F.col("seq")))


def session_stats(raw_rows: DataFrame, sessions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """S4 + A1: per listed session, postings contributed and a status (``no_jobs_directory`` when it has no files,
    else ``success``). ``files`` (:func:`session_files`) tells sessions whose files hold nothing readable from
    those without files, and adds ``structure_type`` (``unknown`` without files)."""
    counts = raw_rows.groupBy("session").agg(F.count(F.lit(1)).alias("jobs_contributed"))
    out = session_metadata(sessions).join(counts, "session", "left")
    missing = F.col("jobs_contributed").isNull()
    if files is not None:
        out = out.join(files, "session", "left")
        out = out.withColumn("structure_type", F.coalesce("structure_type", F.lit("unknown")))
        missing = missing & (F.col("structure_type") == "unknown")
    return out.select("*", F.when(missing, F.lit("no_jobs_directory"))
                      .otherwise(F.lit("success")).alias("status")).fillna(0, ["jobs_contributed"])


def session_structure(raw_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """A1 structure type per listed session: ``api_response`` (array file), ``jobs_directory``
    (one file per posting) or ``unknown`` (no readable files), with the postings count."""
    per = raw_rows.groupBy("session").agg(F.count(F.lit(1)).alias("jobs_count"),
                                          F.max(F.col("from_api").cast("int")).alias("_api"))
    out = sessions.join(per, "session", "left")
    return out.select("session", F.coalesce("jobs_count", F.lit(0)).alias("jobs_count"),
                      F.when(F.col("_api") == 1, "api_response").when(F.col("_api") == 0, "jobs_directory")
                      .otherwise("unknown").alias("structure_type"))
