"""Lookup indexes of the session master (A3-A5).

The reference keeps ``key -> [master_id, ...]`` maps. A key may hold a third of
all postings, so the index is kept *tall* -- one ``(index, key, seq, master_id)``
row per entry, load order given by ``seq`` -- and summarised per key with
aggregates that combine map-side. ``compact_index`` builds the nested export
form in pages of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.plans.ranks import rank_within
from hirelake.sources.ingest import _is_obj, _s, _v

UNKNOWN = "unknown"


def _flat(raw: Column, field: str) -> tuple[Column, str, str]:
    """The flattened record's field: ``data.<field>`` when ``data`` is an object, else the root key."""
    return _is_obj(raw, "$.data"), f"$.data.{field}", f"$.{field}"


def _company_key(raw: Column) -> Column:
    use_data, pd_, pr = _flat(raw, "company")

    def key(path: str) -> Column:
        t = F.schema_of_variant(_v(raw, path))
        return (F.when(t == "STRING", F.lower(_s(raw, path)))
                .when(t.startswith("OBJECT"), F.lower(F.coalesce(F.try_variant_get(raw, f"{path}.name", "string"),
                                                                 F.lit(UNKNOWN)))))
    return F.when(use_data, key(pd_)).otherwise(key(pr))


def _location_key(raw: Column) -> Column:
    use_data, pd_, pr = _flat(raw, "location")

    def key(path: str) -> Column:
        t = F.schema_of_variant(_v(raw, path))
        city = F.try_variant_get(raw, f"{path}.city", "string")
        return (F.when(t == "STRING", F.lower(_s(raw, path)))
                .when(t.startswith("OBJECT") & (F.coalesce(F.length(city), F.lit(0)) > 0), F.lower(city)))
    return F.when(use_data, key(pd_)).otherwise(key(pr))


def index_entries(master: DataFrame) -> DataFrame:
    """A4, tall: ``(index_name, key, seq, master_id)`` for by_session, by_company, by_location.
    ``master`` is ingested postings (with ``raw``)."""
    raw = F.col("raw")

    def entry(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("index_name"), key.alias("key"))

    def where_known(name: str, key: Column) -> Column:
        return F.when(key.isNotNull(), entry(name, key))
    entries = F.array_compact(F.array(entry("by_session", F.col("session")),
                                      where_known("by_company", _company_key(raw)),
                                      where_known("by_location", _location_key(raw))))
    return (master.select("seq", "master_id", F.explode(entries).alias("e"))   # one read of the master
            .select("e.index_name", "e.key", "seq", "master_id"))


def index_summary(entries: DataFrame) -> DataFrame:
    """Per key: number of ids and the first / last id in load order (partial aggregates)."""
    return entries.groupBy("index_name", "key").agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.min_by("master_id", "seq").alias("first_id"),
        F.max_by("master_id", "seq").alias("last_id"))


def compact_index(entries: DataFrame, page_size: int = 1_000) -> DataFrame:
    """Export form, paged: ``(index_name, key, page, first_seq, master_ids)`` with the ids of a key in load order, at most ``page_size`` to a row. A
    key's pages follow each other from 0; one with a third of all postings is many rows, not one."""
    ranked = rank_within(entries, ["index_name", "key"], "seq")
    page = ranked.withColumn("page", F.floor(F.col("rank") / page_size).cast("bigint"))
    return page.groupBy("index_name", "key", "page").agg(
        F.min("seq").alias("first_seq"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "master_id"))), lambda x: x["master_id"]).alias("master_ids"))


def original_to_master(master: DataFrame) -> DataFrame:
    """A5: original id -> master id; the last posting in load order wins."""
    return master.groupBy("original_id").agg(F.max_by("master_id", "seq").alias("master_id"))


def master_totals(session_stats: DataFrame, master: DataFrame) -> DataFrame:
    """A3: successful sessions, total postings, earliest / latest session date (non-null);
    one aggregate over the union of both inputs (no join)."""
    s = session_stats.select(F.lit("s").alias("_src"), "status", "session_date")
    m = master.select(F.lit("m").alias("_src"), F.lit(None).cast("string").alias("status"),
                      F.lit(None).cast("string").alias("session_date"))
    return s.unionByName(m).agg(
        F.count_if((F.col("_src") == "s") & (F.col("status") == "success")).alias("sessions_consolidated"),
        F.min("session_date").alias("earliest"), F.max("session_date").alias("latest"),
        F.count_if(F.col("_src") == "m").alias("total_jobs"))
