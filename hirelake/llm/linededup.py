"""Cross-site line dedup by distinct-site spread (operator 2), native.

A line that stands on at least ``min_sites`` different sites is boilerplate and goes from every document. Per line
hash a HyperLogLog sketch of its sites is built map-side and merged by aggregation. Its estimate decides
lines far from the threshold; the lines within ``band`` of it get an exact distinct count. Only these lines, the
hashes of the boilerplate and the positions it takes are joined; line texts are shuffled by no step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import documents, free_name, let, stored

#: log2 of the sketch's registers: a standard error of 1.6 % (far less for small counts).
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """Two independent 64-bit hashes of the trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit("line"), F.trim(line)).alias("b"))


def line_table(docs: DataFrame, site_col: str, text_col: str, *id_cols: str) -> DataFrame:
    """(id columns, site, pos, key) of every line with more than blanks. Null sites count as no site."""
    lines = F.transform(_lines(F.col(text_col)), lambda line, i: F.when(
        F.trim(line) != "", F.struct(i.alias("pos"), _key(line).alias("key"))))
    at = docs.select(*id_cols, F.col(site_col).alias("site"), F.explode(lines).alias("at")).where("at is not null")
    return at.select(*id_cols, "site", "at.pos", "at.key")


def boilerplate(lines: DataFrame, min_sites: int = 10, band: float = 0.1) -> DataFrame:
    """Line ``key``s that stand on at least ``min_sites`` sites; exact, as far as the sketch errs by less than ``band``
    (over six standard errors)."""
    some = lines.where("site is not null").select("key", F.xxhash64("site").alias("site"))
    spread = stored(some.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
                    .where(F.col("sites") >= int(min_sites * (1 - band))), "spread")
    high = spread.where(F.col("sites") > min_sites * (1 + band)).select("key")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("key")
    exact = (some.join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= min_sites).select("key"))
    return high.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", min_sites: int = 10,
                       band: float = 0.1) -> DataFrame:
    """``docs`` with ``text_col`` less the boilerplate lines, and ``n_lines``, ``n_removed`` (bigint). All lines are counted;
    blank ones stay. A null text stays null and has no lines; an empty one has one (blank) line. Rows are known by id
    and text hash, so repeated rows and null ids get equal results. Columns with the names of the counts give way.
    """
    h, removed, gid, ghash = (free_name(docs, c) for c in ("_hash", "_gone", "_gid", "_ghash"))
    keyed = docs.withColumn(h, F.xxhash64(text_col))
    lines = stored(line_table(keyed.select(F.col(id_col).alias("id"), F.col(h).alias("hash"), site_col, text_col), site_col, text_col, "id", "hash"), "lines")
    bad = boilerplate(lines, min_sites, band)
    # equal rows on several sites give the same positions: one of each
    gone = (lines.join(bad, "key", "left_semi").groupBy("id", "hash").agg(F.collect_set("pos").alias(removed))
            .select(F.col("id").alias(gid), F.col("hash").alias(ghash), removed))
    out = keyed.join(gone, keyed[id_col].eqNullSafe(gone[gid]) & (keyed[h] == gone[ghash]), "left")
    text = F.col(text_col)
    rest = let(F.struct(_lines(text).alias("l"), F.col(removed).alias("gone")), lambda s: F.array_join(F.transform(
        F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["gone"])), lambda i: F.get(s["l"], i)), "\n"))
    made = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("bigint"),
            "n_removed": F.coalesce(F.size(removed), F.lit(0)).cast("bigint")}
    cols = [F.when(F.col(removed).isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col(c)
            for c in docs.columns if c.lower() not in made]
    return out.select(*cols, *[F.greatest(v, F.lit(0)).alias(k) for k, v in made.items()])


def op2(spark, sf_dir: str) -> DataFrame:
    """Query: what is left of every document without lines that stand on 10 or more sources."""
    out = remove_boilerplate(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("bigint").alias("n_bytes"),
                      F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP2_SQL = r"""
with l as (select doc_id, source, pos, line, trim(line, ' ') t from (
       select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos
       from documents where text is not null)),
b as (select t from l where t <> '' group by t having count(distinct source) >= 10),
k as (select l.doc_id, l.pos, l.line, b.t is not null gone from l left join b on l.t = b.t),
r as (select doc_id, count(*) n_lines, count(*) filter (gone) n_removed,
             coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') rest from k group by doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed,
       case when d.text is not null then cast(strlen(rest) as bigint) end n_bytes, md5(coalesce(rest, '')) text_md5
from documents d left join r on d.doc_id = r.doc_id
"""
