"""Benchmark decontamination (operator 6), native.

Words are runs of ``[a-z0-9]`` and non-ASCII characters after lower-casing A-Z. The benchmark's
windows (``n`` consecutive words of an item; a shorter item is one window) become a set of 64-bit
hashes, and the hashes of their first, middle and last words a bit table. The documents' windows are tested against the
bit table in place; those that pass become rows and meet the hash set, which is broadcast
while it is below ``broadcast_windows`` rows (counted first; it does not grow with the documents) and joined by
shuffle beyond that. Every hash hit is verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import documents, free_name, let, once, stored

#: Everything but the word characters of lower-cased text (fixed by the contract); word characters of original text.
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order; none for a null text."""
    text = F.coalesce(text, F.lit(""))
    # lower() is much faster than translate() and does the same to ASCII text
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lower, _NOT_WORD, -1), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """(len, hash, anchor, words, items): each different window with the ids of its items. Items without
    words have none; rows without an id count under the id NULL, which names no item."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = w.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))),
        lambda i: F.slice(F.col("w"), i + 1, F.lit(n)))).alias("words"))
    return at.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.size("words").alias("len"), F.xxhash64("words").alias("hash"),
        _anchor(F.col("words"), F.lit(0), F.size("words")).alias("anchor"), "words", "items")


def _anchor(w: Column, start: Column, n: Column) -> Column:
    """Hash of the first, middle and last word of a window."""
    middle = F.floor(n / 2).cast("int") if not isinstance(n, int) else n // 2
    return F.xxhash64(F.get(w, start), F.get(w, start + middle), F.get(w, start + n - 1))


def _filter_bits(windows: DataFrame, count: int, most: int = 14) -> tuple[Column, int]:
    """The anchors as a bit table (array of 64-bit words) and its number of words, at most 2^``most``. A
    larger benchmark fills it more densely, which lets more positions through to the join and loses none."""
    size = 1 << min(most, max(4, (max(1, count) // 4).bit_length()))
    bits = (windows.groupBy(F.pmod(F.shiftright("anchor", 6), F.lit(size)).alias("at"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("anchor", F.lit(64)).cast("int"))).alias("bits")).collect())
    table = dict((r["at"], r["bits"]) for r in bits)
    text = ",".join(str(table.get(i, 0)) for i in range(size))
    return F.split(F.lit(text), ",").cast("array<bigint>"), size


def candidate_positions(w: Column, lengths: list[int], bits: Column, size: int) -> Column:
    """``array<struct<start, words>>`` of the windows whose anchor is in the bit table."""
    def of_length(s: Column, n: int) -> Column:
        def may(i: Column) -> Column:
            return let(_anchor(s["w"], i, n), lambda h: F.call_function(
                "getbit", F.get(s["bits"], F.pmod(F.shiftright(h, 6), F.lit(size)).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1)
        starts = F.when(F.size(s["w"]) >= n, F.filter(F.sequence(F.lit(0), F.size(s["w"]) - n), may))
        return F.coalesce(F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(s["w"], i + 1, F.lit(n)).alias("words"))), F.array())

    return let(F.struct(w.alias("w"), bits.alias("bits")), lambda s: F.concat(*[of_length(s, n) for n in lengths]))


def _merged(spans: Column) -> Column:
    """Covered word count of ``array<struct<start, len>>`` in order of start."""
    step = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["upto"], s["start"]))).alias("n"),
        F.greatest(a["upto"], s["start"] + s["len"]).alias("upto")))
    return step["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_windows: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(per document with hits, word table): the first has ``id``, ``text_hash``, ``spans`` (sorted, different
    ``start, len`` in words), ``items`` (sorted strings); the second ``id``, ``text_hash``, ``n_words`` for every row.

    A document is known by its id and the hash of its text, so that null and repeated ids stay apart and equal
    rows get equal results. Null texts have no words. An empty benchmark hits nothing.
    """
    windows = stored(benchmark_windows(benchmark, n, item_col, item_text_col), "windows")
    sizes = windows.groupBy("len").count().collect()  # at most n rows
    lengths = sorted(r["len"] for r in sizes) or [n]
    count = sum(r["count"] for r in sizes)
    bits, size = _filter_bits(windows, count)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    # one pass over the texts: what the filter lets through is stored without them
    scanned = once(once(keyed, w=words(F.col("text"))).drop("text"), at=candidate_positions(F.col("w"), lengths, bits, size))
    scanned = stored(scanned.select("id", "text_hash", F.size("w").cast("bigint").alias("n_words"), "at"), "scanned")
    at = scanned.where(F.size("at") > 0).select("id", "text_hash", F.inline("at")).withColumn("hash", F.xxhash64("words"))
    grams = windows.select("hash", F.col("words").alias("gram"), "items")
    met = at.join(F.broadcast(grams) if count <= broadcast_windows else grams, "hash").where(F.col("words") == F.col("gram"))
    per_doc = met.groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", F.size("words").alias("len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per_doc, scanned.select("id", "text_hash", "n_words")


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside a window's occurrence), items (sorted strings), contaminated. Other columns of
    ``docs`` are not returned."""
    hit, every = contamination(docs, benchmark, **how)
    hit = hit.select(F.col("id").alias("hid"), F.col("text_hash").alias("hhash"),
                     _merged(F.col("spans")).cast("bigint").alias("n_hit"), "items")
    out = every.join(hit, F.col("id").eqNullSafe(F.col("hid")) & (F.col("text_hash") == F.col("hhash")), "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _cut(text: Column, spans: Column) -> Column:
    """The text without the words in ``spans``; where words went, one space joins what is left."""
    def rest(s: Column) -> Column:
        gone = F.flatten(F.transform(s["spans"], lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
        keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(s["words"]) - 1), gone))
        return let(F.struct(s["words"].alias("words"), s["gaps"].alias("gaps"), keep.alias("keep")), joined)

    def joined(s: Column) -> Column:
        pieces = F.transform(s["keep"], lambda i, n: F.concat(
            F.when((n > 0) & (F.get(s["keep"], n - 1) == i - 1), F.get(s["gaps"], i)).otherwise(F.lit(" ")),
            F.get(s["words"], i)))
        last = F.when(F.element_at(s["keep"], -1) == F.size(s["words"]) - 1, F.element_at(s["gaps"], -1))
        return F.concat(F.array_join(pieces, ""), F.coalesce(last, F.lit("")))

    parts = F.struct(F.regexp_extract_all(text, F.lit(_WORD_ANY_CASE), F.lit(0)).alias("words"),
                     F.split(text, _WORD_ANY_CASE, -1).alias("gaps"), spans.alias("spans"))
    return F.trim(let(parts, rest))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         max_share: float = 0.5, n_chars_col: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` without benchmark passages: a document whose words lie in them to more than ``max_share`` goes,
    another one loses the words of the passages (``n_chars_col``, if it has one, follows). Documents without a hit are unchanged.
    All columns are kept."""
    hit, _ = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    mark, spans, hid, hhash = (free_name(docs, c) for c in ("_hash", "_spans", "_hid", "_hhash"))
    hit = hit.select(F.col("id").alias(hid), F.col("text_hash").alias(hhash), F.col("spans").alias(spans))
    out = docs.withColumn(mark, F.xxhash64(text_col))
    out = out.join(hit, out[id_col].eqNullSafe(hit[hid]) & (out[mark] == hit[hhash]), "left")
    hit_words = F.coalesce(_merged(F.col(spans)), F.lit(0))
    out = out.where(F.col(spans).isNull() | (hit_words <= max_share * F.size(words(F.col(text_col)))))
    out = out.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_cut(F.col(text_col), F.col(spans))))
    if n_chars_col and n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(F.col(spans).isNull(), F.col(n_chars_col)).otherwise(
            F.char_length(text_col).cast(docs.schema[n_chars_col].dataType)))
    return out.select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """Query: contamination report of every document against the benchmark."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    out = report(documents(spark, sf_dir, "doc_id", "text"), bench, n=10)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: DuckDB twin of op6: windows compared as strings.
OP6_SQL = r"""
with d as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] w from documents),
b as (select item_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] w from benchmark),
g as (select distinct item_id, least(len(w), 10) n, list_aggregate(w[i:i + 9], 'string_agg', ' ') g
      from b, unnest(generate_series(1, greatest(len(w) - 9, 1))) t(i) where len(w) > 0),
ns as (select distinct n from g),
o as (select doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') g
      from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, ns where len(w) >= n)),
h as (select o.doc_id, o.i, o.n, g.item_id from o join g on o.n = g.n and o.g = g.g),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from h) group by 1),
t as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct doc_id, cast(item_id as varchar) s from h) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(t.s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""
