"""Helpers shared by the llm operators: tables, stored intermediates, native span search."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.session import checkpoint_root

#: Rows per Arrow batch for the operators that hand whole texts to Python: texts can be long,
#: so a worker holds a few hundred of them at a time, not Spark's default of 10,000.
ARROW_ROWS = 500


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts can hold (read when a query is planned)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once into the shared checkpoint folder and reads it back: later steps start
    from files that survive a lost executor, and prune their columns."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a plain alias may be inlined into a
    lambda and then be computed for each of its elements)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row, however often later steps use them (plain aliases
    of lambdas may be inlined into each use). A generator of one row keeps them apart."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: Matches per chunk of the two-level prefix sum below.
_CHUNK = 128


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` in ``text``:
    ``array<struct<start, end, hit[, before, after]>>``, offsets in code points, end exclusive.

    ``split`` gives the gaps between the matches and ``regexp_extract_all`` the matches, so a start
    is the length of all gaps and matches before it. These sums go in two levels (chunks of 128
    matches), so that a text with very many matches stays near-linear. ``pattern`` must not match
    the empty string. ``context``: that many code points on either side.
    """
    def found(hits: Column) -> Column:
        parts = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
        return let(parts, lambda s: let(
            F.struct(s["hits"].alias("hits"), s["gaps"].alias("gaps"),
                     F.transform(s["hits"], lambda h, i: F.char_length(h) + F.char_length(F.get(s["gaps"], i))).alias("lens")), sums))

    def sums(s: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(s["hits"]) - 1) / _CHUNK).cast("int"))
        totals = F.transform(chunks, lambda c: _sum(F.slice(s["lens"], c * _CHUNK + 1, F.lit(_CHUNK))))
        off = let(totals, lambda t: F.transform(t, lambda _, i: _sum(F.slice(t, F.lit(1), i))))
        return let(F.struct(s["hits"].alias("hits"), s["gaps"].alias("gaps"), s["lens"].alias("lens"), off.alias("off")),
                   lambda o: F.transform(o["hits"], lambda hit, i: _span(o, hit, i, context)))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # most texts have no match and are not split
    return F.coalesce(let(hits, lambda h: F.when(F.size(h) > 0, found(h))), F.array())


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _span(o: Column, hit: Column, i: Column, context: int) -> Column:
    chunk = F.floor(i / _CHUNK).cast("int")
    gap = F.get(o["gaps"], i)
    start = (F.get(o["off"], chunk) + _sum(F.slice(o["lens"], chunk * _CHUNK + 1, i - chunk * _CHUNK))
             + F.char_length(gap))
    fields = [start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("hit")]
    if context:
        fields += [F.right(gap, F.lit(context)).alias("before"),
                   F.left(F.get(o["gaps"], i + 1), F.lit(context)).alias("after")]
    return F.struct(*fields)


def span_list(spans: Column) -> Column:
    """``array<struct<start, rank, end, kind>>`` as ``kind:start:end``, by start, then kind as listed."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def keyed(df: DataFrame) -> DataFrame:
    """A number per row that stays the same when the stored result is read again. It is taken before
    the rows are stored; call :func:`stored` on the result."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
