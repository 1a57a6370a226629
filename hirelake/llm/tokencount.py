"""Token counts without token ids (operator 13).

A tokenizer first cuts a text into pre-tokens that its merges never cross, so a text's count is the sum of its
pre-tokens' counts. Each distinct pre-token of the corpus is encoded once (:func:`piece_counts`); documents are
joined to that table by their pre-token frequencies and the products are summed. No ids of a document exist.

The frequencies are skewed. Pre-tokens that are common (in at least 1/``common`` of all (document, pre-token) pairs, so
there are at most ``common`` of them, each of at most 64 characters) are looked up in a broadcast table while the documents
are read; all others go through a shuffle join, in which none of them holds more than that share of the rows.
Longer pre-tokens are keyed by their SHA-256, so a key's width is bounded, not the pre-token's.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import documents, small_batches, stored
from hirelake.llm.vocab import model_bytes, piece_counter, public_path

#: Longest pre-token that is its own key.
_KEY = 64
#: Distinct pre-tokens a task holds before it hands their counts on.
_HELD = 200_000
#: Rows of one Arrow batch that leaves a task.
_ROWS = 50_000


def _key(pre: str) -> str:
    # no pre-token of two or more characters starts with a line break
    return pre if len(pre) <= _KEY else "\n" + hashlib.sha256(pre.encode("utf-8", "surrogatepass")).hexdigest()


def _slices(rows, names: list[str], types: list[pa.DataType]):
    rows = iter(rows)
    while block := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names=names)


def piece_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token of ``docs`` once: ``key``, ``pieces`` (its tokens), ``docs`` (documents that hold it)."""
    small_batches(docs.sparkSession)
    model, kind = model_bytes(tokenizer), os.path.splitext(tokenizer)[1]
    names, types = ["key", "long_pre", "docs"], [pa.string(), pa.string(), pa.int64()]

    def held(batches):
        cut, _ = piece_counter(kind, model)
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(set(cut(t.as_py() or "")))
                if len(seen) > _HELD:
                    yield from _slices(((_key(p), p if len(p) > _KEY else None, n) for p, n in seen.items()), names, types)
                    seen = Counter()
        yield from _slices(((_key(p), p if len(p) > _KEY else None, n) for p, n in seen.items()), names, types)

    @F.pandas_udf("int")
    def pieces(pres: pd.Series) -> pd.Series:
        return pd.Series(piece_counter(kind, model)[1](pres.tolist()), dtype="int32")

    found = docs.select(F.col(text).cast("string")).mapInArrow(held, "key string, long_pre string, docs long")
    return (found.groupBy("key").agg(F.max("long_pre").alias("long_pre"), F.sum("docs").alias("docs"))
            .select("key", pieces(F.coalesce("long_pre", "key")).alias("pieces"), "docs"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id: str = "doc_id", text: str = "text",
                 common: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: ``id`` (as named), ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more tokens than ``limit``).

    ``tokenizer``: path of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, read on the driver. Tokens are the library's own, without
    begin, end or added special tokens; special strings inside a text are what the library takes them for by default.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null or equal ids each keep their own row; any text length
    is counted whole; an empty table gives no rows. Other columns are not returned, whatever their names; the id column
    may have no name of a result column. ``common`` bounds the broadcast table (see the module's text).
    """
    if id in ("n_bytes", "n_tokens", "over_limit"):
        raise ValueError(f"rename the id column {id}: a result column has that name")
    spark = docs.sparkSession
    counts = stored(piece_counts(docs, tokenizer, text), "pieces")
    pairs = counts.agg(F.sum("docs")).first()[0] or 0
    is_common = (F.col("docs") * F.lit(common) >= F.lit(pairs)) & (F.length("key") <= _KEY)
    top = counts.where(is_common).select("key", "pieces").toArrow()   # at most `common` rows of at most 64 characters
    table = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    model, kind = model_bytes(tokenizer), os.path.splitext(tokenizer)[1]
    src = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))

    def frequencies(batches):
        """A row of the document itself (its common pre-tokens summed), and one for each of its other distinct pre-tokens."""
        cut, _ = piece_counter(kind, model)
        known = table.value

        def rows(batch):
            for r, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = t.as_py() or ""
                total = 0
                for pre, n in Counter(cut(t)).items():
                    k = known.get(pre)
                    if k is None:
                        yield r, None, _key(pre), n, None, None
                    else:
                        total += n * k
                # a key of its own, so that these rows spread in the join; n = 0, so that nothing it might meet there counts
                yield r, i, f"\n{r}", 0, len(t.encode("utf-8", "surrogatepass")), total
        for batch in batches:
            yield from _slices(rows(batch), ["_row", "_id", "key", "n", "n_bytes", "known"],
                               [pa.int64(), batch.schema.field(1).type, pa.string(), pa.int64(), pa.int64(), pa.int64()])

    freq = src.mapInArrow(frequencies, f"_row long, _id {docs.schema[id].dataType.simpleString()}, key string, n long, n_bytes long, known long")
    rest = counts.where(~is_common).select("key", "pieces")
    n_tokens = F.sum(F.coalesce("known", F.lit(0)) + F.col("n") * F.coalesce("pieces", F.lit(0)))
    return (freq.join(rest, "key", "left").groupBy("_row")
            .agg(F.max("_id").alias(id), F.max("n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens")).drop("_row")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` by piece_bpe_32k.model."""
    return token_counts(documents(spark, sf_dir, "doc_id", "text"), public_path("piece_bpe_32k.model"), limit=4096)
