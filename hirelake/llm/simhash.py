"""SimHash near-duplicates with multi-index hashing (operator 7).

Fingerprint: XXH64 (seed 42) of every shingle; a bit is 1 if more than half the shingles set it.
Copies share a fingerprint, so links are searched between *distinct* fingerprints only.

Search: the 64 bits fall into ``segments`` equal segments. For each segment ``j`` there is a table of
all fingerprints keyed by the other segments. Of a pair within ``max_distance`` let ``j`` be the
segment with the most differing bits; the others then differ in few bits, so one fingerprint
reaches the other's table entry by a small Hamming ball enumerated inside the other segments (one bit
for distance 2). Every table match is verified on the complete 64 bits. Keys have
48 bits, so a table entry is short even among thousands of near copies, and no
group emits all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import free_name, small_batches, stored
from hirelake.llm.components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
_BLOCK = 65_536


def simhash(text: str | None, shingle_words: int = 3) -> int:
    """Signed 64-bit fingerprint of one text; 0 for a null text or one without words."""
    # bytes: lower() touches A-Z only, split() splits at \x20 and \x09-\x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    grams = zip(*(words[i:] for i in range(shingle_words))) if len(words) >= shingle_words else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        block = np.ascontiguousarray(hashes[at:at + _BLOCK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle_words: int = 3, to: str = "fp") -> DataFrame:
    """Adds the signed bigint fingerprint of ``text``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle_words) for t in texts], dtype="int64")

    return docs.withColumn(to, of(F.col(text)))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def probe_masks(max_distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(left-out segment, bits kept in the key, bits flipped) of the balls to enumerate.

    The left-out segment is the one with the most differing bits (the first of several), which
    bounds what the others hold; one entry per such pattern of differing bits in the others."""
    width = BITS // segments
    out = []
    for j in range(segments):
        keep = ((1 << 64) - 1) ^ (((1 << width) - 1) << (j * width))
        bits = [b for b in range(BITS) if b // width != j]
        for flips in range(max_distance):
            for chosen in combinations(bits, flips):
                per = [sum(b // width == i for b in chosen) for i in range(segments)]
                least = max([0, *(per[i] for i in range(j + 1, segments)), *(per[i] + 1 for i in range(j) if per[i])])
                if least + flips <= max_distance:
                    out.append((j, _signed(keep), _signed(sum(1 << b for b in chosen))))
    return out


def fingerprint_links(fingerprints: DataFrame, max_distance: int = 2, segments: int = 4) -> DataFrame:
    """Distinct bigint ``fp`` -> links (u, v), each pair of fingerprints within ``max_distance`` bits.

    Needs ``max_distance <= segments - 1`` or so for short balls; any distance from 0 is exact."""
    if max_distance <= 0:
        return fingerprints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    masks = probe_masks(max_distance, segments)
    tables = sorted({(j, keep) for j, keep, _ in masks})
    entry = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(keep).cast("bigint").alias("keep"))
                                for j, keep in tables]))
    table = (fingerprints.select(F.col("fp").alias("v"), entry.alias("e"))
             .select("v", F.col("e.j").alias("j"), F.col("v").bitwiseAND(F.col("e.keep")).alias("key")))
    ball = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(keep).cast("bigint").alias("keep"),
                                        F.lit(flip).cast("bigint").alias("flip"),
                                        F.lit(_signed(flip & -flip)).cast("bigint").alias("low"))
                               for j, keep, flip in masks]))
    # a link needs one direction: the side with a 0 at the lowest flipped bit looks up the other
    probes = (fingerprints.select(F.col("fp").alias("u"), ball.alias("e"))
              .where(F.col("u").bitwiseAND(F.col("e.low")) == 0)
              .select("u", F.col("e.j").alias("j"), (F.col("e.flip") == 0).alias("exact"),
                      F.col("u").bitwiseXOR(F.col("e.flip")).bitwiseAND(F.col("e.keep")).alias("key")))
    # sorted and merged: the optimizer takes an exploded side for as small as its input and would broadcast it
    met = probes.join(table.hint("merge"), ["j", "key"]).where("u <> v and (not exact or u < v)")
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    max_distance: int = 2, segments: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed bigint), ``component_id``, the smallest id
    reachable over links of at most ``max_distance`` bits.

    Null and wordless texts have fingerprint 0 and link like any other. Rows without an id keep their
    component; a component in which no row has an id has a null ``component_id``. Repeated
    rows are returned as often as given. Other columns are not read.
    """
    fps = stored(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                                  shingle_words=shingle_words).select("id", "fp"), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), max_distance, segments))
    # fingerprints without a link are their own root and need no join with the links' stars
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "id")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    names = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = fps.join(names, "fp")
    return out.select(F.col("id").alias(id_col), F.col("fp"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Keeps, of each component, one row: that with the smallest id, of repeated ids the one with the smallest
    text hash, and one of equal rows. A component without any id keeps one row. All columns are kept."""
    mark, nth = free_name(docs, "_mark"), free_name(docs, "_nth")
    tagged = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                  F.xxhash64(text_col).alias("hash")).alias("rank"), F.col(text_col).alias("text"))
    groups = near_duplicates(tagged, "rank", "text", **how)
    winners = (groups.where("rank = component_id").select("rank.id", "rank.hash").distinct())
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    kept = marked.join(winners, marked[id_col].eqNullSafe(winners["id"]) & (marked[mark] == winners["hash"]), "left_semi")
    first = Window.partitionBy(id_col, mark).orderBy(mark)
    return kept.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprint as 16 hex digits and component of every document."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, shingle_words=3, max_distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
