"""Sharding by best-fit-decreasing bin packing (operator 9).

Rows with equal texts form one indivisible group (known by the 64-bit hash of the text; a collision only
makes two groups travel together). The law is ``bytes``: shard sizes near equal.

Packing in two levels, so that nothing whole meets in one task:

1. Groups smaller than a *unit* (mean shard size / ``grain``) are dealt by hash over buckets of about
   ``GROUPS_PER_TASK`` groups, and each bucket packs its groups, largest first, into the block with
   the least room that still takes them. Blocks hold one unit; every 32nd group goes to blocks of a 32nd of a unit.
   All blocks of a bucket but one are at least half full, so there are at most
   ``4 * shards * grain + 2 * buckets`` of them.
2. These blocks and the larger groups (at most ``shards * grain``) are the items of the final packing
   on the driver: the smallest capacity at which best-fit-decreasing needs no more than ``shards`` shards. A group
   larger than the mean gets a shard of its own and the rest share the others.

The tree: remaining capacities as bits in a tree of 64-way nodes, all leaves at one depth. Insert, remove and the
search for the tightest fit take one step per level.
"""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import documents, free_name, stored

GROUPS_PER_TASK = 200_000
ROWS_PER_TASK = 20_000
FINE = 32
OVERHEAD = 16


class CapacityTree:
    """Sorted set of integers in [0, top] as a balanced tree of 64-way bit nodes."""

    def __init__(self, top: int):
        self.levels: list[dict[int, int]] = [{}]
        while top >> (6 * len(self.levels)):
            self.levels.append({})

    def insert(self, x: int) -> None:
        for level in self.levels:
            old = level.get(x >> 6, 0)
            level[x >> 6] = old | 1 << (x & 63)
            if old:
                return
            x >>= 6

    def remove(self, x: int) -> None:
        for level in self.levels:
            left = level[x >> 6] & ~(1 << (x & 63))
            if left:
                level[x >> 6] = left
                return
            del level[x >> 6]
            x >>= 6

    def at_least(self, x: int) -> int | None:
        """The smallest member that is not below ``x``."""
        for depth, level in enumerate(self.levels):
            found = level.get(x >> 6, 0) >> (x & 63)
            if found:
                x += (found & -found).bit_length() - 1
                for lower in reversed(self.levels[:depth]):
                    node = lower[x]
                    x = (x << 6) | ((node & -node).bit_length() - 1)
                return x
            x = (x >> 6) + 1
        return None


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size (given in decreasing order, none above ``capacity``); None once it takes more than ``most`` bins."""
    tree, open_bins, out, bins = CapacityTree(capacity), {}, [], 0
    for size in sizes:
        room = tree.at_least(size)
        if room is None:
            if bins == most:
                return None
            chosen, room, bins = bins, capacity, bins + 1
        else:
            same = open_bins[room]
            chosen = same.pop()
            if not same:
                del open_bins[room]
                tree.remove(room)
        left = room - size
        if left not in open_bins:
            open_bins[left] = []
            tree.insert(left)
        open_bins[left].append(chosen)
        out.append(chosen)
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size (in decreasing order): at most ``shards`` of them, sizes near equal."""
    total, alone = sum(sizes), 0
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest, n = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    least = max(ceil(total / n), rest[0])
    slack, low = 0.0, None
    while (bins := best_fit(rest, int(least * (1 + slack)), n)) is None:
        low, slack = slack, max(2 * slack, 1e-4)
    for _ in range(5):  # towards the smallest capacity that will do
        if low is None or slack - low < 1e-5:
            break
        middle = (low + slack) / 2
        if (tighter := best_fit(rest, int(least * (1 + middle)), n)) is None:
            low = middle
        else:
            bins, slack = tighter, middle
    return [*range(alone), *(alone + b for b in bins)]


def _blocks(unit: int):
    def of_bucket(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        parts, at = [], 0
        for fine, capacity in ((False, unit), (True, max(1, unit // FINE))):
            # a group too large for a fine block stays with the others
            some = groups[((groups["fine"]) & (groups["bytes"] <= max(1, unit // FINE))) == fine]
            bins = best_fit(some["bytes"].tolist(), capacity)
            parts.append(pd.DataFrame({"key": some["key"], "bytes": some["bytes"], "bucket": some["bucket"], "block": [at + b for b in bins]}))
            at += max(bins, default=-1) + 1
        return pd.concat(parts).astype({"block": "int32"})

    return of_bucket


def text_shards(rows: DataFrame, shards: int, grain: int = 512) -> DataFrame:
    """(key, bytes) rows -> (key, shard), one row per key."""
    spark = rows.sparkSession
    groups = stored(rows.groupBy("key").agg(F.sum("bytes").alias("bytes")), "groups")
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    unit = max(1, int(total) // (shards * grain))
    buckets = max(1, ceil(count / GROUPS_PER_TASK))
    small = (groups.where(F.col("bytes") < unit)
             .withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(buckets)).cast("int"))
             .withColumn("fine", F.pmod(F.xxhash64(F.lit("fine"), "key"), F.lit(FINE)) == 0))
    placed = stored(
        small.groupBy("bucket").applyInPandas(_blocks(unit), "key bigint, bytes bigint, bucket int, block int")
        .unionByName(groups.where(F.col("bytes") >= unit).select(
            "key", "bytes", F.lit(-1).alias("bucket"), F.lit(-1).alias("block"))), "blocks")
    item = [F.col("bucket"), F.col("block"), F.when(F.col("bucket") < 0, F.col("key")).alias("alone")]
    # bounded: see above
    items = sorted((-r["bytes"], r["bucket"], r["block"], r["alone"] or 0) for r in
                   placed.groupBy(*item).agg(F.sum("bytes").alias("bytes")).collect())
    to = pack([-b for b, *_ in items], shards)
    names = spark.createDataFrame([(bucket, block, key, shard) for (_, bucket, block, key), shard in zip(items, to)],
                                  "bucket int, block int, alone bigint, shard int")
    by_item = F.broadcast(names)  # as many rows as items
    return (placed.withColumn("alone", F.when(F.col("bucket") < 0, F.col("key")).otherwise(F.lit(0)))
            .join(by_item, ["bucket", "block", "alone"]).select("key", "shard"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", grain: int = 512,
          keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``size`` (UTF-8 bytes of its text plus 16), ``text_crc32``, ``shard`` in 0..shards-1 and
    ``slot``, gapless from 0 in its shard. ``keep``: the columns returned besides (default: the id).

    A null text has no bytes and belongs to one group with the other null texts. Rows with equal texts share a
    shard, whatever their ids; repeated rows have slots of their own. An empty table gives no rows. Clashing column
    names of ``docs`` are left out unless kept, and then win over the computed ones only by being renamed with ``_in``.
    """
    keep = [id_col] if keep is None else keep
    made = ("size", "text_crc32", "shard", "slot")
    names = [f"{c}_in" if c.lower() in made else c for c in keep]
    text = F.col(text_col)
    base = docs.select(
        F.struct(*[F.col(c).alias(n) for c, n in zip(keep, names)]).alias("kept"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("bytes"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"), F.xxhash64(F.col(id_col), text).alias("order"))
    # the packing works on hashes and sizes; the kept columns are read again and shuffled by the last two steps alone
    narrow = stored(base.drop("kept", "crc"), "rows")
    where = stored(text_shards(narrow.select("key", "bytes"), shards, grain), "shards")
    buckets = max(1, ceil(narrow.count() / (shards * ROWS_PER_TASK)))
    bucket = F.pmod(F.xxhash64(F.lit("slot"), "order"), F.lit(buckets)).cast("int")
    placed = base.join(where, "key").withColumn("bucket", bucket)
    sizes = narrow.join(where, "key").withColumn("bucket", bucket).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", "key"))
    out = placed.withColumn("nth", nth).join(starts, ["shard", "bucket"])
    return out.select(*[F.col("kept")[n].alias(n) for n in names], F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"),
                      "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Query: all documents in 40 shards of near equal bytes."""
    out = shard(documents(spark, sf_dir, "doc_id", "text"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
