"""Mixing sources to target weights by a low-discrepancy schedule (operator 10).

Each source's documents, in an order shuffled by hash, form one stream of words, cut into blocks of
equally many words (the same number for all sources; the last of a source may be shorter). Slot ``i`` of the
schedule takes the golden-ratio point ``frac((i + 1/2) * 0.618...)`` through the cumulative target weights
to a source; the slot's rank among the slots of its source says which block it takes, starting again at the first
after the last. The slot that reaches a source's target is trimmed to it, later ones are dropped, and
where the points gave a source too few slots the missing ones close the schedule. So each source gives
its target to the word, and no document more than twice its words, as targets stop at twice the source.

Only ids, sources and word counts are shuffled. The stream offsets are sums in two levels (source and
hash bucket, then inside a bucket), so a source with a third of all rows is dealt over many tasks. The number
of slots is a parameter, and the block size follows from it.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import documents, free_name, stored

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_TASK = 5_000


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``most`` times its own;
    what that leaves goes to the others by weight, until none is above."""
    out = [0.0] * len(sizes)
    left, active = share * sum(sizes), list(range(len(sizes)))
    while active:
        weight = sum(weights[i] for i in active)
        full = [i for i in active if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in active:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = most * float(sizes[i])
        left = share * sum(sizes) - sum(out)
        active = [i for i in active if i not in set(full)]
    return out


def _points(edges: np.ndarray):
    @F.pandas_udf("int")
    def source_of(slot: pd.Series) -> pd.Series:
        at = np.modf((slot.to_numpy(np.float64) + 0.5) * GOLDEN)[0] * edges[-1]
        return pd.Series(np.minimum(np.searchsorted(edges, at, side="right"), len(edges) - 1).astype(np.int32))

    return source_of


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text",
        weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, slots: int = 300_000,
        keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). Rows: the ``keep`` columns of each row of ``docs`` in a struct ``kept`` (default: the id) with
    ``row``, ``size`` (its words), ``source_size``, ``target`` (of its source), ``taken`` and ``first_position`` (the first slot that takes
    words of it; null if none does). Pieces: what each slot takes, as ``position`` in the schedule, ``row``, ``first`` (word of the row, from 0) and ``words``.

    ``weights`` repeat over the sources in code point order, null last (null is a source like any other). Null and
    wordless texts have size 0 and are never taken. Repeated rows count each. The result depends on the rows'
    values alone; equal rows may swap what is taken of them. One row per source comes to the driver.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)) if size is None else size
    keep = [id_col] if keep is None else keep
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(source_col).alias("source"),
                              size.cast("bigint").alias("size"), F.xxhash64(F.lit("mix"), *[F.col(c) for c in (id_col, text_col) if c in docs.columns]).alias("order"),
                              F.struct(*keep).alias("kept")), "mix-rows")
    found = [(r["source"], int(r["size"])) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    block = max(1, ceil(sum(goal) / slots))
    limit = [round(t) for t in goal]
    plan = spark.createDataFrame(
        [(i, s, n, t, m, max(1, ceil(n / block))) for i, ((s, n), t, m) in enumerate(zip(found, goal, limit))],
        "src int, source string, source_size bigint, target double, lim bigint, blocks bigint")
    numbered = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["source"])).drop(rows["source"]).drop(plan["source"])

    schedule = _schedule(spark, plan, goal, limit, sizes, block, ceil(sum(goal) / block))
    pieces = stored(_pieces(_offsets(numbered), schedule, block), "pieces")
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"))
    out = numbered.join(taken, "row", "left").select("row", "kept", "size", "source_size", "target",
                                                     F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"), "first_position")
    return out, pieces


def _schedule(spark, plan: DataFrame, goal: list[float], limit: list[int], sizes: list[int], block: int, n: int) -> DataFrame:
    """(position, src, block, upto): the slots with the words they take of their block."""
    empty = "position bigint, src int, nth bigint"
    if n:
        at = spark.range(n).select(F.col("id").alias("position"), _points(np.cumsum(goal))("id").alias("src"))
        nth = F.row_number().over(Window.partitionBy("src").orderBy("position")) - 1
        slots = stored(at.select("position", "src", nth.cast("bigint").alias("nth")), "slots")
    else:
        slots = spark.createDataFrame([], empty)
    had = {r["src"]: r["n"] for r in slots.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    missing, position = [], n
    for i, (most, size) in enumerate(zip(limit, sizes)):
        if not size:
            continue
        need = (most // size) * ceil(size / block) + ceil((most % size) / block)
        short = max(0, need - had.get(i, 0))
        missing.append((position, i, had.get(i, 0), short))
        position += short
    closing = (spark.createDataFrame(missing, "position bigint, src int, had bigint, short bigint").where("short > 0")
               .select("src", F.posexplode(F.sequence(F.col("had"), F.col("had") + F.col("short") - 1)).alias("k", "nth"), "position")
               .select((F.col("position") + F.col("k")).alias("position"), "src", "nth"))
    own = F.broadcast(plan.select("src", "source_size", "lim", "blocks"))
    all_slots = slots.unionByName(closing).join(own, "src").where("source_size > 0")
    epoch = F.floor(F.col("nth") / F.col("blocks")).cast("bigint")
    return (all_slots.select("position", "src", (F.col("nth") % F.col("blocks")).alias("block"),
                             (epoch * F.col("source_size")).alias("past"), "lim", "source_size")
            .withColumn("from", F.col("block") * block)
            .withColumn("upto", F.least(F.col("from") + block, F.col("source_size"), F.col("lim") - F.col("past")))
            .where(F.col("upto") > F.col("from")).select("position", "src", "block", "upto"))


def _offsets(rows: DataFrame) -> DataFrame:
    """Adds ``first``: the words of the row's source before it in the shuffled order."""
    count = rows.count()
    some = rows.select("row", "src", "size", "order").withColumn(
        "bucket", F.pmod(F.col("order"), F.lit(max(1, ceil(count / ROWS_PER_TASK)))).cast("int"))
    sums = some.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = (Window.partitionBy("src", "bucket").orderBy("order", "size", "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (some.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(starts, ["src", "bucket"]).select("row", "src", "size", (F.col("start") + F.col("within")).alias("first")))


def _pieces(streams: DataFrame, schedule: DataFrame, block: int) -> DataFrame:
    ends = F.col("first") + F.col("size")
    parts = (streams.where("size > 0").withColumn("end", ends)
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block).cast("bigint"),
                                                       F.floor((F.col("end") - 1) / block).cast("bigint")))))
    met = parts.join(schedule, ["src", "block"])
    start, stop = F.greatest("first", F.col("block") * block), F.least("end", "upto")
    return met.where(stop > start).select("position", "row", (start - F.col("first")).alias("first"), (stop - start).alias("words"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    n_chars_col: str = "n_chars", **how) -> DataFrame:
    """The mix as documents in the order of the schedule, with the columns of ``docs``: a row as often as it is taken whole, and once more
    cut to its first words where the target ends inside it; each copy stands at the slot that takes its first word. Rows that are
    not taken go. ``n_chars_col`` follows the cut."""
    rows, pieces = mix(docs, id_col, source_col, text_col=text_col, keep=docs.columns, **how)
    # a copy begins where its first word is taken; a row has as many copies as such slots, at most twice its words and a cut one
    nth = F.row_number().over(Window.partitionBy("row").orderBy("position"))
    starts = pieces.where("first = 0").select("row", F.col("position").alias("_at"), (nth - 1).alias("_nth"))
    names = {c: free_name(docs, c) for c in ("_cut_to", "_at_slot")}
    whole = F.col("_nth") < F.floor(F.col("taken") / F.col("size"))
    out = rows.join(starts, "row").select("kept.*", F.when(whole, 0).otherwise(F.col("taken") % F.col("size")).cast("int").alias(names["_cut_to"]),
                                          F.col("_at").alias(names["_at_slot"]))
    cut = F.col(names["_cut_to"])
    text = F.array_join(F.slice(F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""),
                                F.lit(1), cut), " ")
    out = out.withColumn(text_col, F.when(cut > 0, text).otherwise(F.col(text_col)))
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(cut > 0, F.char_length(text_col).cast(docs.schema[n_chars_col].dataType))
                             .otherwise(F.col(n_chars_col)))
    return out.orderBy(names["_at_slot"], id_col).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    """Query: what the mix takes of every document, and where in the schedule it is first taken."""
    rows, _ = mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return rows.select("kept.doc_id", "size", "source_size", "target", "taken", "first_position")
