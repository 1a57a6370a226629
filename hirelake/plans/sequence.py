"""Gap-free sequence numbers without a single-partition window (two-phase rank).

``Window.orderBy(...)`` with no partition pulls every row into one task. Instead:
range-partition and sort by the order key, cut lineage so partition ids are
stable, count rows per partition (one number per partition reaches the driver),
prefix-sum those counts, and add each row's position inside its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.session import cut_lineage


def assign_sequence(df: DataFrame, order_by: list[Column | str], name: str = "seq", start: int = 1,
                    num_partitions: int | None = None) -> DataFrame:
    """Adds ``name`` = 1-based (or ``start``-based) rank of each row by ``order_by``.

    The order key must be unique; ties get distinct but arbitrary numbers.
    """
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    # checkpointed: both passes read the same stored partitions, and the returned plan
    # starts from a short leaf instead of the whole input plan
    ranged = cut_lineage(ranged.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")).collect()
    offsets, running = [], start
    for row in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((int(row["_pid"]), running, int(row["_first"])))
        running += int(row["_n"])
    if not offsets:
        return ranged.drop("_pid", "_mid").withColumn(name, F.lit(None).cast("bigint"))
    # one row per partition: broadcasting it is bounded by the partition count, not the data
    table = spark.createDataFrame(offsets, "_pid int, _off bigint, _first bigint")
    seq = (F.col("_off") + (F.col("_mid") - F.col("_first"))).cast("bigint")
    return (ranged.join(F.broadcast(table), "_pid")
            .withColumn(name, seq).drop("_pid", "_mid", "_off", "_first"))
