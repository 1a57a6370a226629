"""Session construction and lineage handling.

Iterative operators (keep-first rounds, merge-chain folds) cut their lineage
by files in the shared folder named by
``spark.checkpoint.dir``; a lost executor then costs a re-read, not a replay of
every earlier round. The folder is read from the session; only when it is unset
(local runs, tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hirelake") -> SparkSession:
    """Session with AQE (coalesce + skew join) on and the UI off."""
    master = master or os.environ.get("HIRELAKE_MASTER")
    parts = shuffle_partitions or os.environ.get("HIRELAKE_SHUFFLE_PARTITIONS")
    builder = SparkSession.builder.appName(app_name)
    if master:   # else what spark-submit says
        builder = builder.master(master)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if memory := os.environ.get("HIRELAKE_DRIVER_MEMORY", "16g" if (master or "").startswith("local") else None):
        builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Uses ``spark.checkpoint.dir`` (or a directory already set on the context).
    Only if neither is set on a local master (a local run or a test) a scratch folder is
    created and registered; on a cluster, where executors would not see it, this raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="hirelake-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def reuse(df: DataFrame) -> DataFrame:
    """Keeps an intermediate result that several later steps read (memory, spilling
    to disk). Not a lineage cut: a lost block is recomputed from its plan."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once into the shared checkpoint folder and reads it back: later steps start from files that survive
    a lost executor, and read only the columns they use. The rows are computed in one pass and never cached, and the
    files are columnar and compressed, as intermediate results fill the disk of a long job."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if '"void"' in df.schema.json():   # a column without a type has no file form
        return df.checkpoint(eager=True)
    path = f"{root.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
