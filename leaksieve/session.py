"""Session helpers: local sessions, input parallelism, shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tasks per core that a spread scan has.
SPLITS = 4


def local_session(cores: int | str = "*", app: str = "leaksieve", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # stack traces per column operation cost more than the operation
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``. Only where that is unset and the session is
    local is a folder below the warehouse used.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = context.getCheckpointDir()
        if folder is not None:
            return folder
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "_scratch")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below :func:`shared_dir` and read it back.

    Cuts the lineage, survives the loss of executors, and tells the planner the
    size of what it reads.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, per_core: int = 1) -> DataFrame:
    """Give a scan enough partitions to keep every core busy to the end.

    Matching is CPU-bound, and a file with a single row group is read by one task.
    The scan is reshuffled only while it has fewer than ``per_core`` splits per core, so
    at most (per_core x cores x split size) bytes move; a larger table has more
    splits than that and is never shuffled. Call it on scans, where asking for the partition
    count only lists files.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores * per_core:
        return df
    return df.repartition(cores * SPLITS, key)


def semi_join(wide: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Keep the rows of ``wide`` whose key is in ``keys``.

    The keys are written first, so that the planner knows their size in bytes and
    broadcasts them only below its own threshold; else AQE splits hot keys of ``wide``.
    """
    return wide.join(written(keys.select(on).distinct(), "keys"), on, "left_semi")
