"""Files that Spark's own file sources skip: names that begin with ``.`` or ``_``.

Secrets like such places (``.env``, ``.npmrc``, ``.aws/credentials``), and no option
makes the built-in sources list them. So the tree is walked level by level as a
DataFrame of directories, listed and read in tasks through Arrow's file systems
(local, HDFS, S3, GCS). Only hidden files are read this way.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import is_likely_false_positive
from ..session import written

# Entries of a folder that are passed on at a time.
FRAME = 10_000
# Directories below which Spark lists nothing, seen from the root: a hidden component.
HIDDEN = r"/(?:[.]|_(?![^/]*=))"
# History is scanned from patches, not from the object store.
REPOSITORY = r"/[.]git(?:/|\z)"


def qualified(spark: SparkSession, path: str):
    """The Hadoop path with scheme and authority."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path)


def _open(uri: str):
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs
    for batch in batches:
        for uri in batch["path"]:
            system, folder = _open(uri)
            found = system.get_file_info(fs.FileSelector(folder))
            # a link to a folder may lead back above it
            entries = [e for e in found if e.type != fs.FileType.Directory or not os.path.islink(e.path) or not uri.startswith("file:")]
            for k in range(0, len(entries) or 1, FRAME):
                part = entries[k:k + FRAME]
                yield pd.DataFrame({
                    "path": [f"{uri.rstrip('/')}/{e.base_name}" for e in part],
                    "is_dir": [e.type == fs.FileType.Directory for e in part],
                    "n_bytes": [e.size or 0 for e in part],
                }).astype({"path": "str", "is_dir": "bool", "n_bytes": "int64"})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # one file per batch: files are as large as they are
        for uri in batch["path"]:
            system, file = _open(uri)
            with system.open_input_stream(file, compression=None) as stream:
                yield pd.DataFrame({"path": [uri], "content": [stream.read()]})


def _shared_out(paths: DataFrame, per_task: int) -> tuple[DataFrame, int]:
    """Paths dealt out to tasks, and how many there are."""
    n = paths.count()
    most = paths.sparkSession.sparkContext.defaultParallelism * 4
    return paths.repartition(max(1, min(most, n // per_task)), "path"), n


def hidden_files(spark: SparkSession, path: str, include_all: bool = False) -> DataFrame:
    """``(path, content)`` of the hidden files below ``path``.

    Files in or below a hidden directory count as hidden. ``.git``, and names that
    mean a likely false positive, are left out unless ``include_all`` is set.
    """
    root = qualified(spark, path).toString().rstrip("/")
    below = F.expr(f"substring(path, {len(root) + 1})")
    level = spark.createDataFrame([(root,)], "path string")
    levels = []
    while True:
        listed = level.mapInPandas(_list, "path string, is_dir boolean, n_bytes bigint")
        if not include_all:
            listed = listed.filter(~below.rlike(REPOSITORY))
        listed = written(listed, "listing")
        levels.append(listed.filter(~F.col("is_dir") & below.rlike(HIDDEN)).select("path", "n_bytes"))
        level, n_folders = _shared_out(listed.filter("is_dir").select("path"), per_task=20)
        if n_folders == 0:
            break
    found = reduce(DataFrame.unionAll, levels).filter("n_bytes > 0").select("path")
    if not include_all:
        found = found.filter(~is_likely_false_positive(below))
    files, _ = _shared_out(found, per_task=10)
    return files.mapInPandas(_read, "path string, content binary")
