"""Files as units: one row per file, whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import is_likely_false_positive
from ..session import SPLITS, spread
from .hidden import hidden_files, qualified


def _units(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("__path").alias("unit_id"), F.col("__path").alias("uri"), F.lit("raw").alias("context"), "text"
    )


def read_file(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One file, or an explicit list of files, whatever its name says."""
    paths = [path] if isinstance(path, str) else list(path)
    # wholetext has to be an argument: text() overrides an option of that name
    whole = spark.read.text(paths, wholetext=True)
    # Spark packs files by size into as many tasks as cores, of uneven length
    return spread(_units(whole.select(F.col("_metadata.file_path").alias("__path"), F.col("value").alias("text"))), "unit_id", SPLITS)


def read_dir(spark: SparkSession, path: str, include_all: bool = False, hidden: bool = True) -> DataFrame:
    """A directory, recursively, without empty files.

    By default minified files, assets and test data are dropped by name, and binary
    files by content: those with NUL bytes and no UTF-16 mark. Texts are UTF-8; others are read as
    UTF-16, of which only characters below U+0100 come out right, or else as Latin-1. ``include_all``
    keeps every file. Files with hidden names, ``.env`` for one,
    are read too unless ``hidden`` is off, see :mod:`leaksieve.sources.hidden`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if not include_all:
        # A filter on the metadata column drops files from the listing, before any is opened.
        # It sees the path below the root, so a root below a folder of tests is not empty.
        name, root = F.col("_metadata.file_path"), F.lit(qualified(spark, path).toUri().getRawPath())
        at = F.instr(name, root)
        below = F.when(at > 0, F.substring(name, at + F.length(root), F.length(name))).otherwise(name)
        files = files.filter(~is_likely_false_positive(below))
    files = files.select("path", "content")
    if hidden:
        files = files.unionByName(hidden_files(spark, path, include_all))
    plain, latin = F.col("content").cast("string"), F.decode("content", "ISO-8859-1")
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    text = F.when(wide, F.replace(F.substring(latin, 3, 2**31 - 1), F.lit("\0"), F.lit(""))).when(F.is_valid_utf8(plain), plain).otherwise(latin)
    if not include_all:
        files = files.filter(wide | ~latin.contains("\0"))
    return _units(files.select(F.col("path").alias("__path"), text.alias("text")))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """A list of domains, one per line; case and blank lines do not matter."""
    return (
        spark.read.text(path).select(F.lower(F.trim("value")).alias("domain"))
        .filter(F.col("domain") != "").distinct()
    )
