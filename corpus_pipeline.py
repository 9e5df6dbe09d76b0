"""The corpus pipeline: documents through the stages below, each written before the next reads it.

A stage takes all that its predecessor kept and learns from that alone (and from labels
or benchmark, where it needs them). All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leaksieve.llm import bpe, leaks, lines, quality, simhash
from leaksieve.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, machine, out="__score").filter("__score >= 0.5").drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line holds, up to two edits or a chain of such steps; n_chars counted anew."""
    return lines.drop_repeated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: four-word shingles, at most 4 of 64 bits apart, chains included."""
    return simhash.keep_first(docs, distance=4, words_per_shingle=4)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return leaks.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), path), path)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe encoding", encode_tokens),
]

# The classifier and the encoder have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str | None]:
    return {"pipeline": ORACLE_SQL}
