"""Detection logic that a regex of the common dialect cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Spans = Callable[[str], Iterable[tuple[int, int]]]


def with_python_rule(
    units: DataFrame, name: str, fn: Spans, type_: str | None = None, prefilter: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Findings of a Python function ``text -> [(start, end), ...]``.

    An escape hatch for look-around, checksums or entropy. Texts travel to Python in
    Arrow batches and only the spans come back; ``prefilter``, a regex that the rule
    implies, keeps most of them in the JVM.
    """

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [] if text is None else [{"start": s, "end": e} for s, e in fn(text)])

    if "context" not in units.columns:
        units = units.withColumn("context", F.lit("raw"))
    wanted = units if prefilter is None else units.filter(F.col("text").rlike(prefilter))
    found = wanted.withColumn("__spans", spans("text")).select(
        "unit_id", "uri", "context", "text", *keep, F.explode("__spans").alias("__span")
    )
    start, end = F.col("__span.start"), F.col("__span.end")
    return found.select(
        "uri", F.lit(type_ or name).alias("type"),
        F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int")).alias("value"),
        start.alias("start"), end.alias("end"), "context", "unit_id", F.lit(name).alias("rule_id"), *keep,
    )
