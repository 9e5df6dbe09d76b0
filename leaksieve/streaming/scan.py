"""Continuous scanning with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import RULES, Rule
from ..operators.detect import detect, mask


def scan_stream(units: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = (), salt: str | None = None) -> DataFrame:
    """Masked findings of a stream of units. Detection is stateless and looks at one unit at a time, names included, so stream equals batch."""
    return mask(detect(units, rules, keep), salt=salt)


# Pairs that a task remembers in a micro-batch. Bounds memory only: a pair that is forgotten reaches state again.
REMEMBERED = 1_000_000


def first_in_task(findings: DataFrame) -> DataFrame:
    """Of the findings of a (fingerprint, uri) pair, the first that a task meets in a micro-batch; rows of a null pair are one pair.

    A secret that fills a stream so reaches the shuffle, and the one task that keeps its state, once per task and batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen = set()
            kept = []
            for k, pair in enumerate(zip(batch.column("fingerprint").to_pylist(), batch.column("uri").to_pylist())):
                if pair not in seen:
                    seen.add(pair)
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return findings.mapInArrow(run, findings.schema)


def dedup_stream(findings: DataFrame, delay: str, time_col: str = "ts") -> DataFrame:
    """Report a secret of a URI once within the horizon ``delay``.

    Repeats within a task are dropped before anything is shuffled. Rows later than the watermark are dropped, and so is state older than it: the
    state holds the (fingerprint, uri) pairs of one horizon, not of the whole stream. A pair is reported again once the watermark has passed its
    first time by ``delay`` and another batch has begun.
    """
    return first_in_task(findings).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["fingerprint", "uri"])


def write_available(stream: DataFrame, path: str, checkpoint_path: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what has arrived, append it exactly once and stop."""
    return (
        stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint_path)
        .outputMode("append").trigger(availableNow=True).start()
    )
