"""Running totals over rows in order, however many of them share a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def running(df: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``run_<column>``: the sum (exclusive or, for ``xors``) of a BIGINT column over rows of equal ``key`` up to and with each row.

    ``key`` is a BIGINT without nulls; within it rows follow ``order``, nulls first. Rows are dealt out by ranges of both, so that a
    key with any share of them is spread over many tasks: each adds up what it has, and one number per task and column
    carries over to the next. An empty table gives no rows.
    """
    columns = [*sums, *xors]
    schema = T.StructType([*df.schema, T.StructField("__part", T.IntegerType()), T.StructField("__row", T.LongType()),
                           *(T.StructField(f"run_{c}", T.LongType()) for c in columns)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, n))
            totals = []
            for c in columns:
                values = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                add, fold = (np.add, np.cumsum) if c in sums else (np.bitwise_xor, np.bitwise_xor.accumulate)
                # what came before a key's first row in this batch is taken off again
                folded = fold(values)
                before = np.concatenate([np.zeros(1, dtype=np.int64), folded])[starts]
                run = folded - np.repeat(before, sizes) if c in sums else folded ^ np.repeat(before, sizes)
                if keys[0] == last:
                    run[:sizes[0]] = add(run[:sizes[0]], carry[c])
                carry[c] = run[-1:].copy()
                totals.append(pa.array(run))
            last = keys[-1]
            place = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(row, row + n))]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *place, *totals], names=[f.name for f in schema])

    by = [key, *order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(local, schema), "running")
    ends = rows.groupBy("__part").agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.max_by(F.struct(*(F.col(f"run_{c}") for c in columns)), "__row").alias("tail"))
    nothing = [F.lit(0).cast("long").alias(c) for c in columns]
    tails = ends.select("__part", F.col("high").alias("__key"), F.lit(1).alias("kind"), *(F.col(f"tail.run_{c}").alias(c) for c in columns))
    heads = ends.select("__part", F.col("low").alias("__key"), F.lit(0).alias("kind"), *nothing)
    earlier = W.partitionBy("__key").orderBy("__part", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = tails.unionByName(heads).select("__part", "__key", "kind", *(
        (F.sum(c) if c in sums else F.bit_xor(c)).over(earlier).alias(f"__{c}") for c in columns)).filter("kind = 0")
    # one row per task of the sort
    joined = rows.join(F.broadcast(carried.withColumnRenamed("__part", "__of")), (F.col("__part") == F.col("__of")) & (F.col(key) == F.col("__key")), "left")
    found = {}
    for c in columns:
        none = F.coalesce(F.col(f"__{c}"), F.lit(0).cast("long"))
        found[c] = (F.col(f"run_{c}") + none if c in sums else F.col(f"run_{c}").bitwiseXOR(none)).alias(f"run_{c}")
    return joined.select(*df.columns, *found.values())
