"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits.

Candidates come from pigeonring filtering. The 64 bits are cut into m segments on
a ring. If two fingerprints differ in at most t bits, some segment starts a chain
in which the first l segments together differ in at most l * t / m bits, for
every l. With m = t + 1 = 5 the first segment is equal and the first two differ in at most one bit:
26 bits that serve as a join key. The rest of the chain is tested before the
whole distance is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .components import components

BITS = 64
SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """The signed 64-bit SimHash of a whole text.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A bit is
    one if it is set in over half of the shingles' hashes, repeats included. Shorter texts
    are one shingle; no words give zero.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    ends = ends[k - 1:]
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 8192):  # bounds the bit matrix
        spans = zip(starts[at:at + 8192].tolist(), ends[at:at + 8192].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, column: str = "text", out: str = "fingerprint", words_per_shingle: int = 4) -> DataFrame:
    """``docs`` without ``column`` but with ``out``, its SimHash as a long. Null texts count as empty."""
    rest = docs.drop(out)
    schema = T.StructType([*(f for f in rest.schema.fields if f.name != column), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            made = pa.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column(at)], pa.int64())
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], names=[*(batch.schema.names[i] for i in kept), out])

    return rest.mapInArrow(run, schema)


class Ring:
    """The segments of a fingerprint, and what a chain of them may differ in."""

    def __init__(self, distance: int) -> None:
        if not 0 <= distance < 16:
            raise ValueError("distance is 0 to 15")
        self.distance, self.m = distance, distance + 1
        cuts = [BITS * i // self.m for i in range(self.m + 1)]
        self.segments = list(zip(cuts, cuts[1:]))

    def mask(self, start: int, length: int) -> int:
        """The bits of ``length`` segments from ``start`` on around the ring."""
        return sum(((1 << (b - a)) - 1) << a for a, b in (self.segments[(start + i) % self.m] for i in range(length)))

    def budget(self, length: int) -> int:
        return length * self.distance // self.m

    def keys(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """For each start: the key of each fingerprint, then its neighbours' keys at the bits that may differ.

        A key is the first two segments under a mixing product, with the start in it.
        """
        for start in range(self.m):
            chain = min(2, self.m)
            own = values & np.uint64(self.mask(start, chain))
            mixed = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(start + 1)
            yield start, mixed(own), False
            if self.budget(2) >= 1 and self.m > 1:
                a, b = self.segments[(start + 1) % self.m]
                for bit in range(a, b):
                    yield start, mixed(own ^ np.uint64(1 << bit)), True

    def linked(self, start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs keep every budget of their chain, the whole distance last."""
        differ = left ^ right
        good = np.ones(len(differ), dtype=bool)
        for length in range(1, self.m + 1):
            masks = np.array([self.mask(s, length) for s in range(self.m)], dtype=np.uint64)
            live = np.flatnonzero(good)
            good[live] = np.bitwise_count(differ[live] & masks[start[live]]) <= self.budget(length)
        return good


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect: each node to the least of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = new


def _bucket_links(ring: Ring, keys: np.ndarray, values: np.ndarray, start: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (arrays sorted by key), as a forest."""
    run_end = np.searchsorted(keys, keys, side="right")
    at = np.arange(len(keys))
    found_a, found_b, held = [np.array([], np.uint64)], [np.array([], np.uint64)], 0
    step = 1
    while True:
        at = at[at + step < run_end[at]]
        if not len(at):
            break
        pairs = at[~(probe[at] & probe[at + step])]
        good = pairs[ring.linked(start[pairs], values[pairs], values[pairs + step])]
        found_a.append(values[good])
        found_b.append(values[good + step])
        held += len(good)
        if held > 500_000:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], len(a)
        step += 1
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(prints: DataFrame, distance: int = 4, bucket: int = 8192) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints at most ``distance`` bits apart.

    Not every link is listed, but any two linked fingerprints are connected through
    those that are. Fingerprints are grouped by the key of their chain. A group of up to
    ``bucket`` is compared in its task, from which only a spanning forest leaves. Members of a larger group are linked through
    ball centres instead: two fingerprints at most ``distance`` apart
    lie in a ball of half that radius around some value, and all within one ball are linked.
    That is exact and linear in the group; it needs an even distance, so that an odd one
    compares groups of any size.
    """
    ring = Ring(distance)
    spark = prints.sparkSession
    distinct = prints.select("fingerprint").distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start, keys, probe in ring.keys(values):
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.view(np.int64)), pa.array(values.view(np.int64)), pa.array(np.full(len(keys), start, np.int8)),
                    pa.array(np.full(len(keys), probe)),
                ], names=["key", "fingerprint", "start", "probe"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(a, b, hot):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

        rest: list[np.ndarray] | None = None
        spilled = None  # the key of a large group whose members are being passed on

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, values, start, probe = columns
            if len(keys):
                a, b = _bucket_links(ring, keys, values, start, probe)
                if len(a):
                    yield emit(a, b, False)

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now[1] = now[1].view(np.uint64)
            columns = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if not len(columns[0]):
                continue
            if spilled is not None:
                n = int(np.searchsorted(columns[0], spilled, side="right"))
                if n:
                    yield emit(columns[1][:n], columns[1][:n], True)
                columns = [c[n:] for c in columns]
                if not len(columns[0]):
                    rest = None
                    continue
                spilled = None
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            ready, rest = [c[:cut] for c in columns], [c[cut:] for c in columns]
            sizes = np.searchsorted(ready[0], ready[0], side="right") - np.searchsorted(ready[0], ready[0])
            large = (sizes > bucket) & (distance % 2 == 0)
            if large.any():
                yield emit(ready[1][large], ready[1][large], True)
                ready = [c[~large] for c in ready]
            yield from done(ready)
            if len(rest[0]) > bucket and distance % 2 == 0:
                yield emit(rest[1], rest[1], True)
                spilled, rest = rest[0][0], None
        if rest is not None:
            yield from done(rest)

    rows = distinct.mapInArrow(keyed, "key long, fingerprint long, start byte, probe boolean")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sorted_rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    found = written(sorted_rows.mapInArrow(compared, "a long, b long, hot boolean"), "links")
    hot = found.filter("hot").select(F.col("a").alias("fingerprint")).distinct()
    near = found.filter("NOT hot").select("a", "b")
    return near if hot.isEmpty() else near.unionByName(_ball_links(hot, distance // 2))


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges from all fingerprints in a ball to its least, for every ball centre near one."""
    from itertools import combinations

    flips = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)], dtype=np.uint64)

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), 256):
                part = values[k:k + 256]
                yield pa.RecordBatch.from_arrays([
                    pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)),
                ], names=["centre", "fingerprint"])

    # a ball holds no more members than it has flips
    balls = prints.mapInArrow(centres, "centre long, fingerprint long").groupBy("centre").agg(F.collect_set("fingerprint").alias("members"))
    return balls.filter(F.size("members") > 1).select(
        F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint (long), component_id (the least doc_id reachable).

    Reads doc_id and text. Null and empty texts share the fingerprint zero. Equal
    texts, ties and repeated rows keep one row each. A null doc_id is never a component's least unless it has no other;
    its row stays. An empty table gives no rows.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), words_per_shingle=words_per_shingle), "prints")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, distance))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, distance: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """One row of ``docs`` per group of linked fingerprints: that of the least doc_id (null last), then text hash; columns unchanged.

    A row is known by doc_id and text: other texts under a repeated or null doc_id are documents of their own,
    and of equal rows one stays.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__th"), "text")
    prints = written(fingerprints(keyed, words_per_shingle=words_per_shingle), "prints")
    roots = components(links(prints, distance)).withColumnRenamed("node", "fingerprint")
    group = prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = group.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__th")).alias("first"))
    kept = written(first.select(F.col("first.doc_id").alias("__id"), F.col("first.__th").alias("__kept")).distinct(), "kept")
    own = docs.withColumn("__th", F.xxhash64("text"))
    chosen = own.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__kept")), "left_semi")
    return chosen.dropDuplicates(["doc_id", "__th"]).select(*docs.columns)
