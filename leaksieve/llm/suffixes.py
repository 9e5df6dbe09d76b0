"""Repeated byte strings across documents, by suffix arrays built in two stages.

Which strings of ``length`` bytes start more than once is decided on sorted
suffixes. Of a block of text only suffixes smaller than their successors are
sorted directly; scans over the buckets of first bytes induce the order of the
others; strings repeat where neighbours in the order share a prefix of ``length`` bytes.

So that blocks stay small and equal strings still meet, every string is
given a key: the least hash of the k-byte strings inside it. Equal strings have
equal keys, and runs of starts with one key form a cell, about ``length - k`` of them per key. Cells whose
key occurs once hold no repeats. Equal cells are counted, not compared. What
remains is sorted by key into blocks. A key with too many different cells is cut finer with a larger k; at
k = length a key stands for one string, and counting is all there is to do.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

LENGTH = 400
# Different cells that one key may bring into a block; beyond that it is cut finer.
CELLS = 4096
# Bytes of text of a block's suffix array, one key's cells apart.
BLOCK = 1 << 19
# Starts that are hashed at a time, and that a cell holds at most.
STRETCH, RUN = 1 << 18, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
# No byte of UTF-8 text has this value.
SEPARATOR = b"\xff"

_CELLS = "doc_id long, th long, piece long, lo long, n int, key long, d1 long, d2 long, occ long, single boolean, inner boolean"


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, and a random value for each byte."""
    base = pow(3, 41, 1 << 64)
    inverse = pow(base, -1, 1 << 64)
    ones = np.ones(n, dtype=np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = base, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte string."""
    up, down, table = _powers(STRETCH + 2 * 4096)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    found = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    found ^= found >> np.uint64(32)
    found *= _ODD
    return found ^ (found >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, from running minima of whole groups."""
    if width == 1:
        return values
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1:n])


def cells_of(data: bytes, n: int, k: int, length: int) -> Iterator[tuple[int, int, int, bool]]:
    """(start, number of starts, key, inner) of the cells of the first ``n`` starts of ``data``.

    ``inner`` is true if the key's k-byte string occurs twice near the cell, so
    that the cell may hold repeats of its own.
    """
    width = length - k + 1
    view = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, n, STRETCH):
        m = min(STRETCH, n - at)
        hashes = _hashes(view[at:at + m + length - 1], k)
        keys = _least(hashes, width)
        # a hash is some key if it is the greatest of the keys of all strings around it
        spread = np.zeros(m + 2 * (width - 1), dtype=np.uint64)
        spread[width - 1:width - 1 + m] = keys
        chosen = np.flatnonzero(~_least(~spread, width) == hashes)
        twice = np.flatnonzero(hashes[chosen[1:]] == hashes[chosen[:-1]])
        inner = np.zeros(m + 1, dtype=np.int32)
        np.add.at(inner, np.maximum(chosen[twice] - width + 1, 0), 1)
        np.add.at(inner, np.minimum(chosen[twice + 1] + 1, m), -1)
        inner = np.cumsum(inner[:-1]) > 0
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = np.unique(np.concatenate([[0], cuts, [m]]))
        if (np.diff(edges) > RUN).any():
            edges = np.unique(np.concatenate([edges, *(np.arange(a, b, RUN) for a, b in zip(edges[:-1], edges[1:]) if b - a > RUN)]))
        own = np.logical_or.reduceat(inner, edges[:-1])
        for a, b, key, doubled in zip(edges[:-1].tolist(), edges[1:].tolist(), keys[edges[:-1]].view(np.int64).tolist(), own.tolist()):
            yield at + a, b - a, key, doubled


def suffix_order(text: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The starts marked in ``wanted`` and all that their order needs, sorted by their suffixes' first ``depth`` bytes or more."""
    t = np.frombuffer(text, dtype=np.uint8).astype(np.int16)
    n = len(t)
    # a run of equal bytes is smaller than what follows it, or larger, as a whole
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.append(t[ends[:-1] + 1] > t[ends[:-1]], False)
    smaller = np.repeat(rises, np.diff(np.append(-1, ends)))
    # the order of a larger suffix comes from the next smaller one: mark the way there
    direct = np.flatnonzero(smaller)
    after = np.searchsorted(direct, np.arange(n))
    reach = np.append(direct, n - 1)[after]
    needed = wanted.copy()
    ahead = np.zeros(n + 1, dtype=np.int32)
    starts = np.flatnonzero(wanted)
    np.add.at(ahead, starts, 1)
    np.add.at(ahead, reach[starts] + 1, -1)
    needed |= np.cumsum(ahead[:-1]) > 0

    first = sorted(np.flatnonzero(smaller & needed).tolist(), key=lambda p: text[p:p + depth])
    first = np.array(first, dtype=np.int64)
    heads = np.searchsorted(t[first], np.arange(257)) if len(first) else np.zeros(257, dtype=np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    if needed[n - 1]:
        waiting[t[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Predecessors of scanned suffixes: larger first bytes wait in their buckets, equal ones are returned."""
        before = scanned[scanned > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        firsts = t[before]
        later = before[firsts > byte]
        if len(later):
            order = np.argsort(t[later], kind="stable")
            later = later[order]
            values, at = np.unique(t[later], return_index=True)
            for value, part in zip(values.tolist(), np.split(later, at[1:])):
                waiting[value].append(part)
        return before[firsts == byte]

    for byte in range(256):
        scanned = np.concatenate(waiting[byte]) if waiting[byte] else np.array([], dtype=np.int64)
        while len(scanned):
            out.append(scanned)
            scanned = induce(scanned, byte)
        own = first[heads[byte]:heads[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    return np.concatenate(out) if out else np.array([], dtype=np.int64)


def repeated_starts(text: bytes, wanted: np.ndarray, length: int) -> np.ndarray:
    """Which of the wanted starts have a string of ``length`` bytes that another of them has too."""
    order = suffix_order(text, wanted, length)
    order = order[wanted[order]]
    found = np.zeros(len(text), dtype=bool)
    if len(order) < 2:
        return found
    left, right = order[:-1], order[1:]
    # neighbours' common prefixes: eight bytes at either end first, then all
    words = np.ndarray((len(text),), dtype="<u8", buffer=text + bytes(8), strides=(1,))
    live = np.flatnonzero((words[left] == words[right]) & (words[left + length - 8] == words[right + length - 8]))
    same = [text[a:a + length] == text[b:b + length] for a, b in zip(left[live].tolist(), right[live].tolist())]
    live = live[np.array(same, dtype=bool)]
    found[left[live]] = found[right[live]] = True
    return found


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Start and size of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def _block(rows: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Repeats (doc_id, th, lo, n) in the single cells of a block."""
    text = SEPARATOR.join(r[5] for r in rows)
    wanted = np.zeros(len(text), dtype=bool)
    at = 0
    for r in rows:
        wanted[at:at + r[3]] = True
        at += len(r[5]) + 1
    found = repeated_starts(text, wanted, length)
    at = 0
    for doc_id, th, lo, n, single, data in rows:
        if single:
            for start, size in _runs(found[at:at + n]):
                yield doc_id, th, lo + start, size
        at += len(data) + 1


def _level(pieces: DataFrame, k: int, length: int, cells: int) -> tuple[DataFrame, DataFrame | None]:
    """Repeats (doc_id, th, lo, n) within pieces (doc_id, th, piece, n, single, data), and pieces to be cut finer."""
    import hashlib

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 4 + [pa.bool_()] * 2
        names = ["doc_id", "th", "piece", "lo", "n", "key", "d1", "d2", "occ", "single", "inner"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                doc_id, th, piece, n, single, data = (c[i].as_py() for c in batch.columns)
                for lo, m, key, inner in cells_of(data, n, k, length) if n > 0 else ():
                    # at k = length a cell is one string, however often it follows itself
                    digest = hashlib.blake2b(data[lo:lo + (length if k == length else m - 1 + length)], digest_size=16).digest()
                    occ = hashlib.blake2b(b"%d,%d,%d" % (doc_id or 0, th, piece + lo), digest_size=8).digest()
                    rows.append((doc_id, th, piece, piece + lo, m, key, *np.frombuffer(digest, "<i8").tolist(), int.from_bytes(occ, "little", signed=True), single, inner))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    weight = F.sum(F.when(F.col("single"), 1).otherwise(2))
    every = written(pieces.mapInArrow(cut, _CELLS), "cells")
    shared = every.groupBy("key").agg(weight.alias("w"), F.max("inner").alias("inner")).filter("w > 1 OR inner").select("key")
    found = written(every.join(shared, "key", "left_semi"), "shared-cells")
    kinds = ["key", "d1", "d2"]
    different = written(found.groupBy(*kinds).agg(weight.alias("w"), F.max("inner").alias("inner"), F.min("occ").alias("occ")), "different-cells")
    # at k = length a cell is one string, more than once if it is its own neighbour
    equal = different.filter("w > 1 OR inner" if k == length else "w > 1")
    whole = found.filter("single").join(equal.select(*kinds), kinds, "left_semi").select("doc_id", "th", "lo", "n")
    if k == length:
        return whole, None
    counts = different.groupBy("key").agg(F.count("*").alias("cells"), F.max("inner").alias("any")).filter("cells > 1 OR any").select("key", "cells")
    chosen = different.join(counts, "key").select(*kinds, "occ", "w", "cells")
    # one place of each different cell, with the text there
    places = found.join(chosen, [*kinds, "occ"]).select(
        "doc_id", "th", "piece", F.struct("lo", "n", "key", "cells", (F.col("single") & (F.col("w") == 1)).alias("single")).alias("cell"))
    per_piece = places.groupBy("doc_id", "th", "piece").agg(F.collect_set("cell").alias("cells"))

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
        names = ["key", "doc_id", "th", "lo", "n", "single", "finer", "data"]
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                doc_id, th, piece, data, own = (c[i].as_py() for c in batch.columns)
                for c in own:
                    at = c["lo"] - piece
                    part = data[at:at + c["n"] - 1 + length]
                    rows.append((c["key"], doc_id, th, c["lo"], c["n"], c["single"], c["cells"] > cells, part))
                    held += len(part)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    on = [pieces[c].eqNullSafe(per_piece[c]) for c in ("doc_id", "th", "piece")]
    fetched = pieces.join(per_piece, on).select(pieces["doc_id"], pieces["th"], pieces["piece"], "data", "cells")
    texts = written(fetched.mapInArrow(text_of, "key long, doc_id long, th long, lo long, n int, single boolean, finer boolean, data binary"), "cell-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = list(_block(held, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "th", "lo", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key and size > BLOCK:
                    yield from done()
                    held, size = [], 0
                key = row[0]
                held.append(row[1:])
                size += len(row[-1])
        if held:
            yield from done()

    spark = pieces.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = texts.filter("NOT finer").select("key", "doc_id", "th", "lo", "n", "single", "data").repartition(parts, "key").sortWithinPartitions("key")
    compared = dealt.mapInArrow(compare, "doc_id long, th long, lo long, n int")
    finer = texts.filter("finer").select("doc_id", "th", F.col("lo").alias("piece"), F.col("n").cast("long").alias("n"), "single", "data")
    return whole.unionByName(compared), None if finer.isEmpty() else finer


def repeats(docs: DataFrame, length: int = LENGTH, cells: int = CELLS) -> DataFrame:
    """(doc_id, th, lo, n): runs of ``n`` starts from byte ``lo`` whose strings of ``length`` bytes start elsewhere too.

    ``th`` is the hash of the text, which tells rows with equal doc_ids apart. Strings lie
    within one document; equal rows count as two documents. Null and shorter texts have none.
    """
    if length < 16 or length > 4096:
        raise ValueError("length is 16 to 4096")
    data = F.col("text").cast("binary")
    pieces = docs.filter(F.octet_length("text") >= length).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.lit(0).cast("long").alias("piece"),
        (F.octet_length("text") - (length - 1)).cast("long").alias("n"), F.lit(True).alias("single"), data.alias("data"))
    found = []
    for k in (length // 4, length * 5 // 8, length * 7 // 8, length):
        here, pieces = _level(pieces, k, length, cells)
        found.append(written(here, "repeats"))
        if pieces is None:
            break
    return functools.reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, length: int = LENGTH, cells: int = CELLS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept, the bytes of the text that no repeated string covers.

    All rows and other columns stay (columns of these names are replaced). Null texts count as empty. ``kept`` is binary:
    a repeat may begin or end within a character. All copies of a string go, the first as well.
    """
    found = repeats(docs, length, cells)
    per_doc = found.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("lo", "n")).alias("__runs"))
    rest = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    joined = rest.join(per_doc, on, "left").select(*(rest[c] for c in rest.columns), F.col("text").cast("binary").alias("__data"), "__runs")
    columns = rest.columns
    added = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for data, runs in zip(part.column(len(columns)), part.column(len(columns) + 1)):
                    data, runs = data.as_py() or b"", runs.as_py() or []
                    change = np.zeros(len(data) + 1, dtype=np.int64)
                    for r in runs:
                        change[r["lo"]] += 1
                        change[r["lo"] + r["n"] - 1 + length] -= 1
                    gone = np.cumsum(change[:-1]) > 0
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    rows.append((len(data), len(data) - len(kept), len(_runs(gone)), kept))
                made = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), added)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(columns)], *made], names=[*columns, *(name for name, _ in added)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), "n_bytes long, n_removed long, n_spans long, kept binary"])
    return joined.mapInArrow(cut, schema)
