"""Trie of the turns that conversations begin with.

Turns are known by 120 bits of their SHA-256. Conversations are cut into bands of ``BAND`` turns, so that a row
has a fixed size however long a conversation is, and bands are dealt to shards by ranges of their turns: copies of a hot conversation spread over
shards, its nodes lie on shard borders. A shard is a padded matrix of turn ids: lexsort orders its rows,
change masks accumulated by OR over the columns mark where nodes start, and reduceat aggregates every depth.
Nodes on borders, and those with turns in deeper bands, leave their shard as parts and are put together by joins and sums.

Everything that is summed is a sum over rows: a row adds the words of a turn unless the node starts with it,
and counts a leaf if it is the last row of a node and ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .running import running

# Turns in a row of a matrix.
BAND = 32
# Rows of a matrix, about.
SHARD = 20_000
# Ids in a piece of a list of ids.
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"
_NOTHING = hashlib.sha256(b"").hexdigest()
_PARTS = """kind int, depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, parent_open boolean,
  n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"""


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, hi, lo, n_words): turns of each conversation numbered from 1, by turn (null first), then role and digest.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out; repeated
    rows are turns of their own. Other columns are not read. Rows are numbered across tasks: one conversation may hold any share of them.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)

    def part(at: int):
        return F.conv(F.substring("digest", at, 15), 16, 10).cast("long")

    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    turns = turns.select("conv_id", "turn", "role", part(1).alias("hi"), part(16).alias("lo"), "n_words",
                         F.lit(1).cast("long").alias("pos"), F.monotonically_increasing_id().alias("tie"))
    numbered = running(turns, "conv_id", ["turn", "role", "hi", "lo", "tie"], sums=["pos"])
    return numbered.select("conv_id", F.col("run_pos").alias("pos"), "hi", "lo", "n_words")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: turns (conv_id, depth, hi, lo, n_words) and conversations (conv_id, length).

    The first h turns of conversation c become those of conversation c - c % every (as many as it has), h being crc32 of c's
    decimal digits modulo ``most`` + 1. Heads hold ``most`` turns at most.
    """
    head = F.when(F.col("pos") <= most, F.struct("pos", "hi", "lo", "n_words"))
    convs = written(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(head)).alias("head"), F.max("pos").alias("n_own")), "heads")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    base = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("lead"))
    asked = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    lead = F.slice(F.coalesce("lead", F.slice("head", 1, 0)), F.lit(1), F.col("h"))
    built = asked.select("conv_id", "h", "n_own", lead.alias("lead"))
    built = written(built.select(
        "conv_id", "h", "lead", F.size("lead").alias("n_lead"), (F.size("lead") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("long").alias("length")), "built")
    own = turns.join(built.select("conv_id", "h", "n_lead"), "conv_id").filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n_lead")).alias("depth"), "hi", "lo", "n_words")
    led = built.select("conv_id", F.explode("lead").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.hi", "t.lo", "t.n_words")
    return own.unionByName(led), built.select("conv_id", "length")


def _mixed(depth: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of a turn at a depth; the exclusive or of those down a path is the key of its node."""
    def stir(x: np.ndarray) -> np.ndarray:
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    at, a, b = (x.astype(np.uint64) for x in (depth, hi, lo))
    one = stir(stir(a + at * np.uint64(0x9E3779B97F4A7C15)) ^ b)
    two = stir(stir(b + at * np.uint64(0xD6E8FEB86659FD93)) ^ (a << np.uint64(1)))
    return one.view(np.int64), two.view(np.int64)


class _Matrix:
    """Band rows as padded matrices of one column per turn; cells beyond a row's turns hold -1."""

    def __init__(self, rows: pa.Table | pa.RecordBatch) -> None:
        def column(name: str) -> np.ndarray:
            return rows.column(name).to_numpy() if isinstance(rows, pa.Table) else rows.column(name).to_numpy(zero_copy_only=False)

        turns = rows.column("turns")
        turns = turns.combine_chunks() if isinstance(turns, pa.ChunkedArray) else turns
        turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
        self.conv, self.band, self.length, self.k1, self.k2 = (column(c).astype(np.int64) for c in ("conv_id", "band", "length", "k1", "k2"))
        self.size = np.diff(turns.offsets.to_numpy()).astype(np.int64)
        flat = turns.flatten()
        at = np.repeat(np.arange(len(self.size)), self.size), np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.hi, self.lo, self.words = (np.full((len(self.size), int(self.size.max(initial=0))), pad, dtype=np.int64) for pad in (-1, -1, 0))
        for matrix, name in ((self.hi, "hi"), (self.lo, "lo"), (self.words, "n_words")):
            matrix[at] = flat.field(name).to_numpy(zero_copy_only=False)
        self.more = self.length > (self.band + 1) * BAND

    def sort(self) -> None:
        columns = [m[:, c] for c in reversed(range(self.hi.shape[1])) for m in (self.lo, self.hi)]
        order = np.lexsort([self.conv, self.more, *columns, self.k2, self.k1, self.band])
        for name, value in vars(self).items():
            setattr(self, name, value[order])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the nodes at every cell."""
        depth = self.band[:, None] * BAND + np.arange(1, self.hi.shape[1] + 1)
        present = np.arange(self.hi.shape[1]) < self.size[:, None]
        return tuple(np.bitwise_xor.accumulate(np.where(present, m, 0), axis=1) ^ k[:, None] for m, k in zip(_mixed(depth, self.hi, self.lo), (self.k1, self.k2)))


def _table(columns: dict[str, list]) -> pa.Table:
    """Rows of _PARTS from lists of arrays; names that are missing are null."""
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t])
                        for n, t in (field.split() for field in _PARTS.split(","))])
    n = sum(len(x) for x in columns["kind"])
    arrays = [pa.array(np.concatenate(columns[f.name]) if f.type != pa.string() else [x for part in columns[f.name] for x in part], f.type, from_pandas=True)
              if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema)


def _shard_nodes(rows: pa.Table, before: int, after: int) -> Iterator[pa.Table]:
    """The nodes of one shard: whole ones (kind 0), parts (1), pieces of parts' ends (2), sums of rows of long conversations (3).

    ``before`` is how many turns the first row shares with the last row of the shard before (-1: another band or key), ``after``
    the same for the last row and the shard behind.
    """
    m = _Matrix(rows)
    m.sort()
    n, width = m.hi.shape
    k1, k2 = m.keys()
    present = np.arange(width) < m.size[:, None]
    # a column's mask: where the path up to it changes against the row above
    changed = np.ones((n, width + 1), dtype=bool)
    changed[1:, 0] = (m.band[1:] != m.band[:-1]) | (m.k1[1:] != m.k1[:-1]) | (m.k2[1:] != m.k2[:-1])
    changed[1:, 1:] = (m.hi[1:] != m.hi[:-1]) | (m.lo[1:] != m.lo[:-1])
    np.logical_or.accumulate(changed, axis=1, out=changed)
    starts = changed[:, 1:] & present
    starts[0, :max(before, 0)] = False
    gained = np.where(starts, 0, m.words)
    below = np.concatenate([np.cumsum(gained[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1), dtype=np.int64)], axis=1)
    # the last row of a node that ends where the row ends
    last = np.ones((n, width + 1), dtype=bool)
    last[:-1] = changed[1:]
    last[-1, :after + 1] = False
    leaf = (last[np.arange(n), m.size] & ~m.more & ((m.size > 0) | (m.band == 0))).astype(np.int64)
    ender = ~m.more

    parents = np.zeros(n, dtype=np.int64)  # of each row, the least member of the node in the column before
    parents_open = np.ones(n, dtype=bool)
    for c in range(width + 1):
        at = np.flatnonzero(changed[:, c])
        if c == 0:
            # the node that a band starts from: the root, or one that the band above knows but for its children
            root, there = m.band[at] == 0, np.ones(len(at), dtype=bool)
            depth, a, b = m.band[at] * BAND, m.k1[at], m.k2[at]
        else:
            root, there = np.zeros(len(at), dtype=bool), present[at, c - 1]
            depth, a, b = m.band[at] * BAND + c, k1[at, c - 1], k2[at, c - 1]
        sizes = np.diff(np.append(at, n))
        members, least = sizes.astype(np.int64), np.minimum.reduceat(m.conv, at)
        children = np.add.reduceat(starts[:, c].astype(np.int64), at) if c < width else np.zeros(len(at), dtype=np.int64)
        leaves, saved = np.add.reduceat(leaf, at), np.add.reduceat(below[:, max(c - 1, 0)], at)
        ends = np.add.reduceat((ender & (m.size == c)).astype(np.int64), at)
        is_open = np.logical_or.reduceat(m.more, at)
        is_open[0] |= before >= c
        is_open[-1] |= after >= c
        if c == 0:
            is_open[:] = True
            members, leaves, saved, ends = (np.where(root, x, 0) for x in (members, leaves, saved, ends))
        group = np.repeat(np.arange(len(at)), sizes)
        if c == 0:
            up1, up2 = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        else:
            up1, up2 = (k[at, c - 2] for k in (k1, k2)) if c > 1 else (m.k1[at], m.k2[at])
        listed = []
        for g in np.flatnonzero(there):
            ids = m.conv[at[g]:at[g] + ends[g]]
            if not is_open[g]:
                listed.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else _NOTHING)
                continue
            listed.append(None)
            pieces = [ids[k:k + PIECE] for k in range(0, len(ids), PIECE)]
            if pieces:
                k = len(pieces)
                yield _table({"kind": [[2] * k], "depth": [[depth[g]] * k], "k1": [[a[g]] * k], "k2": [[b[g]] * k],
                              "conv_id": [[p[0] for p in pieces]], "ends": [[",".join(map(str, p.tolist())) for p in pieces]]})
        keep = np.flatnonzero(there)
        if len(keep):
            named = members[keep] > 0
            yield _table({
                "kind": [is_open[keep].astype(np.int32)], "depth": [depth[keep]], "k1": [a[keep]], "k2": [b[keep]], "p1": [up1[keep]], "p2": [up2[keep]],
                "conv_id": [[x if ok else None for x, ok in zip(least[keep].tolist(), named)]], "parent_conv_id": [parents[at[keep]]],
                "parent_open": [parents_open[at[keep]]], "n_convs": [members[keep]], "n_children": [children[keep]],
                "n_leaves": [leaves[keep]], "saved_tokens": [saved[keep]], "ends": [listed]})
        parents, parents_open = least[group], is_open[group]
    long = np.flatnonzero(m.length > BAND)
    if len(long):
        yield _table({"kind": [np.full(len(long), 3)], "depth": [m.band[long]], "conv_id": [m.conv[long]],
                      "n_leaves": [leaf[long]], "saved_tokens": [below[long, 0]]})


def _bands(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, band, length, turns, k1, k2): the turns of each conversation, ``BAND`` to a row, and the key of the node they start from."""
    struct = F.struct("depth", "hi", "lo", "n_words")
    rows = turns.join(convs, "conv_id").select("conv_id", F.floor((F.col("depth") - 1) / BAND).cast("long").alias("band"), "length", struct.alias("turn"))
    # conversations without turns have a row, too
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("band"), "length", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn")))
    bands = rows.groupBy("conv_id", "band").agg(F.max("length").alias("length"), F.sort_array(F.collect_list("turn")).alias("turns"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _Matrix(batch.append_column("k1", pa.array(np.zeros(batch.num_rows, dtype=np.int64))).append_column("k2", pa.array(np.zeros(batch.num_rows, dtype=np.int64))))
            whole = [k[:, -1] if k.shape[1] else np.zeros(batch.num_rows, dtype=np.int64) for k in m.keys()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k) for k in whole)], names=["conv_id", "band", "length", "turns", "x1", "x2"])

    schema = T.StructType([*bands.schema, T.StructField("x1", T.LongType()), T.StructField("x2", T.LongType())])
    bands = written(bands.mapInArrow(keyed, schema), "bands")
    long = running(bands.filter(f"length > {BAND}"), "conv_id", ["band"], xors=["x1", "x2"])
    long = long.select("conv_id", "band", "length", "turns", *(F.col(f"run_{x}").bitwiseXOR(F.col(x)).alias(k) for x, k in (("x1", "k1"), ("x2", "k2"))))
    zero = F.lit(0).cast("long")
    return bands.filter(f"length <= {BAND}").select("conv_id", "band", "length", "turns", zero.alias("k1"), zero.alias("k2")).unionByName(long)


def _borders(sharded: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard how many turns its first and last rows share with their neighbours beyond; -1 for another band or key.

    Two rows per shard reach the driver, ``SHARD`` rows standing behind each.
    """
    place = F.struct("band", "k1", "k2", "ids", "more", "conv_id")
    ends = sorted(sharded.groupBy("shard").agg(F.min(place).alias("first"), F.max(place).alias("last")).collect(), key=lambda r: r.shard)
    shared = []
    for left, right in zip(ends, ends[1:]):
        a, b = left["last"], right["first"]
        n = -1
        if (a.band, a.k1, a.k2) == (b.band, b.k1, b.k2):
            n = next((i for i, (x, y) in enumerate(zip(a.ids, b.ids)) if x != y), min(len(a.ids), len(b.ids)))
        shared.append(n)
    return {r.shard: (b, a) for r, b, a in zip(ends, [-1, *shared], [*shared, -1])}


def _whole_ends(pieces: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): digests of lists of ids given in pieces; a list streams through one task, which holds a piece of it."""
    key = ["depth", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(node, digest):
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([digest.hexdigest()])], names=[*key, "ends"])

        node, digest = None, None
        for batch in batches:
            for *now, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != node:
                    if node is not None:
                        yield row(node, digest)
                    node, digest = now, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if node is not None:
            yield row(node, digest)

    rows = pieces.select(*key, "conv_id", "ends").repartition(*key).sortWithinPartitions(*key, "conv_id")
    return rows.mapInArrow(run, "depth long, k1 long, k2 long, ends string")


def _on_path(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_leaves, saved_tokens): what deeper bands add, for every node that a row of turns passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _Matrix(batch)
            keys, top = m.keys(), np.flatnonzero(m.band == 0)
            row, c = np.nonzero(np.arange(m.hi.shape[1]) < m.size[:, None])
            adds = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("n_leaves", "saved_tokens")]
            none = np.zeros(len(top), dtype=np.int64)
            columns = [np.append(m.band[row] * BAND + c + 1, none), *(np.append(k[row, c], none) for k in keys), *(np.append(x[row], x[top]) for x in adds)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["depth", "k1", "k2", "n_leaves", "saved_tokens"])

    return rows.mapInArrow(run, "depth long, k1 long, k2 long, n_leaves long, saved_tokens long")


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (from 1), hi, lo, n_words, ``convs`` each conv_id once and its length, which may be 0. The
    root has depth 0 and no parent; no conversations give no rows. ``shard`` bounds what a task holds.
    """
    bands = written(_bands(turns, convs), "keyed-bands")
    more = (F.col("length") > (F.col("band") + 1) * BAND).alias("more")
    ids = F.transform("turns", lambda t: F.struct(t["hi"], t["lo"])).alias("ids")
    placed = bands.select("*", more, ids).repartitionByRange(max(1, -(-bands.count() // shard)), "band", "k1", "k2", "ids", "more", "conv_id")
    sharded = written(placed.withColumn("shard", F.spark_partition_id()), "shards")
    borders = _borders(sharded)

    def nodes(rows: pa.Table) -> pa.Table:
        return pa.concat_tables(_shard_nodes(rows, *borders[rows.column("shard")[0].as_py()]))

    found = written(sharded.select("shard", "conv_id", "band", "length", "turns", "k1", "k2").groupBy("shard").applyInArrow(nodes, _PARTS), "nodes")
    key, sums = ["depth", "k1", "k2"], ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    # what the deeper bands of a conversation add to the nodes of each of its bands
    rows = found.filter("kind = 3").select("conv_id", F.col("depth").alias("band"), (-F.col("depth")).alias("back"), "n_leaves", "saved_tokens")
    deeper = running(rows, "conv_id", ["back"], sums=["n_leaves", "saved_tokens"]).select(
        "conv_id", "band", *((F.col(f"run_{c}") - F.col(c)).alias(c) for c in ("n_leaves", "saved_tokens")))
    path = _on_path(bands.filter(more).join(deeper, ["conv_id", "band"]))
    parts = found.filter("kind = 1").select(*key, "p1", "p2", "conv_id", *sums)
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    parts = parts.unionByName(path.select(*key, null.alias("p1"), null.alias("p2"), null.alias("conv_id"), zero.alias("n_convs"), zero.alias("n_children"), "n_leaves", "saved_tokens"))
    # a band's start has a part without members in the band below; there, its parent isn't known
    known = F.col("conv_id").isNotNull()
    joined = parts.groupBy(*key).agg(
        F.max(F.when(known, F.col("p1"))).alias("p1"), F.max(F.when(known, F.col("p2"))).alias("p2"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
    opened = written(joined.join(_whole_ends(found.filter("kind = 2")), key, "left"), "open-nodes")
    above = opened.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *sums, F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256")]
    closed = found.filter("kind = 0")
    near = closed.filter("parent_open").drop("parent_conv_id").unionByName(opened, allowMissingColumns=True)
    return near.join(above, ["depth", "p1", "p2"], "left").select(*out).unionByName(closed.filter("NOT parent_open").select(*out))
