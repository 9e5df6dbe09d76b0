"""The trie of conversation prefixes, and running totals, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import prefix_trie, running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, shard string, n_words string"


def brute(rows):
    """Every node from the contract's words alone; ties follow role and digest."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, digest[:30], text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(int)
    for p in nodes:
        children[p[:-1]] += bool(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        words = sum(1 for w in _split(p[-1][1]) if w) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * words
    return sorted((
        min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))).encode()).hexdigest()) for p, m in nodes.items())


def _split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return text.split(" ")


def got(spark, rows, shard):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = prefix_trie.ordered_turns(table)
    found = prefix_trie.trie(*prefix_trie.with_shared_heads(turns), shard=shard)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in found.collect())


def conversations(seed, n):
    """Few turns to choose from, so that prefixes are shared; some conversations of many bands, and copies of those."""
    rng, rows = random.Random(seed), []
    said = [("user", "a b"), ("user", "c"), ("assistant", "d  e\tf"), (None, None), ("", ""), ("user", "é x")]
    shared = [rng.choice(said[:2]) for _ in range(150)]
    for c in range(-30, n):
        kind = rng.random()
        size = rng.choice([0, 1, 2, 3, 5]) if kind < 0.8 else rng.choice([31, 32, 33, 64, 65, 100, 150])
        turns = [rng.choice(said) for _ in range(size)] if kind < 0.8 else shared[:size]
        rows += [(c, t, role, text, "d", "k", "s", "w") for t, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shard", [5, 20_000])
def test_trie_equals_brute_force(spark, shard):
    rows = conversations(shard, 90)
    assert got(spark, rows, shard) == brute(rows)


def test_trie_on_odd_rows(spark):
    word = "w " * 50_000
    rows = [
        (None, 1, "user", "of no conversation"), (7, None, "user", "first"), (7, 0, "user", word), (7, 0, "user", word), (7, 0, None, None),
        (7, 3, "", ""), (27, 0, "user", "a"), (27, 0, "user", "b"), (27, 0, "system", "b"), (-7, 1, "user", "a"), (20, 1, "user", "x"), (0, 1, "user", "x"),
    ]
    rows = [(*r, "d", None, "s", None) for r in rows]
    assert got(spark, rows, 2) == brute(rows)
    assert got(spark, [], 10) == []


def test_a_conversation_copied_often_spreads_over_shards(spark):
    """Ends of one node in many pieces, and a root whose members are all alike."""
    rows = [(20 * c, t, "user", f"turn {t}", "", "", "", "") for c in range(400) for t in range(2)]
    assert got(spark, rows, 10) == brute(rows)


def test_running_totals_cross_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randrange(100)) for i in range(500)]
    table = spark.createDataFrame(rows, "k long, i long, v long").withColumn("x", F.col("v") * 7 + 1).repartition(5)
    found = {(r.k, r.i): (r.run_v, r.run_x) for r in running.running(table, "k", ["i"], sums=["v"], xors=["x"]).collect()}
    assert len(found) == len(rows)
    total, mixed = defaultdict(int), defaultdict(int)
    for k, i, v in sorted(rows):
        total[k] += v
        mixed[k] ^= v * 7 + 1
        assert found[k, i] == (total[k], mixed[k])
    assert running.running(table.filter("k > 9"), "k", ["i"], sums=["v"]).count() == 0
