"""Phrase collocations against plain code, with few shared ids, and the tiles against numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from leaksieve.llm import collocations as col

SCHEMA = "lang string, text string, phrase string, n string, part string"


def brute(rows, most_words, least, best):
    ones, out = {}, []
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        counts = ones.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, most_words + 1):
                counts.update(zip(*(words[i:] for i in range(k))))
    for lang, f in ones.items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            if any(100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items() if len(q) > len(p)):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "City", "a", "b", "né", "日本", "x\xa0y", "w" * 70, *(f"r{i}" for i in range(40))]
    weights = [40, 10, 30, 10, 10, 8, 5, 5, 4, 4, 2, 3, *[1] * 40]

    def text():
        parts = []
        for _ in range(rng.choice([0, 1, 3, 40])):
            parts.append("new york City" if rng.random() < 0.2 else rng.choices(vocabulary, weights)[0])
            parts.append(rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b", " ! "]))
        return "".join(parts)

    return [(rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]


def got(spark, data, *asked):
    table = spark.createDataFrame([(lang, text, "p", None, "x") for lang, text in data], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in col.collocations(table, *asked).collect())


@pytest.mark.parametrize("asked", [(3, 10, 2000), (4, 3, 25), (2, 2, 5)])
def test_collocations_equal_brute_force(spark, asked):
    data = rows(asked[0], 400)
    want = brute(data, *asked)
    assert len(want) > 10 and got(spark, data, *asked) == want


@pytest.mark.parametrize("shared", [0, 4])
def test_words_and_phrases_beyond_the_shared_ids_count(spark, monkeypatch, shared):
    """The tables that tasks share are made on the driver, so that a lower number of ids acts there."""
    monkeypatch.setattr(col, "WORD_IDS", shared)
    monkeypatch.setattr(col, "PHRASE_IDS", shared)
    data = rows(9, 300)
    assert got(spark, data, 4, 5, 2000) == brute(data, 4, 5, 2000)


def test_odd_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), ("en", ""), ("en", " .,\n"), ("en", "a b")]) == []
    # one phrase everywhere, a very long text, repeated rows
    data = [("en", "a b c " * 50_000), *[("en", "x y. X Y")] * 30]
    assert got(spark, data, 3, 10, 2000) == brute(data, 3, 10, 2000)


def test_tiles_count_pairs(monkeypatch):
    monkeypatch.setattr(col, "BUFFER", 5_000)
    monkeypatch.setattr(col, "SIDE", 16)
    monkeypatch.setattr(col, "GRID", 4)
    monkeypatch.setattr(col, "DENSE", 3)
    rng, tiles, want = np.random.default_rng(0), col.Tiles(), Counter()
    for _ in range(30):
        a, b = (rng.geometric(0.05, 900).astype(np.int64) - 1 for _ in range(2))
        tiles.add(a, b)
        want.update(zip(a.tolist(), b.tolist()))
    assert tiles.dense
    found = Counter()
    for a, b, n in tiles.taken():
        for key, k in zip(zip(a.tolist(), b.tolist()), n.tolist()):
            assert key not in found
            found[key] = k
    assert found == want and not tiles.dense and not len(tiles.codes)


def test_scores_stay_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 10**12 + 7, 3 * 10**12 + 1, 2 * 10**12 + 11
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(col._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)
