"""Weak supervision by rules: counts against plain code, the model against planted votes, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import weak_rules

ODD = ["", None, " \t\r\n", "\n\n", "a", "a b c a b c", "word " * 30_000, "né à Zürich\t日本 😀 " * 40, "x" * 5000, "\x1c\x85 ​\xa0", "Same line.\nSame line.\n \n\nSame line."]


def table(spark, texts, ids=None, /, **more):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, *(v for v in more.values())) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more)).repartition(3)


def plain(text):
    """The contract's counts, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside), failed


def random_text(rng):
    words = [rng.choice(["a", "b", "cé", "#x", "日本", "<b>", "d\x0bd", "e\xa0e"]) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0c"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 10, 60, 300]))]
    return "".join(words) + rng.choice(["", "\n", " "])


def test_counts_equal_plain_code(spark):
    rng = random.Random(1)
    texts = [*ODD, *(random_text(rng) for _ in range(200)), " ".join(str(i) for i in range(200_000))]
    got = {r.doc_id: r for r in weak_rules.judge(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text)
        assert not (r.base_failed and r.kept)


def test_the_model_finds_how_often_rules_err():
    """Votes drawn from known accuracies, with abstentions, are told apart; the estimates come close."""
    rng = np.random.default_rng(5)
    n, good = 40_000, 0.8
    on_good, on_bad, votes = np.array([0.97, 0.9, 0.95, 0.85, 0.6]), np.array([0.2, 0.3, 0.1, 0.4, 0.6]), np.array([1.0, 0.7, 0.9, 1.0, 0.5])
    truth = rng.random(n) < good
    says = np.where(rng.random((n, 5)) < np.where(truth[:, None], on_good, on_bad), 1, -1) * (rng.random((n, 5)) < votes)
    patterns, counts = np.unique(says, axis=0, return_counts=True)
    model = weak_rules.expectation_maximisation(patterns, counts)
    assert abs(model.good - good) < 0.02
    assert np.abs(model.on_good - on_good).max() < 0.03 and np.abs(model.on_bad - on_bad).max() < 0.05
    logit = np.log(model.good / (1 - model.good)) + (says == 1) @ np.log(model.on_good / model.on_bad) + (says == -1) @ np.log((1 - model.on_good) / (1 - model.on_bad))
    majority = ((says.sum(axis=1) > 0) == truth).mean()
    assert ((logit > 0) == truth).mean() > max(0.93, majority)


def test_one_pattern_or_none():
    everything_fine = weak_rules.expectation_maximisation(np.ones((1, 10)), np.array([1000]))
    assert everything_fine.good > 0.9 and (everything_fine.on_good >= everything_fine.on_bad).all()
    assert weak_rules.expectation_maximisation(np.zeros((0, 10)), np.array([])).rounds == 0


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "kalo temi suro vena pidu".split() for b in ["", "n", "s", "ta", "ri"]]

    def prose():
        return " ".join(rng.choice(vocabulary) + (". " if rng.random() < 0.1 else "") for _ in range(rng.randrange(80, 300)))

    clean = [prose() for _ in range(300)]
    junk = [" ".join(w + rng.choice("#$%&*") * 3 for w in prose().split()) for _ in range(15)] + [" ".join(w + "!!" for w in prose().upper().split()) for _ in range(15)]
    got = {r.doc_id: r for r in weak_rules.judge(table(spark, clean + junk)).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 330))
    kept = weak_rules.keep_good(table(spark, clean + junk, [None] * 330, kept="k", good="g", n_words="n"))
    assert kept.columns == ["doc_id", "text", "kept", "good", "n_words"]
    assert sorted(r.text for r in kept.collect()) == sorted(clean)


def test_odd_tables(spark):
    clashing = table(spark, [*ODD, "Same text."], [None, None, *range(10)], n_words="w", kept="k", symbols="s", text_2="t")
    got = weak_rules.judge(clashing)
    assert got.count() == 12 and got.filter("kept").count() == 0 and got.filter("doc_id IS NULL").count() == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert weak_rules.judge(empty).count() == 0 and weak_rules.keep_good(empty).count() == 0
    twice = weak_rules.judge(table(spark, ["w " * 60] * 3, [1, 1, 2]))
    assert twice.count() == 3 and twice.select("base_failed", "kept", F.round("good", 9)).distinct().count() == 1
