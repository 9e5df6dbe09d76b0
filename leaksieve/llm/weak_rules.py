"""Quality rules as weak supervision: rules vote or abstain, and what they agree on tells how far each can be trusted.

No rule rejects a document alone and no labels are read. Expectation maximisation over the counts of all vote patterns
estimates the share of good documents and, per rule, how often its votes are right on good and on bad
ones; the posterior probability of being good replaces a chain of filters that all must pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

LEAST_WORDS = 50
# A window of words that a text holds twice or more counts as repeated.
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
# Counts that rules look at, besides those that are returned.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_commonest", "n_ascii_letters", "n_capitals", "n_other", "n_digits", "n_marks", "n_calls")
STATISTICS = COUNTS[:5]


@dataclass(frozen=True)
class Rule:
    """Votes good between ``low`` and ``high`` and bad outside ``worst``; between those, and where ``asks`` isn't so, it abstains.

    ``value`` and ``asks`` are SQL over COUNTS.
    """
    name: str
    value: str
    good: tuple[float, float]
    worst: tuple[float, float]
    asks: str = "n_words > 0"

    def vote(self) -> Column:
        value = F.expr(f"CASE WHEN {self.asks} THEN {self.value} END")
        return F.when(value.between(*self.good), 1).when((value <= self.worst[0]) | (value >= self.worst[1]), -1).otherwise(0).alias(self.name)


_MOST = 1e300
RULES = (
    Rule("symbols", "n_symbols / n_words", (0, 0.02), (-1, 0.1)),
    Rule("repeated_lines", "n_dup_lines / n_lines", (0, 0.1), (-1, 0.4), "n_lines >= 4"),
    Rule("repeated_words", "n_repeat_words / n_words", (0, 0.1), (-1, 0.35)),
    Rule("commonest_word", "n_commonest / n_words", (0, 0.12), (-1, 0.3), "n_words >= 20"),
    Rule("word_length", "word_chars / n_words", (3, 10), (2, 15), "n_words > 0 AND 2 * n_other < word_chars"),
    Rule("capitals", "n_capitals / n_ascii_letters", (0, 0.15), (-1, 0.5), "n_ascii_letters >= 20"),
    Rule("letters", "(n_ascii_letters + n_other) / word_chars", (0.85, 1), (0.65, 2)),
    Rule("sentence_marks", "n_marks / n_words", (1 / 60, 0.25), (0, 0.6), "n_words >= 20 AND 2 * n_other < word_chars"),
    Rule("calls", "n_calls / n_words", (0, 0.05), (-1, 0.3)),
    Rule("digits", "n_digits / word_chars", (0, 0.1), (-1, 0.3)),
)


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words within windows that occur twice or more, and the count of the commonest word."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    commonest = int(np.bincount(ids).max())
    if len(ids) <= WINDOW:
        return 0, commonest
    code = ids[:-WINDOW + 1]
    for k in range(1, WINDOW):
        # codes stay below n times the number of different words
        code = np.unique(code, return_inverse=True)[1] * len(known) + ids[k:len(ids) - WINDOW + 1 + k]
    _, place, n = np.unique(code, return_inverse=True, return_counts=True)
    twice = n[place] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(WINDOW):
        covered[k:k + len(twice)] |= twice
    return int(covered.sum()), commonest


def count(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; zeros for null."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return (0,) * len(COUNTS)
    of = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)

    def total(chars: bytes) -> int:
        return int(of[list(chars)].sum())

    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    repeated, commonest = _repeated(words)
    capitals = int(of[65:91].sum())
    # a code point beyond ASCII begins with a byte from C0
    others = int(of[0xC0:].sum())
    return (
        len(words), int(of[:128].sum()) + others - total(SPACES), total(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), commonest,
        capitals + int(of[97:123].sum()), capitals, others, int(of[48:58].sum()), total(b".!?"), total(b"!?"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row; repeated rows and null ids stay. Other columns than doc_id and text are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for k in range(0, batch.num_rows, 512):
                rows = np.array([count(t) for t in texts.slice(k, 512).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([ids.slice(k, 512), *(pa.array(c) for c in rows.T)], names=["doc_id", *COUNTS])

    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(run, T.StructType([chosen.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Model:
    """Share of good documents; per rule how likely a vote is for good, on good documents and on bad ones."""
    good: float
    on_good: np.ndarray
    on_bad: np.ndarray
    rounds: int

    def logit(self, votes: list[Column]) -> Column:
        """Log odds of being good. Abstentions add nothing."""
        up, down = np.log(self.on_good / self.on_bad), np.log((1 - self.on_good) / (1 - self.on_bad))
        total = F.lit(float(np.log(self.good / (1 - self.good))))
        for vote, u, d in zip(votes, up, down):
            total = total + F.when(vote == 1, float(u)).when(vote == -1, float(d)).otherwise(0.0)
        return total


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 500) -> Model:
    """Fit a model to vote patterns (rows of -1, 0, 1) and how often each occurs.

    Rules are taken to err independently. At the start a vote against is rare on good documents and not common on bad ones, as there are many
    kinds of those and a rule sees few of them: one such vote among many others leaves a document good, two do not. A rule that would turn out worse
    than chance counts as uninformative, so that good and bad can't change places; each rule has one imagined vote of either kind on
    either side. Without patterns the start is returned.
    """
    n_rules = patterns.shape[1] if patterns.ndim == 2 else len(RULES)
    good, on_good, on_bad = 0.7, np.full(n_rules, 0.98), np.full(n_rules, 0.8)
    if not len(n):
        return Model(good, on_good, on_bad, 0)
    ups, downs, n = (patterns == 1).astype(float), (patterns == -1).astype(float), n.astype(float)
    for done in range(1, rounds + 1):
        logit = np.log(good / (1 - good)) + ups @ np.log(on_good / on_bad) + downs @ np.log((1 - on_good) / (1 - on_bad))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        sides = []
        for weight in (n * posterior, n * (1 - posterior)):
            up, down = weight @ ups, weight @ downs
            sides.append((up + 1) / (up + down + 2))
        new_good, new_bad = sides
        both = (n @ ups + 1) / (n @ ups + n @ downs + 2)
        worse = new_good < new_bad
        new_good, new_bad = np.where(worse, both, new_good), np.where(worse, both, new_bad)
        share = float(np.clip((n @ posterior + 1) / (n.sum() + 2), 0.01, 0.99))
        moved = max(abs(share - good), float(np.abs(new_good - on_good).max()), float(np.abs(new_bad - on_bad).max()))
        good, on_good, on_bad = share, new_good, new_bad
        if moved < 1e-9:
            break
    return Model(good, on_good, on_bad, done)


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """A model of all rows; what reaches the driver is one row per vote pattern, at most 3 to the number of rules."""
    names = [rule.name for rule in rules]
    found = voted.groupBy(*names).agg(F.count("*").alias("__n")).orderBy(*names).collect()
    return expectation_maximisation(np.array([r[:-1] for r in found]).reshape(-1, len(names)), np.array([r[-1] for r in found]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, STATISTICS, base_failed, kept, good (posterior probability) and a column of votes per rule, for every row.

    Words are what ASCII white space separates. Null and empty texts have no words and fail the base rules, which come before
    the verdict: ``kept`` is false for rows that fail them, else whether ``good`` is at least 0.5. The model is fitted on all
    rows that pass them. Equal texts get equal results; an empty table gives no rows.
    """
    voted = written(counts(docs).select("doc_id", *STATISTICS, base_failed().alias("base_failed"), *(rule.vote() for rule in rules)), "votes")
    names = [rule.name for rule in rules]
    model = fit(voted.filter("NOT base_failed"), rules)
    good = 1 / (1 + F.exp(-model.logit([F.col(name) for name in names])))
    return voted.withColumn("good", good).select(
        "doc_id", *STATISTICS, "base_failed", (~F.col("base_failed") & (F.col("good") >= 0.5)).alias("kept"), "good", *names)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged. A row is known by doc_id and text."""
    keyed = docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")))
    kept = judge(keyed, rules).filter("kept").select(F.col("doc_id.id").alias("__id"), F.col("doc_id.th").alias("__th")).distinct()
    return docs.join(written(kept, "kept"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_semi")
