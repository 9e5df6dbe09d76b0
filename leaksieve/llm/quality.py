"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector x: its words, hashed into ``buckets``, and its standardised
statistics. The score is the logistic of

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where the pairs are not visited: their sum is half of (square of sums - sum of
squares) for each factor, which takes time linear in the entries of x.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .held_out import held_out, lowest_hashes

STATISTICS = (
    "log_words", "word_length", "distinct_words", "commonest_word", "distinct_lines", "line_length", "upper", "digits",
    "symbols", "exclamation", "blanks", "beyond_ascii", "bytes_per_char",
)
_KIND = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((range(65, 91), range(48, 58), b"\"#$%&()*+/:;<=>?@[\\]^_`{|}~", b"!", b" \t\r\n", range(128, 256)), start=1):
    _KIND[list(_chars)] = _i


@dataclass(frozen=True)
class Settings:
    """What fixes a model. ``sample`` bounds the labelled rows that it is fitted on."""

    buckets: int = 1 << 14
    factors: int = 8
    sample: int = 6000
    epochs: int = 8
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 7


def statistics(text: str, words: Counter, n_words: int) -> list[float]:
    """Figures about the shape of a whole text; zeros where it has none. Its length is the metadata."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    size = max(1, len(data))
    kinds = np.zeros(7)
    for k in range(0, len(data), 1 << 20):
        kinds += np.bincount(_KIND[data[k:k + (1 << 20)]], minlength=7)
    lines = text.split("\n")
    n = max(1, n_words)
    return [
        np.log1p(n_words), (size - kinds[5]) / n, len(words) / n, max(words.values(), default=0) / n,
        len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), *(kinds[1:7] / size), len(data) / max(1, len(text)),
    ]


def features(text: str | None, buckets: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets and weights of the words, log counts of unit length, and the statistics."""
    text = text or ""
    split = text.split()
    counts = Counter(split)
    ids = np.empty(len(counts), dtype=np.int32)
    if len(known) > 300_000:
        known.clear()
    for k, word in enumerate(counts):
        if (at := known.get(word)) is None:
            at = zlib.crc32(word.lower().encode()) % buckets
            known[word] = at
        ids[k] = at
    weights = np.log1p(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
    if len(weights):
        weights /= np.sqrt((weights * weights).sum())
    return ids, weights, statistics(text, counts, len(split))


class Machine:
    """Weights of a fitted factorisation machine."""

    def __init__(self, settings: Settings) -> None:
        size = settings.buckets + len(STATISTICS)
        rng = np.random.default_rng(settings.seed)
        self.bias, self.w = np.float32(0), np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.01, (size, settings.factors)).astype(np.float32)
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
        self.buckets = settings.buckets

    def rows(self, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of all rows, one after another, and where each row starts."""
        stats = np.clip((np.array([f[2] for f in found]) - self.mean) / self.scale, -4, 4).astype(np.float32)
        own = np.arange(self.buckets, self.buckets + len(STATISTICS), dtype=np.int32)
        ids = np.concatenate([x for f in found for x in (own, f[0])])
        values = np.concatenate([x for s, f in zip(stats, found) for x in (s, f[1])])
        return ids, values, np.cumsum([0] + [len(own) + len(f[0]) for f in found])[:-1]

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each row before the logistic, and its sums by factor."""
        scaled = self.v[ids] * values[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat(scaled * scaled, starts, axis=0)
        linear = np.add.reduceat(self.w[ids] * values, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, found: list[tuple]) -> np.ndarray:
        margin, _ = self.margins(*self.rows(found))
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))


def fit(found: list[tuple], labels: np.ndarray, settings: Settings) -> Machine:
    """Logistic loss by AdaGrad over small batches. No rows leave the model at 0.5 for every text."""
    machine = Machine(settings)
    if not len(found):
        machine.v[:] = 0
        return machine
    stats = np.array([f[2] for f in found])
    machine.mean, machine.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    rng = np.random.default_rng(settings.seed)
    grad_w, grad_v, grad_b = np.full_like(machine.w, 1e-6), np.full_like(machine.v, 1e-6), 1e-6
    for _ in range(settings.epochs):
        order = rng.permutation(len(found))
        for k in range(0, len(order), 32):
            chosen = order[k:k + 32]
            ids, values, starts = machine.rows([found[i] for i in chosen])
            margin, sums = machine.margins(ids, values, starts)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]).astype(np.float32)
            sizes = np.diff(np.append(starts, len(ids)))
            per_entry = np.repeat(error, sizes)[:, None]
            slope_v = per_entry * values[:, None] * (np.repeat(sums, sizes, axis=0) - machine.v[ids] * values[:, None])
            touched, place = np.unique(ids, return_inverse=True)
            step_w = np.bincount(place, weights=per_entry[:, 0] * values, minlength=len(touched)) + settings.decay * machine.w[touched]
            step_v = np.stack([np.bincount(place, weights=slope_v[:, f], minlength=len(touched)) for f in range(slope_v.shape[1])], axis=1)
            step_v += settings.decay * machine.v[touched]
            grad_b += float(error.sum()) ** 2
            grad_w[touched] += step_w ** 2
            grad_v[touched] += step_v ** 2
            machine.bias -= np.float32(settings.rate * error.sum() / np.sqrt(grad_b))
            machine.w[touched] -= (settings.rate * step_w / np.sqrt(grad_w[touched])).astype(np.float32)
            machine.v[touched] -= (settings.rate * step_v / np.sqrt(grad_v[touched])).astype(np.float32)
    return machine


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> Machine:
    """Fit on at most ``settings.sample`` labelled rows that are not held out.

    Takes the labelled doc_ids whose hash is lowest; rows with a null label or id are
    passed over, of several labels for one id the lowest counts. The features of these rows are
    gathered in one task and only the model (2 MB) reaches the driver.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    # labelled ids without a document don't use up the sample
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = lowest_hashes(present, settings.sample, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [features(t, settings.buckets, seen) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)] + [
                    pa.array([f[i] for f in found], t) for i, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64())))
                ], names=["doc_id", "y", "ids", "weights", "stats"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        held = []
        for batch in batches:
            ids, y, *parts = (batch.column(i) for i in range(5))
            for k in range(batch.num_rows):
                a, b, c = (p[k].values.to_numpy(zero_copy_only=False) for p in parts)
                held.append((ids[k].as_py(), float(c.sum()), y[k].as_py(), (a, b, c.tolist())))
        held.sort(key=lambda r: r[:3])
        machine = fit([h[3] for h in held], np.array([h[2] for h in held], dtype=np.float32), settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], names=["model"])

    import pickle

    schema = "doc_id long, y int, ids array<int>, weights array<float>, stats array<double>"
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(extract, schema)
    model = found.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(model[0].model)) if model else Machine(settings)


def score(docs: DataFrame, machine: Machine, column: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, a double from 0 to 1, higher where label 1 is likelier.

    Only the text is read for it. Null texts count as empty, and empty ones get a score as
    any other. A column named ``out`` is replaced, all others pass unchanged.
    """
    rest = docs.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = part.column(part.schema.get_field_index(column)).to_pylist()
                made = pa.array(model.score([features(t, model.buckets, seen) for t in texts]), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return rest.mapInArrow(run, schema)
