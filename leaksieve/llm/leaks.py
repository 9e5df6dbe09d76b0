"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of a few words around a position, chosen by a mask that
ignores the words between. A substituted word under a gap does not change the seed. The two
masks are chosen so that any ``WINDOW`` words with up to ``SUBSTITUTIONS`` others
among them still share a seed at some place: a hit. Around each hit the words
are compared one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

WINDOW = 13
SUBSTITUTIONS = 2
# Word offsets that a seed takes in. Together they meet every choice of two places in a window.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
# Items of this many words and more, but fewer than WINDOW, may have one word substituted: then one of two runs of four words is whole.
SHORT, RUN = 8, (0, 1, 2, 3)
# Places in the filter on document seeds: what is broadcast has at most so many bits.
FILTER_BITS = 1 << 25
# Places in the filter on doc_ids that are read again.
DOC_PLACES = 1 << 18

# Fixed value: scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han). Each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")


class WordHashes:
    """64-bit hashes of the words of texts: lower case, letters and digits only."""

    def __init__(self, remembered: int = 400_000) -> None:
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        if not text:
            return np.array([], dtype=np.uint64)
        words, known = _WORD.findall(text.lower()), self.known
        if len(known) > self.remembered:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for k, h in enumerate(found):
                if h is None:
                    found[k] = known[words[k]] = xxhash.xxh64_intdigest(words[k].encode())
        return np.array(found, dtype=np.uint64)


def kinds(n: int) -> dict[int, tuple[int, ...]]:
    """The masks for an item of ``n`` words, by number: two spaced ones, a run of words, or all its words."""
    if n >= WINDOW:
        return dict(enumerate(MASKS, start=1))
    return {len(MASKS) + 1: RUN} if n >= SHORT else {EXACT + n: tuple(range(n))} if n else {}


# Masks of whole items are numbered from here.
EXACT = 100
ALL_KINDS = {number: mask for n in range(1, WINDOW + 1) for number, mask in kinds(n).items()}


def seeds(words: np.ndarray, masks: dict[int, tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask: its number, the positions where it fits, and the seeds there."""
    for number, mask in masks.items():
        n = len(words) - mask[-1]
        if n > 0:
            mixed = np.full(n, number, dtype=np.uint64)
            for offset in mask:
                mixed = (mixed ^ words[offset:offset + n]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            yield number, np.arange(n), mixed


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Start in the document, length and matches of what an item shares with it on one diagonal.

    The words from the first to the last window that qualifies. None if no window does.
    """
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    window, allowed = (WINDOW, SUBSTITUTIONS) if len(item) >= WINDOW else (len(item), int(len(item) >= SHORT))
    if high - low < window:
        return None
    same = doc[low:high] == item[low - diagonal:high - diagonal]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[window:] - sums[:-window] >= window - allowed)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + window
    matching = np.flatnonzero(same[first:last])
    first, last = first + int(matching[0]), first + int(matching[-1]) + 1
    return low + first, last - first, int(sums[last] - sums[first])


def _item_seeds(benchmark: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes(text)
                for number, at, found in seeds(words, kinds(len(words)) if len(words) >= least else {}):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(found.view(np.int64)), pa.array([item] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([number] * len(at), pa.int32()),
                    ], names=["seed", "item_id", "item_at", "kind"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "seed long, item_id long, item_at long, kind int")


def _filter(found: DataFrame) -> np.ndarray:
    """Bits at the places of all item seeds; fewer than FILTER_BITS / 64 rows reach the driver."""
    place = F.pmod("seed", F.lit(FILTER_BITS))
    words = found.select((place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[row.word] = row.bits
    return bits.view(np.uint64)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_same): benchmark items found in documents, the longest overlap of each.

    An item leaks into a document if ``WINDOW`` words in a row (words in lower case, without marks) agree but for at most
    ``SUBSTITUTIONS`` of them; items of ``SHORT`` words and more but for one, shorter items as they are. Characters of
    scripts without spaces are words. Items of under ``least`` words, null and empty texts give nothing; repeated rows and rows of one id
    count once; of overlaps of equal length the one with more words alike counts, then the first. The benchmark may have any size: its seeds are joined, not broadcast; only a filter of fixed size is.
    """
    spark = docs.sparkSession
    item_seeds = written(_item_seeds(benchmark, least).distinct(), "seeds")
    shared = spark.sparkContext.broadcast(_filter(item_seeds))
    masks = {r.kind: ALL_KINDS[r.kind] for r in item_seeds.select("kind").distinct().collect()}

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), shared.value
        for batch in batches:
            ids, texts = batch.columns
            for k in range(0, batch.num_rows, 256):
                out = [], [], []
                for doc, text in zip(ids.slice(k, 256).to_pylist(), texts.slice(k, 256).to_pylist()):
                    for _, at, found in seeds(hashes(text), masks):
                        place = (found % np.uint64(FILTER_BITS)).astype(np.int64)
                        for i in np.flatnonzero((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)):
                            for column, value in zip(out, (found[i].view(np.int64), doc, at[i])):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["seed", "doc_id", "doc_at"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = texts.mapInArrow(hit, "seed long, doc_id long, doc_at long")
    met = hits.join(item_seeds, "seed").select("doc_id", "item_id", "kind", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
    # whole items: one place will do
    exact = met.filter(F.col("kind") >= EXACT).groupBy("doc_id", "item_id").agg(F.min("diagonal").alias("diagonal"))
    met = written(met.filter(F.col("kind") < EXACT).select("doc_id", "item_id", "diagonal").distinct().unionByName(exact), "hits")
    # documents with hits are read again; a filter of fixed size keeps most others from being shuffled
    places = met.select(F.pmod("doc_id", F.lit(DOC_PLACES)).alias("place")).distinct()
    again = texts.join(F.broadcast(places), F.pmod("doc_id", F.lit(DOC_PLACES)) == F.col("place"), "left_semi")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    per_pair = met.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    compared = again.join(per_pair, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item", "diagonals")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, item, text, asked, diagonals in zip(*(c.to_pylist() for c in batch.columns)):
                left, right = hashes(text), hashes(asked)
                found = [o for d in diagonals if (o := overlap(left, right, d))]
                if found:
                    rows.append((doc, item, *max(found, key=lambda o: (o[1], o[2], -o[0]))))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first_word", "n_words", "n_same"])

    found = compared.mapInArrow(verify, "doc_id long, item_id long, first_word long, n_words long, n_same long")
    best = F.max(F.struct("n_words", "n_same", (-F.col("first_word")).alias("back"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("first_word"), "best.n_words", "best.n_same")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, least: int = SHORT) -> DataFrame:
    """The rows of ``docs`` into which no item of at least ``least`` words leaks; columns unchanged.

    Items of fewer words occur in clean texts, too. A row is known by doc_id and text: other texts under a repeated or null doc_id
    are rows of their own, equal rows go or stay together.
    """
    key = F.xxhash64(F.struct("doc_id", "text"))
    found = written(leaks(docs.select(key.alias("doc_id"), "text"), benchmark, least).select(F.col("doc_id").alias("__row")).distinct(), "leaked")
    return docs.join(found, key == F.col("__row"), "left_anti")
