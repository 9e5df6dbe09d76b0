"""Licence scans: runs of sentences against licence templates, by Dice coefficient over word bigrams.

Texts are normalised to lower-case words. A template of n bigrams can reach a
coefficient d only with a run of d / (2 - d) * n to (2 - d) / d * n bigrams that has at least
the former number in common with it; templates and runs outside these bounds are never compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

LIKENESS = 0.8
# Templates up to this many bigrams are also sought inside sentences.
SHORT = 64
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?;:]\s+|\n")
# Spellings that count as one.
_SAME = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def normalised(text: str) -> list[str]:
    """Words of a text in lower case, marks dropped."""
    words = _WORD.findall(text.lower())
    return [_SAME.get(w, w) for w in words] if "licence" in text.lower() else words


def dice(a: Counter, b: Counter) -> float:
    """Twice what two bags share, over what they hold."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Templates as bags of numbered bigrams, with what their sizes bound."""

    def __init__(self, texts: dict[str, str], likeness: float) -> None:
        self.likeness = likeness
        words = {name: normalised(text) for name, text in texts.items()}
        self.numbers = {w: i for i, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.base = len(self.numbers)
        self.bags = {name: Counter(self.codes([self.numbers[w] for w in ws]).tolist()) for name, ws in words.items() if len(ws) > 1}
        self.names = sorted(self.bags)
        self.sizes = {name: bag.total() for name, bag in self.bags.items()}
        self.least = {n: math.ceil(likeness / (2 - likeness) * size - 1e-9) for n, size in self.sizes.items()}
        self.most = {n: math.floor((2 - likeness) / likeness * size + 1e-9) for n, size in self.sizes.items()}
        self.all_codes = np.array(sorted({c for bag in self.bags.values() for c in bag}), dtype=np.int64)
        # distinct bigrams of a template that must occur: its repeated ones may make up for some
        self.distinct = {n: self.least[n] - (self.sizes[n] - len(self.bags[n])) for n in self.names}
        self.member = np.array([[c in self.bags[n] for c in self.all_codes.tolist()] for n in self.names], dtype=bool).reshape(len(self.names), -1)
        self.rows = dict(zip(self.names, self.member))

    def codes(self, numbers: list[int]) -> np.ndarray:
        """Bigrams of numbered words; -1 where a word is in no template."""
        ids = np.array(numbers, dtype=np.int64)
        if len(ids) < 2:
            return np.array([], dtype=np.int64)
        return np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.base + ids[1:], -1)

    def known(self, codes: np.ndarray) -> np.ndarray:
        """The place of each bigram among those of all templates, -1 for others."""
        at = np.minimum(np.searchsorted(self.all_codes, codes), len(self.all_codes) - 1)
        return np.where(self.all_codes[at] == codes, at, -1)

    def matches(self, text: str | None) -> Iterator[tuple[str, float, int, int]]:
        """(template, coefficient, first word, words) of the likest run of sentences for each template that reaches the likeness.

        Of equally like runs the first, then the shorter one.
        """
        read = self._read(text)
        if read:
            for name in read[-1]:
                if best := self._best(name, read, False, ()):
                    yield name, *best

    def likeliest(self, text: str | None) -> Iterator[tuple[str, float, int, int]]:
        """Like :meth:`matches`, with short templates sought inside sentences too, and one template where several fit.

        The likest run comes first, of equal ones the longest, then by name. It takes its words: another
        template is not found where more than half of its run is taken, but may be found elsewhere.
        """
        read = self._read(text)
        if not read:
            return
        taken: list[tuple[int, int]] = []
        open_ = {name: best for name in read[-1] if (best := self._best(name, read, True, ()))}
        while open_:
            name = min(open_, key=lambda n: (-open_[n][0], -open_[n][2], n))
            best = open_.pop(name)
            yield name, *best
            taken.append((best[1], best[1] + best[2]))
            for other, (_, first, n) in list(open_.items()):
                if _covered(first, first + n, taken):
                    if again := self._best(other, read, True, taken):
                        open_[other] = again
                    else:
                        del open_[other]

    def _read(self, text: str | None) -> tuple | None:
        """A text's bigrams, their places, its sentences' first words, and the templates that may occur."""
        if not text or not self.names:
            return None
        get = self.numbers.get
        codes = self.codes([get(w, -1) for w in normalised(text)])
        places = self.known(codes)
        present = np.unique(places[places >= 0])
        if not len(present):
            return None
        counts = self.member[:, present].sum(axis=1)
        likely = [n for n, c in zip(self.names, counts.tolist()) if c >= self.distinct[n]]
        if not likely:
            return None
        # words before each sentence; its own bigrams start there
        edges = [0]
        for sentence in _END.split(text):
            if n := len(normalised(sentence)):
                edges.append(edges[-1] + n)
        return codes, places, np.array(edges, dtype=np.int64), likely

    def _best(self, name: str, read: tuple, inside: bool, taken) -> tuple[float, int, int] | None:
        codes, places, starts, _ = read
        bag, row = self.bags[name], self.rows[name]
        hit = np.concatenate([[0], np.cumsum((places >= 0) & row[places])])
        size = self.sizes[name]
        firsts, lasts = [np.array([], np.int64)], [np.array([], np.int64)]
        # a run's bigrams are those from its first word to before its last
        lows = np.searchsorted(starts, starts[:-1] + 1 + self.least[name], side="left")
        highs = np.searchsorted(starts, starts[:-1] + 1 + self.most[name], side="right")
        for i, (low, high) in enumerate(zip(lows.tolist(), highs.tolist())):
            last = starts[max(low, i + 1):high] - 1
            last = last[hit[last] - hit[starts[i]] >= self.least[name]]
            firsts.append(np.full(len(last), starts[i]))
            lasts.append(last)
        if inside and size <= SHORT and len(codes) >= size:
            first = np.flatnonzero(hit[size:] - hit[:-size] >= self.likeness * size - 1e-9)
            firsts.append(first)
            lasts.append(first + size)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        # what a run holds of the template's bigrams, repeats included, bounds its coefficient
        bound = 2 * np.minimum(hit[last] - hit[first], size) / (size + last - first)
        best = None
        for at in np.argsort(-bound, kind="stable").tolist():
            if bound[at] < (best[0] if best else self.likeness) - 1e-9:
                break
            a, b = int(first[at]), int(last[at])
            if _covered(a, b + 1, taken):
                continue
            value = dice(bag, Counter(codes[a:b].tolist()))
            if value >= self.likeness and (best is None or (-value, a, b - a + 1) < (-best[0], *best[1:])):
                best = (value, a, b - a + 1)
        return best


def _covered(first: int, last: int, taken) -> bool:
    """Whether other runs take more than half of the words from first to last."""
    return 2 * sum(max(0, min(last, b) - max(first, a)) for a, b in taken) > last - first


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, likeness: float = LIKENESS, likeliest: bool = False) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words): for each document and template the likest run of sentences.

    A row for every pair that reaches ``likeness``; null, empty and other texts give none. Repeated rows
    give repeated results. With ``likeliest`` as in :meth:`Templates.likeliest`. Templates of one word are never found. No shuffle: rows stay where they are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, likeness)
        for batch in batches:
            rows = []
            for doc, text in zip(*batch.columns):
                rows.extend((doc.as_py(), *found) for found in (known.likeliest if likeliest else known.matches)(text.as_py()))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "license", "dice", "first_word", "n_words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, license string, dice double, first_word long, n_words long")
