"""Language identification by words first, and by ever shorter character n-grams for unseen words.

A known word adds its log frequency in each language. For an unseen word the
longest n for which any of its character n-grams is known decides: it adds the mean
log frequency of those. The language with the highest sum wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .held_out import held_out

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
# All ASCII characters but letters, as blanks.
_BLANKED = {i: " " for i in range(128) if not chr(i).isalpha()}


@dataclass(frozen=True)
class Size:
    """How large a model may grow, whatever the corpus: counts cover all rows, the commonest are kept."""

    words: int = 40_000
    grams: int = 60_000
    longest: int = 4


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, in order."""
    lowered = text.lower()
    return lowered.translate(_BLANKED).split() if lowered.isascii() else WORD.findall(lowered)


def _grams(word: str, longest: int) -> list[str]:
    marked = f"\x02{word}\x03"
    found = list(word)
    for n in range(2, longest + 1):
        found += [marked[k:k + n] for k in range(len(marked) - n + 1)]
    return found


def _counted(rows: DataFrame, column: str, weight: str | None, terms) -> DataFrame:
    """(lang, term, n) over all rows, summed within each task before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, term, n) for lang, counts in held.items() for term, n in counts.items()]
            held.clear()
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "term", "n"])

        for batch in batches:
            weights = batch.column(2).to_pylist() if weight else None
            for k, (lang, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                counts = held.setdefault(lang, Counter())
                if weights is None:
                    counts.update(terms(value))
                else:
                    get, weight_k = counts.get, weights[k]
                    for term in terms(value):
                        counts[term] = get(term, 0) + weight_k
                if not k % 64 and sum(map(len, held.values())) > 300_000:
                    yield flush()
        yield flush()

    picked = rows.select("lang", column, *([weight] if weight else []))
    return picked.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log frequencies by word and by n-gram, a column for each language in alphabetical order."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    longest: int


def _tops(counts: DataFrame, langs: list[str], n: int) -> tuple[dict[str, int], np.ndarray]:
    """The ``n`` terms with the highest share of any language, and their smoothed log shares."""
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.col("n") / max(1, totals.get(lang, 1))).otherwise(share)
    by_term = counts.groupBy("term").agg(F.max(share).alias("share"), *(
        F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)))
    rows = by_term.orderBy(F.desc("share"), "term").limit(n).collect()
    table = np.array([[r[f"n{i}"] for i in range(len(langs))] for r in rows], dtype=np.float64).reshape(len(rows), len(langs))
    sums = np.array([totals.get(lang, 0) for lang in langs], dtype=np.float64)
    return {r["term"]: i for i, r in enumerate(rows)}, np.log((table + 0.5) / (sums + 0.5 * (len(rows) + 1)))


def train(docs: DataFrame, size: Size = Size()) -> Model:
    """Count words and n-grams of all rows that have a text and a language and are not held out.

    The number of languages must be moderate (each is a column of the model). The
    driver receives the model only, which ``size`` bounds.
    """
    rows = docs.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), size.longest)
    words = written(_counted(rows, "text", None, words_of), "words")
    grams = written(_counted(words, "term", "n", lambda w: _grams(w, size.longest)), "grams")
    prior = np.log(np.array([per_lang[lang] for lang in langs]) / sum(per_lang.values()))
    return Model(langs, prior, *_tops(words, langs, size.words), *_tops(grams, langs, size.grams), size.longest)


class Scorer:
    """Adds up the log frequencies of texts; remembers the rows of words it has met."""

    def __init__(self, model: Model, remembered: int = 300_000) -> None:
        self.model, self.first = model, len(model.words) + 1
        self.rows = np.zeros((self.first + remembered, len(model.langs)), dtype=np.float32)
        self.rows[1:self.first] = model.word_logs
        self._reset()

    def _reset(self) -> None:
        self.known = {w: i + 1 for w, i in self.model.words.items()}
        self.used = self.first

    def _learn(self, words: list[str]) -> None:
        """Rows for unseen words; a word of which not even a letter is known gets the place 0, a row of zeros."""
        get, longest = self.model.grams.get, self.model.longest
        places, sizes, named = [], [], []
        for word in words:
            marked, found = f"\x02{word}\x03", []
            for n in range(min(longest, len(marked)), 0, -1):
                if found := [g for k in range(len(marked) - n + 1) if (g := get(marked[k:k + n])) is not None]:
                    break
            if found:
                places += found
                sizes.append(len(found))
                named.append(word)
            else:
                self.known[word] = 0
        if named:
            end = self.used + len(named)
            sums = np.add.reduceat(self.model.gram_logs[places], np.cumsum([0, *sizes[:-1]]), axis=0)
            self.rows[self.used:end] = sums / np.array(sizes)[:, None]
            self.known.update(zip(named, range(self.used, end)))
            self.used = end

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else Counter()
        if not self.model.langs or not any(any(c.isalpha() for c in w) for w in words):
            return UNDETERMINED, 0.0
        total, held = self.model.prior.copy(), list(words)
        counts = np.fromiter(words.values(), dtype=np.float64, count=len(held))
        for k in range(0, len(held), 50_000):
            part = held[k:k + 50_000]
            if self.used + len(part) > len(self.rows):
                self._reset()
            ids = list(map(self.known.get, part))
            if None in ids:
                self._learn([w for w, i in zip(part, ids) if i is None])
                ids = list(map(self.known.get, part))
            total += counts[k:k + 50_000] @ self.rows[ids]
        best = int(np.argmax(total))
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1, the posterior of that language).

    Only the text is read for it. A text that is null or has no letter is ``und``
    with score 0, as is every text if the model learned no language; of languages with equal sums the
    first in the alphabet wins. Columns of these names are replaced, others pass unchanged.
    """
    rest = docs.drop("lang_pred", "score")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = [scorer.predict(t) for t in part.column(part.schema.get_field_index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, schema)
