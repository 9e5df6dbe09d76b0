"""Phrases whose words occur together far more often than apart.

Words get ids by falling frequency, so that common pairs of ids lie in few tiles of a square. A task counts the pairs of
a full tile by direct address (a dense bincount) and those of the others as sorted coordinates with counts; tasks' counts are summed
by a shuffle on the phrase. Frequent pairs are ranked again and take the place of words: the next pass counts pairs of them with a word, and so on.

What is broadcast has a fixed size: ids of the most frequent words and phrases, and a filter of bits for all frequent ones, as far as
there are more. Words and phrases beyond the ids get ids of their own in each task, so that none is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

# Ids that all tasks share, of words and of phrases of each length.
WORD_IDS, PHRASE_IDS = 1 << 17, 1 << 18
# Longer words, in bytes, get their ids in tasks.
LONGEST = 64
FILTER_BITS = 1 << 25
# Side of a tile, tiles along a side that may be dense, how many of them are at a time, and the share of cells that a buffer fills to make one so.
SIDE, GRID, DENSE, FULL = 512, 64, 16, 1 / 16
BUFFER, MOST_CELLS = 1 << 19, 1 << 20
# Parts of a language whose phrases are ranked apart first.
SALTS = 64
# Rows of counts handed on at a time.
ROWS = 1 << 16
# Entries that a task remembers for itself before it hands on what it has counted.
REMEMBERED = 200_000
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_COUNTS = "lang string, phrase string, n long"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[str | None]) -> list[bytes]:
    """Words of texts in lower case (A-Z), a newline between pieces, and empty strings, which mean nothing."""
    joined = "\n".join(t or "" for t in texts).encode().lower().translate(_BREAKS)
    return joined.replace(b"\n", b" \n ").split(b" ")


def _by_language(batch: pa.RecordBatch, docs: int = 512) -> Iterator[tuple[str, list[str | None]]]:
    for k in range(0, batch.num_rows, docs):
        texts: dict[str, list] = {}
        for lang, text in zip(*(c.slice(k, docs).to_pylist() for c in batch.columns)):
            texts.setdefault(lang, []).append(text)
        yield from texts.items()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words. A null lang is ``und``."""
    def rows(counted: dict[str, Counter]) -> pa.RecordBatch:
        flat = [(lang, word, n) for lang, words in counted.items() for word, n in words.items()]
        columns = list(zip(*flat)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, Counter] = {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                own = counted.setdefault(lang, Counter())
                own.update(tokens(texts))
                del own[b""], own[b"\n"]
                if sum(map(len, counted.values())) > REMEMBERED:
                    yield rows(counted)
                    counted = {}
        yield rows(counted)

    return _texts(docs).mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_hash(lang: str, word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(32))) * _FACTOR + second
    return (mixed ^ (mixed >> np.uint64(29))) * _FACTOR


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(39)).astype(np.int64) % FILTER_BITS


class Ids:
    """Ids of the phrases of one length: shared ones by falling frequency, own ones of a task behind them.

    ``first`` and ``second`` are the ids of what a phrase is made of: all but its last word, and that word (a word's own ``second`` is nothing).
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, hashes: np.ndarray, bits: np.ndarray | None) -> None:
        self.shared, self.first, self.second, self.hashes, self.bits = len(first), first, second, hashes, bits
        codes = (first << 32) | second
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.own: dict[int, int] = {}

    def forget(self) -> None:
        self.own = {}
        self.first, self.second, self.hashes = (x[:self.shared] for x in (self.first, self.second, self.hashes))

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        places = _places(hashes)
        return (self.bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) > 0

    def find(self, first: np.ndarray, second: np.ndarray, before: "Ids", words: "Words") -> np.ndarray:
        """Ids of phrases, -1 for those that aren't frequent."""
        found = np.full(len(first), -1, dtype=np.int64)
        at = np.flatnonzero((first >= 0) & (second >= 0))
        codes = (first[at] << 32) | second[at]
        place = np.searchsorted(self.codes, codes)
        place[place == len(self.codes)] = 0
        hit = self.codes[place] == codes if len(self.codes) else np.zeros(len(at), dtype=bool)
        found[at[hit]] = self.order[place[hit]]
        if self.bits is not None and not hit.all():
            at, codes = at[~hit], codes[~hit]
            hashes = _pair_hash(before.hashes[first[at]], words.hashes[second[at]])
            likely = self.maybe(hashes)
            at, codes, hashes = at[likely], codes[likely], hashes[likely]
            unique, where, back = np.unique(codes, return_index=True, return_inverse=True)
            new = [k for k, code in enumerate(unique.tolist()) if code not in self.own]
            for k in new:
                self.own[int(unique[k])] = self.shared + len(self.own)
            if new:
                where = where[new]
                self.first, self.second = np.append(self.first, first[at[where]]), np.append(self.second, second[at[where]])
                self.hashes = np.append(self.hashes, hashes[where])
            found[at] = np.array([self.own[code] for code in unique.tolist()], dtype=np.int64)[back]
        return found


class Words:
    """Ids of words, each with its language: -1 for words that aren't frequent, -2 for the end of a piece."""

    def __init__(self, langs: list[str], words: list[bytes], hashes: np.ndarray, bits: np.ndarray | None) -> None:
        self.shared, self.langs, self.words, self.hashes, self.bits = len(words), langs, words, hashes, bits
        self.base: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(langs, words)):
            self.base.setdefault(lang, {})[word] = k
        self.forget()

    def forget(self) -> None:
        del self.langs[self.shared:], self.words[self.shared:]
        self.hashes = self.hashes[:self.shared]
        self.own: list[int] = []
        self.known: dict[str, _Known] = {}
        self.remembered = 0

    def of(self, lang: str) -> "_Known":
        if lang not in self.known:
            self.known[lang] = _Known(self, lang)
        return self.known[lang]

    def find(self, lang: str, texts: list[str | None]) -> np.ndarray:
        split = tokens(texts)
        found = np.fromiter(map(self.of(lang).__getitem__, split), np.int64, len(split))
        if self.own:
            self.hashes = np.append(self.hashes, np.array(self.own, dtype=np.uint64))
            self.own = []
        return found[found != -3]


class _Known(dict):
    def __init__(self, words: Words, lang: str) -> None:
        super().__init__(words.base.get(lang, {}))
        self.update({b"": -3, b"\n": -2})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        words, found = self.words, -1
        if words.bits is not None:
            hashed = _word_hash(self.lang, word)
            place = (hashed >> 39) % FILTER_BITS
            if int(words.bits[place >> 6]) >> (place & 63) & 1:
                found = len(words.words)
                words.langs.append(self.lang)
                words.words.append(word)
                words.own.append(hashed)
        words.remembered += 1
        self[word] = found
        return found


class Tiles:
    """Counts of pairs of ids: dense tiles by direct address, the rest as sorted coordinates."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.dense: dict[int, np.ndarray] = {}
        self.codes, self.n = np.array([], dtype=np.int64), np.array([], dtype=np.int64)

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        self.waiting.append((first, second))
        self.size += len(first)
        if self.size >= BUFFER:
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        first, second = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        inside = (first < SIDE * GRID) & (second < SIDE * GRID)
        tile = np.where(inside, (first // SIDE) * GRID + second // SIDE, GRID * GRID)
        filled = np.bincount(tile, minlength=GRID * GRID + 1)[:-1]
        for t in np.argsort(-filled, kind="stable")[:DENSE]:
            if filled[t] >= FULL * SIDE * SIDE and len(self.dense) < DENSE:
                self.dense.setdefault(int(t), np.zeros(SIDE * SIDE, dtype=np.int64))
        sparse = np.ones(GRID * GRID + 1, dtype=bool)
        for t, cells in self.dense.items():
            sparse[t] = False
            if filled[t]:
                here = tile == t
                cells += np.bincount((first[here] % SIDE) * SIDE + second[here] % SIDE, minlength=SIDE * SIDE)
        rest = sparse[tile]
        codes, n = np.unique((first[rest] << 32) | second[rest], return_counts=True)
        codes, n = np.concatenate([self.codes, codes]), np.concatenate([self.n, n])
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.array([], dtype=np.int64)
        self.codes, self.n = codes[starts], np.add.reduceat(n, starts) if len(starts) else n

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All counts so far as (first, second, n); nothing is left."""
        self.fold()
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield (t // GRID) * SIDE + at // SIDE, (t % GRID) * SIDE + at % SIDE, cells[at]
        yield self.codes >> 32, self.codes & 0xFFFFFFFF, self.n
        self.__init__()


class Shared:
    """What all tasks get: the ids of words and of phrases of each length that is known so far."""

    def __init__(self) -> None:
        self.length = 0
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.word_hashes = np.array([], dtype=np.uint64)
        self.word_bits: np.ndarray | None = None
        self.levels: list[tuple] = []

    def add(self, counted: DataFrame) -> None:
        """Take in the frequent phrases of the next length. At most WORD_IDS or PHRASE_IDS rows reach the driver."""
        self.length += 1
        length = self.length
        most = WORD_IDS if length == 1 else PHRASE_IDS
        rows = counted.filter(F.octet_length("phrase") <= LONGEST * length).orderBy(F.desc("n"), "lang", "phrase").limit(most).select("lang", "phrase").toArrow()
        langs, phrases = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        if length == 1:
            self.langs, self.words = langs, [p.encode() for p in phrases]
            self.known = {(lang, p): k for k, (lang, p) in enumerate(zip(langs, phrases))}
            self.word_hashes = np.array([_word_hash(lang, word) for lang, word in zip(self.langs, self.words)], dtype=np.uint64)
            self.before, self.hashes = self.known, self.word_hashes
            if counted.count() > len(phrases):
                self.word_bits = _filter(counted)
            return
        first, second, kept = [], [], {}
        for lang, phrase in zip(langs, phrases):
            head, _, last = phrase.rpartition(" ")
            a, b = self.before.get((lang, head)), self.known.get((lang, last))
            if a is not None and b is not None:
                kept[lang, phrase] = len(first)
                first.append(a)
                second.append(b)
        ids = np.array(first, dtype=np.int64), np.array(second, dtype=np.int64)
        hashes = _pair_hash(self.hashes[ids[0]], self.word_hashes[ids[1]])
        self.levels.append((*ids, hashes, _filter(counted) if counted.count() > len(first) else None))
        self.before, self.hashes = kept, hashes

    def sent(self) -> tuple:
        return self.langs, self.words, self.word_hashes, self.word_bits, self.levels


def _filter(phrases: DataFrame) -> np.ndarray:
    """Bits at the places of phrases; FILTER_BITS / 64 rows reach the driver at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                first, *rest = (np.array([_word_hash(lang, w)], dtype=np.uint64) for w in phrase.encode().split(b" "))
                for word in rest:
                    first = _pair_hash(first, word)
                hashes.append(first)
            places = _places(np.concatenate(hashes)) if hashes else np.array([], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array((np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    found = phrases.select("lang", "phrase").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return bits.view(np.uint64)


class Task:
    """What one task counts: phrases one word longer than those it has ids for."""

    def __init__(self, langs: list[str], words: list[bytes], hashes: np.ndarray, bits: np.ndarray | None, levels: list[tuple]) -> None:
        self.words, self.phrases, self.tiles = Words(list(langs), list(words), hashes, bits), [Ids(*level) for level in levels], Tiles()

    def add(self, lang: str, texts: list[str | None]) -> None:
        ids = self.words.find(lang, texts)
        held, before = ids, self.words
        for reach, level in enumerate(self.phrases, start=1):
            held, before = level.find(held[:len(ids) - reach], ids[reach:], before, self.words), level
        reach = len(self.phrases) + 1
        if len(ids) > reach:
            first, following, last = held[:-1], held[1:], ids[reach:]
            both = (first >= 0) & (following >= 0) & (last >= 0)
            self.tiles.add(first[both], last[both])

    def full(self) -> bool:
        return len(self.tiles.codes) > MOST_CELLS or self.words.remembered + sum(len(level.own) for level in self.phrases) > REMEMBERED

    def counted(self) -> Iterator[pa.RecordBatch]:
        """All counts so far with their phrases; ids of the task's own are given up."""
        names, langs = pa.array(self.words.words, pa.binary()).cast(pa.string()), pa.array(self.words.langs, pa.string())

        def named(level: int, ids: np.ndarray) -> pa.Array:
            if level == 0:
                return names.take(pa.array(ids))
            own = self.phrases[level - 1]
            return pc.binary_join_element_wise(named(level - 1, own.first[ids]), names.take(pa.array(own.second[ids])), " ")

        for first, second, n in self.tiles.taken():
            for k in range(0, len(n), ROWS):
                a, b, of = (x[k:k + ROWS] for x in (first, second, n))
                phrase = pc.binary_join_element_wise(named(len(self.phrases), a), named(0, b), " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(b)), phrase, pa.array(of)], names=["lang", "phrase", "n"])
        for table in (self.words, *self.phrases):
            table.forget()


def count_phrases(docs: DataFrame, shared: Shared) -> DataFrame:
    """(lang, phrase, n) of the phrases one word longer than those that ``shared`` knows, as far as their parts are frequent."""
    sent = docs.sparkSession.sparkContext.broadcast(shared.sent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(*sent.value)
        for batch in batches:
            for lang, texts in _by_language(batch):
                task.add(lang, texts)
                if task.full():
                    yield from task.counted()
        yield from task.counted()

    return _texts(docs).mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits."""
    n = [c.cast("decimal(18,0)") for c in (a, left, right)]
    return F.call_function("div", n[0] * n[0] * F.lit(1_000_000).cast("decimal(7,0)"), n[1] * n[2])


def phrase_tables(docs: DataFrame, most_words: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and for each length (lang, phrase, n) of the phrases that occur at least ``least`` times."""
    counted = written(count_words(docs), "words")
    shared, tables = Shared(), [counted.filter(F.col("n") >= least)]
    for length in range(2, most_words + 1):
        shared.add(tables[-1])
        tables.append(written(count_phrases(docs, shared).filter(F.col("n") >= least), f"phrases-{length}"))
    return counted.groupBy("lang").agg(F.sum("n").alias("n")), tables


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of 2 to ``most_words`` words of each language.

    Texts are cut into pieces at line ends and ``.,;:!?``, pieces into words at spaces and tabs; A-Z count as a-z. ``n`` counts a
    language's words, ``a`` the phrase, ``l`` and ``r`` its parts at the cut of the lowest score, floor(1000000 a a / (l r)); of equal ones
    at the first. Phrases under ``least`` don't count, nor those inside a longer one that occurs at least half as often. Order: score, a (both
    falling), phrase. A null lang is ``und``, null and empty texts hold nothing, repeated rows count as often as they occur.
    """
    totals, tables = phrase_tables(docs, most_words, least)
    scored = []
    for length, table in enumerate(tables[1:], start=2):
        found = table.withColumnRenamed("n", "a")
        for cut in range(1, length):
            for side, part, of in (("l", F.substring_index("phrase", " ", cut), cut), ("r", F.substring_index("phrase", " ", cut - length), length - cut)):
                parts = tables[of - 1].select("lang", F.col("phrase").alias("part"), F.col("n").alias(f"{side}{cut}"))
                found = found.withColumn("part", part).join(parts, ["lang", "part"]).drop("part")
        cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length)]
        scored.append(found.select("lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")))
    # the commonest longer phrase around each phrase
    for length in range(2, most_words):
        around = None
        for longer in range(length + 1, most_words + 1):
            for skipped in range(longer - length + 1):
                inner = F.substring_index(F.substring_index("phrase", " ", skipped - longer), " ", length)
                inside = tables[longer - 1].select("lang", inner.alias("phrase"), F.col("n").alias("longer"))
                around = inside if around is None else around.unionByName(inside)
        most = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        rest = scored[length - 2].join(most, ["lang", "phrase"], "left")
        scored[length - 2] = rest.filter(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).drop("longer")
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    order = F.desc("score"), F.desc("a"), "phrase"
    every = every.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    # the best of each part of a language first, so that none is sorted in one task
    near = every.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
