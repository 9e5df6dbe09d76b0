"""Token ids in binary files: zstandard frames under one shared dictionary, with an offset index.

Layout below ``path``:

``dictionary/``  one row: the dictionary's bytes, their SHA-256, the width of an id
                 in bytes, the end id.
``segments/``    rows of about ``segment_bytes``: ``payload`` is the frames of
                 documents in ascending doc_id order, one frame each; ``doc_ids``,
                 ``offsets`` and ``counts`` are the index into it, and
                 ``dictionary_sha256`` names the dictionary that opens it.

Columns are stored apart, so the index is read without the payload. Short
documents compress well because the dictionary holds what they share; one can be
read alone through its offset.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that a Python worker remembers. Bounds memory only.
REMEMBERED_WORDS = 500_000
# New words that are given to the library at a time: a word of a long text takes it longer than one of a short text.
LEARNED_WORDS = 100

SEGMENT_SCHEMA = (
    "part int, first_doc long, last_doc long, part_start long, dictionary_sha256 string, "
    "doc_ids array<long>, offsets array<long>, counts array<long>, payload binary"
)


def _is_letters(word: str) -> bool:
    """Letters only, also when composed and in lower case, which may part a mark from a letter."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordwiseTokenizer:
    """Ids of whole texts, word by word, for tokenizers that drop white space.

    For these, blanks and line ends only separate, so that the ids of a text are
    those of its words in turn. Texts with the string of a special token, which
    the library finds before it looks for words, are given to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        if self.tokenizer.encode("a \n b", add_special_tokens=False).ids != self.tokenizer.encode("a b", add_special_tokens=False).ids:
            raise ValueError("this tokenizer keeps white space")
        self.lowers = self._ids("ABC ÀÉ") == self._ids("abc àé")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A digit is a word of its own, so its id marks where the words around it end.
        self.mark = self._ids("0")[0] if len(self._ids("0")) == 1 else None
        # Where tokens that end a word are told by a suffix, words of letters need no mark between them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        # Marks that are split from the letters before them.
        self.marks = tuple(m for m in ".,;:!?" if self._ids(f"ab{m}") == self._ids(f"ab {m}") and len(self._ids(m)) == 1)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def _words(self, text: str) -> list[str]:
        """Words between blanks; in lower case where that can't change ids, so that fewer differ.

        Latin-1 texts hold no marks that combine, and their letters have one lower case each.
        """
        if self.lowers:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def _learn(self, words: list[str]) -> None:
        """Encode new words in one call, apart from those that hold the mark."""
        letters = [w for w in words if _is_letters(w)]
        ids = np.array(self._ids(" ".join(letters)), dtype=f"<u{self.width}")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(letters):
            for word, start, end in zip(letters, [0, *ends[:-1].tolist()], ends.tolist()):
                self.known[word] = ids[start:end].tobytes()
        joined = [w for w in words if "0" not in w and w not in self.known] if self.mark is not None else []
        ids = np.array(self._ids(" 0 ".join(joined)), dtype=f"<u{self.width}")
        marks = np.flatnonzero(ids == self.mark) if joined else []
        if len(marks) == len(joined) - 1:
            ends = [*marks.tolist(), len(ids)]
            for word, start, end in zip(joined, [0, *(m + 1 for m in ends[:-1])], ends):
                self.known[word] = ids[start:end].tobytes()
        for word in words:
            if word not in self.known:
                self.known[word] = self._pack(self._ids(word))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null text counts as empty."""
        # words are looked up in lower case, where the string of a special token could come about anew
        whole = [any(s in t or s in t.lower() for s in self.special) if t else False for t in texts]
        words = [[] if w or not t else self._words(t) for t, w in zip(texts, whole)]
        if len(self.known) > REMEMBERED_WORDS // 2:
            self.known, self.older = {}, self.known
        missing = set(chain.from_iterable(words)).difference(self.known)
        again = [w for w in missing if w in self.older]
        self.known.update((w, self.older[w]) for w in again)
        missing = missing.difference(again, ("",))
        self.known[""] = b""
        # letters with a mark behind them are made of what the letters and the mark give
        marked = [w for w in missing if w.endswith(self.marks) and _is_letters(w[:-1])] if self.marks else []
        new = list(missing.difference(marked).union(w[:-1] for w in marked).union(self.marks).difference(self.known))
        for k in range(0, len(new), LEARNED_WORDS):
            self._learn(new[k:k + LEARNED_WORDS])
        known = self.known
        ids_of = known.__getitem__
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in marked)
        return [
            self._pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if w else b"".join(map(ids_of, ws))
            for t, w, ws in zip(texts, whole, words)
        ]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordwiseTokenizer:
    """One tokenizer per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordwiseTokenizer(path)


def _codec(dictionary: bytes, level: int | None = None):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if level is None:
        return zstandard.ZstdDecompressor(dict_data=data)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True)


def train_dictionary(docs: DataFrame, tokenizer_path: str, size: int = 64 << 10, documents: int = 1000, sample_bytes: int = 16 << 10) -> bytes:
    """A dictionary of at most ``size`` bytes from a bounded sample.

    The sample is the ``documents`` documents whose id hashes lowest, and of each the
    first ``sample_bytes`` of its packed ids; at most their product reaches the
    driver (16 MB as preset). The dictionary only makes frames smaller. Too little data
    gives an empty dictionary, and frames are then written without one.
    """
    import zstandard

    chosen = docs.select("doc_id", F.xxhash64("doc_id").alias("__h")).distinct().orderBy("__h", "doc_id").limit(documents)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for k in range(0, batch.num_rows, 64):
                packed = tokenizer(tokenizer_path).encode(texts.slice(k, 64).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([p[:sample_bytes] for p in packed], pa.binary())], names=["ids"])

    rows = docs.join(F.broadcast(chosen), docs["doc_id"].eqNullSafe(chosen["doc_id"])).select("text").mapInArrow(pack, "ids binary")
    samples = sorted(bytes(r.ids) for r in rows.orderBy("ids").limit(documents).collect() if r.ids)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the documents into at most ``parts`` runs of about equal length."""
    found = docs.select("doc_id").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    return np.unique(np.array(found, dtype=np.int64))


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, level: int = 3, segment_bytes: int = 1 << 20, dictionary: bytes | None = None,
) -> None:
    """Write the ids of every whole text, with ``end_id`` appended, in ascending doc_id order.

    Reads the columns doc_id and text only. A null or empty text is its end id
    alone. Rows with a null doc_id come first; rows with equal doc_ids are all kept, in
    the order of their frames. An empty table gives a dictionary and no segments.
    Texts are encoded where they are read; what is shuffled is compressed frames.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer_path)
    digest = hashlib.sha256(dictionary).hexdigest()
    parts = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    bounds = _bounds(docs, parts)
    width = tokenizer(tokenizer_path).width
    end = int(end_id).to_bytes(width, "little")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _codec(dictionary, level)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                ids, texts = (c.slice(k, 256) for c in batch.columns)
                packed = [p + end for p in tokenizer(tokenizer_path).encode(texts.to_pylist())]
                part = [0 if i is None else int(np.searchsorted(bounds, i, side="left")) for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part, pa.int32()), ids, pa.array([len(p) // width for p in packed], pa.int64()),
                    pa.array([compressor.compress(p) for p in packed], pa.binary()),
                ], names=["part", "doc_id", "n", "frame"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            nonlocal start, held, size
            sizes = [len(f) for _, _, f in held]
            numbered = [i for i, _, _ in held if i is not None]
            values = {
                "part": part, "first_doc": min(numbered, default=None), "last_doc": max(numbered, default=None), "part_start": start,
                "dictionary_sha256": digest, "doc_ids": [i for i, _, _ in held], "offsets": [0, *np.cumsum(sizes).tolist()],
                "counts": [n for _, n, _ in held], "payload": b"".join(f for _, _, f in held),
            }
            start, held, size = start + sum(values["counts"]), [], 0
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values.values(), kinds)], names=list(values))

        for batch in batches:
            for p, i, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size + len(frame) > segment_bytes):
                    yield row()
                if p != part:
                    part, start = p, 0
                held.append((i, n, frame))
                size += len(frame)
        if held:
            yield row()

    made = docs.mapInArrow(frames, "part int, doc_id long, n long, frame binary")
    placed = made.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n", "frame")
    placed.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(dictionary), digest, width, int(end_id))], "dictionary binary, sha256 string, width int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")


def read(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """The stored documents: doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian).

    ``start`` counts the ids of all documents before, in the order of the files.
    With ``doc_id`` only segments whose bounds hold it are read, and of these
    only its own frames are opened. A dictionary that is not the one that a segment was written
    with is an error.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, digest, width = bytes(head.dictionary), head.sha256, head.width
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    # one row for each part, of which there are as many as write() had partitions
    sums = segments.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base, total = {}, 0
    for row in sorted(sums.collect()):
        base[row.part], total = total, total + row.n
    wanted = segments if doc_id is None else segments.filter(F.lit(doc_id).between(F.col("first_doc"), F.col("last_doc")))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = _codec(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError("segment was written with another dictionary")
                at, start, payload = row["offsets"], base[row["part"]] + row["part_start"], memoryview(row["payload"])
                out: list[list] = [[], [], [], []]
                for k, (i, n) in enumerate(zip(row["doc_ids"], row["counts"])):
                    if doc_id is None or i == doc_id:
                        ids = np.frombuffer(decompressor.decompress(payload[at[k]:at[k + 1]]), dtype=f"<u{width}")
                        if len(ids) != n:
                            raise ValueError("a frame holds another number of ids than its index says")
                        for column, value in zip(out, (i, start, n, ids.astype("<u4").tobytes())):
                            column.append(value)
                    start += n
                columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return wanted.mapInArrow(opened, "doc_id long, start long, n_tokens long, ids binary")
