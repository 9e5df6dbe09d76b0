"""BPE encoding and decoding with a byte-level vocabulary file.

The encoder never replays merges. An Aho-Corasick automaton over the vocabulary
gives the longest token at each position; a token may follow another only if the
merges would really leave that pair (the pair-compatibility table); where no
token fits, the encoder steps back and takes the next shorter prefix. Each
position is given up at most once, so the work is linear in the text. The
decoder slices one buffer of all token bytes by an offset table.

Texts are cut into words by the vocabulary's own pattern first, and merges never
cross words, so a task remembers the ids of words it has met.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a task remembers. Bounds memory only: others are encoded each time.
REMEMBERED_WORDS = 500_000
REMEMBERED_LENGTH = 40

# Fixed value: the byte-level pattern, with white space as the Unicode property.
WORDS = (
    r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def newer_letters() -> str:
    """Letters and digits that the ``regex`` package knows and Unicode 15.1, which the tokenizers library follows, doesn't.

    To the library they are neither, like marks.
    """
    import sys
    import unicodedata

    import regex

    unassigned = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return "".join(regex.findall(r"[\p{L}\p{N}\p{White_Space}]", unassigned))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (256 + i for i in range(256))
    return {b: chr(b) if b in kept else chr(next(spare)) for b in range(256)}


class Remembered(dict):
    """The latest results of a function of one string, the oldest half dropped at a time."""

    def __init__(self, function, size: int = REMEMBERED_WORDS) -> None:
        super().__init__()
        self.function, self.size, self.older = function, size // 2, {}

    def __missing__(self, key: str):
        value = self.older[key] if key in self.older else self.function(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Tables of one vocabulary file: automaton, splits, prefixes, offsets.

    Inside, a token is known by its rank (bytes first, then merges in order);
    ``packed`` holds the file's ids as bytes.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        alphabet = byte_alphabet()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        tokens = [alphabet[b] for b in range(256)] + [a + b for a, b in merges]
        self.rank = {t: r for r, t in reversed(list(enumerate(tokens)))}
        self.length = [len(t) for t in tokens]
        self.packed = [vocab[t].to_bytes(4, "little") for t in tokens]
        self.merged = {(self.rank[a], self.rank[b]): self.rank[a + b] for a, b in merges}
        self.left, self.right = list(range(256)), list(range(256))
        for a, b in merges:
            self.left.append(self.rank[a])
            self.right.append(self.rank[b])
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, rank)
        self.shorter = [next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1) for t in tokens]
        self.automaton.make_automaton()
        self.to_alphabet = {b: alphabet[b] for b in range(256)}
        self.words = regex.compile(WORDS)
        newer = newer_letters()
        self.newer = frozenset(newer)
        older = {r"\p{L}": rf"[\p{{L}}--[{newer}]]", r"\p{N}": rf"[\p{{N}}--[{newer}]]"}
        # class differences are slower, so that only texts with such letters are split this way
        self.words_of_newer = regex.compile(
            rf" ?{older[r'\p{L}']}+|'s|'t|'re|'ve|'m|'ll|'d| ?{older[r'\p{N}']}+| ?[^\p{{White_Space}}{older[r'\p{L}']}{older[r'\p{N}']}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+", regex.V1)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known_words = Remembered(self._word, 200_000)
        self.known_pieces = Remembered(self._piece)
        self._decoder(vocab, alphabet)

    def _decoder(self, vocab: dict[str, int], alphabet: dict[int, str]) -> None:
        byte_of = {c: b for b, c in alphabet.items()}
        pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def may_follow(self, first: int, second: int) -> bool:
        """Whether merging the text of both tokens leaves just these two.

        Undo both tokens step by step, the later merge first. They are compatible
        unless some pair at the seam merges before the seam's tokens were formed.
        """
        key = (first, second)
        if (answer := self.compatible.get(key)) is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            self.compatible[key] = answer = self._seam_holds(first, second)
        return answer

    def _seam_holds(self, first: int, second: int) -> bool:
        bound = len(self.length)
        while True:
            if self.merged.get((first, second), bound) < bound:
                return False
            if first > second or second < 256:
                if first < 256:
                    return True
                bound, first = first, self.right[first]
            else:
                bound, second = second + 1, self.left[second]

    def encode_word(self, word: str) -> list[int]:
        """Ranks of one word that is written in the byte alphabet."""
        if (whole := self.rank.get(word)) is not None:
            return [whole]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        size, longest = len(word), [0] * len(word)
        # matches come by rising end, so the last at a start is the longest
        for end, rank in self.automaton.iter(word):
            longest[end + 1 - length[rank]] = rank
        out: list[int] = []
        given_up = set()
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if end not in given_up:
                if not out:
                    fits = True
                elif (fits := compatible.get((out[-1], token))) is None:
                    fits = self.may_follow(out[-1], token)
                if fits:
                    out.append(token)
                    if end == size:
                        return out
                    at, token = end, longest[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                given_up.add(at)
                token = out.pop()
                at -= length[token]

    def _word(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[r] for r in self.encode_word(word.encode().decode("latin-1").translate(self.to_alphabet))])

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a blank and what follows up to the next, None if white space meets either end."""
        if len(piece) == 1 or piece[1].isspace() or piece[-1].isspace():
            return None
        return b"".join([self.known_words[w] for w in self.words.findall(piece)])

    def _has_newer(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.newer.isdisjoint(text)
        return False

    def _plain(self, text: str) -> bytes:
        if self._has_newer(text):
            return b"".join([self.known_words[w] for w in self.words_of_newer.findall(text)])
        # A blank between two other characters always starts a word, so that texts
        # of such blanks can be taken apart at them, which is faster than the pattern.
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            found = [self.known_pieces[p] for p in [" " + p for p in rest]]
            if None not in found:
                return b"".join([self.known_words[w] for w in self.words.findall(first)] + found)
        return b"".join([self.known_words[w] for w in self.words.findall(text)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return np.frombuffer(self._plain(text), dtype="<u4")
        pieces = self.specials.split(text)
        return np.frombuffer(b"".join(
            np.uint32(self.special[p]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(pieces)
        ), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: each one's slice of the token bytes, copied in pieces of bounded size."""
        out = []
        for k in range(0, len(ids), 1 << 16):
            part = ids[k:k + (1 << 16)].astype(np.int64)
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes())
        return b"".join(out).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Tables of a vocabulary file, built once per Python worker."""
    return Vocabulary(path)


def _mapped(df: DataFrame, added: T.StructField, column: str, compute) -> DataFrame:
    """``df`` with one more column that ``compute`` makes of another, batch by batch.

    An existing column of that name is replaced.
    """
    df = df.drop(added.name)
    schema = T.StructType([*df.schema.fields, added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows are handled in slices, so that results stay small beside the batch
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = compute(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, added.name])

    return df.mapInArrow(run, schema)


def lists_of(arrays: list, kind: pa.DataType) -> pa.Array:
    """Numpy arrays (or None) as one Arrow list column."""
    sizes = np.array([0 if a is None else len(a) for a in arrays], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    filled = [a for a in arrays if a is not None]
    values = np.concatenate(filled) if filled else np.array([], dtype=np.int32)
    mask = pa.array([a is None for a in arrays], pa.bool_()) if len(filled) < len(arrays) else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind), mask=mask)


def encode(df: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids (array of int) of each whole text.

    Same ids as the tokenizers library gives without special tokens added; the
    strings of special tokens in a text become their ids. A null or empty text
    has no ids: an empty array. All other columns pass unchanged; a column named
    ``out`` is replaced. No shuffle: rows stay where they are read.
    """

    def compute(texts: pa.Array) -> pa.Array:
        tables = vocabulary(path)
        return lists_of([tables.encode(t or "").astype(np.int32) for t in texts.to_pylist()], pa.int32())

    return _mapped(df, T.StructField(out, T.ArrayType(T.IntegerType(), False)), column, compute)


def decode(df: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of each array of ids. Null ids give an empty text."""

    def compute(ids: pa.Array) -> pa.Array:
        tables = vocabulary(path)
        return pa.array([tables.decode(row.values.to_numpy(zero_copy_only=False)) if row.is_valid else "" for row in ids], pa.string())

    return _mapped(df, T.StructField(out, T.StringType()), column, compute)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of :func:`encode`: count and digest of its ids, digest of what they decode to."""
    ids, decoded = F.col("ids"), F.col("decoded")
    return decode(encoded.select("doc_id", "ids"), path).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"),
    )
