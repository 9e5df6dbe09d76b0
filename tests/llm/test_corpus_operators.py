"""The ten corpus operators against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leaksieve.llm import bpe, components, language, leaks, licenses, lines, quality, simhash, sketch, suffixes, token_files
from leaksieve.session import scratch_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n\n", "a", "word " * 3000, "né à Zürich\t日本 😀", "<|endoftext|> x <|startoftext|>", "Same text.", "Same text.", "x" * 5000, "\x1c\x85 ​"]


def table(spark, texts, ids=None, /, **more):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, *(v[k] for v in more.values())) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more)).repartition(3)


def words(rng, n, vocabulary=("alpha", "beta", "gamma", "delta", "of", "the", "zeta", "eta.", "Theta,", "é")):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    """Odd rows with columns whose names the operators use themselves."""
    return table(spark, ODD, [0, 1, 2, 3, None, None, 4, 5, 6, 6, 7, 8], score=["s"] * 12, ids=["i"] * 12, key=["k"] * 12, lang=["en", None] * 6, n=["1"] * 12)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# --- 1 token files ---

def test_token_files_hold_what_the_tokenizer_gives(spark):
    texts = [*ODD, *(words(random.Random(i), i) for i in range(60))]
    path = scratch_path(spark, "files")
    token_files.write(table(spark, texts, list(range(100, 100 + len(texts)))), path, WORDS, end_id=2, segment_bytes=200)
    known = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in token_files.read(spark, path).collect()}
    start = 0
    for i, text in enumerate(texts, start=100):
        want = [*known.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == want
        assert (got[i].start, got[i].n_tokens) == (start, len(want))
        start += len(want)
    one = token_files.read(spark, path, doc_id=107).collect()
    assert len(one) == 1 and bytes(one[0].ids) == bytes(got[107].ids) and one[0].start == got[107].start


def test_words_are_taken_apart_as_the_library_does():
    """Special strings in any case, marks behind letters, letters that no mark stands between."""
    own, known, rng = token_files.WordwiseTokenizer(WORDS), Tokenizer.from_file(WORDS), random.Random(9)
    pieces = ["a", "word", "Über", "ΣΑΣ", "σας", "İ", "ǅ", "日本", "né", "e\u0301", "\u0301", "0", "7x", "'s", "don't", ".", ",", "...", "!?", ";", " ", " ", "\n", "  ",
              "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "\u0345", "ª", "𝒜", "ᾳ.", "ſ,", "क़"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["<|ENDOFTEXT|>", "É <|ENDOFTEXT|> 日"]
    for k in range(0, len(texts), 100):
        for text, packed in zip(texts[k:k + 100], own.encode(texts[k:k + 100])):
            assert np.frombuffer(packed, f"<u{own.width}").tolist() == known.encode(text, add_special_tokens=False).ids, text


def test_token_files_keep_odd_rows(spark, clashing, empty):
    path = scratch_path(spark, "files")
    token_files.write(clashing, path, WORDS, end_id=2)
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 0, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert rows[2].n_tokens == rows[3].n_tokens == 1
    path = scratch_path(spark, "files")
    token_files.write(empty, path, WORDS, end_id=2)
    assert token_files.read(spark, path).count() == 0


def test_token_files_refuse_another_dictionary(spark):
    path = scratch_path(spark, "files")
    token_files.write(table(spark, [words(random.Random(1), 40)] * 30), path, WORDS, end_id=2)
    head = spark.read.parquet(f"{path}/dictionary").withColumn("sha256", F.lit("other"))
    rows = head.collect()
    spark.createDataFrame(rows, head.schema).write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read(spark, path).collect()


# --- 2 BPE ---

def test_bpe_equals_the_library():
    own, known, rng = bpe.Vocabulary(BYTES), Tokenizer.from_file(BYTES), random.Random(5)
    pieces = ["a", "b", "th", "ing", " ", "  ", "\n", "'s", "'", "é", "ß", "12", "!", "<|endoftext|>", "日", "\x1c", "\x85", "​", "😀", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        ids = known.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, dtype="<u4")) == text


def test_bpe_of_every_code_point():
    """Letters and digits newer than the library's tables, too."""
    own, known = bpe.Vocabulary(BYTES), Tokenizer.from_file(BYTES)
    points = [c for c in map(chr, range(0x20, 0x32400)) if not 0xD800 <= ord(c) <= 0xDFFF]
    for k in range(0, len(points), 64):
        text = "".join(f"a{c} {c}1{c}" for c in points[k:k + 64])
        if own.encode(text).tolist() != known.encode(text, add_special_tokens=False).ids:
            for c in points[k:k + 64]:
                assert own.encode(f"a{c} {c}1{c}").tolist() == known.encode(f"a{c} {c}1{c}", add_special_tokens=False).ids, hex(ord(c))


def test_bpe_on_odd_rows(clashing, empty):
    known = Tokenizer.from_file(BYTES)
    rows = bpe.decode(bpe.encode(clashing, BYTES), BYTES).collect()
    assert len(rows) == len(ODD) and rows[0].score == "s"
    for r in rows:
        assert r.ids == known.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(empty, BYTES).count() == 0
    digest = {r.doc_id: r for r in bpe.digests(bpe.encode(clashing, BYTES), BYTES).collect()}
    assert digest[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and digest[0].n_tokens == 0


# --- 3 licences ---

def licenses_by_hand(text, templates, likeness):
    def bag(ws):
        return Counter(zip(ws, ws[1:]))

    parts = [ws for s in re.split(r"[.!?;:]\s+|\n", text or "") if (ws := licenses.normalised(s))]
    for name, template in templates.items():
        want, best = bag(licenses.normalised(template)), None
        for i, j in itertools.combinations(range(len(parts) + 1), 2):
            run = [w for ws in parts[i:j] for w in ws]
            got = bag(run)
            value = 2 * (want & got).total() / max(1, want.total() + got.total())
            if value >= likeness and (best is None or value > best[0]):
                best = (value, sum(map(len, parts[:i])), len(run))
        if best:
            yield name, *best


def test_licences_equal_brute_force(spark, clashing, empty):
    rng, templates = random.Random(2), licenses.TEMPLATES
    texts = []
    for _ in range(40):
        own = licenses.normalised(rng.choice(list(templates.values())))
        for _ in range(rng.randint(0, len(own) // 8)):
            own[rng.randrange(len(own))] = "other"
        cut = sorted(rng.randrange(len(own)) for _ in range(3))
        texts.append(f"{words(rng, 8)}.\n" + ". ".join(" ".join(own[a:b]) for a, b in zip([0, *cut], [*cut, len(own)])) + f"\n{words(rng, 5)}")
    got = {(r.doc_id, r.license): (round(r.dice, 9), r.first_word, r.n_words) for r in licenses.scan(table(spark, texts)).collect()}
    want = {(i, n): (round(v, 9), a, b) for i, t in enumerate(texts) for n, v, a, b in licenses_by_hand(t, templates, licenses.LIKENESS)}
    assert got == want and len(want) > 20
    assert licenses.scan(clashing).count() == 0 and licenses.scan(empty).count() == 0


@pytest.mark.parametrize("text, license", [
    ("Licensed under the MIT License.", "MIT"), ("This project is released under the MIT License.", "MIT"),
    ("Licensed under the Apache License 2.0.", "Apache-2.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("we note that all of the code here is Licensed under the MIT License as far as it is ours", "MIT"),
    (licenses.TEMPLATES["BSD-3-Clause"], "BSD-3-Clause"), (licenses.TEMPLATES["BSD-2-Clause"], "BSD-2-Clause"),
    *((licenses.TEMPLATES.get(n, ""), n) for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "CC0-1.0")),
])
def test_licences_are_named_by_the_likeliest_template(text, license):
    found = list(licenses.Templates(licenses.TEMPLATES, licenses.LIKENESS).likeliest(text))
    assert found and found[0][0].split()[0] == license
    if len(text) < 200:
        assert {f[0].split()[0] for f in found} == {license}


# --- 4 repeated strings ---

def repeats_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("cells", [4096, 2])
def test_repeated_strings_equal_brute_force(spark, cells):
    """With 2 cells for a key every larger group goes through the finer levels."""
    rng, length = random.Random(4), 40
    passage = words(rng, 60)
    texts = [*ODD, "ab" * 300, "aaab" * 40 + "aaac" * 40, passage, passage + " end", *(words(rng, 15) + passage[a:a + 90] + words(rng, 9) for a in range(0, 200, 7))]
    texts += [words(rng, 30)] * 3
    rows = {r.doc_id: r for r in suffixes.remove_repeats(table(spark, texts), length, cells).collect()}
    for i, want in enumerate(repeats_by_hand(texts, length)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, bytes(rows[i].kept)) == want, i


@pytest.mark.parametrize("cells", [4096, 1])
def test_runs_of_one_character_of_many_lengths(spark, cells):
    """A run of exactly the length sought is the same string as those within longer runs."""
    rng, length = random.Random(2), 16
    texts = ["x" * n for n in range(10, 60)] + [f"a{'x' * 16}b"] + ["-" * 16, f"{words(rng, 4)}{'-' * 40}{words(rng, 3)}", "=" * 16, "=" * 15]
    rows = {r.doc_id: r for r in suffixes.remove_repeats(table(spark, texts), length, cells).collect()}
    for i, want in enumerate(repeats_by_hand(texts, length)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, bytes(rows[i].kept)) == want, i


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(9)
    for _ in range(200):
        text = bytes(rng.choice(b"aab\xff") for _ in range(rng.randint(1, 60)))
        order = suffixes.suffix_order(text, np.ones(len(text), dtype=bool), 400)
        assert order.tolist() == sorted(range(len(text)), key=lambda p: text[p:])


def test_repeated_strings_on_odd_rows(clashing, empty):
    rows = suffixes.remove_repeats(clashing, 16).collect()
    assert len(rows) == len(ODD) and all(r.n_bytes == 0 and bytes(r.kept) == b"" for r in rows if not r.text)
    assert suffixes.remove_repeats(empty, 16).count() == 0


# --- 5 lines ---

def edited_copy(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, what = rng.randrange(max(1, len(chars))), rng.choice("ids")
        chars[at:at + (what != "i")] = [] if what == "d" else [rng.choice("abcé ")]
    return "".join(chars)


def test_banded_distance_equals_levenshtein(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 2, 5, 20, 70]))) for _ in range(800)]
    df = spark.createDataFrame([(a, edited_copy(rng, a, rng.randint(0, 5)) if a else "b") for a in made], "a string, b string")
    for most in (1, 2, 4):
        got = df.select(lines.banded_distance(F.col("a"), F.col("b"), most).alias("d"), F.levenshtein("a", "b").alias("e")).collect()
        assert all(r.d == r.e if r.e <= most else r.d > most for r in got)


def test_line_links_lose_none(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([20, 21, 22, 40, 90]))) for _ in range(30)]
    all_lines = sorted({edited_copy(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(300)} | set(base))
    df = spark.createDataFrame([(x,) for x in all_lines], "line string").select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("length"))
    got = {(r.a, r.b) for r in lines.links(df).collect()}
    ids = {r.line: r.id for r in df.collect()}
    x, y = df.alias("x"), df.alias("y")
    near = x.join(y, (F.col("x.id") < F.col("y.id")) & (F.levenshtein("x.line", "y.line") <= 2)).select("x.id", "y.id").collect()
    assert got == {(a, b) for a, b in near} and len(got) > 100 and len(ids) == len(all_lines)


def test_lines_on_odd_rows(spark, clashing, empty):
    long = "a line that is long enough to count"
    docs = table(spark, [f"{long}\nshort\n{long}.", None, "", f"x\n{long}"], [3, 1, None, 2], n_chars=["0"] * 4, line_no=["c"] * 4)
    rows = {(r.doc_id, r.line_no): r for r in lines.line_classes(docs).collect()}
    assert set(rows) == {(3, 0), (3, 1), (3, 2), (2, 0), (2, 1)}
    assert {k for k, r in rows.items() if r.kept} == {(2, 1), (2, 0), (3, 1)}
    assert {(r.first_doc, r.first_line) for k, r in rows.items() if k not in ((2, 0), (3, 1))} == {(2, 1)}
    short = lines.line_classes(table(spark, ["Les.\nLes!\n \t\n", "Les.\r\n\nLes."], [5, 4])).collect()
    assert {(r.doc_id, r.line_no, r.first_doc, r.first_line, r.n_links, r.kept) for r in short} == {
        (5, 0, 4, 2, 0, False), (5, 1, 5, 1, 0, True), (4, 0, 4, 0, 0, True), (4, 2, 4, 2, 0, True)}
    assert [rows[k].n_links for k in ((2, 1), (3, 0), (3, 2))] == [1, 1, 1]
    left = {r.doc_id: r.text for r in lines.drop_repeated(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert left == {3: "short", 1: None, None: "", 2: f"x\n{long}"}
    assert lines.drop_repeated(clashing).count() == len(ODD) and lines.line_classes(empty).count() == 0


# --- 6 leaks ---

def leaks_by_hand(docs, items, least=1):
    unspaced = "\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff"
    split = lambda t: re.findall(rf"[{unspaced}]|[^\W_{unspaced}]+", (t or "").lower())
    for (i, text), (k, item) in itertools.product(docs, items):
        a, b = split(text), split(item)
        window, allowed = (13, 2) if len(b) >= 13 else (len(b), int(len(b) >= 8))
        if len(b) >= least and any(
            sum(x != y for x, y in zip(a[p:p + window], b[q:q + window])) <= allowed
            for p in range(len(a) - window + 1) for q in range(len(b) - window + 1)
        ):
            yield i, k


def test_leaks_equal_brute_force(spark, clashing, empty):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, words(rng, rng.choice([1, 3, 5, 7, 8, 9, 12, 13, 14, 30, 60]), vocabulary)) for k in range(40)] + [(40, "今天天气很好我们去公园吧。"), (41, "ไทย")]
    texts = ["他说：今天天气很好，我们去公园吧！", "今天天气很坏我们去公园吧", "x ภาษาไทย y"]
    for _ in range(147):
        own = rng.choice(items)[1].split()
        a = rng.randrange(len(own))
        own = own[a:a + rng.choice([8, 12, 13, 14, 20, 60])]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "zzz"
        texts.append(f"{words(rng, 9, vocabulary)} {' '.join(own)}! {words(rng, 7, vocabulary)}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaks(table(spark, texts), bench).collect()
    want = set(leaks_by_hand(enumerate(texts), items))
    assert {(r.doc_id, r.item_id) for r in got} == want and 30 < len(want) and {(0, 40), (1, 40), (2, 41)} <= want
    for r in got:  # of equal overlaps the first
        if len(items[r.item_id][1].split()) == 1 and r.item_id < 40:
            assert r.first_word == re.findall(r"[^\W_]+", texts[r.doc_id].lower()).index(items[r.item_id][1]) and r.n_words == r.n_same == 1
    for least in (8, 13):
        kept = leaks.drop_leaked(table(spark, texts), bench, least)
        assert {r.doc_id for r in kept.collect()} == set(range(150)) - {i for i, _ in leaks_by_hand(enumerate(texts), items, least)}
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "few words only")], "item_id long, text string")
    assert leaks.leaks(clashing, odd).count() == 0 and leaks.leaks(empty, bench).count() == 0
    assert leaks.drop_leaked(clashing, bench).count() == len(ODD)


# --- 7 quality ---

def test_pairs_by_sums_equal_pairs_one_by_one():
    machine, rng = quality.Machine(quality.Settings(buckets=64, factors=3)), np.random.default_rng(1)
    machine.w, machine.v = rng.normal(size=machine.w.shape).astype(np.float32), rng.normal(size=machine.v.shape).astype(np.float32)
    found = [quality.features("some words, some MORE words!\nand a line", 64, {}), quality.features("", 64, {})]
    ids, values, starts = machine.rows(found)
    got, _ = machine.margins(ids, values, starts)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
        want = machine.bias + sum(machine.w[i] * x for i, x in zip(ids[a:b], values[a:b]))
        want += sum(float(machine.v[ids[i]] @ machine.v[ids[j]]) * values[i] * values[j] for i in range(a, b) for j in range(i + 1, b))
        assert abs(want - got[k]) < 1e-2


def test_quality_learns_and_scores_held_out_rows(spark, clashing, empty):
    rng = random.Random(1)
    texts = [words(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in words(rng, 60).split()) for i in range(400)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    machine = quality.train(docs, labels, quality.Settings(epochs=4))
    scored = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scored[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.97
    again = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs.repartition(5), labels, quality.Settings(epochs=4))).collect()}
    assert scored == again
    rows = quality.score(clashing, machine).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and rows[0].key == "k"
    assert quality.score(empty, machine).count() == 0
    unlearned = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(3), unlearned).collect()} == {0.5}


# --- 8 SimHash ---

def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    for text in [*ODD, *(words(rng, n) for n in (1, 3, 4, 5, 50, 400))]:
        split = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        hashes = [xxhash.xxh64_intdigest(b" ".join(split[i:i + 4]), 42) for i in range(max(1, len(split) - 3))] if split else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) % (1 << 64) == want


@pytest.mark.parametrize("bucket", [8192, 3])
def test_simhash_links_connect_all(spark, bucket):
    """With a bucket of 3 the larger groups go through ball centres."""
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:6]:
        for _ in range(25):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long").repartition(3)
    got = {r.node: r.root for r in components.components(simhash.links(df, 4, bucket)).collect()}
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= 4 and (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_near_duplicates_on_odd_rows(spark, clashing, empty):
    rows = simhash.near_duplicates(clashing).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fingerprint == 0} == {0}
    assert [r.component_id for r in rows if r.doc_id == 6] == [6, 6]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    text = words(random.Random(3), 300)
    docs = table(spark, [text, text + " end", words(random.Random(4), 300), text, None, ""], [5, 2, 3, 2, 7, 8])
    assert sorted(r.doc_id for r in simhash.keep_first(docs, words_per_shingle=5).collect()) == [2, 3, 7]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9 languages ---

def test_language_backs_off_and_keeps_odd_rows(spark, clashing, empty):
    english, german = ["the", "house", "with", "thing", "going"], ["das", "haus", "mit", "nicht", "gehen"]
    rng = random.Random(5)
    texts = [words(rng, 30, english if i % 2 else german) for i in range(200)]
    docs = table(spark, texts, lang=["en" if i % 2 else "de" for i in range(200)])
    model = language.train(docs)
    asked = table(spark, ["Thinghouse withing", "nichtgehen hausmit", None, "", "12 + 3", "日本", *texts], list(range(6 + 200)))
    rows = {r.doc_id: r for r in language.predict(asked, model).collect()}
    assert [rows[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "und"]
    assert rows[5].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[6 + i].lang_pred == ("en" if i % 2 else "de") for i in range(200))
    assert language.predict(clashing, model).count() == len(ODD) and language.predict(empty, model).count() == 0
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


# --- 10 fingerprints ---

def shingle_hashes(text, n=5):
    split, out = (text or "").lower().split(), set()
    for i in range(max(1, len(split) - n + 1) if split else 0):
        h = 42
        for w in split[i:i + n]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def test_fingerprints_follow_the_next_document(spark, empty):
    rng = random.Random(3)
    texts = [t for t in ODD if t != "\x1c\x85 ​"] + [words(rng, n) for n in (3, 40, 900, 901)]
    ids = [i * 700 - 3000 for i in range(len(texts))]
    rows = {r.doc_id: r for r in sketch.compare_with_next(table(spark, texts, ids), k=64).collect()}
    as_text = lambda t: "".join(f"{h % (1 << 64):016x}" for h in sorted(shingle_hashes(t))[:64])
    order = sorted(zip(ids, texts), reverse=True)
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i].fingerprint == as_text(text) and rows[i].edited_fingerprint == as_text(changed)
        a, b = shingle_hashes(text), shingle_hashes(after)
        if len(a | b) <= 64:
            assert rows[i].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert sketch.compare_with_next(empty).count() == 0


def test_sketches_merge_and_estimate(spark, clashing):
    vocabulary = [f"w{i}" for i in range(5000)]
    rng = random.Random(1)
    a, b = words(rng, 3000, vocabulary), words(rng, 1000, vocabulary)
    df = spark.createDataFrame([(f"{a} {b}", a, b)], "ab string, a string, b string").select(*(sketch.sketch(F.col(c)).alias(c) for c in ("ab", "a", "b")))
    row = df.select(
        sketch.resemblance(F.col("ab"), F.col("a")).alias("r"), sketch.containment(F.col("b"), F.col("ab")).alias("c"),
        sketch.distinct_shingles(F.col("ab")).alias("n"), (F.size(F.array_except(sketch.merge(F.col("a"), F.col("b")), F.col("ab")))).alias("new")).first()
    assert abs(row.r - 0.75) < 0.12 and row.c > 0.8 and abs(row.n - 3996) < 900 and row.new <= 4
    assert sketch.compare_with_next(clashing).count() == len(ODD)
    parts = df.select(F.lit(1).alias("g"), F.explode(F.array("a", "b")).alias("fingerprint"))
    merged = sketch.merge_groups(parts, ["g"]).first().fingerprint
    assert merged == df.select(sketch.merge(F.col("a"), F.col("b")).alias("m")).first().m


def test_language_rows_of_unseen_words_are_the_means_of_their_longest_known_grams():
    import numpy as np

    assert language.words_of("It's a_b c3d É-ß, ﬁ ² Straße") == [w for w in language.WORD.findall("it's a_b c3d é-ß, ﬁ ² straße")]
    assert language.words_of("\x02Tabs\tand\x03 A-Z[^]`{|}~\x7f 09 end") == language.WORD.findall("\x02tabs\tand\x03 a-z[^]`{|}~\x7f 09 end")
    assert set(language._grams("abc", 3)) == {"a", "b", "c", "\x02a", "ab", "bc", "c\x03", "\x02ab", "abc", "bc\x03"}
    grams = ["\x02ab", "abc", "bc\x03", "x", "\x02x"]
    logs = np.random.default_rng(1).normal(size=(len(grams), 2))
    model = language.Model(["aa", "bb"], np.zeros(2), {"known": 0}, np.array([[-1.0, -2.0]]), {g: i for i, g in enumerate(grams)}, logs, 4)
    scorer = language.Scorer(model, remembered=3)
    scorer._learn(["abc", "x", "qq"])
    rows = {w: scorer.rows[i].tolist() for w, i in scorer.known.items()}
    assert rows["abc"] == logs[[0, 1, 2]].mean(axis=0).astype(np.float32).tolist()
    assert rows["x"] == logs[4].astype(np.float32).tolist() and rows["qq"] == [0, 0] and rows["known"] == [-1, -2]
    # the memory of words is full, and begins anew
    first = [scorer.predict(t) for t in ("abc x", "abcd abce xa", "known qq", "xb xc xd")]
    assert first == [language.Scorer(model).predict(t) for t in ("abc x", "abcd abce xa", "known qq", "xb xc xd")]


def test_new_words_are_encoded_a_few_at_a_time_as_the_library_encodes_whole_texts(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "é", "b.", "zq", "0", "7x", " ", " ", "\n", "-", "ß,", "日", "'s"]) for _ in range(600)) for _ in range(12)]
    own, plain = token_files.WordwiseTokenizer(WORDS), Tokenizer.from_file(WORDS)
    seen = []
    monkeypatch.setattr(own, "_learn", lambda words, learn=own._learn: (seen.append(len(words)), learn(words)))
    got = [np.frombuffer(p, dtype=f"<u{own.width}").tolist() for p in own.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) > 2 and max(seen) <= token_files.LEARNED_WORDS
