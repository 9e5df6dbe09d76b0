"""The pipeline stage by stage, each against brute force on what the stage before it kept."""

import hashlib
import itertools
import random
import re
import sys
from pathlib import Path

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from leaksieve.llm import leaks, lines, simhash  # noqa: E402
from leaksieve.session import written  # noqa: E402

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(300)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Clean documents, junk, copies, near copies, repeated lines, benchmark passages, null and empty texts."""
    rng, folder = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    items = [(k, prose(rng, 30)) for k in range(5)]
    texts = ["\n".join(prose(rng, 25) for _ in range(3)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(30)]
    line = prose(rng, 12)
    texts += junk + [texts[3], texts[4] + " tail"] + [f"{prose(rng, 30)}\n{line}{'.' * (k % 3)}" for k in range(6)]
    long = prose(rng, 500)
    texts += [long, long + " more", f"{prose(rng, 20)} {items[2][1]} {prose(rng, 20)}", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(t not in junk), 0) for i, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    tables, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        tables.append({r.doc_id: r for r in docs.collect()})
        docs = written(stage(spark, docs, folder), "test-stage")
        assert docs.columns == COLUMNS or name == corpus_pipeline.STAGES[-1][0]
    return folder, items, junk, tables, {r.doc_id: r for r in docs.collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_quality_keeps_clean_documents(made):
    _, _, junk, (docs, kept, *_), _ = made
    assert {i for i, r in docs.items() if r.text and r.text not in junk} <= set(kept)
    assert not any(r.text in junk for r in kept.values()) and all(kept[i] == docs[i] for i in kept)


def test_lines_keep_the_first_of_each_class(made):
    _, _, _, (_, before, after, *_), _ = made
    places = [(i, k, line) for i, r in sorted(before.items()) for k, line in enumerate((r.text or "").split("\n")) if len(line) >= 20]
    root = {line: line for _, _, line in places}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
            root[find(a)] = find(b)
    seen, gone = set(), set()
    for i, k, line in places:
        if find(line) in seen:
            gone.add((i, k))
        seen.add(find(line))
    assert len(gone) > 5
    for i, r in before.items():
        want = r.text and "\n".join(line for k, line in enumerate(r.text.split("\n")) if (i, k) not in gone)
        assert after[i].text == want and after[i].n_chars == len(want or "")


def test_one_document_of_each_group_stays(made):
    _, _, _, (_, _, before, after, _), _ = made

    def fingerprint(text):
        split = (text or "").lower().split()
        hashes = [xxhash.xxh64_intdigest(" ".join(split[i:i + 4]).encode(), 42) for i in range(max(1, len(split) - 3))] if split else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(r.text) for i, r in before.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert set(after) == {i for i in prints if find(i) == i} and len(after) < len(before)


def test_leaked_documents_go(made):
    _, items, _, (*_, before, after), _ = made
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def leaks(text):
        a = split(text)
        return any(
            sum(x != y for x, y in zip(a[p:p + 13], b[q:q + 13])) <= 2
            for b in (split(t) for _, t in items) for p in range(len(a) - 12) for q in range(len(b) - 12))

    assert set(before) - set(after) == {i for i, r in before.items() if leaks(r.text)} and len(before) - len(after) == 1


def test_the_rest_is_encoded(made, spark):
    folder, _, _, (*_, before), result = made
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(result) == set(before)
    for i, r in before.items():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        assert result[i].n_tokens == len(ids) and result[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert result[i].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_no_documents_no_rows(made, spark):
    folder = made[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "test-stage")
        assert docs.count() == 0


def test_leaks_are_known_by_id_and_text(spark):
    """A clean text under the id of a leaked one stays, a leaked text without an id goes; clashing columns stay as they are."""
    rng = random.Random(6)
    item, clean = prose(rng, 20), [prose(rng, 40) for _ in range(4)]
    rows = [(1, clean[0]), (1, f"{clean[1]} {item}"), (None, f"{item} {clean[2]}"), (None, clean[2]), (2, clean[3]), (2, clean[3]), (3, None)]
    docs = spark.createDataFrame([(*r, "s", "k") for r in rows], "doc_id long, text string, seed string, kind string")
    items = spark.createDataFrame([(1, item), (2, "w"), (3, clean[3].split()[0])], "item_id long, text string")
    left = leaks.drop_leaked(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted([(1, clean[0]), (-1, clean[2]), (2, clean[3]), (2, clean[3]), (3, "")])


def test_lines_of_rows_that_share_an_id_go_one_by_one(spark):
    rng = random.Random(7)
    copied, *own = (prose(rng, 15) for _ in range(5))
    rows = [(0, copied), (None, f"{copied}\n{own[0]}"), (None, f"{own[1]}\n{copied}."), (3, f"{own[2]}\n{own[2]}"), (3, f"{own[3]}\nx")]
    left = lines.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in left} == {(0, copied), (None, own[0]), (None, own[1]), (3, own[2]), (3, f"{own[3]}\nx")}


def test_simhash_keeps_texts_that_share_an_id(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[3])]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted(texts)
