"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm import bpe, collocations, language, leaks, licenses, lines, prefix_trie, quality, simhash, sketch, suffixes, token_files, weak_rules
from leaksieve.llm.held_out import held_out
from leaksieve.session import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), likeliest=True)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs, length=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(_table(spark, sf_dir, "documents"))


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), distance=4, words_per_shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(_table(spark, sf_dir, "documents"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", *weak_rules.STATISTICS, "base_failed", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), most_words=3, least=10, best=2000)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(*prefix_trie.with_shared_heads(turns, every=20, most=3))


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_bpe": op2_bpe,
        "op3_licenses": op3_licenses,
        "op4_suffixes": op4_suffixes,
        "op5_lines": op5_lines,
        "op6_leaks": op6_leaks,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_language": op9_language,
        "op10_fingerprints": op10_fingerprints,
        "op11_rules": op11_rules,
        "op12_collocations": op12_collocations,
        "op13_prefix_trie": op13_prefix_trie,
    }


# Lines, their links and classes from scratch: pairs are compared in full. That two
# lines share a third of the shorter one follows from the distance and only saves time.
LINES_SQL = """
WITH RECURSIVE lines AS MATERIALIZED (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE regexp_matches(l[i], '[^ \\t\\r\\x0B\\x0C]')),
firsts AS MATERIALIZED (SELECT line, min((doc_id, line_no)) AS first FROM lines GROUP BY line),
near AS MATERIALIZED (
  SELECT x.line AS a, y.line AS b, x.first AS fa, y.first AS fb FROM firsts x JOIN firsts y
  ON length(x.line) >= 20 AND length(y.line) BETWEEN length(x.line) AND length(x.line) + 2 AND x.line <> y.line
  AND (contains(y.line, left(x.line, length(x.line) // 3)) OR contains(y.line, substring(x.line, length(x.line) // 3 + 1, length(x.line) // 3))
    OR contains(y.line, right(x.line, length(x.line) // 3)))),
pairs AS MATERIALIZED (SELECT DISTINCT a, b, fa, fb FROM (
  SELECT * FROM near WHERE levenshtein(a, b) <= 2 UNION ALL SELECT b, a, fb, fa FROM near WHERE levenshtein(a, b) <= 2)),
reached(line, first) AS (
  SELECT a, fa FROM pairs UNION SELECT p.b, r.first FROM reached r JOIN pairs p ON p.a = r.line),
classes AS (SELECT f.line, coalesce(min(r.first), any_value(f.first)) AS first FROM firsts f LEFT JOIN reached r USING (line) GROUP BY f.line),
degrees AS (SELECT a AS line, count(*) AS n FROM pairs GROUP BY 1)
SELECT doc_id, line_no, struct_extract(first, 1) AS first_doc, struct_extract(first, 2) AS first_line, coalesce(n, 0) AS n_links,
  (doc_id, line_no) = first AS kept
FROM lines JOIN classes USING (line) LEFT JOIN degrees USING (line)
"""


# Phrases from scratch: every window of one to three words of every piece is a row.
PHRASES_SQL = """
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda w: w <> '') AS l
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
places AS (SELECT lang, l, unnest(range(1, len(l) + 1)) AS i FROM pieces),
ones AS MATERIALIZED (SELECT lang, l[i] AS x, count(*) AS n FROM places GROUP BY 1, 2),
twos AS MATERIALIZED (SELECT lang, l[i] AS x, l[i + 1] AS y, count(*) AS n FROM places WHERE i < len(l) GROUP BY 1, 2, 3),
threes AS MATERIALIZED (SELECT lang, l[i] AS x, l[i + 1] AS y, l[i + 2] AS z, count(*) AS n FROM places WHERE i + 1 < len(l) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(n) AS most FROM (SELECT lang, x, y, n FROM threes UNION ALL SELECT lang, y, z, n FROM threes) GROUP BY 1, 2, 3),
cuts AS (
  SELECT lang, concat(t.x, ' ', t.y) AS phrase, t.n AS a, p.n AS l, q.n AS r, 1 AS k
  FROM twos t JOIN ones p USING (lang, x) JOIN ones q ON q.lang = t.lang AND q.x = t.y LEFT JOIN longer o ON o.lang = t.lang AND o.x = t.x AND o.y = t.y
  WHERE t.n >= 10 AND NOT coalesce(100 * most >= 50 * t.n, false)
  UNION ALL
  SELECT t.lang, concat(t.x, ' ', t.y, ' ', t.z), t.n, p.n, q.n, 1 FROM threes t JOIN ones p ON p.lang = t.lang AND p.x = t.x
    JOIN twos q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, concat(t.x, ' ', t.y, ' ', t.z), t.n, p.n, q.n, 2 FROM threes t JOIN twos p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y
    JOIN ones q ON q.lang = t.lang AND q.x = t.z),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest),
totals AS (SELECT lang, sum(n) AS n FROM ones GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

# The trie from scratch: every prefix of every rebuilt conversation is a row, grouped by the whole of what it holds.
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(role, text) ORDER BY pos) AS l FROM turns GROUP BY c),
ids AS (
  SELECT c, l, xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda s, e: CASE WHEN xor(s, e) % 2 = 1 THEN xor(xor(s, e) // 2, 3988292384) ELSE xor(s, e) // 2 END, 4294967295::BIGINT)) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT x.c, list_concat(coalesce(b.l[1:x.h], []), x.l[x.h + 1:]) AS l FROM ids x LEFT JOIN own b ON b.c = x.c - x.c % 20),
prefixes AS (SELECT c, len(l) AS n, d, l[1:d] AS p FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')), 0) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256, max(n) = d AS leaf
  FROM prefixes GROUP BY d, p),
below AS (
  SELECT a, p[1:a] AS p, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (d = a + 1) AS n_children
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes) GROUP BY a, p[1:a])
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below y ON y.a = x.d AND y.p = x.p LEFT JOIN nodes u ON u.d = x.d - 1 AND u.p = x.p[1:x.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express on whole tables."""
    return {"op5_lines": LINES_SQL, "op12_collocations": PHRASES_SQL, "op13_prefix_trie": TRIE_SQL}
