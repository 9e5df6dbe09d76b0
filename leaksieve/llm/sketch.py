"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the k least of the distinct 64-bit hashes of a text's word shingles, in
ascending order. Sketches of parts merge into the sketch of the whole. From two of them follow
resemblance and containment, from one the number of distinct shingles; all are
exact where the texts have at most k distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

K = 256
WORDS = 5
# Ids that share a bucket of next_documents().
BUCKET = 256
_HALF = float(2 ** 63)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the plan does to projections."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The sketch of a whole text, an array of longs.

    Words are what white space separates, in lower case. Texts of fewer words are one
    shingle; null texts and texts without words have an empty sketch.
    """
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def shingles(array: Column) -> Column:
        last = F.greatest(F.size(array) - words, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(array, i + 1, words)))
        return F.when(F.size(array) > 0, F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<bigint>"))

    return _let(split, shingles)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together. A null sketch counts as empty."""
    none = F.array().cast("array<bigint>")
    return F.slice(F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none))), 1, k)


def merge_groups(df: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One merged sketch per group. Hashes are cut to k in every task before they are shuffled."""
    hashes = df.select(*keys, F.explode_outer(column).alias("__hash")).distinct()
    ranked = hashes.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("__hash").asc_nulls_last()))).filter(F.col("__rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles among those of either text, 0 to 1. Two empty sketches resemble fully."""
    def share(union: Column) -> Column:
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))

    return _let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(_HALF)) / F.lit(2 * _HALF)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1; 1 if the first has none."""
    both = distinct_shingles(merge(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def _next_higher(ids: DataFrame, span: int) -> DataFrame:
    """Distinct ids, each with the next higher one; the highest gets the lowest.

    Neighbours are found within runs of ``span`` ids, and between runs from their ends: what
    is sorted in one task is one run, or the ends of all runs.
    """
    run = F.floor(F.col("id") / span)
    inner = W.partitionBy("run").orderBy("id")
    placed = ids.withColumn("run", run).withColumn("higher", F.lead("id").over(inner))
    ends = placed.groupBy("run").agg(F.min("id").alias("low"))
    outer = W.orderBy("run")
    first = F.first("low").over(outer.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    between = ends.select("run", F.coalesce(F.lead("low").over(outer), first).alias("after"))
    return placed.join(between, "run").select("id", F.coalesce("higher", "after").alias("higher"))


def next_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next document in descending doc_id order; the first follows the last.

    Null doc_ids come last; rows with equal ids follow each other in the order of their texts' hashes. A
    single row follows itself. Documents are shuffled once, by runs of ids, and only
    the highest of each run is copied to the run above it.
    """
    lowest = F.lit(-(2 ** 55))
    numbered = docs.withColumn("__bucket", F.coalesce(F.floor(F.col("doc_id") / BUCKET), lowest)).withColumn("__guest", F.lit(False))
    tops = numbered.groupBy("__bucket").agg(F.max("doc_id").alias("__top"))
    higher = _next_higher(tops.select(F.col("__bucket").alias("id")), 4096)
    # written, so that the planner knows their size before it deals out texts to meet them
    hosts = written(tops.join(higher, F.col("__bucket") == F.col("id")).select("__top", F.col("higher").alias("__bucket")), "hosts")
    guests = docs.join(hosts, F.col("doc_id").eqNullSafe(F.col("__top"))).drop("__top").withColumn("__guest", F.lit(True))
    order = W.partitionBy("__bucket").orderBy("__guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    dealt = numbered.unionByName(guests).repartition("__bucket")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter("NOT __guest").drop("__bucket", "__guest")


def edited(text: Column, following: Column) -> Column:
    """A text whose last half of code points is replaced by as many of the next text's first, or all of them."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def as_text(a: Column) -> Column:
    """A sketch as 16 hexadecimal digits per hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def compare_with_next(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of documents and of their edited texts, as text, and how alike they are.

    Reads doc_id and text; null texts count as empty. All rows stay, repeated ones too. An
    empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = next_documents(texts, ["text"]).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    marked = paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k, words).alias("own"), sketch(F.col("edited"), k, words).alias("changed"), sketch(F.col("next_text"), k, words).alias("following"),
    )
    own, changed, following = (F.col(c) for c in ("own", "changed", "following"))
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"),
        resemblance(own, changed, k).alias("near_edited"), resemblance(own, following, k).alias("near_next"),
    )
