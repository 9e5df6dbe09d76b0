"""Near-duplicate lines within a small edit distance, in DataFrame functions only.

A segment-partition join: a line is cut into distance + 1 segments, so that a line
within the distance holds one of them unchanged, at nearly the same place. Segments
of indexed lines are hashed with their line's length and number; a line probes, for its own
length and each shorter one in reach, only the substrings where such a segment can still lie. What meets
there is verified by an edit distance over a diagonal band, one bit per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .components import components

DISTANCE = 2
# Shorter lines are alike only if they are equal: two edits make other lines of them.
SHORTEST = 20
# A line with a character besides white space.
FILLED = r"[^ \t\r\x0B\x0C]"
# Places in the filter on line ids: bounds what is broadcast, to a few MB.
FILTER_PLACES = 1 << 18


def lines_of(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, line_no, id, line) of all lines of at least ``least`` characters that aren't blank, before them columns that ``docs`` has besides text.

    The id is the line's 64-bit hash. Null and empty texts have none.
    """
    own = [c for c in docs.columns if c != "text"]
    lines = docs.select(*own, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.filter((F.length("line") >= least) & F.col("line").rlike(FILLED)).select(*own, "line_no", F.xxhash64("line").alias("id"), "line")


def _places(distance: int) -> list[tuple[int, int, int, bool]]:
    """What a line is cut and probed at: (characters fewer, segment, shift, indexed).

    Edits left of a segment and right of it must fit together: at most i before segment i
    of distance + 1 (from 0), at most distance - i after it. Lines of one length meet at
    their indexed segments, so that these need no probes.
    """
    own = [(0, i, 0, True) for i in range(distance + 1)]
    return own + [
        (shorter, i, shift, False)
        for shorter in range(distance + 1) for i in range(distance + 1) for shift in range(-distance, distance + 1)
        if abs(shift) <= i and abs(shorter - shift) <= distance - i and (shorter or shift)
    ]


def _keys(distance: int) -> Column:
    """Keys of a line, null where a substring would not lie within it. Needs columns line and length.

    The last bit of a key tells whether its segment is indexed or probed with. Segments are
    as long as each other, the last ones a character longer where that does not come out even.
    """
    line, length, count = F.col("line"), F.col("length"), distance + 1
    places = F.array(*(
        F.struct(F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), F.lit(shift).alias("shift"), F.lit(int(indexed)).cast("long").alias("bit"))
        for shorter, i, shift, indexed in _places(distance)))

    def key(p: Column) -> Column:
        other = length - p["shorter"]
        plain = count - other % count  # segments without an extra character
        at = p["i"] * (other / count).cast("int") + F.greatest(p["i"] - plain, F.lit(0)) + p["shift"]
        size = ((other + p["i"]) / count).cast("int")
        hashed = F.xxhash64(other, p["i"], F.substring(line, at + 1, size))
        return F.when((at >= 0) & (at + size <= length), hashed.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(p["bit"]))

    return F.transform(places, key)


def bigram_parity(line: Column) -> Column:
    """64 bits that tell which hashed character pairs occur an odd number of times.

    One edit turns at most two pairs into two others, so that it changes at most four bits.
    """
    def fold(chars: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(chars) - 1), F.lit(0).cast("long"),
            lambda bits, i: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(chars[i - 1], chars[i]), F.lit(64)))))

    return F.transform(F.array(F.split(line, "")), lambda c: F.when(F.size(c) > 1, fold(c)).otherwise(F.lit(0).cast("long")))[0]


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings if it is at most ``most``, else any number above it.

    Bits of one long stand for the cells of a diagonal band of 2 * most + 1 rows:
    which of them match the next character, where the distance rises (``up``) or
    falls (``down``) against the row above. Each character moves the band one row down. The
    distance is followed down the band's lower edge to the last row, and along that row from there.
    """
    width = 2 * most + 1
    full, top = (1 << width) - 1, width - 1

    def long(n: int) -> Column:
        return F.lit(n).cast("long")

    def bit(value: Column, place: Column) -> Column:
        return F.call_function("shiftright", value, place.cast("int")).bitwiseAND(long(1))

    def run(pair: Column) -> Column:
        p, t = pair["p"], pair["t"]  # the longer is the column's side, the shorter gives the steps
        rows, steps = F.size(p), F.size(t)

        def step(s: Column, i: Column) -> Column:
            match = long(0)
            for k in range(width):
                match = match + F.when(F.get(p, i + (k - most)) == F.get(t, i), long(1 << k)).otherwise(long(0))
            up, down = s["up"], s["down"]

            def moved(m: Column) -> Column:
                same = (m.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(m).bitwiseOR(down).bitwiseAND(long(full))
                return F.transform(F.array(same), lambda d0: F.transform(
                    F.array(F.struct(down.bitwiseOR(long(full) - d0.bitwiseOR(up)).alias("hp"), d0.bitwiseAND(up).alias("hn"))), lambda h: F.struct(
                        (h["hn"].bitwiseOR(long(full) - F.call_function("shiftright", d0, F.lit(1)).bitwiseOR(h["hp"]))).alias("up"),
                        F.call_function("shiftright", d0, F.lit(1)).bitwiseAND(h["hp"]).alias("down"),
                        (s["cost"] + F.when(
                            i + most < rows, long(1) - bit(d0, F.lit(top)),
                        ).otherwise(bit(h["hp"], rows - 1 - i + most) - bit(h["hn"], rows - 1 - i + most))).alias("cost"),
                    ))[0])[0]

            return F.transform(F.array(match), moved)[0]

        start = F.struct(long(((1 << (most + 1)) - 1) << most).alias("up"), long(0).alias("down"), long(most).alias("cost"))
        # a string that ends within the band has no lower edge to follow
        return F.when(rows <= most, F.levenshtein(a, b).cast("long")).when(rows - steps > most, long(most + 1)).otherwise(
            F.aggregate(F.sequence(F.lit(0), steps - 1), start, step, lambda s: s["cost"]))

    chars_a, chars_b = (F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, "")) for x in (a, b))
    pair = F.when(F.length(a) >= F.length(b), F.struct(chars_a.alias("p"), chars_b.alias("t"))).otherwise(
        F.struct(chars_b.alias("p"), chars_a.alias("t")))
    return F.transform(F.array(pair), run)[0]


def links(lines: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of ids of different lines at most ``distance`` edits apart; each once, none left out.

    ``lines`` has id, line and length, each line once. Keys without a partner go before any
    text moves; the join of the rest compares character-pair parities, so that only likely pairs leave it.
    """
    rows = lines.select("id", F.explode(_keys(distance)).alias("key")).filter("key IS NOT NULL")
    rows = rows.select(F.expr("shiftright(key, 1)").alias("key"), "id", (F.col("key") % 2 != 0).alias("indexed"))
    met = W.partitionBy("key")
    shared = rows.withColumn("low", F.min("id").over(met)).withColumn("high", F.max("id").over(met)).withColumn("any", F.max("indexed").over(met))
    active = written(shared.filter("low <> high AND any").select("key", "id", "indexed").distinct(), "active")
    wanted = active.select("id").distinct()
    places = wanted.select(F.pmod("id", F.lit(FILTER_PLACES)).alias("place")).distinct()
    near = lines.join(F.broadcast(places), F.pmod("id", F.lit(FILTER_PLACES)) == F.col("place"), "left_semi")
    texts = written(near.join(wanted, "id", "left_semi").select("id", "line", bigram_parity(F.col("line")).alias("parity")), "texts")
    marked = active.join(texts.select("id", "parity"), "id")
    index = marked.filter("indexed").select("key", F.col("id").alias("a"), F.col("parity").alias("pa"))
    probe = marked.select("key", F.col("id").alias("b"), F.col("parity").alias("pb"))
    likely = (F.col("a") != F.col("b")) & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 4 * distance)
    on_key = index.join(probe, (index["key"] == probe["key"]) & likely)
    pairs = on_key.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    verified = pairs.join(left, "a").join(right, "b").filter(banded_distance(F.col("line_a"), F.col("line_b"), distance) <= distance)
    return verified.select("a", "b")


def _placed(docs: DataFrame, row: list[str], distance: int, shortest: int, least: int) -> DataFrame:
    """(*row, line_no, n_links, first) of every line of at least ``least`` characters in ``docs`` (columns ``row`` and text).

    Lines below ``shortest`` are linked to none. ``first`` is (null id, doc_id, line_no, rest of the row) of the first line of its class.
    """
    lines = lines_of(docs, least)
    path = scratch_path(docs.sparkSession, "lines")
    lines.filter(F.length("line") >= shortest).select("id", "line").distinct().withColumn("length", F.length("line")).write.option("compression", "zstd").parquet(path)
    distinct = docs.sparkSession.read.parquet(path)
    pairs = written(links(distinct, distance), "line-links")
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    known = degrees.join(components(pairs).withColumnRenamed("node", "id"), "id")
    placed = lines.select(*row, "line_no", "id").join(known, "id", "left").select(
        *row, "line_no", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    placed = written(placed, "placed")
    where = F.struct(F.col("doc_id").isNull(), "doc_id", "line_no", *row[1:])
    # only classes met more than once need their first line looked up
    first = placed.groupBy("class_id").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return placed.join(first, "class_id", "left").select(*row, "line_no", "n_links", F.coalesce("first", where).alias("first"))


def _is_first() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))


def line_classes(docs: DataFrame, distance: int = DISTANCE, shortest: int = SHORTEST) -> DataFrame:
    """Every line that isn't blank: doc_id, line_no, first_doc, first_line, n_links, kept.

    Equal lines, and lines of at least ``shortest`` characters linked through at most ``distance`` edits, over any number
    of steps, form a class. It is named by its first line, that with the least doc_id and
    then line_no (null doc_ids last); ``n_links`` counts the different lines that a line is linked to.
    ``kept`` is true for the first line of a class (of repeated rows for all that are first). Lines are known by 64-bit hashes.
    """
    found = _placed(docs.select("doc_id", "text"), ["doc_id"], distance, shortest, least=1)
    return found.select(
        "doc_id", "line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "n_links",
        _is_first().alias("kept"))


def drop_repeated(docs: DataFrame, distance: int = DISTANCE, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of ``text``; all rows and columns stay.

    Lines below ``shortest`` characters stay, as they are common in clean texts. Other lines keep their order, null texts stay null, and a text all of whose lines go
    becomes empty. A row is known by doc_id and text: other texts under a repeated or null doc_id keep their
    own lines, equal rows are treated alike. Of a class all but the first line go, so that the end of a chain of links may
    be further than ``distance`` from the line that stays. A column n_chars is counted anew.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__th"), "text")
    gone = _placed(keyed, ["doc_id", "__th"], distance, shortest, least=shortest).filter(~(_is_first() & (F.col("__th") == F.col("first.__th"))))
    per_doc = gone.groupBy(F.col("doc_id").alias("__id"), "__th").agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    rest = F.transform(F.array(lines), lambda own: F.array_join(F.transform(left, lambda i: own[i]), "\n"))[0]
    text = F.when(F.col("__gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(rest)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
