"""Places in the stored page of what was found in the decoded one.

Decoding shortens character references and leaves everything else, so a page is a row of tokens
with a stored and a decoded length each. Their running totals are the table of offsets; a place is looked up in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import let
from ..functions.text import ENTITIES, decode_reference
from .contexts import CLOSE, OPEN, RAW, decode_markup

REFERENCE = "&(?:" + "|".join(name[1:-1] for name, _ in (*ENTITIES, ("&amp;", "&"))) + "|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"


def _token(stored: Column, decoded: Column) -> Column:
    return F.struct(F.length(stored).cast("bigint").alias("s"), F.length(decoded).cast("bigint").alias("d"), decoded.alias("decoded"))


def _tokens(html: Column) -> Column:
    """Gaps and references in order, as stored length, decoded length and decoded text; scripts and styles are gaps."""
    def of_piece(piece: Column, end: Column) -> Column:
        raw = F.when(end.isNull(), F.lit("")).otherwise(F.regexp_extract(piece, f"{OPEN % RAW}.*", 0))
        return let(raw, lambda r: cut(F.left(piece, F.length(piece) - F.length(r)), F.concat(r, F.coalesce(end, F.lit("")))))

    def cut(outside: Column, verbatim: Column) -> Column:
        def of_outside(text: Column) -> Column:
            gaps = F.transform(F.split(text, REFERENCE, -1), lambda gap: _token(gap, gap))
            references = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda ref: let(decode_reference(ref), lambda d: _token(ref, d)))
            # there is one gap more than there are references
            return F.flatten(F.zip_with(gaps, references, lambda gap, ref: F.array_compact(F.array(gap, ref))))

        return F.array_append(let(outside, of_outside), let(verbatim, lambda v: _token(v, v)))

    ends = F.regexp_extract_all(html, F.lit(CLOSE % RAW), F.lit(0))
    return F.flatten(F.zip_with(F.split(html, CLOSE % RAW, -1), ends, of_piece))


def _looked_up(tokens: Column, start: Column, end: Column) -> Column:
    """(start, end) in the stored page: one pass that carries the totals of both sides."""
    zero, unknown = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")

    def step(acc: Column, t: Column) -> Column:
        # within a gap places keep their distance; a reference is taken whole
        gap, begins, ends = t["s"] == t["d"], acc["dt"] + t["d"] > start, acc["dt"] + t["d"] >= end
        begin = F.when(begins, acc["st"] + F.when(gap, start - acc["dt"]).otherwise(zero))
        stop = F.when(ends, acc["st"] + F.when(gap, end - acc["dt"]).otherwise(t["s"]))
        return F.struct(
            (acc["st"] + t["s"]).alias("st"), (acc["dt"] + t["d"]).alias("dt"),
            F.coalesce(acc["stored_start"], begin).alias("stored_start"), F.coalesce(acc["stored_end"], stop).alias("stored_end"))

    nothing = F.struct(zero.alias("st"), zero.alias("dt"), unknown.alias("stored_start"), unknown.alias("stored_end"))
    return F.aggregate(tokens, nothing, step, lambda acc: F.struct(acc["stored_start"].alias("stored_start"), acc["stored_end"].alias("stored_end")))


def stored_places(findings: DataFrame, html_col: str = "html") -> DataFrame:
    """Findings of the context ``html`` that kept the stored page, with ``stored_start`` and ``stored_end``: code points of that page, half open.

    The stored text there decodes to the value. Findings of other contexts have null places, as have
    those of a page in which decoding puts a new reference together from several (``&&#108;t;``): no
    table of offsets describes it. Each finding reads its page anew. Only pages with findings are looked at, in the rows where they are.
    """
    html = F.col(html_col)

    def placed(tokens: Column) -> Column:
        whole = F.array_join(F.transform(tokens, lambda t: t["decoded"]), "") == decode_markup(html)
        return F.when(whole, _looked_up(tokens, F.col("start"), F.col("end")))

    at = F.when(F.col("context") == "html", let(_tokens(html), placed))
    row = let(at, lambda a: F.struct(a["stored_start"].alias("stored_start"), a["stored_end"].alias("stored_end")))
    # out of a generator: a filter on the places is not pushed below it, where the page would be read once more
    return findings.select("*", F.inline(F.array(row)))
