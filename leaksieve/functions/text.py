"""Small column expressions on URLs and HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import let

# The named character references that occur in source text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))

# What every text that decoding changes holds.
DECODABLE = "&(?:#|lt;|gt;|quot;|apos;|nbsp;|amp;)"

_SCHEME_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def host(url: Column) -> Column:
    """Lower-cased host of an absolute URL, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(url, _SCHEME_HOST, 1))


def origin(url: Column) -> Column:
    """``scheme://authority`` of an absolute URL."""
    return F.regexp_extract(url, _ORIGIN, 1)


def host_suffixes(name: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: every domain the host belongs to."""
    labels = F.split(name, r"\.", -1)
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def _decode_numeric(text: Column, pattern: str, base: int) -> Column:
    """Decode references to printable ASCII; the ampersand is left to the last step."""
    digits = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))
    lead = "&#" if base == 10 else "&#[xX]"

    def step(acc: Column, digit: Column) -> Column:
        code = F.conv(digit, base, 10).cast("int")
        quoted = F.concat(F.lit(lead + "(?i:"), digit, F.lit(");"))
        # quoteReplacement: the two characters that a replacement text treats specially
        char = F.char(code)
        char = F.when(char.isin("$", "\\"), F.concat(F.lit("\\"), char)).otherwise(char)
        return F.when((code >= 32) & (code <= 126) & (code != 38), F.regexp_replace(acc, quoted, char)).otherwise(acc)

    return F.aggregate(digits, text, step)


def decode_entities(text: Column) -> Column:
    """Decode named references of markup characters and numeric ones of printable ASCII.

    ``&amp;`` goes last, so that ``&amp;lt;`` becomes ``&lt;`` and no further. Texts
    without a reference pass untouched.
    """
    def numeric(t: Column) -> Column:
        ampersands = F.regexp_replace(t, "&#(?:0*38|[xX]0*26);", "&amp;")
        decimal = let(ampersands, lambda d: _decode_numeric(d, "()&#([0-9]{1,7});", 10))
        return let(decimal, lambda d: _decode_numeric(d, "()&#[xX]([0-9A-Fa-f]{1,6});", 16))

    def decoded(t: Column) -> Column:
        plain = F.when(t.contains("&#"), numeric(t)).otherwise(t)
        for name, char in ENTITIES:
            plain = F.replace(plain, F.lit(name), F.lit(char))
        plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
        return F.when(t.rlike(DECODABLE), plain).otherwise(t)

    # the text may be an expression of its own
    return let(text, decoded)


def decode_reference(ref: Column) -> Column:
    """What :func:`decode_entities` makes of a text that is one reference and nothing else."""
    digits = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(F.regexp_extract(ref, "[xX](.*);", 1), 16, 10)).otherwise(F.regexp_extract(ref, "#(.*);", 1))
    code = digits.try_cast("int")
    out = F.when(ref.startswith("&#"), F.when((code >= 32) & (code <= 126), F.char(code)).otherwise(ref))
    for name, char in (*ENTITIES, ("&amp;", "&")):
        out = out.when(ref == name, F.lit(char))
    return out.otherwise(ref)
