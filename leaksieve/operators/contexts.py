"""Web contexts: the places in a page that secrets hide in.

Contexts are cut out by pattern, not by a DOM parser, so malformed markup is read
approximately: a ``<script>`` without its end tag, for one, is only seen as part of
the whole page, and a tag ends at the next ``<`` even within quotes. Everything here is a projection on the page row; there is no
shuffle, and a page is parsed where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import let
from ..functions.text import DECODABLE, decode_entities

# Every pattern stops at the next "<", so that a page of unclosed tags is read once, not once per tag.
OPEN = r"(?is)<%s[^<>]*>"
CLOSE = r"(?i)</%s>"
HANDLER_DOUBLE = r"""(?is)\son[a-z]+\s*=\s*"([^"]*)\""""
HANDLER_SINGLE = r"(?is)\son[a-z]+\s*=\s*'([^']*)'"
META = r"(?is)<meta([^<>]*)>"
CONFIG = r"window[.]__[A-Za-z0-9_]+__\s*=\s*[{]"
LAST_BRACE = r"(?s)\A(.*[}])"
JSON_TYPE = r"""(?is)\A<script[^<>]*type\s*=\s*["']application/(?:[a-z.+-]*[+])?json["'][^<>]*>"""
JSON_BODY = r"\A\s*[\[{]"
JSON_CODE = r"\\u00([2-7][0-9A-Fa-f])"
# Script and style bodies are not entity-encoded, all other text and attributes are.
RAW = "(?:script|style)"

CONTEXTS = ("script", "css", "handler", "meta", "config", "json", "html")


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def elements(html: Column, name: str) -> Column:
    """The elements of a name, from the first open tag before each close tag, that tag included.

    The page is cut at the close tags, and each piece is cut once more, so that the
    work is linear. An element without its close tag is no element.
    """
    closed = let(F.split(html, CLOSE % name, -1), lambda pieces: F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    cut = F.transform(closed, lambda piece: F.regexp_extract(piece, f"{OPEN % name}.*", 0))
    return F.filter(cut, lambda element: element != "")


def _body(element: Column, name: str) -> Column:
    return F.regexp_replace(element, rf"\A{OPEN % name}", "")


def decode_markup(html: Column) -> Column:
    """Decode entities in text and attributes and leave script and style bodies alone."""
    pieces, ends = F.split(html, CLOSE % RAW, -1), F.regexp_extract_all(html, F.lit(CLOSE % RAW), F.lit(0))

    def decoded(piece: Column, end: Column) -> Column:
        # what follows the last close tag holds no closed element
        raw = F.when(end.isNull(), F.lit("")).otherwise(F.regexp_extract(piece, f"{OPEN % RAW}.*", 0))
        return let(raw, lambda r: F.concat(decode_entities(F.left(piece, F.length(piece) - F.length(r))), r, F.coalesce(end, F.lit(""))))

    return F.when(html.rlike(DECODABLE), F.array_join(F.zip_with(pieces, ends, decoded), "")).otherwise(html)


def unescape_json(text: Column) -> Column:
    """Undo ``\\/`` and the code escapes of printable ASCII, so that keys show as they are used."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(JSON_CODE), F.lit(1)))

    def step(acc: Column, code: Column) -> Column:
        return F.replace(acc, F.concat(F.lit("\\u00"), code), F.char(F.conv(code, 16, 10).cast("int")))

    return F.when(text.contains("\\"), F.replace(F.aggregate(codes, text, step), F.lit("\\/"), F.lit("/"))).otherwise(text)


def json_texts(html: Column, scripts: Column | None = None) -> Column:
    """JSON as it is stored: bodies of scripts of a JSON type, and a page that is JSON."""
    scripts = elements(html, "script") if scripts is None else scripts
    body = F.when(html.rlike(JSON_BODY), F.array(html)).otherwise(F.array().cast("array<string>"))
    typed = F.filter(scripts, lambda e: e.rlike(JSON_TYPE))
    return F.concat(F.transform(typed, lambda e: _body(e, "script")), body)


def context_texts(html: Column, context: str, scripts: Column | None = None) -> Column:
    """The texts of one context, as an array; ``scripts`` are the page's elements of that name, where they are known."""
    scripts = elements(html, "script") if scripts is None else scripts
    if context == "script":
        return F.transform(scripts, lambda e: _body(e, "script"))
    if context == "css":
        return F.transform(elements(html, "style"), lambda e: _body(e, "style"))
    if context == "handler":
        handlers = F.concat(_all(html, HANDLER_DOUBLE), _all(html, HANDLER_SINGLE))
        return F.transform(handlers, decode_entities)
    if context == "meta":
        return F.transform(_all(html, META), decode_entities)
    if context == "config":
        # an object ends with the last brace before the next one, or before the script's end
        def objects(script: Column) -> Column:
            parts = F.split(_body(script, "script"), CONFIG, -1)
            ends = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda part: F.regexp_extract(part, LAST_BRACE, 1))
            return F.transform(F.filter(ends, lambda end: end != ""), lambda end: F.concat(F.lit("{"), end))

        return F.flatten(F.transform(scripts, objects))
    if context == "json":
        return F.transform(json_texts(html, scripts), unescape_json)
    if context == "html":
        return F.array(decode_markup(html))
    raise ValueError(f"unknown context {context!r}")


def _labelled(texts: Column, name: str) -> Column:
    return F.transform(
        texts, lambda text, i: F.struct(F.lit(name).alias("context"), i.alias("piece"), text.alias("text"))
    )


def contexts(
    pages: DataFrame, only: Sequence[str] = CONTEXTS, id_col: str = "page_id", keep: Sequence[str] = ()
) -> DataFrame:
    """Units of text per page and context. The first of a page is ``named``: rules on names look at its address.

    Positions found later refer to the text of the unit: the decoded page for
    ``html``, the extracted piece for the other contexts. A value that occurs in
    several contexts is reported once for each.
    """
    html = F.col("html")

    def found(scripts: Column | None) -> Column:
        return F.filter(F.flatten(F.array(*[_labelled(context_texts(html, name, scripts), name) for name in only])), lambda p: p["text"] != "")

    # each array is an expression inside one inline(), so a page is parsed once, and cut into scripts once
    pieces = let(elements(html, "script"), found) if {"script", "config", "json"} & set(only) else found(None)
    numbered = F.transform(pieces, lambda p, i: F.struct(p["context"].alias("context"), p["piece"].alias("piece"), p["text"].alias("text"), (i == 0).alias("named")))
    return pages.select(F.col(id_col).cast("string").alias("__id"), F.col("url").alias("uri"), *keep, F.inline(numbered)).select(
        F.concat_ws(":", "__id", "context", F.col("piece").cast("string")).alias("unit_id"), "uri", "context", "text", "named", *keep)
