"""Tables of text, and stored pages, as units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.contexts import CONTEXTS, contexts, json_texts
from ..operators.leaves import json_leaves
from ..session import SPLITS, spread


def units_from(
    df: DataFrame, id_col: str, text_col: str, uri_expr: Column | str, keep: Sequence[str] = (), spread_out: bool = True
) -> DataFrame:
    """Any table with a key and a text column. Only the columns named here are read.

    ``spread_out`` gives a small scan one partition per core and more, see
    :func:`leaksieve.session.spread`; turn it off when ``df`` is not a plain scan.
    """
    uri = F.expr(uri_expr) if isinstance(uri_expr, str) else uri_expr
    units = df.select(
        F.col(id_col).cast("string").alias("unit_id"), uri.alias("uri"), F.lit("raw").alias("context"),
        F.col(text_col).alias("text"), *keep,
    )
    return spread(units, "unit_id", SPLITS) if spread_out else units


def units_from_pages(
    pages: DataFrame, only: Sequence[str] = CONTEXTS, keep: Sequence[str] = (), spread_out: bool = True
) -> DataFrame:
    """Stored pages ``(page_id, url, html)``: one unit per page and web context."""
    pages = pages.select("page_id", "url", "html", *keep)
    return contexts(spread(pages, "page_id", SPLITS) if spread_out else pages, only, keep=keep)


def units_from_json(
    df: DataFrame, id_col: str, json_col: str, uri_expr: Column | str, keep: Sequence[str] = (), spread_out: bool = True
) -> DataFrame:
    """A table with a column of JSON: one unit per leaf, see :func:`leaksieve.operators.leaves.json_leaves`."""
    return json_leaves(units_from(df, id_col, json_col, uri_expr, keep, spread_out), keep)


def units_from_page_json(pages: DataFrame, keep: Sequence[str] = (), spread_out: bool = True) -> DataFrame:
    """Leaves of the JSON in stored pages: scripts of a JSON type, and pages that are JSON."""
    pages = pages.select("page_id", "url", "html", *keep)
    pages = spread(pages, "page_id", SPLITS) if spread_out else pages
    pieces = pages.select("page_id", F.col("url").alias("uri"), *keep, F.posexplode(json_texts(F.col("html"))).alias("piece", "text"))
    units = pieces.select(
        F.concat_ws(":", F.col("page_id").cast("string"), F.lit("leaf"), F.col("piece").cast("string")).alias("unit_id"), "uri", F.lit("leaf").alias("context"),
        "text", (F.col("piece") == 0).alias("named"), *keep)
    return json_leaves(units, keep)
