"""Filters for likely false positives and for scope.

Filters on ``uri`` come before detection and read no text. All of them are off when
a source is read with ``include_all=True``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import any_of
from ..functions.text import host, host_suffixes
from ..session import semi_join

MINIFIED = r"(?i)[.]min[.](?:js|css)(?:[?#]|\z)"
TEST_PATH = r"(?:^|/)(?:tests?|fixtures?|mocks?|__tests__|testdata)/"

# Extensions of images, fonts, media, archives and compiled files.
ASSET_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "tif", "tiff",
    "woff", "woff2", "ttf", "eot", "otf",
    "mp3", "mp4", "avi", "mov", "webm", "ogg", "wav",
    "zip", "gz", "tar", "bz2", "xz", "7z", "rar", "jar", "class",
    "exe", "dll", "so", "o", "a", "pyc", "pdf",
)
EXTENSION = r"[.]([A-Za-z0-9]{1,8})(?:[?#][^\n]*)?\z"

# Words that mark a value as a placeholder, matched in lower case.
PLACEHOLDER_WORDS = (
    "placeholder", "changeme", "change_me", "your_", "your-", "dummy", "xxxx", "redacted", "insert_",
)
VARIABLE = r"\A(?:[$][{(]?[A-Za-z_]|[{]{2}|%[A-Za-z_]+%)"


URL = r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def name_of(uri: Column) -> Column:
    """What of a uri is a name: of a URL its path, without host, query and fragment; else all of it."""
    return F.when(uri.rlike(URL) & ~uri.startswith("file:"), F.regexp_extract(uri, URL, 1)).otherwise(uri)


def is_minified(uri: Column) -> Column:
    return name_of(uri).rlike(MINIFIED)


def is_asset(uri: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(uri), EXTENSION, 1)).isin(*ASSET_EXTENSIONS)


def is_test_data(uri: Column) -> Column:
    return name_of(uri).rlike(TEST_PATH)


def is_noise(value: Column) -> Column:
    """Placeholder words, one character repeated, references to a variable."""
    lowered = F.lower(value)
    return (
        any_of([lowered.contains(word) for word in PLACEHOLDER_WORDS])
        | (F.replace(value, F.left(value, F.lit(1)), F.lit("")) == "")
        | value.rlike(VARIABLE)
    )


def drop_minified(units: DataFrame) -> DataFrame:
    return units.filter(~is_minified(F.col("uri")))


def drop_assets(units: DataFrame) -> DataFrame:
    return units.filter(~is_asset(F.col("uri")))


def drop_test_data(units: DataFrame) -> DataFrame:
    return units.filter(~is_test_data(F.col("uri")))


def is_likely_false_positive(uri: Column) -> Column:
    return is_minified(uri) | is_asset(uri) | is_test_data(uri)


def drop_likely_false_positives(units: DataFrame, include_all: bool = False) -> DataFrame:
    """The three filters on ``uri``; full coverage keeps everything."""
    return units if include_all else units.filter(~is_likely_false_positive(F.col("uri")))


def drop_noise(findings: DataFrame) -> DataFrame:
    """Drop findings whose value is not a secret; needs the plain ``value``."""
    return findings.filter(~is_noise(F.col("value")))


def in_scope(
    pages: DataFrame, domain: str, subdomains: bool = True, include_all: bool = False, url_col: str = "url"
) -> DataFrame:
    """Pages of a domain and, by default, of its subdomains."""
    if include_all:
        return pages
    name, wanted = host(F.col(url_col)), domain.strip().lower()
    exact = name == wanted
    return pages.filter(exact | name.endswith("." + wanted) if subdomains else exact)


def in_list(pages: DataFrame, domains: DataFrame, subdomains: bool = True, url_col: str = "url") -> DataFrame:
    """Pages of any domain in a table of domains.

    Only the distinct hosts meet the list; the pages, with their texts, are then
    kept by host and do not move while the matching hosts are few enough to broadcast.
    """
    hosts = pages.select(host(F.col(url_col)).alias("__host")).distinct()
    wanted = domains.select(F.lower(F.trim("domain")).alias("__domain")).distinct()
    suffixes = host_suffixes(F.col("__host")) if subdomains else F.array("__host")
    matching = (
        hosts.select("__host", F.explode(suffixes).alias("__domain")).join(wanted, "__domain", "left_semi")
        .select("__host").distinct()
    )
    return semi_join(pages.withColumn("__host", host(F.col(url_col))), matching, "__host").drop("__host")
