"""The page graph: links, hosts, reachability, page budgets. All on stored pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.matching import let
from ..functions.text import decode_entities, host, origin
from ..session import written

REFERENCE_DOUBLE = r"""(?is)\s(?:href|src)\s*=\s*"([^"]*)\""""
REFERENCE_SINGLE = r"(?is)\s(?:href|src)\s*=\s*'([^']*)'"
REFERENCE_PLAIN = r"""(?is)\s(?:href|src)\s*=\s*([^\s"'<>=`]+)"""
BASE = r"""(?is)<base\s[^<>]*href\s*=\s*["']?([^\s"'<>]+)"""
ABSOLUTE = r"^(?i:https?)://"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
SALTS = 64


def without_dots(url: Column) -> Column:
    """An absolute URL with the ``.`` and ``..`` segments of its path carried out."""
    lead = origin(url)
    rest = F.substring(url, F.length(lead) + 1, F.length(url))
    path = F.regexp_extract(rest, r"\A([^?#]*)", 1)
    tail = F.substring(rest, F.length(path) + 1, F.length(rest))
    segments = F.split(path, "/", -1)

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.array_append(kept, segment))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"), step)
    # a path that ends with such a segment names a folder
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(url.rlike(r"/[.]"), F.concat(lead, F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(url)


def resolve(base: Column, reference: Column) -> Column:
    """Absolute URL of a reference found on page ``base``; null if it is not a link to a page. The fragment is dropped."""
    return let(_joined(base, reference), without_dots)


def _joined(base: Column, reference: Column) -> Column:
    return let(F.regexp_replace(F.trim(reference), r"#[^\n]*\z", ""), lambda ref: _joined_to(base, ref))


def _joined_to(base: Column, ref: Column) -> Column:
    page = F.regexp_replace(base, r"[?#][^\n]*\z", "")
    folder = F.when(page == origin(base), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*\z", ""))
    return (
        F.when(ref == "", F.lit(None))
        .when(ref.rlike(ABSOLUTE), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), ref))
        .when(ref.rlike(OTHER_SCHEME), F.lit(None))
        .when(ref.startswith("/"), F.concat(origin(base), ref))
        .when(ref.startswith("?"), F.concat(page, ref))
        .otherwise(F.concat(folder, ref))
    )


def _references(pages: DataFrame) -> DataFrame:
    """Links of each page, without repeats on the page. Narrow."""
    # a base address is no link
    references = let(F.regexp_replace("html", BASE, ""), lambda html: F.concat(*(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)) for pattern in (REFERENCE_DOUBLE, REFERENCE_SINGLE, REFERENCE_PLAIN))))
    read = pages.select(
        F.regexp_replace("url", r"#[^\n]*\z", "").alias("src"), F.regexp_extract("html", BASE, 1).alias("given"), references.alias("references"))
    base = F.when(F.col("given") == "", F.col("src")).otherwise(F.coalesce(resolve(F.col("src"), let(F.col("given"), decode_entities)), F.col("src")))
    found = read.select("src", base.alias("base"), F.explode(F.array_distinct("references")).alias("reference"))
    return (
        found.select("src", resolve(F.col("base"), let(F.col("reference"), decode_entities)).alias("dst"))
        .filter(F.col("dst").isNotNull())
    )


def links(pages: DataFrame) -> DataFrame:
    """Distinct links ``(src, dst)`` of all pages. The page text is dropped before the shuffle."""
    return _references(pages).distinct()


def subdomains(pages: DataFrame, domain: str) -> DataFrame:
    """Hosts of a domain, as far as the urls and links of the stored pages show them.

    Links are reduced to hosts, and those to distinct ones, before anything is shuffled.
    """
    wanted = domain.strip().lower()
    hosts = F.array(host(F.col("src")), host(F.col("dst")))
    linked = _references(pages).select(F.explode(hosts).alias("host"))
    seen = pages.select(host(F.col("url")).alias("host")).union(linked)
    return seen.filter((F.col("host") == wanted) | F.col("host").endswith("." + wanted)).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Pages within ``depth`` links of the seeds: ``(url, depth)`` with the smallest depth.

    ``edges`` is ``(src, dst)``, ``seeds`` has ``url``. Breadth first: each level joins
    the frontier with the edges and removes what was seen before, so cycles end and
    paths do not multiply. Edges and levels are written out, so no level recomputes
    an earlier one or the extraction of the links. A target that many pages link to
    collapses before it is shuffled.
    """
    edges = written(edges.select("src", "dst"), "edges")
    level = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    levels = [level]
    for step in range(1, depth + 1):
        visited = reduce(DataFrame.unionAll, levels).select("url")
        frontier = level.select(F.col("url").alias("src"))
        level = written(
            edges.join(frontier, "src", "left_semi").select(F.col("dst").alias("url")).distinct()
            .join(visited, "url", "left_anti").withColumn("depth", F.lit(step)),
            "level",
        )
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionAll, levels)


def reachable_by_site(edges: DataFrame, stored: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """For many sites at once, pages within ``depth`` links of a site's seeds: ``(site, url, depth)`` with the smallest depth.

    ``edges`` is ``(src, dst)``, ``stored`` the pages of each site ``(site, url)``, ``seeds`` has the same columns. A walk goes on
    from stored pages only and stays on the site: its domain and subdomains. As in :func:`reachable` each level is one join and
    is written, and what a site has seen it does not visit again; links to one target collapse before they are shuffled.
    """
    hops = written(edges.select("src", "dst", host(F.col("dst")).alias("__to")), "edges")
    level = written(seeds.select("site", "url").distinct().withColumn("depth", F.lit(0)), "level")
    levels = [level]
    on_site = (F.col("__to") == F.col("site")) | F.col("__to").endswith(F.concat(F.lit("."), F.col("site")))
    for step in range(1, depth + 1):
        frontier = level.join(stored.select("site", "url"), ["site", "url"], "left_semi").select("site", F.col("url").alias("src"))
        visited = reduce(DataFrame.unionAll, levels).select("site", "url")
        reached = hops.join(frontier, "src").filter(on_site).select("site", F.col("dst").alias("url")).distinct()
        level = written(reached.join(visited, ["site", "url"], "left_anti").withColumn("depth", F.lit(step)), "level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionAll, levels)


def page_budget(pages: DataFrame, n: int, by: str | None = None, url_col: str = "url") -> DataFrame:
    """At most ``n`` pages per host, or per column ``by``: nearest first, then by URL.

    Ranks are taken within salts of a host first, so that a host with a large share
    of all pages is ranked by many tasks; the final rank sees at most ``n`` pages per salt.
    ``depth`` counts when there is such a column.
    """
    key = host(F.col(url_col)) if by is None else F.col(by)
    order = [F.col(url_col)] if "depth" not in pages.columns else [F.col("depth"), F.col(url_col)]
    # several copies of one address: the least page_id, or a hash of the row where there is none
    order.append(F.col("page_id") if "page_id" in pages.columns else F.xxhash64(*pages.columns))
    salted = pages.withColumns({"__key": key, "__salt": F.pmod(F.xxhash64(url_col), F.lit(SALTS))})
    within_salt = F.row_number().over(W.partitionBy("__key", "__salt").orderBy(*order))
    overall = F.row_number().over(W.partitionBy("__key").orderBy(*order))
    return (
        salted.withColumn("__rank", within_salt).filter(F.col("__rank") <= n)
        .withColumn("__rank", overall).filter(F.col("__rank") <= n)
        .drop("__key", "__salt", "__rank")
    )


