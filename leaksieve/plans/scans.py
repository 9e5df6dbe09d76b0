"""Whole scans: from a source to masked findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import RULES, Rule, may_span_lines
from ..operators.contexts import CONTEXTS
from ..operators.detect import best_rule, detect, mask
from ..operators.filters import drop_likely_false_positives, drop_noise, in_list, in_scope, is_likely_false_positive
from ..operators.history import removed_since, standing, with_line_numbers
from ..functions.text import host, host_suffixes
from ..operators.links import links, page_budget, reachable, reachable_by_site
from ..session import semi_join, written
from ..sources.files import read_dir, read_file
from ..sources.history import HISTORY_COLUMNS, signed_units, units_from_history
from ..sources.tables import units_from_pages


def scan_units(
    units: DataFrame, rules: Sequence[Rule] = RULES, include_all: bool = False, best_only: bool = False,
    keep: Sequence[str] = (), keep_values: bool = False, salt: str | None = None,
) -> DataFrame:
    """Filters on the name, detection, noise filter, masking.

    ``include_all`` switches the filters on names off; noise in values is dropped
    either way. ``best_only`` keeps one rule per span, at the price of a shuffle of the findings.
    """
    findings = drop_noise(detect(drop_likely_false_positives(units, include_all), rules, keep))
    if best_only:
        findings = best_rule(findings, rules)
    return mask(findings, keep_values, salt)


def scan_file(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """Files that are named are scanned whatever their names."""
    return scan_units(read_file(spark, path), include_all=True, **options)


def scan_dir(spark: SparkSession, path: str, include_all: bool = False, **options) -> DataFrame:
    """A directory; the source applies the filters on names, below the directory."""
    return scan_units(read_dir(spark, path, include_all), include_all=True, **options)


def scan_history(commits: DataFrame, include_all: bool = False, **options) -> DataFrame:
    """Lines that patches add. Filters on names see the path, not the repository's name; rules on names see each file of a commit once."""
    units = units_from_history(commits)
    if not include_all:
        units = units.filter(~is_likely_false_positive(F.col("path")))
    found = scan_units(units, include_all=True, keep=(*HISTORY_COLUMNS, "text"), **options)
    return with_line_numbers(found)


def standing_secrets(commits: DataFrame, rules: Sequence[Rule] = RULES, salt: str | None = None) -> DataFrame:
    """``repo``, ``fingerprint`` and ``n_standing`` of the secrets that the history leaves in the files, without a table of them.

    Values within a line are sought line by line, which makes the sums exact: what a line holds depends on the line alone.
    Values of several lines are sought in lines that a patch adds or removes together; one that goes in pieces counts as standing.
    The history is to be whole and without merges that repeat the patches of their parents.
    """
    texts = [rule for rule in rules if rule.target == "text"]
    single = detect(signed_units(commits), texts, keep=("repo", "sign"))
    # runs are read for the rules whose values can hold a line break
    spanning = [rule for rule in texts if may_span_lines(rule)]
    if spanning:
        several = detect(signed_units(commits, runs=True), spanning, keep=("repo", "sign"))
        single = single.unionByName(several.filter(F.col("value").contains("\n")))
    return standing(mask(single, salt=salt))


def scan_removed(commits: DataFrame, rules: Sequence[Rule] = RULES, salt: str | None = None, **options) -> DataFrame:
    """Findings of the history whose secret is gone from the current files of its repository: what rewriting the history must take out."""
    texts = [rule for rule in rules if rule.target == "text"]
    return removed_since(scan_history(commits, rules=texts, salt=salt, **options), standing_secrets(commits, texts, salt))


def sites_pages(
    pages: DataFrame, domains: DataFrame, depth: int | None = None, max_pages: int | None = None, seeds: DataFrame | None = None,
) -> DataFrame:
    """Stored pages of every listed domain: per domain within ``depth`` links of its seeds and within its own budget.

    All sites are walked at once: the frontier holds (site, url) pairs, so that there is a join per level and none per
    domain. A link counts for a site if the page it is on and the page it leads to are on the domain or a subdomain of it; a page
    below two listed domains belongs to both. Seeds default to all pages on the domain's own host; others are taken for the site of
    that host. Which pages to take is decided on URLs; the pages themselves join that list last.
    """
    if depth is None and max_pages is None:
        return in_list(pages, domains)
    address = F.regexp_replace("url", r"#[^\n]*\z", "")
    sites = domains.select(F.lower(F.trim("domain")).alias("site")).filter("site <> ''").distinct()
    hosts = pages.select(host(F.col("url")).alias("host")).distinct()
    # hosts and the sites that they belong to; written, so that the planner knows how few they are
    member = written(hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("site")).join(sites, "site", "left_semi").distinct(), "sites")
    stored = written(pages.select(address.alias("url"), host(F.col("url")).alias("host")).distinct().join(member, "host").select("site", "url", "host"), "stored")
    if depth is None:
        chosen = stored.select("site", "url")
    else:
        start = stored.filter("host = site").select("site", "url")
        if seeds is not None:
            start = seeds.select(address.alias("url"), host(F.col("url")).alias("site")).join(sites, "site", "left_semi").select("site", "url")
        chosen = reachable_by_site(links(semi_join(pages.withColumn("__host", host(F.col("url"))), member.select(F.col("host").alias("__host")), "__host")), stored, start, depth)
    if max_pages is not None:
        # pages only: a link to a page that is not stored takes nothing from the budget
        chosen = page_budget(chosen.join(stored.select("site", "url"), ["site", "url"], "left_semi"), max_pages, by="site")
    keys = chosen.select(F.col("url").alias("__address"))
    return semi_join(pages.withColumn("__address", address), keys, "__address").drop("__address")


def scan_domains(
    pages: DataFrame, domains: DataFrame, only: Sequence[str] = CONTEXTS, depth: int | None = None, max_pages: int | None = None,
    seeds: DataFrame | None = None, **options,
) -> DataFrame:
    """Findings on the pages of every listed domain, see :func:`sites_pages`."""
    return scan_units(units_from_pages(sites_pages(pages, domains, depth, max_pages, seeds), only, spread_out=False), **options)


def site_pages(
    pages: DataFrame, domain: str, depth: int | None = None, max_pages: int | None = None,
    seeds: DataFrame | None = None, include_all: bool = False,
) -> DataFrame:
    """Stored pages of one site: in scope, within ``depth`` links of the seeds, within the budget.

    Seeds default to all pages of the domain's own host. Which pages to take is
    decided on URLs; the pages themselves join that list last.
    """
    scoped = in_scope(pages, domain, include_all=include_all)
    if depth is None and max_pages is None:
        return scoped
    address = F.regexp_replace("url", r"#[^\n]*\z", "")
    if depth is None:
        chosen = scoped.select(address.alias("url")).distinct()
    else:
        start = in_scope(scoped, domain, subdomains=False) if seeds is None else seeds
        near = reachable(links(scoped), start.select(address.alias("url")), depth)
        chosen = in_scope(near, domain, include_all=include_all)
    if max_pages is not None:
        # pages only: a link to a page that is not stored takes nothing from the budget
        stored = scoped.select(address.alias("url")).distinct()
        chosen = page_budget(chosen.join(stored, "url", "left_semi").withColumn("site", F.lit(domain)), max_pages, by="site")
    keys = chosen.select(F.col("url").alias("__address"))
    return semi_join(scoped.withColumn("__address", address), keys, "__address").drop("__address")


def scan_site(
    pages: DataFrame, domain: str, depth: int | None = None, max_pages: int | None = None,
    seeds: DataFrame | None = None, include_all: bool = False, only: Sequence[str] = CONTEXTS, **options,
) -> DataFrame:
    """Findings on the pages of one site, see :func:`site_pages`."""
    chosen = site_pages(pages, domain, depth, max_pages, seeds, include_all)
    return scan_units(units_from_pages(chosen, only, spread_out=False), include_all=include_all, **options)
