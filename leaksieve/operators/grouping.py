"""Grouping, counting and comparing findings.

Texts never enter a shuffle here: findings are small, and every aggregate combines
on the map side, so one URI, type or fingerprint that holds a large share of all
findings leaves each map task as a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRIEF = ("uri", "type", "value_masked", "start", "end")
VERBOSE = BRIEF + ("context", "unit_id", "rule_id", "fingerprint")

# Findings of one unit are listed in pieces of this many characters of text, so that
# no list grows with the size of a unit.
SPAN = 65_536


def by_unit(findings: DataFrame) -> DataFrame:
    """One row per file or URL: findings, different secrets, and the types found.

    A secret that shows in several contexts of a page is several findings and one secret.
    """
    per_secret = findings.groupBy("uri", "fingerprint").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    return per_secret.groupBy("uri").agg(
        F.sum("n").alias("n_findings"), F.count("*").alias("n_secrets"),
        # no type of the catalogue more than once
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
    )


def listed_by_unit(findings: DataFrame, span: int = SPAN) -> DataFrame:
    """Findings grouped by file or URL, as arrays in order of position.

    The key is (uri, unit, piece of text). The list of a piece is bounded by its
    length; a URI that many units share, or a unit with very many findings,
    becomes several rows.
    """
    piece = F.floor(F.col("start") / span).cast("bigint")
    entry = F.struct("start", "end", "type", "value_masked")
    return (
        findings.groupBy("uri", "unit_id", piece.alias("piece"))
        .agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_list(entry)).alias("findings"))
    )


def by_type(findings: DataFrame) -> DataFrame:
    """Findings and distinct secrets per type, in two steps so that no type is one task."""
    return (
        findings.groupBy("type", "fingerprint").agg(F.count("*").alias("n"))
        .groupBy("type").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_secrets"))
    )


def project(findings: DataFrame, verbose: bool = False) -> DataFrame:
    """The brief or the verbose columns of masked findings."""
    return findings.select(*(VERBOSE if verbose else BRIEF))


def scan_summary(units: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Per source: units, units with findings, findings. ``by`` is kept in both tables.

    Both sides are reduced to one row per source before they meet, and the count of
    units reads the ``by`` column alone.
    """
    counted = units.groupBy(by).agg(F.count("*").alias("n_units"))
    found = (
        findings.groupBy(by, "unit_id").agg(F.count("*").alias("n"))
        .groupBy(by).agg(F.count("*").alias("n_units_with_findings"), F.sum("n").alias("n_findings"))
    )
    zero = F.lit(0).cast("bigint")
    # null is a source like any other
    return (
        counted.alias("u").join(found.alias("f"), F.col(f"u.{by}").eqNullSafe(F.col(f"f.{by}")), "left")
        .select(
            F.col(f"u.{by}").alias(by), "n_units",
            F.coalesce("n_units_with_findings", zero).alias("n_units_with_findings"),
            F.coalesce("n_findings", zero).alias("n_findings"),
        )
    )


def shared_secrets(findings: DataFrame, min_units: int = 2) -> DataFrame:
    """Secrets found in several files or URLs."""
    return (
        findings.groupBy("fingerprint", "uri").agg(F.count("*").alias("n"))
        .groupBy("fingerprint").agg(F.count("*").alias("n_uris"), F.sum("n").alias("n_findings"))
        .filter(F.col("n_uris") >= min_units)
    )


def clean_units(units: DataFrame, findings: DataFrame) -> DataFrame:
    """Files or URLs without findings. Both sides are made distinct before they are joined."""
    return units.select("uri").distinct().join(findings.select("uri").distinct(), "uri", "left_anti")


def gate(findings: DataFrame, max_allowed: int = 0) -> DataFrame:
    """One row for a CI gate: how many findings, and whether that is acceptable."""
    return findings.agg(F.count("*").alias("n_findings")).select(
        "n_findings", (F.col("n_findings") <= max_allowed).alias("passed")
    )
