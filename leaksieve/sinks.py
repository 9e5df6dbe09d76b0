"""Outputs: text report, structured findings, CI gate (see ``operators.grouping.gate``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written

# Layout of one finding in the text report.
RULER = "-" * 50
# Lines that a verbose report adds.
VERBOSE = (("Context", "context"), ("Unit", "unit_id"), ("Rule", "rule_id"), ("Fingerprint", "fingerprint"))
ORDER = ("uri", "start", "end", "type", "context", "unit_id")


def report_blocks(findings: DataFrame, value_col: str = "value_masked", verbose: bool = False) -> DataFrame:
    """The text block of every finding, with the columns that order the report.

    Units named by a URL are labelled ``URL``, all others ``File``. ``verbose`` adds where and by which rule it was found.
    """
    label = F.when(F.col("uri").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & ~F.col("uri").startswith("file:"), "URL").otherwise("File")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Type: "), "type"),
        F.concat(F.lit("Value: "), value_col),
        F.concat(F.lit("Position: "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")),
        F.concat(label, F.lit(": "), "uri"),
        *([F.concat(F.lit(f"{name}: "), column) for name, column in VERBOSE] if verbose else []),
        F.lit(RULER),
    )
    return findings.select(*[c for c in ORDER if c in findings.columns], block.alias("block"))


def write_report(findings: DataFrame, path: str, value_col: str = "value_masked", verbose: bool = False) -> None:
    """Write the report, grouped by file or URL.

    The parts of the output, read in order of their names, are sorted by URI and
    position. Ranges are cut on the position as well as on the URI, so a URI with
    very many findings spreads over several tasks and stays contiguous. Range
    partitioning samples its input first; the blocks are written out before, so
    that the scan behind them runs once.
    """
    blocks = written(report_blocks(findings, value_col, verbose), "report")
    order = [c for c in ORDER if c in blocks.columns]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("block").write.mode("overwrite").text(path)


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write findings by type. Rebalancing keeps a type from becoming one task or many small files."""
    findings.hint("rebalance", "type").write.mode(mode).partitionBy("type").format(fmt).save(path)
