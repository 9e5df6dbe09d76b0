"""Commit patches as units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import added_runs, signed_lines, signed_runs

HISTORY_COLUMNS = ("repo", "commit_id", "seq", "path", "line_no")


def units_from_history(commits: DataFrame) -> DataFrame:
    """Runs of added lines as units, so that a secret of several lines is found in the commit that brought it.

    ``line_no`` is that of a run's first line, see :func:`leaksieve.operators.history.with_line_numbers`. Carry ``HISTORY_COLUMNS`` through detection with ``keep``.
    """
    lines = added_runs(commits)
    return lines.select(
        F.concat_ws(":", "repo", "commit_id", "path", F.col("line_no").cast("string")).alias("unit_id"),
        F.concat_ws("/", "repo", "path").alias("uri"),
        F.lit("raw").alias("context"),
        "text", "named", *HISTORY_COLUMNS,
    )


def signed_units(commits: DataFrame, runs: bool = False) -> DataFrame:
    """Changed lines as units with their ``repo`` and ``sign``; with ``runs`` those that follow each other as one unit.

    Rules on names see none of them: a patch that removes lines leaves the name.
    """
    lines = signed_runs(commits) if runs else signed_lines(commits)
    return lines.select(
        F.concat_ws(":", "repo", "commit_id", "path").alias("unit_id"), F.concat_ws("/", "repo", "path").alias("uri"),
        F.lit("raw").alias("context"), "text", F.lit(False).alias("named"), "repo", "sign",
    )
