"""Commit history: lines that patches add, and when secrets came and went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import let

HUNK = r"\n@@ -[0-9]+(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))? @@[^\n]*"


KEYS = ("repo", "commit_id", "seq", "ts", "path")
FILE = r"\ndiff --git [^\n]*"


def _count(digits: Column) -> Column:
    """The number of lines that a hunk header gives; none means one."""
    return F.when(digits == "", F.lit(1)).otherwise(F.coalesce(F.least(digits.try_cast("bigint"), F.lit(2**31 - 1)), F.lit(2**31 - 1)).cast("int"))


def _hunks(commits: DataFrame) -> tuple[DataFrame, Column, Column]:
    """One row per hunk, the lines that it leaves in the new file and those that it had in the old one, in order.

    In a hunk, removed lines and
    remarks do not exist in the new file; what is left is numbered from the start
    that the hunk header gives, and ends after the number of lines it gives. So a
    line knows its number without looking at other rows: no window, no shuffle, and
    ``+++`` headers of a following file are not taken for content. A patch may hold
    several files behind ``diff --git`` lines; each is booked under its own name.
    """
    files = F.split(F.concat(F.lit("\n"), F.col("patch")), FILE, -1)
    commits = commits.select("*", F.inline(let(files, lambda own: F.transform(own, lambda file: F.struct((F.size(own) > 1).alias("__several"), file.alias("__file"))))))
    own = F.regexp_extract(F.regexp_extract("__file", r"(?s)\A(.*?)(?:\n@@ |\z)", 1), r"\n[+]{3} (?:b/)?([^\t\n]+)", 1)
    commits = commits.withColumn("path", F.when(F.col("__several") & ~own.isin("", "/dev/null"), own).otherwise(F.col("path")))
    patch = F.concat(F.lit("\n"), F.col("__file"))
    # piece 0 lies before the first hunk
    hunks = F.zip_with(
        let(F.split(patch, HUNK, -1), lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))),
        F.arrays_zip(
            F.regexp_extract_all(patch, F.lit(HUNK), F.lit(1)).alias("old"),
            F.regexp_extract_all(patch, F.lit(HUNK), F.lit(2)).alias("first"),
            F.regexp_extract_all(patch, F.lit(HUNK), F.lit(3)).alias("count"),
        ),
        lambda body, head: F.struct(
            head["first"].try_cast("bigint").alias("first"),
            _count(head["count"]).alias("count"),
            _count(head["old"]).alias("old"),
            body.alias("body"),
        ),
    )
    def numbered(own: Column) -> Column:
        # the first hunk that adds a line speaks for the file's name
        first = F.array_position(F.transform(own, lambda h: h["body"].contains("\n+")), F.lit(True))
        return F.transform(own, lambda h, i: F.struct(h["first"].alias("first"), h["count"].alias("count"), h["old"].alias("old"), h["body"].alias("body"), (i + 1 == first).alias("leading")))

    per_hunk = commits.select(*KEYS, F.inline(let(hunks, numbered)))
    body = F.split(F.expr("substring(body, 2)"), "\n", -1)
    new = F.filter(body, lambda line: ~(line.startswith("-") | line.startswith("\\")))
    old = F.filter(body, lambda line: ~(line.startswith("+") | line.startswith("\\")))
    return per_hunk, F.slice(new, F.lit(1), F.col("count")), F.slice(old, F.lit(1), F.col("old"))


def added_lines(commits: DataFrame) -> DataFrame:
    """Every added line of every patch, with its line number in the new file.

    ``commits`` has ``repo, commit_id, seq, ts, path, patch``; a patch is a unified
    diff, with or without file headers.
    """
    per_hunk, lines, _ = _hunks(commits)
    return (
        per_hunk.select(*KEYS, "first", F.posexplode(lines).alias("pos", "line"))
        .filter(F.col("line").startswith("+"))
        .select(
            *KEYS, (F.col("first") + F.col("pos")).cast("bigint").alias("line_no"),
            F.expr("substring(line, 2)").alias("text"),
        )
    )


def signed_lines(commits: DataFrame) -> DataFrame:
    """Every line that a patch adds (``sign`` 1) or removes (``sign`` -1), without a number, in patch order per hunk and sign."""
    per_hunk, new, old = _hunks(commits)

    def side(lines: Column, mark: str, sign: int) -> Column:
        return F.transform(F.filter(lines, lambda line: line.startswith(mark)), lambda line: F.struct(F.lit(sign).cast("bigint").alias("sign"), F.substring(line, 2, 2**31 - 1).alias("text")))

    return per_hunk.select(*KEYS, F.inline(F.concat(side(new, "+", 1), side(old, "-", -1))))


def _runs(own: Column, mark: str) -> Column:
    """Marked lines that follow each other as (place of the first, whether it is the first run, text)."""
    def marked(i: Column) -> Column:
        return F.coalesce(F.get(own, i).startswith(mark), F.lit(False))

    places = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: marked(i) & ~marked(i - 1))
    ends = F.filter(places, lambda i: marked(i) & ~marked(i + 1))
    whole = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    return F.transform(whole, lambda r, i: F.struct(
        r["s"].alias("pos"), (i == 0).alias("initial"),
        F.array_join(F.transform(F.slice(own, r["s"] + 1, r["e"] - r["s"] + 1), lambda l: F.substring(l, 2, 2**31 - 1)), "\n").alias("text")))


def signed_runs(commits: DataFrame) -> DataFrame:
    """What patches add (``sign`` 1) and remove (``sign`` -1), lines that follow each other as one text, for values of several lines."""
    per_hunk, new, old = _hunks(commits)

    def side(lines: Column, mark: str, sign: int) -> Column:
        return F.transform(let(lines, lambda own: _runs(own, mark)), lambda run: F.struct(F.lit(sign).cast("bigint").alias("sign"), run["text"].alias("text")))

    return per_hunk.select(*KEYS, F.inline(F.concat(side(new, "+", 1), side(old, "-", -1))))


def added_runs(commits: DataFrame) -> DataFrame:
    """Added lines that follow each other as one text each, with the number of the first line; ``named`` is the first run of a file."""
    per_hunk, lines, _ = _hunks(commits)
    found = per_hunk.select(*KEYS, "first", "leading", F.inline(let(lines, lambda own: _runs(own, "+"))))
    return found.select(*KEYS, (F.col("first") + F.col("pos")).cast("bigint").alias("line_no"), "text", (F.col("leading") & F.col("initial")).alias("named"))


def with_line_numbers(findings: DataFrame) -> DataFrame:
    """Findings that kept ``line_no`` and ``text`` of their run, with the number of the line that they begin on."""
    before = F.substring(F.col("text"), F.lit(1), F.col("start").cast("int"))
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    # a name has its place in the name
    return findings.withColumn("line_no", F.when(F.col("context") == "uri", F.col("line_no")).otherwise(F.col("line_no") + breaks)).drop("text")


def first_seen(findings: DataFrame) -> DataFrame:
    """First commit of each secret.

    A minimum over a struct instead of a window: a secret that fills the history
    leaves every map task as one row.
    """
    where = F.struct("seq", "commit_id", "uri", "unit_id", "start", "type")
    return findings.groupBy("fingerprint").agg(F.min(where).alias("first"), F.count("*").alias("n_findings")).select(
        "fingerprint", "n_findings", *[F.col(f"first.{c}").alias(c) for c in ("seq", "commit_id", "uri", "unit_id", "start", "type")]
    )


def history_only(history: DataFrame, head: DataFrame) -> DataFrame:
    """Findings of the history whose secret is not in the current state.

    The current state is reduced to distinct fingerprints first. Findings carry no
    texts; a fingerprint that dominates the history is split by AQE on that side.
    """
    return history.join(head.select("fingerprint").distinct(), "fingerprint", "left_anti")


def standing(found: DataFrame) -> DataFrame:
    """Secrets that the patches of a repository leave in its files, from masked findings with ``repo`` and ``sign``.

    A line that is added counts 1, one that is removed counts -1, so the sum over the whole history is the number of times
    that the secret stands in the current files, in whatever order patches come. Sums are over a repository, not over a path: a renamed
    file takes its unchanged lines along without a patch that shows them. Counts are summed in the map tasks, so that a secret
    which fills the history leaves each of them as one row.
    """
    return found.groupBy("repo", "fingerprint").agg(F.sum("sign").alias("n_standing")).filter("n_standing > 0")


def removed_since(history: DataFrame, standing: DataFrame) -> DataFrame:
    """Findings of the history whose secret is in no current file of the same repository."""
    return history.join(standing.select("repo", "fingerprint"), ["repo", "fingerprint"], "left_anti").select(*history.columns)
