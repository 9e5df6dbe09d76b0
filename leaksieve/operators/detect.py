"""Detection: one row per match of every rule, with exact positions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import ANY_SHAPE, RULES, Rule
from ..functions.matching import BOUNDARY, any_of, entry_gate, gate_column, lookup, names, rule_condition, running_total


def _with_context(units: DataFrame) -> DataFrame:
    return units if "context" in units.columns else units.withColumn("context", F.lit("raw"))


def _gates(rules: Sequence[Rule]) -> dict[tuple[str, str], int]:
    """Distinct entry gates and the place of each in the ``__gates`` array."""
    return {gate: i for i, gate in enumerate(dict.fromkeys(g for g in map(entry_gate, rules) if g is not None))}


@lru_cache(maxsize=32)
def _expressions(rules: tuple[Rule, ...], session: int) -> tuple[Column, Column, Column, Column, Column]:
    """The columns ``__shaped``, ``__gates``, ``__lower`` and ``__names``, and the array of matching rule ordinals.

    Gates are evaluated once per unit, shapes only behind the pass that all of them
    imply, the lower-cased text only where a rule with ``words`` can still match.
    Every regex is a literal, so it is compiled once. The gates share one array
    column: many aliases of expressions that also occur in each other would make
    Spark's constraint propagation exponential.

    The expressions name their input columns and nothing else about the table, so
    they are built once per catalogue: making hundreds of columns from Python takes
    longer than scanning a small table. ``session`` tells JVMs apart.
    """
    text, uri = F.col("text"), F.col("uri")
    gates = _gates(rules)
    passed = {gate: F.get(F.col("__gates"), F.lit(i)) for gate, i in gates.items()}
    lowering = dict.fromkeys(entry_gate(rule) for rule in rules if rule.words and not rule.in_name)
    naming = dict.fromkeys(entry_gate(rule) for rule in rules if rule.in_name)
    shaped = text.rlike(ANY_SHAPE) if any(kind == "shape" for kind, _ in gates) else F.lit(False)
    gated = F.array(*[gate_column(gate, text, uri, F.col("__named"), F.col("__shaped")) for gate in gates]).cast("array<boolean>")
    lower = F.when(any_of([passed[gate] for gate in lowering]), F.lower(text))
    assigned = F.when(any_of([passed[gate] for gate in naming]), names(text))

    groups: dict[tuple[str, str] | None, list[Column]] = {}
    for ordinal, rule in enumerate(rules, start=1):
        condition = rule_condition(rule, text, F.col("__lower"), F.col("__names"), uri)
        groups.setdefault(entry_gate(rule), []).append(F.when(condition, F.lit(ordinal)))
    none = F.array().cast("array<int>")
    arrays = [
        F.array(*members) if gate is None else F.when(passed[gate], F.array(*members)).otherwise(none)
        for gate, members in groups.items()
    ]
    return shaped, gated, lower, assigned, F.array_compact(F.concat(none, *arrays))


def _gated(units: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, Column]:
    """Units with helper columns, and the array of matching rule ordinals as an expression."""
    shaped, gated, lower, assigned, hits = _expressions(tuple(rules), id(units.sparkSession.sparkContext))
    return units.withColumn("__shaped", shaped).withColumn("__gates", gated).withColumn("__lower", lower).withColumn("__names", assigned), hits


def with_hits(units: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``__hits``, the ordinals (from 1) of the rules that match each unit."""
    gated, hits = _gated(units.withColumn("__named", F.lit(True)), rules)
    return gated.withColumn("__hits", hits).drop("__shaped", "__gates", "__lower", "__names", "__named")


def detect(units: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = (), names_once: bool = False) -> DataFrame:
    """Apply all rules: one row per match, see :func:`_detect`.

    With ``names_once`` rules on names report each ``uri`` once, whatever the number of units that share it: the names that are
    hit are grouped, and the least unit of each reports it. Texts stay out of that shuffle. Streams have no such memory.
    """
    on_names = [rule for rule in rules if rule.target == "uri"]
    if not names_once or units.isStreaming or not on_names:
        return _detect(units, rules, keep)
    units = _with_context(units)
    kept = [c for c in keep if c not in ("uri", "text")]
    hit = units.filter(any_of([F.col("uri").rlike(rule.regex) for rule in on_names])).select("uri", "unit_id", *kept)
    first = hit.groupBy("uri").agg(F.min(F.struct("unit_id", *kept)).alias("first"))
    files = first.select("uri", "first.*", F.lit("uri").alias("context"), F.lit("").alias("text"))
    texts = [rule for rule in rules if rule.target != "uri"]
    found = _detect(files, on_names, keep)
    return _detect(units, texts, keep).unionByName(found) if texts else found


def _detect(units: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """Apply all rules to every unit: one row per match, in batch and in streaming alike.

    ``units`` has ``unit_id``, ``uri``, ``text`` and optionally ``context`` and ``named``; columns
    named in ``keep`` are carried along. Positions are 0-based code points, half
    open, and span the value. Matches of one rule do not overlap; matches of
    different rules may, see :func:`best_rule`.

    Rules on names look at the ``uri`` of units that are ``named``: sources that make several units of one page or
    file set it on the first of them, so that a name is reported once without a look at other rows. Without that column all units are.

    The whole operator is narrow. Projections decide which rules hit; only the
    (unit, rule) pairs that hit go on to the part that extracts values and positions.
    """
    units = _with_context(units)
    named = F.col("named") if "named" in units.columns else F.lit(True)
    units = units.select("unit_id", "uri", "context", "text", named.alias("__named"), *keep)
    # The array goes into explode as an expression: over a named column Spark would
    # infer a filter on its size and evaluate all the regexes a second time. There is
    # no filter on the gates either: it would be pushed below the repartitioning of a
    # small input and run there on few cores. Units without hits end at the explode.
    gated, hits = _gated(units, rules)
    hits = gated.select("unit_id", "uri", "context", *keep, "text", F.explode(hits).alias("__rule"))

    def of_rule(attribute: str) -> Column:
        return lookup([getattr(rule, attribute) for rule in rules], F.col("__rule"))

    def is_one_of(chosen: Sequence[int]) -> Column:
        return F.col("__rule").isin(*chosen) if chosen else F.lit(False)

    on_uri = is_one_of([i for i, rule in enumerate(rules, start=1) if rule.target == "uri"])
    bounded = is_one_of([i for i, rule in enumerate(rules, start=1) if rule.bounded])
    subject = F.when(on_uri, F.col("uri")).otherwise(F.col("text"))
    matched = hits.select(
        "unit_id", "uri", *keep,
        F.when(on_uri, F.lit("uri")).otherwise(F.col("context")).alias("context"),
        "__rule", subject.alias("__subject"), of_rule("regex").alias("__regex"),
    ).select(
        "unit_id", "uri", *keep, "context", "__rule",
        F.regexp_extract_all("__subject", F.col("__regex"), F.lit(0)).alias("__match"),
        F.regexp_extract_all("__subject", F.col("__regex"), F.lit(2)).alias("__value"),
        F.split("__subject", F.col("__regex"), -1).alias("__gap"),
    )

    # A match ends where all gaps and matches up to it have been passed, and its value ends with it.
    lengths = F.transform("__match", lambda m, i: (F.length(F.get("__gap", i)) + F.length(m)).cast("bigint"))
    ends = matched.withColumn("__length", lengths).withColumn(
        "__end", running_total(F.col("__length"), F.size("__length"))
    )

    def row(match: Column, i: Column) -> Column:
        value, end = F.get("__value", i), F.get("__end", i)
        gap, following = F.get("__gap", i + 1), F.get("__match", i + 1)
        return F.struct(
            value.alias("value"),
            (end - F.length(value)).alias("start"),
            end.alias("end"),
            # the character after the match: from the next gap, or from the next match if they touch
            F.when(F.length(gap) > 0, F.substring(gap, 1, 1)).otherwise(F.substring(following, 1, 1)).alias("__next"),
        )

    found = ends.select("unit_id", "uri", *keep, "context", "__rule", F.inline(F.transform("__match", row)))
    cut = bounded & F.coalesce(F.col("__next").rlike(BOUNDARY), F.lit(False))
    for following in sorted({rule.followed for rule in rules if rule.followed}):
        asked = is_one_of([i for i, rule in enumerate(rules, start=1) if rule.followed == following])
        cut = cut | (asked & (F.coalesce(F.col("__next"), F.lit("")) != following))
    return found.filter(~cut).select(
        "uri", of_rule("type").alias("type"), "value", "start", "end", "context", "unit_id",
        of_rule("rule_id").alias("rule_id"), *keep,
    )


def mask(findings: DataFrame, keep_values: bool = False, salt: str | None = None) -> DataFrame:
    """Add ``value_masked`` and ``fingerprint`` and, by default, drop the plain value.

    Values shorter than 16 characters are masked whole. With ``salt`` the
    fingerprints cannot be compared with those of a run under another salt.
    """
    value = F.col("value")
    salted = value if salt is None else F.concat(F.lit(salt), value)
    masked = findings.withColumns({
        "value_masked": F.when(
            F.length(value) >= 16, F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4)))
        ).otherwise(F.lit("***")),
        "fingerprint": F.sha2(salted, 256),
    })
    return masked if keep_values else masked.drop("value")


def best_rule(findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One finding per span: the most specific rule wins, then the smaller rule id.

    A minimum over a struct, so every map task sends one row per span.
    """
    ranked = {rank: [r.rule_id for r in rules if r.rank == rank] for rank in sorted({r.rank for r in rules})}
    rank = F.coalesce(*[F.when(F.col("rule_id").isin(ids), F.lit(rank)) for rank, ids in ranked.items()])
    span = ["unit_id", "uri", "context", "start", "end"]
    rest = [c for c in findings.columns if c not in span and c != "rule_id"]
    best = findings.groupBy(*span).agg(
        F.min(F.struct(rank.alias("rank"), F.col("rule_id"), *rest)).alias("best")
    )
    return best.select(*[F.col(c) if c in span else F.col(f"best.{c}").alias(c) for c in findings.columns])

