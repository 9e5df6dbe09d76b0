"""Column expressions that apply a rule catalogue to a text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import NAMES, SHAPES, Rule

# Prefix sums are taken in blocks, so that a text with very many matches costs
# n * BLOCK steps and not n * n.
BLOCK = 256

BOUNDARY = "[A-Za-z0-9_]"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def entry_gate(rule: Rule) -> tuple[str, str] | None:
    """The first, cheapest gate of a rule: its shape, else its literal."""
    if rule.target == "uri":
        return ("uri", rule.regex)
    if rule.shape is not None:
        return ("shape", rule.shape)
    if rule.literal is not None:
        return ("literal", rule.literal)
    if rule.words:
        return ("words", "|".join(rule.words))
    return None


def gate_column(gate: tuple[str, str], text: Column, uri: Column, named: Column, shaped: Column) -> Column:
    kind, arg = gate
    if kind == "uri":
        return named & uri.rlike(arg)
    if kind == "shape":
        return shaped & text.rlike(SHAPES[arg])
    if kind == "literal":
        return text.contains(arg)
    lowered = F.lower(text)
    return any_of([lowered.contains(word) for word in arg.split("|")])


def names(text: Column) -> Column:
    """The names in a text that something is assigned to, lower-cased, one per line."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(NAMES), F.lit(1)), "\n"))


def rule_condition(rule: Rule, text: Column, lowered: Column, named: Column, uri: Column) -> Column:
    """Whether a rule matches at all, with the gates behind its entry gate in front."""
    subject = uri if rule.target == "uri" else text
    conditions = []
    if rule.literal is not None and rule.shape is not None:
        conditions.append(subject.contains(rule.literal))
    if rule.words:
        conditions.append(any_of([(named if rule.in_name else lowered).contains(word) for word in rule.words]))
    if rule.tail is not None:
        conditions.append(subject.rlike(rule.tail))
    conditions.append(subject.rlike(rule.regex))
    return all_of(conditions)


def running_total(lengths: Column, size: Column) -> Column:
    """Prefix sums of an array of BIGINT, inclusive, block by block."""
    zero = F.lit(0).cast("bigint")

    def total(array: Column) -> Column:
        return F.aggregate(array, zero, lambda acc, x: acc + x)

    blocks = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    parts = F.transform(blocks, lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    # Blocks travel with the totals of the blocks before them: folding keeps both in one pass.
    based = F.aggregate(
        parts,
        F.struct(zero.alias("base"), F.array().cast("array<struct<base:bigint,part:array<bigint>>>").alias("done")),
        lambda acc, part: F.struct(
            (acc["base"] + total(part)).alias("base"),
            F.array_append(acc["done"], F.struct(acc["base"].alias("base"), part.alias("part"))).alias("done"),
        ),
        lambda acc: acc["done"],
    )
    return F.flatten(F.transform(
        based, lambda s: F.transform(s["part"], lambda _, i: s["base"] + total(F.slice(s["part"], F.lit(1), i + 1)))
    ))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, evaluating ``value`` once where ``body`` uses it several times.

    Common subexpressions are not shared inside conditions and lambdas, so the value
    is bound as the element of an array of one.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def lookup(values: Sequence[str], ordinal: Column) -> Column:
    """``values[ordinal - 1]`` as a column: one literal that Spark splits once, while planning."""
    separator = "\x1f"
    assert not any(separator in value for value in values)
    return F.element_at(F.split(F.lit(separator.join(values)), separator, -1), ordinal)
