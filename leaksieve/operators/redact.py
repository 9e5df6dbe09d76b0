"""Redaction: the text of each unit with every secret replaced."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import RULES, SHAPES, Rule
from ..functions.matching import let, lookup, names
from .detect import with_hits


# an escape, a class or a character
_ATOM = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.DOTALL)


def _meets_labels(rule: Rule, labels: Sequence[str]) -> bool:
    """Whether a match of the rule can hold a part of a label; in doubt it can.

    A match that holds a part of a label and text beside it holds a bracket.
    """
    regex = rule.regex + re.escape(rule.followed)
    atoms = _ATOM.findall(re.sub(r"\(\?i?:", "(", regex))
    odd = ("\\b", "\\B", "\\A", "\\G", "\\Z", "\\z", "\\Q", "$")
    if "(?" in "".join(a for a in atoms if len(a) == 1) or any(a in odd or "&&" in a for a in atoms):
        return True
    try:
        if any(re.fullmatch(a, c) for a in atoms if len(a) > 1 or a in ".[]" for c in "[]"):
            return True
        return any(re.search(regex, label) for label in labels)
    except re.error:
        return True


def redact(units: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Replace what each rule matches by ``[REDACTED:type]``, rule after rule.

    A text that no rule hits cannot change, nor one before the first rule that hits it, so
    the chain begins there. From it on the rules are folded over the text: those that hit it, and those
    that could match a part of a label together with what is beside it. A rule is skipped where the text, as it stands
    at that point, lacks what a match of the rule implies. A match that detection drops
    for its right boundary is redacted all the same: this errs on the side of hiding
    too much. The labels themselves are placeholders to ``drop_noise``, so a scan of
    redacted text reports nothing.
    """
    text_rules = [rule for rule in rules if rule.target == "text"]
    # what a match of the rule cannot do without, '' where there is none: its literal, else its one word, in lower case
    words = [rule.literal or (rule.words[0] if len(rule.words) == 1 else "") for rule in text_rules]
    # the cheap regex that it implies; the empty one matches always
    implied = [rule.tail or (SHAPES[rule.shape] if rule.shape else "") for rule in text_rules]
    in_name = [i for i, rule in enumerate(text_rules, start=1) if rule.in_name and not rule.literal]
    lowered = [i for i, rule in enumerate(text_rules, start=1) if rule.words and not rule.in_name and not rule.literal]
    labels = [f"[REDACTED:{rule.type}]" for rule in text_rules]
    opened = [i for i, rule in enumerate(text_rules, start=1) if _meets_labels(rule, labels)]
    first = F.array_min("__hits")
    later = F.filter(F.lit(opened).cast("array<int>") if opened else F.array().cast("array<int>"), lambda i: i > first)
    ordinals = F.array_sort(F.array_union("__hits", later))

    def state(text: Column) -> Column:
        return F.struct(text.alias("text"), names(text).alias("names"))

    def step(acc: Column, i: Column) -> Column:
        # what must follow the value is matched, too, and put back
        regex = lookup([rule.regex + rule.followed for rule in text_rules], i)
        label = F.concat(F.lit("$1[REDACTED:"), lookup([f"{rule.type}]{rule.followed}" for rule in text_rules], i))
        replaced = let(F.regexp_replace(acc["text"], regex, label), state)
        searched = F.when(i.isin(*in_name), acc["names"]).when(i.isin(*lowered), F.lower(acc["text"])).otherwise(acc["text"])
        # lower case is made last, the search for a word is cheap elsewhere
        found, likely = searched.contains(lookup(words, i)), F.rlike(acc["text"], lookup(implied, i))
        possible = F.when(i.isin(*lowered), likely & found).otherwise(found & likely)
        return F.when(possible, replaced).otherwise(acc)

    chain = F.aggregate(ordinals, state(F.col("text")), step, lambda acc: acc["text"])
    redacted = F.when(F.size("__hits") > 0, chain).otherwise(F.col("text")).alias("text")
    return with_hits(units, text_rules).select(
        *[redacted if name == "text" else F.col(name) for name in units.columns]
    )
