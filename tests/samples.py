"""Secret-shaped samples, put together at run time, and a plain reference matcher."""

import random
import re
import warnings

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leaksieve.catalogue import RULES

BOUNDARY = re.compile("[A-Za-z0-9_]")


def compiled(rule):
    return re.compile(rule.regex.replace(r"\z", r"\Z"), re.ASCII)


def generated(rule, n, seed=0):
    """``n`` texts that the rule's regex matches in full."""
    found = []

    @settings(max_examples=n, database=None, deadline=None, derandomize=True,
              suppress_health_check=list(HealthCheck))
    @given(st.from_regex(compiled(rule), fullmatch=True))
    def draw(text):
        found.append(text)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        draw()
    return [t + rule.followed for t in found if "\x0b" not in t][:n]


def value_of(rule, text):
    return compiled(rule).search(text).group(2)


def expected(units, rules=RULES):
    """(unit_id, rule_id, value, start, end) by ``finditer``: no gates, no Spark."""
    rows = []
    for unit_id, uri, text in units:
        for rule in rules:
            subject = uri if rule.target == "uri" else text
            for m in compiled(rule).finditer(subject or ""):
                if rule.bounded and BOUNDARY.match(subject[m.end(2):m.end(2) + 1]):
                    continue
                if rule.followed and subject[m.end(2):m.end(2) + 1] != rule.followed:
                    continue
                rows.append((unit_id, rule.rule_id, m.group(2), m.start(2), m.end(2)))
    return sorted(rows)


def hexes(n, seed=1):
    return "".join(random.Random(seed).choices("0123456789abcdef", k=n))
