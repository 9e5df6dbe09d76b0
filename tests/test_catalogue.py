import re

import duckdb
import pytest
from pyspark.sql import functions as F

from leaksieve.catalogue import (
    ANY_SHAPE, KEYWORD_RULES, RULES, SHAPES, Rule, _is_left_and_value, rules, select_rules, validate, with_rules,
)
from samples import compiled, generated, value_of


def test_size_and_ids():
    assert len(RULES) > 100
    assert len({r.rule_id for r in RULES}) == len(RULES)
    assert len(KEYWORD_RULES) == 64
    assert {"Google API Key", "AWS Secret Key"} <= {r.type for r in RULES}


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.rule_id)
def test_form_and_re2(rule):
    assert _is_left_and_value(rule.regex)
    assert not any(compiled(rule).search(p) and compiled(rule).search(p).group() == "" for p in ("", "a", " ", "\n"))
    assert duckdb.execute("SELECT regexp_matches('', ?)", [rule.regex]).fetchone() == (False,)


def test_java_compiles_and_never_matches_empty(spark):
    validate(spark, RULES)


def test_gates_are_implied_by_the_regex():
    """Every match passes its gates; checked on texts generated from the regexes."""
    any_shape = re.compile(ANY_SHAPE, re.ASCII)
    for rule in RULES:
        for text in generated(rule, 8):
            if rule.shape:
                assert re.search(SHAPES[rule.shape], text, re.ASCII), (rule.rule_id, text)
                assert any_shape.search(text), (rule.rule_id, text)
            if rule.literal:
                assert rule.literal in text, (rule.rule_id, text)
            if rule.words:
                assert any(w in text.lower() for w in rule.words), (rule.rule_id, text)
            if rule.tail:
                assert re.search(rule.tail, text, re.ASCII), (rule.rule_id, text)


def test_words_stand_in_names(spark):
    """Every match of a rule whose words are in names shows one of them there, behind whatever else the text holds."""
    from leaksieve.functions.matching import names

    rows = [(rule.rule_id, lead + text) for rule in RULES if rule.in_name for text in generated(rule, 8)
            for lead in ("", "\U0001f642 a=b " * 3 + "\n", "x" * 300 + "=" + "y" * 40 + "_")]
    words = {rule.rule_id: rule.words for rule in RULES}
    # only texts that the rule still matches behind what was put in front
    rows = [(rule_id, text) for rule_id, text in rows if compiled(next(r for r in RULES if r.rule_id == rule_id)).search(text)]
    assert len({rule_id for rule_id, _ in rows}) >= 70
    found = spark.createDataFrame(rows, "rule_id string, text string").select("rule_id", "text", names(F.col("text")).alias("names")).collect()
    assert not [r for r in found if not any(word in r.names for word in words[r.rule_id])]


def test_words_are_not_sought_in_texts(spark):
    """Dozens of words are looked for in a few names, and no text is searched for each of them."""
    from leaksieve.operators.detect import detect

    df = spark.createDataFrame([("1", "f", "x")], "unit_id string, uri string, text string")
    plan = detect(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(text") + plan.count("Contains(__lower") < 60


def test_values_of_several_lines():
    """Rules whose values may hold a line break, and no others of the catalogue; in doubt a rule may."""
    from leaksieve.catalogue import may_span_lines

    spanning = {r.rule_id for r in RULES if r.target == "text" and may_span_lines(r)}
    assert {"pem_private_key", "pgp_private_key", "ssh2_private_key", "gcp_service_account"} == spanning
    for value in (".{3}", r"a\s+b", "[^a]{4}", r"[\w\n]{3}", "(?s:a.b)", "a\nb", "[a\n]{3}", r"\Ra", "[a-z&&[^b]]{3}"):
        assert may_span_lines(Rule("r", "R", "custom", f"()({value})")), value


def test_near_miss():
    """The shortest value of a rule, one character shorter, is not found any more."""
    for rule in select_rules(RULES, families=["aws", "google", "commerce", "platform", "code_hosting"]):
        if rule.kind != "fixed" or not rule.bounded:
            continue
        for text in generated(rule, 3):
            value = value_of(rule, text)
            assert not compiled(rule).search(text[: text.index(value) + len(value) - 1]), rule.rule_id


def test_catalogue_table(spark):
    table = rules(spark)
    assert table.count() == len(RULES)
    assert table.filter(F.col("kind") == "keyword").count() == 64


def test_selection_and_extension(spark):
    aws = select_rules(RULES, families=["aws"])
    assert {r.family for r in aws} == {"aws"}
    mine = Rule("mine", "Mine", "custom", r"((?:^|[^a-z]))(zz[0-9]{4})")
    both = with_rules(spark, aws, [mine])
    assert [r.rule_id for r in both] == [r.rule_id for r in aws] + ["mine"]
    replaced = with_rules(spark, both, [Rule("mine", "Other", "custom", r"()(q[0-9]+)")])
    assert len(replaced) == len(both) and replaced[-1].type == "Other"


@pytest.mark.parametrize("regex", [
    r"()(a*)", r"(a)", r"abc", r"()(a)b", r"()(a)(b)", r"(?:x)(a)", r"()(?:a)", r"()([", r"(\()(a)x", r"()()", r"(a)|(b)",
])
def test_rejected_rules(spark, regex):
    with pytest.raises(ValueError):
        with_rules(spark, [], [Rule("bad", "Bad", "custom", regex)])


@pytest.mark.parametrize("regex", [r"()(a)", r"(\()([)]+)", r"([^]()]x)(a(?:b|c)+)", r"((?i:k))((?:0x)?[0-9]+)"])
def test_accepted_rules(spark, regex):
    validate(spark, [Rule("good", "Good", "custom", regex)])
