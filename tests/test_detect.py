import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leaksieve.catalogue import RULES, Rule, select_rules
from leaksieve.functions.matching import BLOCK
from leaksieve.operators.detect import best_rule, detect, mask
from leaksieve.operators.filters import drop_noise
from leaksieve.operators.redact import redact
from leaksieve.schema import FINDINGS
from samples import expected, generated, hexes


def rows(df):
    return sorted(tuple(r) for r in df.select("unit_id", "rule_id", "value", "start", "end").collect())


def plain(df):
    return [(r.unit_id, r.uri, r.text) for r in df.collect()]


def test_every_rule_against_finditer(spark, units):
    """Generated positives of all rules, alone, at the end of a line, after an emoji, followed by a letter."""
    texts = []
    for rule in RULES:
        if rule.target == "text":
            for text in generated(rule, 2):
                texts += [text, f"é🙂 {text}\n{text} x", f"{text}Z"]
    df = units(texts)
    got, want = rows(detect(df)), expected(plain(df))
    assert {r[1] for r in want} == {r.rule_id for r in RULES if r.target == "text"}
    assert got == want


def test_random_mixtures(spark, units):
    rng = random.Random(7)
    pieces = [generated(rule, 1)[0] for rule in RULES if rule.target == "text"]
    pieces += ["🙂", "é", " ", "\n", "\r\n", "=", '"', "key", "token: ", "://", "-", "_", "x" * 40, hexes(40), " ", "K"]
    df = units(["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(150)])
    assert rows(detect(df)) == expected(plain(df))


def test_positions_slice_back(spark, units):
    token = hexes(40)
    df = units([f'🙂🙂 token = "{token}"; token="{token}"', f'token = "{token}"'])
    found = detect(df, keep=("text",)).collect()
    assert len(found) == 3
    assert all(r.text[r.start:r.end] == r.value for r in found)


def test_dense_text_is_linear_and_exact(spark, units):
    """More matches than several blocks of the prefix sum, next to each other and apart."""
    n = 5 * BLOCK + 3
    rule = Rule("ab", "AB", "custom", "()(ab?)")
    df = units(["ab" * n + "x" + "a" * n + " é" * 3 + "ab"])
    assert rows(detect(df, [rule])) == expected(plain(df), [rule])


def test_boundary_and_neighbours(spark, units):
    rule = Rule("six", "Six", "custom", "()(k[0-9]{5})", bounded=True)
    df = units(["k12345", "k123456", "k12345k12345", "k12345 k12345_", "k12345é", "k12345\n"])
    assert rows(detect(df, [rule])) == expected(plain(df), [rule])


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([("1", "a", None), ("2", "b", ""), ("3", "c/.env", None)], "unit_id string, uri string, text string")
    assert [(r.unit_id, r.value, r.context) for r in detect(df).collect()] == [("3", ".env", "uri")]


def test_config_files_by_name(spark, units):
    names = [".env", "a/.env.local", "a/.environment", "k/id_rsa", "k/id_rsa.pub", "x/.npmrc", "credentials.json", "mycredentials.json"]
    found = detect(units([(n, "") for n in names]), select_rules(RULES, rule_ids=["critical_config_file"]))
    assert sorted(r.uri for r in found.collect()) == [".env", "a/.env.local", "credentials.json", "k/id_rsa", "x/.npmrc"]


def test_value_of_a_key_without_prefix(spark, units):
    """A secret key that only its context gives away, with the position of its value."""
    value = hexes(20).upper() + "/+" + hexes(18)
    text = 'region = "ap-southeast-1"\naws_secret_key  = "' + value + '"\n'
    found = detect(units([text], "config.py"), select_rules(RULES, rule_ids=["aws_secret_key"])).collect()
    assert [(r.type, r.value, r.start, r.end, r.uri) for r in found] == [("AWS Secret Key", value, 45, 85, "config.py")]


def test_mask(spark, units):
    long, short = hexes(40), "pw1"
    df = detect(units([f'token = "{long}" redis://u:{short}@h']))
    masked = {r.rule_id: r for r in mask(df).collect()}
    assert masked["generic_secret"].value_masked == f"{long[:4]}...{long[-4:]}"
    assert masked["uri_redis"].value_masked == "***"
    assert "value" not in mask(df).columns
    kept = mask(df, keep_values=True)
    assert {f.name for f in kept.schema} == {f.name for f in FINDINGS}
    assert all(kept.schema[f.name].dataType == f.dataType for f in FINDINGS)
    salted = mask(df, salt="s").filter("rule_id = 'generic_secret'").collect()[0]
    assert salted.fingerprint != masked["generic_secret"].fingerprint


def test_best_rule_prefers_the_specific_one(spark, units):
    df = detect(units([f'github_token = "ghp_{hexes(36)}"']))
    assert {r.rule_id for r in df.collect()} == {"github_token", "kw_github", "generic_secret"}
    assert [r.rule_id for r in best_rule(df).collect()] == ["github_token"]
    generic = detect(units([f'token = "{hexes(40)}"']))
    assert [r.rule_id for r in best_rule(generic).collect()] == ["generic_secret"]


def test_redaction_leaves_nothing_to_detect(spark, units):
    texts = [t for rule in RULES if rule.target == "text" for t in generated(rule, 1)] + ["nothing here", None]
    rules = [r for r in RULES if r.target == "text"]
    clean = redact(units(texts))
    # rules that allow any character in a value see the label itself, which counts as a placeholder
    left = detect(clean, rules)
    assert drop_noise(left).count() == 0
    assert all("[REDACTED" in r.value for r in left.collect())
    by_id = {int(r.unit_id): r.text for r in clean.collect()}
    assert by_id[len(texts) - 2] == "nothing here" and by_id[len(texts) - 1] is None


def test_redaction_is_the_chain_of_replacements(spark, units):
    import re

    from samples import compiled
    rng = random.Random(3)
    pieces = [generated(rule, 1)[0] for rule in RULES if rule.target == "text"] + [" ", "\n", "$1", "\\"]
    texts = ["".join(rng.choices(pieces, k=4)) for _ in range(40)]
    want = []
    for text in texts:
        for rule in RULES:
            if rule.target == "text":
                whole = re.compile(compiled(rule).pattern + rule.followed, re.ASCII)
                text = whole.sub(lambda m, rule=rule: m.group(1) + f"[REDACTED:{rule.type}]{rule.followed}", text)
        want.append(text)
    got = {int(r.unit_id): r.text for r in redact(units(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_rules_without_a_hit_are_tried_only_where_a_label_can_take_part(spark, units):
    from leaksieve.operators.redact import _meets_labels
    from samples import compiled

    by_id = {rule.rule_id: rule for rule in RULES}
    labels = [f"[REDACTED:{rule.type}]" for rule in RULES]
    assert not any(_meets_labels(by_id[name], labels) for name in ("aws_access_key_id", "github_token", "bearer_token", "slack_webhook"))
    assert all(_meets_labels(by_id[name], labels) for name in ("jwt", "kw_github", "uri_http", "generic_password", "pem_private_key"))
    odd = [r"()(TED:AWS)", r"()(x\b[0-9])", r"()(\][0-9])", r"()(.{9}z)", r"()(x(?=y))", r"()(\S{9}z)", r"()([^a]z)", r"()([a-z&&[x]]z)", r"(()x)(z$)", r"()(\p{L}z)"]
    assert all(_meets_labels(Rule("r", "R", "r", regex), labels) for regex in odd)
    # rules that meet what earlier ones leave, none of which hits the text itself
    rules = [by_id["aws_access_key_id"], Rule("next", "Next", "r", r"(Key ID\])([0-9]{3}_)", bounded=True), Rule("inside", "In", "r", r"()(REDACTED:Next)"), by_id["jwt"]]
    rng = random.Random(5)
    pieces = [generated(rule, 1)[0] for rule in RULES if rule.target == "text"] + ["AKIA" + "B7" * 8, "123_", "eyJabcd.eyJabcd.abcdefghij", "]", "[", " ", "\n"]
    texts = ["".join(rng.choices(pieces, k=6)) for _ in range(60)] + ["AKIA" + "B7" * 8 + "123_eyJabcd.eyJabcd.abcdefghij", "AKIA" + "B7" * 8 + "eyJabcd.eyJabcd.abcdefghij"]
    for chosen in ([rule for rule in RULES if rule.target == "text"], rules, rules[:1]):
        want = []
        for text in texts:
            for rule in chosen:
                whole = re.compile(compiled(rule).pattern + rule.followed, re.ASCII)
                text = whole.sub(lambda m, rule=rule: m.group(1) + f"[REDACTED:{rule.type}]{rule.followed}", text)
            want.append(text)
        got = {int(r.unit_id): r.text for r in redact(units(texts), chosen).collect()}
        assert [got[i] for i in range(len(texts))] == want


@settings(max_examples=5, deadline=None, database=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='ab=:"\' -_/@.🙂é\nK9', max_size=60), min_size=5, max_size=40))
def test_arbitrary_text(spark, units, texts):
    df = units([t + 'api_key="' + "a1" * 9 + '"' + t for t in texts])
    assert rows(detect(df)) == expected(plain(df))


def test_detection_moves_no_data(spark, units):
    plan = detect(units(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_long_values_are_found_whole_and_redacted_whole(spark, units):
    from leaksieve.operators.detect import detect, mask
    from leaksieve.operators.redact import redact

    body = "\n".join(hexes(64, seed=i) for i in range(20))
    keys = [f"-----BEGIN RSA PRIVATE KEY-----\n{b}\n-----END RSA PRIVATE KEY-----" for b in (body, body[::-1])]
    long = [hexes(n, seed=n) for n in (300, 1500)]
    texts = [f"a\n{keys[0]}\nb", f"a\n{keys[1]}\nb", f'token = "{long[0]}"', f"bearer {long[1]}", f"x eyJ{long[1]}.eyJ{long[1]}.{long[0]} y"]
    found = {(r.unit_id, r.rule_id): r.value for r in detect(units(texts)).collect()}
    assert [found[str(i), "pem_private_key"] for i in (0, 1)] == keys
    assert found["2", "generic_secret"] == long[0] and found["3", "bearer_token"] == long[1]
    assert found["4", "jwt"] == f"eyJ{long[1]}.eyJ{long[1]}.{long[0]}"
    prints = {r.fingerprint for r in mask(detect(units(texts[:2]))).filter("rule_id = 'pem_private_key'").collect()}
    assert len(prints) == 2
    left = "".join(r.text for r in redact(units(texts)).collect())
    assert not any(secret[k:k + 12] in left for secret in (*keys[0].split("\n")[1:-1], *long) for k in range(0, len(secret) - 12, 7))


def test_keys_of_any_headers_go_whole(spark, units):
    """PGP and SSH2 blocks with headers that hold dashes, and PEM blocks with any headers."""
    body = "\n".join(hexes(64, seed=i) for i in range(5))
    keys = {
        "pgp_private_key": f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nComment: https://my-host.example/a-b\nCharset: utf-8\nX-Long: {'z-' * 300}\n\n{body}\n=AbCd\n-----END PGP PRIVATE KEY BLOCK-----",
        "ssh2_private_key": f'---- BEGIN SSH2 ENCRYPTED PRIVATE KEY ----\r\nComment: "me@my-host"\r\n{body}\r\n---- END SSH2 ENCRYPTED PRIVATE KEY ----',
        "pem_private_key": f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{hexes(32)}\nX-Own: a-b\n\n{body}\n-----END RSA PRIVATE KEY-----",
    }
    df = units([f"a\n{key}\nb" for key in keys.values()])
    assert {(r.rule_id, r.value) for r in detect(df).collect()} == set(keys.items())
    left = "".join(r.text for r in redact(df).collect())
    assert not any(body[k:k + 16] in left for k in range(0, len(body) - 16, 5))


def test_ports_are_no_passwords(spark, units):
    ports = "postgres://localhost:5432/db redis://localhost:6379/0 amqp://h:5672 https://elastic:9200/x mysql://h:3306"
    real = "postgres://u:s3cret@h:5432/db redis://:s3cret@h"
    df = units([ports, real])
    assert {(r.unit_id, r.rule_id, r.value) for r in detect(df).collect()} == {("1", "uri_postgres", "s3cret"), ("1", "uri_redis", "s3cret")}
    assert [r.text for r in redact(df).orderBy("unit_id").collect()] == [
        ports, "postgres://u:[REDACTED:PostgreSQL URI Password]@h:5432/db redis://:[REDACTED:Redis URI Password]@h"]


def test_names_are_reported_once(spark):
    """Once per page and per file of a commit, from a single scan and without a shuffle, in a stream as in a batch."""
    from leaksieve.operators.contexts import contexts

    page = spark.createDataFrame([(1, "https://h.com/.env", "<script>a</script><style>b</style><p>c"), (2, "https://h.com/id_rsa", "<p>c")], "page_id long, url string, html string")
    found = detect(contexts(page))
    assert sorted((r.unit_id, r.rule_id, r.context) for r in found.collect()) == [("1:script:0", "critical_config_file", "uri"), ("2:html:0", "critical_config_file", "uri")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1


def test_passwords_in_web_addresses(spark, units):
    """What stands between user and host; ports and paths are none."""
    texts = ["https://user:passw0rd@host/x", "http://host:8080/a@b", "https://host/a:bcd", "HTTP://u:abc@h"]
    found = {(r.unit_id, r.value) for r in detect(units(texts)).collect() if r.rule_id == "uri_http"}
    assert found == {("0", "passw0rd"), ("3", "abc")}


def test_names_without_marks_are_reported_once(spark):
    """Units of a table that marks no first one: a name that many of them share is reported by the least."""
    rows = [(str(i), ("a/.env", "b/id_rsa", "c/x.txt")[i % 3], "API_TOKEN=" + hexes(20, seed=1)) for i in range(30)]
    df = spark.createDataFrame(rows, "unit_id string, uri string, text string")
    found = detect(df, select_rules(RULES, families=["config_file"]), keep=("text",), names_once=True).collect()
    names = sorted((r.uri, r.unit_id, r.value) for r in found if r.context == "uri")
    assert names == [("a/.env", "0", ".env"), ("b/id_rsa", "1", "id_rsa")]
    assert sum(r.rule_id == "dotenv_assignment" for r in found) == 30
    every = detect(df, select_rules(RULES, families=["config_file"]))
    assert every.filter("context = 'uri'").count() == 20
