import hashlib
import random
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from leaksieve.catalogue import RULES
from leaksieve.operators.detect import detect, mask
from leaksieve.operators.history import added_lines, first_seen, history_only, signed_lines
from leaksieve.operators.links import links, page_budget, reachable, resolve, subdomains
from leaksieve.operators.python_rule import with_python_rule
from leaksieve.plans.scans import scan_history, scan_removed, scan_site, standing_secrets
from leaksieve.session import shared_dir, spread
from leaksieve.sources.history import HISTORY_COLUMNS, units_from_history
from leaksieve.sources.tables import units_from
from leaksieve.streaming.scan import dedup_stream, scan_stream, write_available
from samples import hexes

COMMITS = "repo string, commit_id string, seq bigint, ts timestamp, path string, patch string"


def commits(spark, *patches):
    rows = [("r", f"c{i}", i, None, "a.py", p) for i, p in enumerate(patches)]
    return spark.createDataFrame(rows, COMMITS)


def test_added_lines_of_two_hunks(spark):
    patch = (
        "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n"
        "@@ -1,3 +1,4 @@ def f():\n one\n-two\n+TWO\n+++ plus\n three\n"
        "@@ -10 +11 @@\n-old\n\\ No newline at end of file\n+new\n\\ No newline at end of file\n"
        "diff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n"
        "@@ -5,2 +6,0 @@\n-x\n-y\n"
    )
    got = [(r.line_no, r.text) for r in added_lines(commits(spark, patch)).orderBy("line_no").collect()]
    assert got == [(2, "TWO"), (3, "++ plus"), (11, "new")]


def test_patches_without_hunks(spark):
    assert added_lines(commits(spark, "", "Binary files differ", "+++ b/x\n+not a hunk", None)).count() == 0


def diff(old, new):
    import difflib
    return "\n".join(difflib.unified_diff(old, new, "a", "b", lineterm="", n=1))


def test_added_lines_against_difflib(spark):
    rng = random.Random(5)
    patches, want = [], []
    for i in range(40):
        old = [rng.choice(["a", "b", "-c", "+d", "@@ e", "", "++ f"]) for _ in range(rng.randint(0, 30))]
        new = list(old)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(new))
            new[at:at + rng.randint(0, 2)] = [rng.choice(["N", "+N", "-N", "@@ -1 +1 @@", ""]) for _ in range(rng.randint(0, 3))]
        patches.append(diff(old, new))
        import difflib
        for tag, _, _, lo, hi in difflib.SequenceMatcher(None, old, new).get_opcodes():
            if tag in ("replace", "insert"):
                want += [(f"c{i}", n + 1, new[n]) for n in range(lo, hi)]
    got = [(r.commit_id, r.line_no, r.text) for r in added_lines(commits(spark, *patches)).collect()]
    assert sorted(got) == sorted(want)


def test_history_operators(spark):
    a, b = hexes(32, 1), hexes(32, 2)
    history = scan_history(commits(
        spark, f'@@ -0,0 +1,2 @@\n+token = "{a}"\n+x\n', f'@@ -1,2 +1,2 @@\n-token = "{a}"\n+token = "{b}"\n x\n', f'@@ -2 +2 @@\n-x\n+token = "{a}"\n'))
    assert sorted((r.commit_id, r.line_no) for r in history.collect()) == [("c0", 1), ("c1", 1), ("c2", 2)]
    first = {r.commit_id: r.n_findings for r in first_seen(history).collect()}
    assert first == {"c0": 2, "c1": 1}
    head = mask(detect(spark.createDataFrame([("h", "a.py", f'token = "{b}"')], "unit_id string, uri string, text string")))
    assert {r.commit_id for r in history_only(history, head).collect()} == {"c0", "c2"}


def test_history_is_narrow(spark):
    """Only rules on names aggregate, over names."""
    texts = [rule for rule in RULES if rule.target == "text"]
    plan = detect(units_from_history(commits(spark, "")), texts, keep=HISTORY_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_a_key_over_several_added_lines_and_files(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(hexes(64, seed=i) for i in range(3)) + "\n-----END RSA PRIVATE KEY-----"
    lines = "\n".join("+" + line for line in key.split("\n"))
    patch = (f"diff --git a/x.txt b/x.txt\n--- a/x.txt\n+++ b/x.txt\n@@ -1 +1,2 @@\n one\n+two\n"
             f"diff --git a/k.pem b/k.pem\n--- /dev/null\n+++ b/k.pem\n@@ -0,0 +1,6 @@\n+first\n{lines}\n"
             "diff --git a/.env b/.env\n--- /dev/null\n+++ b/.env\n@@ -0,0 +1,3 @@\n" + "+a\n" * 3)
    found = scan_history(commits(spark, patch), keep_values=True).collect()
    assert {(r.path, r.line_no, r.value) for r in found if r.rule_id == "pem_private_key"} == {("k.pem", 2, key)}
    assert [r.path for r in found if r.rule_id == "critical_config_file"] == [".env"]


@pytest.mark.parametrize("base,ref,want", [
    ("https://h.com/a/b/c", "../d/./e?x=../y", "https://h.com/a/d/e?x=../y"), ("https://h.com/a", "../../b/..", "https://h.com/"),
    ("https://h.com/a/b?q=1", "c", "https://h.com/a/c"), ("https://h.com/a/b", "/c#f", "https://h.com/c"), ("https://h.com", "c", "https://h.com/c"),
    ("http://h.com/a", "//o.org/x", "http://o.org/x"), ("http://h.com/a", "HTTPS://o.org", "HTTPS://o.org"), ("http://h.com/a?x=1", "?y=2", "http://h.com/a?y=2"),
    ("http://h.com/a", "#top", None), ("http://h.com/a", "mailto:x@y", None), ("http://h.com/a", "javascript:void(0)", None), ("http://h.com/a", " b ", "http://h.com/b"),
])
def test_resolve(spark, base, ref, want):
    assert spark.createDataFrame([(base, ref)], "b string, r string").select(resolve(F.col("b"), F.col("r"))).collect()[0][0] == want


def site(spark):
    def html(*refs):
        return "".join(f'<a href="{r}">x</a>' for r in refs)
    token = hexes(32)
    return spark.createDataFrame([
        (1, "https://example.com/", html("/b", "/b#x", "https://sub.example.com/c?a=1&amp;b=2")),
        (2, "https://example.com/b", html("/") + html("/d")),
        (3, "https://sub.example.com/c?a=1&b=2", f"<img src='i.png'><p>token = '{token}'</p>"),
        (4, "https://example.com/d", html("/e") + f"token = '{token}'"),
        (5, "https://example.com/island", "token = '" + token + "'"),
        (6, "https://other.org/", html("https://example.com/")),
    ], "page_id bigint, url string, html string")


def test_links_and_subdomains(spark):
    found = {(r.src, r.dst) for r in links(site(spark)).collect()}
    assert ("https://example.com/", "https://sub.example.com/c?a=1&b=2") in found
    assert len([1 for s, _ in found if s == "https://example.com/"]) == 2
    assert {r.host for r in subdomains(site(spark), "example.com").collect()} == {"example.com", "sub.example.com"}


def test_reachable_with_cycle_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", "c"), ("a", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")

    def at(depth):
        return sorted(tuple(r) for r in reachable(edges, seeds, depth).collect())

    assert at(0) == [("a", 0)]
    assert at(2) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert at(9) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def test_reachable_with_a_hot_target(spark):
    n = 2000
    edges = spark.range(n).select(F.concat(F.lit("p"), "id").alias("src"), F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("p"), F.col("id") + 1)).alias("dst"))
    seeds = spark.range(n).select(F.concat(F.lit("p"), "id").alias("url"))
    got = reachable(edges, seeds, 3)
    assert got.filter("url = 'hub'").collect()[0].depth == 1 and got.count() == n + 1 + (1 if (n - 1) % 3 else 0)


def test_page_budget_is_exact(spark):
    pages = spark.range(3000).select("id", F.concat(
        F.lit("https://"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), F.col("id") % 50)), F.lit(".com/"), F.col("id")).alias("url"))
    got = {}
    for r in page_budget(pages, 7).collect():
        got.setdefault(r.url.split("/")[2], []).append(r.url)
    want = {}
    for r in pages.collect():
        want.setdefault(r.url.split("/")[2], []).append(r.url)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:7] for k, v in want.items()}
    deep = spark.createDataFrame([("https://a/1", 5), ("https://a/2", 0), ("https://a/3", 1)], "url string, depth int")
    assert {r.url for r in page_budget(deep, 2).collect()} == {"https://a/2", "https://a/3"}


def test_scan_site(spark):
    seeds = spark.createDataFrame([("https://example.com/",)], "url string")

    def found(**kw):
        return sorted({r.uri for r in scan_site(site(spark), "example.com", only=["html"], **kw).collect()})

    assert found(depth=1, seeds=seeds) == ["https://sub.example.com/c?a=1&b=2"]
    assert found(depth=2, seeds=seeds) == ["https://example.com/d", "https://sub.example.com/c?a=1&b=2"]
    assert found() == ["https://example.com/d", "https://example.com/island", "https://sub.example.com/c?a=1&b=2"]
    assert found(depth=2, seeds=seeds, max_pages=3) == ["https://sub.example.com/c?a=1&b=2"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), f"f{i}", f'é token = "{hexes(32, i % 5)}" x') for i in range(60)]
    df = spark.createDataFrame(rows, "unit_id string, uri string, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_available(scan_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = mask(detect(df))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_dedup(spark, tmp_path):
    a, b = f'token = "{hexes(32, 1)}"', f'token = "{hexes(32, 2)}"'
    schema = "unit_id string, uri string, text string, ts timestamp"
    batches = [
        [("1", "f", a, "2024-01-01 00:00:00"), ("2", "f", a, "2024-01-01 00:05:00"), ("3", "g", a, "2024-01-01 00:06:00")],
        [("4", "f", a, "2024-01-01 00:08:00"), ("5", "f", b, "2024-01-01 03:00:00")],  # inside the horizon; moves the watermark on
        [("6", "f", b, "2024-01-01 00:00:00"), ("7", "f", a, "2024-01-01 03:01:00")],  # late; outside the horizon
    ]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    found = dedup_stream(scan_stream(stream, keep=("ts",)), "10 minutes")
    for batch in batches:
        df = spark.createDataFrame(batch, "unit_id string, uri string, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(source))
        write_available(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    ids = {r.unit_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(ids & {"1", "2"}) == 1 and ids - {"1", "2"} == {"3", "5", "7"}


def test_python_rule(spark, units):
    def luhn(text):
        import re
        for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text):
            digits = [int(c) for c in m.group()]
            if sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
                yield m.span()
    df = units(["🙂 card 4539578763621486 and 1234567890123456", None, "11"])
    found = with_python_rule(df, "card", luhn, "Card", prefilter="[0-9]{16}", keep=("text",)).collect()
    assert [(r.value, r.rule_id, r.type) for r in found] == [("4539578763621486", "card", "Card")]
    assert found[0].text[found[0].start:found[0].end] == found[0].value


def test_spread_only_moves_small_scans(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(10)], "id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    df.repartition(8).write.parquet(str(tmp_path / "many"))
    one = units_from(spark.read.parquet(str(tmp_path / "one")), "id", "text", "id")
    assert one.rdd.getNumPartitions() > 1
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, cores)
    assert spread(many, "id") is many


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir() or shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_signed_lines_against_a_replay(spark):
    rng = random.Random(5)
    states = [[]]
    for _ in range(12):
        lines = list(states[-1])
        for _ in range(rng.randint(1, 4)):
            if lines and rng.random() < 0.4:
                lines.pop(rng.randrange(len(lines)))
            else:
                lines.insert(rng.randint(0, len(lines)), rng.choice(["-- a/f", "++ b/f", "x", "", "- y", "+z", f'token = "{hexes(32, rng.randint(1, 3))}"']))
        states.append(lines)
    steps = list(pairwise(states))
    got = Counter()
    for r in signed_lines(commits(spark, *[diff(old, new) for old, new in steps])).collect():
        got[r.text] += r.sign
    assert {k: v for k, v in got.items() if v} == Counter(states[-1])
    standing = {r.fingerprint: r.n_standing for r in standing_secrets(commits(spark, *[diff(old, new) for old, new in steps])).collect()}
    tokens = Counter(line.split('"')[1] for line in states[-1] if line.startswith("token"))
    assert standing == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in tokens.items()}


def test_secrets_removed_since(spark):
    a, b, c = (f'token = "{hexes(32, i)}"' for i in (1, 2, 3))
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(hexes(64, seed=i) for i in range(3)) + "\n-----END RSA PRIVATE KEY-----"
    lines = key.split("\n")
    patches = [
        f"@@ -0,0 +1,4 @@\n+{a}\n+{b}\n+{c}\n+x\n", f"@@ -1,3 +1 @@\n-{a}\n-{b}\n {c}\n", f"@@ -9,0 +9 @@\n+    {b}  # again\n",
        "@@ -0,0 +1,5 @@\n" + "".join(f"+{line}\n" for line in lines), "@@ -1,5 +0,0 @@\n" + "".join(f"-{line}\n" for line in lines),
        # a file that goes, and one that is renamed with its secret in an unchanged line
        f"diff --git a/n b/n\n--- a/n\n+++ /dev/null\n@@ -1 +0,0 @@\n-{c}\n\\ No newline at end of file\ndiff --git a/o b/p\nsimilarity index 90%\n--- a/o\n+++ b/p\n@@ -1,2 +1,2 @@\n {b}\n-x\n+y\n",
    ]
    gone = scan_removed(commits(spark, *patches), keep_values=True).collect()
    assert {(r.commit_id, r.value) for r in gone} == {("c0", a.split('"')[1]), ("c0", c.split('"')[1]), ("c3", key)}
    # a secret that stands in another repository is gone from its own
    two = commits(spark, *patches[:2]).unionByName(commits(spark, f"@@ -0,0 +1 @@\n+{a}\n").withColumn("repo", F.lit("other")))
    assert hexes(32, 1) in {r.value for r in scan_removed(two, keep_values=True).collect()}
    assert scan_removed(commits(spark, "")).count() == 0
    # nothing but findings is shuffled
    plan = standing_secrets(commits(spark, *patches))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "partial_sum" in plan
