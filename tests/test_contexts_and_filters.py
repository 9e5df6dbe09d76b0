import html as stdlib_html
import json
import random

from pyspark.sql import functions as F

from leaksieve.functions.text import decode_entities, host, host_suffixes
from leaksieve.operators import contexts as ctx
from leaksieve.operators import filters as flt
from leaksieve.operators.detect import detect
from leaksieve.operators.places import stored_places
from leaksieve.plans.scans import scan_domains, scan_site, scan_units
from leaksieve.sources.tables import units_from_json, units_from_page_json
from samples import hexes

TOKEN = hexes(32)


def page(spark, html, url="https://www.example.com/a"):
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


def texts(spark, html, name):
    rows = ctx.contexts(page(spark, html), [name]).orderBy("unit_id").collect()
    return [r.text for r in rows]


def test_each_context(spark):
    html = (
        '<html><head><META name="a" content="x &quot;y&quot;"><style type="t">p{}</style>'
        "<script>\nvar q='&quot;'; window.__env__ = {\"k\": {\"n\": 1}};</SCRIPT>"
        '<script type="application/json">{"a": 1}</script><script></script></head>'
        "<body onLoad='go(&#39;1&#39;)'><a onclick=\"f(&quot;t&quot;)\">&lt;b&gt;</a></body></html>"
    )
    assert texts(spark, html, "script") == ["\nvar q='&quot;'; window.__env__ = {\"k\": {\"n\": 1}};", '{"a": 1}']
    assert texts(spark, html, "css") == ["p{}"]
    assert texts(spark, html, "handler") == ['f("t")', "go('1')"]
    assert texts(spark, html, "meta") == [' name="a" content="x "y""']
    assert texts(spark, html, "config") == ['{"k": {"n": 1}}']
    assert texts(spark, html, "json") == ['{"a": 1}']
    whole = texts(spark, html, "html")[0]
    assert "var q='&quot;'" in whole and "><b></a>" in whole and 'content="x "y""' in whole
    assert texts(spark, '{"key": "v"}', "json") == ['{"key": "v"}']


def test_entities_against_the_standard_library(spark):
    samples = ["plain", "&lt;a&gt; &quot;&apos;", "&amp;lt;", "&#38;lt; &#x26;amp;", "&#61;&#x3D;&#X3d;&#061;", "&amp;amp;#39;",
               "&#36;1 &#92; $&#49;", "& &; &#; &#xzz;", "&#233; stays", "a&#39;b&#x27;c&#034;"]
    df = spark.createDataFrame([(s,) for s in samples], "s string").select("s", decode_entities(F.col("s")).alias("d"))
    for row in df.collect():
        if "233" not in row.s:
            assert row.d == stdlib_html.unescape(row.s), row.s
    assert df.filter("s = '&#233; stays'").collect()[0].d == "&#233; stays"


def test_token_hidden_by_entities(spark):
    found = detect(ctx.contexts(page(spark, f"<p>token = &quot;{TOKEN}&quot;</p>"))).collect()
    assert [(r.context, r.value) for r in found] == [("html", TOKEN)]


def test_one_finding_per_context(spark):
    found = detect(ctx.contexts(page(spark, f"<script>window.__env__ = {{token: '{TOKEN}'}};</script>"))).collect()
    assert sorted(r.context for r in found) == ["config", "html", "script"]


def test_filters_on_names(spark):
    uris = ["a/app.js", "a/app.min.js", "x.MIN.css?v=1", "i/logo.PNG", "p.svg#f", "tests/a.py", "src/test/b", "latest/c", "contests/d", "font.woff2"]
    df = spark.createDataFrame([(u,) for u in uris], "uri string")

    def left(op):
        return [r.uri for r in op(df).collect()]

    assert set(uris) - set(left(flt.drop_minified)) == {"a/app.min.js", "x.MIN.css?v=1"}
    assert set(uris) - set(left(flt.drop_assets)) == {"i/logo.PNG", "p.svg#f", "font.woff2"}
    assert set(uris) - set(left(flt.drop_test_data)) == {"tests/a.py", "src/test/b"}
    assert left(flt.drop_likely_false_positives) == ["a/app.js", "latest/c", "contests/d"]
    assert left(lambda d: flt.drop_likely_false_positives(d, include_all=True)) == uris


def test_noise(spark):
    values = ["aaaaaaaaaaaaaaaa", "${SECRET}", "$(cat key)", "{{ token }}", "%TOKEN%", "your_api_key_here", "CHANGEME-please-1", TOKEN, "pa$$word", "x"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert [r.value for r in flt.drop_noise(df).collect()] == [TOKEN, "pa$$word"]


def test_hosts(spark):
    urls = {"https://User:pw@A.Example.com:8080/x": "a.example.com", "http://b.org?x=1": "b.org", "mailto:x": "", "/rel": "", "ftp://h#f": "h"}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host(F.col("u")).alias("h"))
    assert {r.u: r.h for r in df.collect()} == urls
    assert spark.range(1).select(host_suffixes(F.lit("a.b.c"))).collect()[0][0] == ["a.b.c", "b.c", "c"]


def scope_pages(spark):
    hosts = ["example.com", "www.example.com", "notexample.com", "example.com.evil.org", "EXAMPLE.com", "x.org"]
    return spark.createDataFrame(
        [(i, f"https://{h}/p", f"<p>token = &quot;{hexes(32, i)}&quot;</p>") for i, h in enumerate(hosts)], "page_id bigint, url string, html string")


def test_scope(spark):
    pages = scope_pages(spark)
    assert [r.page_id for r in flt.in_scope(pages, "Example.com").collect()] == [0, 1, 4]
    assert [r.page_id for r in flt.in_scope(pages, "example.com", subdomains=False).collect()] == [0, 4]
    assert flt.in_scope(pages, "example.com", include_all=True).count() == 6
    domains = spark.createDataFrame([(" Example.COM",), ("x.org",), ("com",)], "domain string")
    assert sorted(r.page_id for r in flt.in_list(pages, domains).collect()) == [0, 1, 2, 4, 5]
    assert sorted(r.page_id for r in flt.in_list(pages, domains, subdomains=False).collect()) == [0, 4, 5]


def test_wide_scope_without_broadcast(spark):
    """Beyond the size limit the semi join shuffles instead; the result is the same."""
    from leaksieve.session import semi_join
    pages = scope_pages(spark).withColumn("k", F.col("page_id") % 3)
    keys = spark.createDataFrame([(0,), (1,)], "k bigint")
    small = semi_join(pages, keys, "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    large = semi_join(pages, keys, "k").persist()
    large.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(small.collect()) == sorted(large.collect())


def test_plans_over_pages(spark):
    pages = scope_pages(spark)
    domains = spark.createDataFrame([("x.org",)], "domain string")
    assert [r.uri for r in scan_domains(pages, domains).collect()] == ["https://x.org/p"]
    assert sorted(r.uri for r in scan_site(pages, "example.com").collect()) == [
        "https://EXAMPLE.com/p", "https://example.com/p", "https://www.example.com/p"]
    assert scan_site(pages, "example.com", max_pages=1).count() == 1


def test_scan_units_filters_then_masks(spark, units):
    df = units([("a.min.js", f'token="{TOKEN}"'), ("a.js", f'token="{TOKEN}" secret="{"z" * 20}"')])
    assert [(r.uri, r.rule_id) for r in scan_units(df).collect()] == [("a.js", "generic_secret")]
    assert scan_units(df, include_all=True).count() == 2
    assert scan_units(df, best_only=True, keep_values=True).collect()[0].value == TOKEN


def test_unclosed_tags_cost_linear_time(spark):
    """A megabyte of tags that never close is read once, not once per tag."""
    import time

    from leaksieve.sources.tables import units_from_pages

    for tag in ("<script>", "<meta x", "<style>", "<script type=", "<script>window.__a__ = {"):
        page = spark.createDataFrame([(1, "https://e.com", tag * (1_000_000 // len(tag)))], "page_id long, url string, html string")
        began = time.perf_counter()
        units_from_pages(page, ["script", "css", "meta", "config", "json", "html"]).select(F.sum(F.length("text"))).collect()
        assert time.perf_counter() - began < 20, tag


def leaves(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, j string")
    return units_from_json(df, "id", "j", F.lit("x"), spread_out=False)


def test_json_leaves_against_the_standard_library(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(["a", "b.c", "d/e", "f~g", "", "h\"[i", "ü", "{"]) : value(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(["", "x]}", 'q"[{', "back\\slash\\", "line\nbreak", "\u2028é", 7, -3, True, False, None, "\\\""])

    def walk(node, path=""):
        if isinstance(node, dict):
            return [leaf for k, v in node.items() for leaf in walk(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")]
        if isinstance(node, list):
            return [leaf for i, v in enumerate(node) for leaf in walk(v, f"{path}/{i}")]
        return [] if node is None else [(path, str(node).lower() if isinstance(node, bool) else str(node))]

    docs = [value(6) for _ in range(150)]
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, d in enumerate(docs)]
    value_of = F.expr("substring(text, value_at + 1, length(text) - value_at - if(value_at > 0, 1, 0))")
    got = leaves(spark, *texts).select("unit_id", "path", value_of.alias("value")).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"{i}#{path}", path, v) for i, d in enumerate(docs) for path, v in walk(d))


def test_json_leaves_of_odd_texts(spark):
    deep = "[" * 300 + '"z"' + "]" * 300
    got = leaves(spark, None, "", "{}", "null", "nope", '{"a":1,"a":2}', '"s"', deep, '{"a":[1,{"b":[2]}]}').collect()
    assert [(r.unit_id, r.text, r.path) for r in got if r.unit_id != "7#" + "/0" * 300] == [
        ("4", "nope", None), ("5", '{"a":1,"a":2}', None), ("6#", "s", ""), ("8#/a/0", 'a = "1"', "/a/0"), ("8#/a/1/b/0", 'a.b = "2"', "/a/1/b/0")]
    assert [r.text for r in got if r.unit_id.startswith("7#")] == ["z"]


def test_secrets_in_json_leaves(spark):
    """Keys are the left context, escapes are undone, and places refer to the value."""
    text = '{"db": {"settings": {"password": "p\\u0040ss\\/word\\u00221", "port": 5432}}, "list": [{"api_key": ["%s"]}], "t": "see \\u0041KIA%s"}' % ("a1" * 16, "B2" * 8)
    found = {(r.rule_id, r.path, r.value, r.start - r.value_at) for r in detect(leaves(spark, text), keep=("path", "value_at")).collect()}
    assert ("aws_access_key_id", "/t", "AKIA" + "B2" * 8, 4) in found
    assert ("generic_secret", "/list/0/api_key/0", "a1" * 16, 0) in found
    assert {f[1] for f in found} == {"/t", "/list/0/api_key/0", "/db/settings/password"}
    plan = leaves(spark, text)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_json_of_pages(spark):
    html = '<script type="application/json">{"k": {"token": "%s"}}</script><script>{"a": 1}</script><script type="application/ld+json">nope</script>' % hexes(32)
    got = units_from_page_json(page(spark, html), spread_out=False).collect()
    assert [(r.unit_id, r.path, r.context, r.named) for r in got] == [("1:leaf:0#/k/token", "/k/token", "leaf", True), ("1:leaf:1", None, "leaf", False)]


def test_places_in_the_stored_page(spark):
    """What stands at a mapped place decodes to the value, whatever stands around it."""
    rng = random.Random(11)
    noise = ["&lt;", "&amp;lt;", "&#65;", "&#x41;", "&#233;", "&amp;", "&", "&nbsp;", "é", "\U0001f600", "<p>", "<script>a&lt;b</script>", "<style>&amp;</style>", " x ", "&#38;gt;", "<script>"]
    pages = []
    for i in range(40):
        token = "".join(rng.choice([c, f"&#{ord(c)};", f"&#x{ord(c):x};"]) if rng.random() < 0.3 else c for c in "AKIA" + hexes(16, i).upper())
        around = ["".join(rng.choice(noise) for _ in range(rng.choice([0, 5, 400]))) for _ in range(2)]
        pages.append((i, "u", f"{around[0]}|{token}|{around[1]}"))
    df = spark.createDataFrame([*pages, (98, "u", "&&#108;t; AKIA" + hexes(16).upper()), (99, "u", ""), (100, "u", None)], "page_id bigint, url string, html string")
    found = detect(ctx.contexts(df, ["html", "script"], keep=["html"]), keep=("html",)).filter("rule_id = 'aws_access_key_id'")
    got = stored_places(found).withColumn("stored", F.expr("substring(html, int(stored_start + 1), int(stored_end - stored_start))")).collect()
    html = [r for r in got if r.context == "html" and r.unit_id != "98:html:0"]
    assert len(html) >= 35
    for r in html:
        assert r.html[r.stored_start:r.stored_end] == r.stored and stdlib_html.unescape(r.stored) == r.value
        assert r.stored_start == r.html.index("|") + 1
    assert [r.stored_start for r in got if r.unit_id == "98:html:0"] == [None]
    assert all(r.stored_start is None for r in got if r.context != "html")


def test_page_is_cut_once(spark):
    """Scripts are cut out once for all contexts that look into them."""
    from leaksieve.operators.contexts import contexts

    page = spark.createDataFrame([(1, "https://h.com/a", "<script>a</script>")], "page_id long, url string, html string")
    plan = contexts(page)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)</script>") == 1


def test_single_references(spark):
    """A reference alone is decoded as within a text."""
    from leaksieve.functions.text import decode_entities, decode_reference

    refs = ["&lt;", "&gt;", "&quot;", "&apos;", "&nbsp;", "&amp;", "&#38;", "&#038;", "&#x26;", "&#X0026;", "&#65;", "&#x41;", "&#X6a;", "&#x6A;",
            "&#31;", "&#127;", "&#126;", "&#0;", "&#9999999;", "&#xFFFFFF;", "&#36;", "&#92;", "&#32;", "&#59;", "&#35;"]
    df = spark.createDataFrame([(ref,) for ref in refs], "ref string").select("ref", decode_reference(F.col("ref")).alias("a"), decode_entities(F.col("ref")).alias("b"))
    assert [(r.ref, r.a) for r in df.collect()] == [(r.ref, r.b) for r in df.collect()]


def test_filter_on_places_reads_pages_once(spark):
    from leaksieve.operators.places import stored_places

    page = "<p>&lt;&#65;KIA&quot;</p>" + "x&nbsp;" * 600 + "<script>&lt;</script>KEY&amp;"
    df = spark.createDataFrame([(page, "html", page.replace("&lt;&#65;", "<A").index("AKIA"), 0)], "html string, context string, start long, n long")
    at = len("<p><AKIA\"</p>") + 600 * 2 + len("<script>&lt;</script>")
    df = df.select("html", "context", F.lit(at).cast("long").alias("start"), F.lit(at + 4).cast("long").alias("end"))
    placed = stored_places(df).filter("stored_start >= 0")
    row = placed.collect()[0]
    assert page[row.stored_start:row.stored_end] == "KEY&amp;"
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("array_join") <= 3


def test_scans_are_spread_over_several_tasks_a_core(spark):
    from leaksieve.session import spread
    from leaksieve.sources.tables import units_from

    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, cores), spark.range(0, 100, 1, 4 * cores)
    assert units_from(few, "id", "id", "'f'").rdd.getNumPartitions() == 4 * cores
    assert spread(many, "id", 4) is many


def test_files_are_spread(spark, tmp_path):
    from leaksieve.sources.files import read_file

    for i in range(20):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    df = read_file(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.text for r in df.collect()) == sorted(f"text {i}" for i in range(20))
