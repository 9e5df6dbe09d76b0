
from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve import sinks  # noqa: E402
from leaksieve.catalogue import RULES, Rule, rules, select_rules, with_rules
from leaksieve.functions.text import decode_entities, host
from leaksieve.operators import grouping as grp
from leaksieve.operators.detect import best_rule, detect, mask
from leaksieve.operators.filters import (
    drop_assets, drop_likely_false_positives, drop_minified, drop_noise, drop_test_data, in_list, in_scope,
)
from leaksieve.operators.history import added_lines, first_seen, history_only, with_line_numbers
from leaksieve.operators.links import links, page_budget, reachable, subdomains
from leaksieve.operators.places import stored_places
from leaksieve.operators.python_rule import with_python_rule
from leaksieve.operators.redact import redact
from leaksieve.plans.scans import scan_domains, scan_removed, scan_site, scan_units, sites_pages, standing_secrets
from leaksieve.session import SPLITS, scratch_path, spread
from leaksieve.sources.files import read_dir, read_domains, read_file
from leaksieve.sources.history import HISTORY_COLUMNS, units_from_history
from leaksieve.sources.tables import units_from, units_from_json, units_from_page_json, units_from_pages
from leaksieve.streaming.scan import dedup_stream, scan_stream, write_available
from oracle import sql as duck

DOMAIN = "example.com"

# Card numbers, as a rule that a user adds.
CUSTOM = Rule("card_number", "Card Number", "custom", r"((?:^|[^0-9]))([0-9]{16})", bounded=True)

# The regex part of the Python rule, for its oracle.
HEX_RUN = Rule("hex_entropy", "Hex Token", "custom", r"((?:^|[^0-9a-f]))([0-9a-f]{40})", bounded=True)

# Secret-shaped lines put together from the hash of each document, so that every
# family of rules meets the whole table. {h} is 32 hex digits, {H} the same in
# upper case, {hh} 64 hex digits, {d} a dollar sign.
PLANTS = (
    'key_id AKIA{H:16}',
    'aws_secret_access_key = "{hh:40}"',
    'aws_session_token: {hh}{hh}',
    'bucket https://b{h:12}.s3.eu-west-1.amazonaws.com/x',
    'maps AIza{hh:35}',
    '1{h:0}2345-{h}.apps.googleusercontent.com',
    '{{"private_key": "-----BEGIN PRIVATE KEY-----{hh}{hh}-----END PRIVATE KEY-----"}}',
    'tw 12345-{hh:40}',
    'slack xoxb-{h}',
    'hook https://hooks.slack.com/services/T{H:9}/B{H:9}/{h:24}',
    'hook https://discord.com/api/webhooks/123456789012345678/{hh}{h:4}',
    'bot 123456789:{hh:35}',
    'GITHUB_TOKEN=ghp_{hh:36}',
    'gitlab-token: glpat-{h:20}',
    'pay sk_live_{h:24} and rk_live_{h:24}',
    'sq0atp-{h:22} sq0csp-{hh:43}',
    'mail key-{h} list {h}-us12',
    'SG.{h:22}.{hh:43}',
    'shop shpat_{h} chat sk-{hh:48}',
    'hf_{hh:34} hvs.{h}',
    'DefaultEndpoints;AccountKey={hh}{h:22}==;',
    'rpc https://mainnet.infura.io/v3/{h}',
    'wallet_key: 0x{hh}',
    'jwt eyJ{h}.eyJ{h}.{h}',
    'Authorization: Bearer {hh}',
    'Cookie: PHPSESSID={h}; csrf_token={h}',
    '-----BEGIN OPENSSH PRIVATE KEY-----',
    '-----BEGIN RSA PRIVATE KEY-----\n{hh}\n{hh}\n{hh}\n-----END RSA PRIVATE KEY-----',
    'long token="{hh}{hh}{hh}{hh}{hh}{h:10}"',
    'Authorization: Bearer {hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}',
    'jwt eyJ{h}.eyJ{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}{hh}.{hh}',
    'temporary ASIA{H:16} app xapp-{h} test sk_test_{h}',
    'oauth GOCSPX-{h:28} ya29.{hh}',
    'Authorization: Basic {h}==',
    'db_password = "P@ss!{h:6}" api-key: "{h}"',
    'redis://:{h:10}@cache postgres://u:{h:12}@db mongodb+srv://u:{h:3}@m',
    'export APP_SECRET="{h:12}"',
    'heroku.api-key => {h} and openai_token := {h}',
    'longer AKIA{H:16}9 sk_live_{h:24}0 hf_{hh:34}_',
    'password="{d}{{DB_PASSWORD_FROM_VAULT}}" secret="changeme-changeme-1" token="aaaaaaaaaaaaaaaaaaaa"',
)


# Markup for the contexts that the stored pages lack; {q} is a single quote, {b} a backslash.
PAGE_PLANTS = (
    '<button onclick="send({q}u{q}, token = &quot;{h}&quot;)" class="x">&amp;lt;</button>',
    '<script>var u="&quot;"; window.__env__ = {{"apiKey": "AIza{hh:35}",\n "n": 1}}; window.__cfg__={{}};</script>',
    '<script id="d" type="application/ld+json">{{"stripe_secret": "{hh:40}"}}</script>',
    '<meta name="v" content="csrf_token=&#39;{h}&#39;"><p onload = {q}go(){q}>&#x41;KIA{H:16} &#38;amp; &#233;</p>',
    '<SCRIPT type="application/json">{{"token": "{h}{b}/{h}{b}u003d", "u": "{b}u0041KIA{H:16}"}}</SCRIPT><script>window.__a__ = {{"s": "x}};y", "k": "{h}"}}</script><script>open',
    '<style>a{{background:url(https://b{h:9}.s3.amazonaws.com/i.png)}}</style><a href="https://sub.example.com/a#b">&nbsp;</a>',
)


def _render(template: str, column: str = "text") -> str:
    """A template as an SQL expression that both engines read alike."""
    digest = f"md5({column})"
    sources = {"h": digest, "H": f"upper({digest})", "hh": f"concat({digest}, md5(reverse({digest})))", "d": "chr(36)", "q": "chr(39)", "b": "chr(92)"}
    parts, rest = [], template.replace("{{", "\x01").replace("}}", "\x02")
    while rest:
        plain, brace, rest = rest.partition("{")
        if plain:
            parts.append("'" + plain.replace("\x01", "{").replace("\x02", "}") + "'")
        if brace:
            name, _, rest = rest.partition("}")
            name, _, size = name.partition(":")
            parts.append(f"substring({sources[name]}, 1, {size})" if size else sources[name])
    return f"concat({', '.join([*parts, chr(39) * 2])})"


# What some of the planted lines must give, written down without the rules: part of the line, rule, the value and the text before it.
PLANTED_VALUES = (
    ("key_id AKIA{H:16}", "aws_access_key_id", "key_id ", "AKIA{H:16}"),
    ("slack xoxb-{h}", "slack_token", "slack ", "xoxb-{h}"),
    ("GITHUB_TOKEN=ghp_{hh:36}", "github_token", "GITHUB_TOKEN=", "ghp_{hh:36}"),
    ("pay sk_live_{h:24} and rk_live_{h:24}", "stripe_restricted_key", "pay sk_live_{h:24} and ", "rk_live_{h:24}"),
    ("-----BEGIN RSA", "pem_private_key", "", "-----BEGIN RSA PRIVATE KEY-----\n{hh}\n{hh}\n{hh}\n-----END RSA PRIVATE KEY-----"),
    ('{{"private_key"', "gcp_service_account", '{{"private_key": "', "-----BEGIN PRIVATE KEY-----{hh}{hh}-----END PRIVATE KEY-----"),
    ("long token", "generic_secret", 'long token="', "{hh}{hh}{hh}{hh}{hh}{h:10}"),
    ("Authorization: Bearer {hh}{hh}", "bearer_token", "Authorization: Bearer ", "{hh}" * 17),
    ("jwt eyJ{h}.eyJ{hh}", "jwt", "jwt ", "eyJ{h}.eyJ" + "{hh}" * 17 + ".{hh}"),
    ("temporary ASIA", "aws_access_key_id", "temporary ", "ASIA{H:16}"),
    ("temporary ASIA", "slack_app_token", "temporary ASIA{H:16} app ", "xapp-{h}"),
    ("oauth GOCSPX", "google_oauth_token", "oauth GOCSPX-{h:28} ", "ya29.{hh}"),
    ("Authorization: Basic", "basic_auth", "Authorization: Basic ", "{h}=="),
    ("db_password", "generic_password", 'db_password = "', "P@ss!{h:6}"),
    ("db_password", "generic_secret", 'db_password = "P@ss!{h:6}" api-key: "', "{h}"),
)

PLANTED_TEXT = "concat(text, chr(10), CASE " + " ".join(
    f"WHEN doc_id % {len(PLANTS)} = {i} THEN {_render(t)}" for i, t in enumerate(PLANTS)
) + " END)"

PLANTED_HTML = "concat(html, CASE " + " ".join(
    f"WHEN page_id % {len(PAGE_PLANTS)} = {i} THEN {_render(t, 'html')}" for i, t in enumerate(PAGE_PLANTS)
) + " END)"

# Names for documents that the filters on names tell apart.
NAMED_URI = """concat(source, CASE doc_id % 6 WHEN 0 THEN '/app.min.js' WHEN 1 THEN '/logo.PNG' WHEN 2 THEN '/tests/a.py'
  WHEN 3 THEN '/.env' WHEN 4 THEN '/latest/contests.py' ELSE '/conf/id_rsa' END)"""


# Addresses whose host, query or fragment look like file names; of the last kind the path is one.
ADDRESSES = """CASE page_id % 6 WHEN 0 THEN concat(url, '?img=a.png') WHEN 1 THEN concat(url, '#x.zip') WHEN 2 THEN 'https://www.notion.so'
  WHEN 3 THEN concat(url, '?next=/tests/x') WHEN 4 THEN concat(url, '#/app.min.js')
  ELSE concat(regexp_replace(url, '[?#].*', ''), '/logo.png?v=1') END"""


CROSSED_HTML = f"""concat({PLANTED_HTML}, '<a href="', coalesce(following, ''), '"></a><a href="', coalesce(further, ''), '#x"></a>')"""

# Pages of references that take resolving, and what they lead to.
LINKED_HTML = """concat('<base target="x" href="https://base.example.org/a/b/c?q">', '<a href="../up/', page_id, '.html">',
  '<a href=plain/', page_id, '>', '<a href="./x/../y', page_id, '?z=1#f">', '<a  HREF = "/r/./s/', page_id, '/..">')"""
# Blocks and addresses that redaction must take whole or leave, and what must be left of them, written down without the rules.
KEY_TEXT = """concat('a', chr(10), '-----BEGIN PGP PRIVATE KEY ', 'BLOCK-----', chr(10), 'Comment: https://my-host.example/', md5(text), chr(10), 'Charset: utf-8', chr(10), chr(10),
  md5(text), md5(reverse(text)), chr(10), '=', left(md5(text), 4), chr(10), '-----END PGP PRIVATE KEY ', 'BLOCK-----', chr(10), 'postgres://localhost:5432/db redis://h:6379/0', chr(10),
  'postgres://u:', md5(text), '@h:5432/db', chr(10), '---- BEGIN SSH2 ENCRYPTED PRIVATE ', 'KEY ----', chr(10), 'Comment: me@my-host', chr(10), md5(text), chr(10),
  '---- END SSH2 ENCRYPTED PRIVATE ', 'KEY ----', chr(10), 'amqp://broker:5672 ', doc_id)"""
KEY_TEXT_LEFT = """concat('a', chr(10), '[REDACTED:PGP Private Key]', chr(10), 'postgres://localhost:5432/db redis://h:6379/0', chr(10),
  'postgres://u:[REDACTED:PostgreSQL URI Password]@h:5432/db', chr(10), '[REDACTED:SSH2 Private Key]', chr(10), 'amqp://broker:5672 ', doc_id)"""

# JSON appended to pages: nested keys and escaped values, and where in it which value stands, written down without the rules.
JSON_HTML = """concat(html, '<script type="application/json">{"app": {"db": {"password": "p', chr(92), 'u0040', chr(92), '/', left(md5(html), 12), '", "port": 5432}, "list": [1, {"api_key": ["',
  md5(html), '"]}]}, "note": "see ', chr(92), 'u0041KIA', upper(left(md5(html), 16)), '", "none": null}</script>')"""
JSON_VALUES = (
    ("generic_password", "/app/db/password", "concat('p@/', left(md5(html), 12))", 0),
    ("generic_secret", "/app/list/1/api_key/0", "md5(html)", 0),
    ("aws_access_key_id", "/note", "concat('AKIA', upper(left(md5(html), 16)))", 4),
)

# A key behind and within references, appended to pages; what stands in the stored page, written down without the rules.
HIDDEN_KEY = "concat('A&#75;I&#x41;', upper(left(md5(html), 8)), '&#', ascii(upper(substring(md5(html), 9, 1))), ';', upper(substring(md5(html), 10, 7)))"
HIDDEN_HTML = f"concat(html, '<p title=&quot;&amp;lt;&gt; ', {HIDDEN_KEY}, ' &#233;')"

# Three commits of each document: a secret comes with the whole text, goes from two of three documents, comes again in one.
SECRET_LINE = "concat('secret_token = \"', md5(concat('s', text)), '\"')"
REPLAYED = (
    ("true", "concat('@@ -0,0 +1,', size(split(text, '\n', -1)) + 1, ' @@\n+', {secret}, '\n+', replace(text, '\n', '\n+'))"),
    ("doc_id % 3 > 0", "concat('--- a/f\n+++ b/f\n@@ -1 +0,0 @@\n-', {secret}, '\n')"),
    ("doc_id % 3 = 2", "concat('@@ -4,2 +4,3 @@\n x\n+  ', {secret}, ' # again\n y')"),
)

LINKED_TO = (
    ("https://base.example.org/a/up/", "page_id", ".html"), ("https://base.example.org/a/b/plain/", "page_id", ""),
    ("https://base.example.org/a/b/y", "page_id", "?z=1"), ("https://base.example.org/r/s/", "''", ""),
)


# --- inputs -----------------------------------------------------------------

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, text: str = "text", uri: str = "concat(source, '/', doc_id)") -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    if text != "text":
        docs = docs.withColumn("text", F.expr(text))
    return units_from(docs, "doc_id", "text", uri, keep=["source", "doc_id"])


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = _table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    return units_from(conv, "id", "text", "concat('conv/', id)", keep=["role"])


def _findings(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return mask(detect(_documents(spark, sf_dir), keep=keep, names_once=True))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_documents(spark, sf_dir, text=PLANTED_TEXT), names_once=True)


def _planted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the planted lines, for the rules that PLANTED_VALUES names."""
    docs = _table(spark, sf_dir, "documents").withColumn("plant", F.expr(f"doc_id % {len(PLANTS)}")).withColumn("n", F.length("text"))
    units = units_from(docs.withColumn("text", F.expr(PLANTED_TEXT)), "doc_id", "text", "concat(source, '/', doc_id)", keep=["plant", "n"])
    asked = F.lit(False)
    for part, rule, _, _ in PLANTED_VALUES:
        asked = asked | ((F.col("plant") == _plant(part)) & (F.col("rule_id") == rule))
    found = detect(units, keep=("plant", "n")).filter(asked & (F.col("start") > F.col("n")))
    return found.select("unit_id", "rule_id", "value", "start", "end")


def _plant(part: str) -> int:
    """The number of the planted line that begins with ``part``."""
    return next(i for i, line in enumerate(PLANTS) if line.startswith(part))


def _digest(units: DataFrame, *columns: str) -> DataFrame:
    return units.select("unit_id", "uri", "context", *columns, F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits: one hunk of added, unchanged and removed lines, then one that adds the whole text."""
    marked = """array_join(transform(split(text, '\n', -1),
      (l, i) -> concat(CASE i % 3 WHEN 0 THEN '+' WHEN 1 THEN ' ' ELSE '-' END, l)), '\n')"""
    whole = "concat('+', replace(text, '\n', '\n+'))"
    n = "size(split(text, '\n', -1))"
    patch = f"""concat('--- a/f\n+++ b/f\n@@ -1,', {n} - int(({n} + 2) / 3), ' +11,', {n} - int({n} / 3), ' @@ f()\n', {marked},
      '\n@@ -900 +900,', {n}, ' @@\n', {whole}, '\n\\\\ No newline at end of file')"""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("repo"), F.concat(F.lit("c"), F.col("doc_id")).alias("commit_id"), F.col("doc_id").alias("seq"),
        F.timestamp_seconds("doc_id").alias("ts"), F.concat(F.col("lang"), F.lit(".txt")).alias("path"), F.expr(patch).alias("patch"),
    ).repartition(spark.sparkContext.defaultParallelism * 4, "commit_id")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a history in which secrets come, go and come again."""
    docs = _table(spark, sf_dir, "documents")
    steps = F.array_compact(F.array(*[F.when(F.expr(asked), F.expr(patch.format(secret=SECRET_LINE))) for asked, patch in REPLAYED]))
    return spread(docs, "doc_id", SPLITS).select(
        F.col("source").alias("repo"), "doc_id", F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.posexplode(steps).alias("step", "patch"),
    ).select("repo", F.concat_ws("-", "doc_id", "step").alias("commit_id"), (F.col("doc_id") * 3 + F.col("step")).alias("seq"),
             F.timestamp_seconds("doc_id").alias("ts"), "path", "patch")


def _text_tree(spark: SparkSession, sf_dir: str) -> str:
    """Documents written out as a tree of text files of at most 500 documents each."""
    path = scratch_path(spark, "tree")
    docs = _table(spark, sf_dir, "documents").select("source", "text")
    docs.write.option("maxRecordsPerFile", 500).partitionBy("source").text(path)
    return path


def _per_source_file(units: DataFrame) -> DataFrame:
    found = mask(detect(units))
    return found.groupBy(
        F.regexp_extract("uri", "source=([^/]+)/", 1).alias("source"), "type", "fingerprint"
    ).agg(F.count("*").alias("n_findings"))


def _report_roundtrip(spark: SparkSession, sf_dir: str, verbose: bool = False) -> DataFrame:
    path = scratch_path(spark, "report")
    sinks.write_report(_findings(spark, sf_dir), path, verbose=verbose)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _findings_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "findings")
    sinks.write_findings(_findings(spark, sf_dir), path)
    return spark.read.parquet(path)


def _domains_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "domains")
    names = _table(spark, sf_dir, "pages").select(F.concat(F.lit("  "), F.upper(host(F.col("url"))), F.lit(" \n")).alias("value"))
    names.write.text(path)
    return read_domains(spark, path)


def _even_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose name has an even length: a derived list of domains that leaves the others out."""
    name = host(F.col("url"))
    return _table(spark, sf_dir, "pages").filter(F.length(name) % 2 == 0).select(name.alias("domain")).distinct()


def _crossed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to the page after them and to one further on, often of another site."""
    pages = _table(spark, sf_dir, "pages")
    other = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("following"))
    further = pages.select((F.col("page_id") - 7).alias("page_id"), F.col("url").alias("further"))
    linked = pages.join(other, "page_id", "left").join(further, "page_id", "left")
    return linked.select("page_id", "url", F.expr(CROSSED_HTML).alias("html"))


def _stream_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "documents").schema
    # a table may be one file or a folder of part files; file streams read folders and patterns
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    return units_from(stream.withColumn("ts", F.timestamp_seconds("doc_id")), "doc_id", "text", "concat(source, '/', doc_id)", keep=["source", "ts"])


def _run_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    write_available(stream, path, state).awaitTermination()
    return spark.read.parquet(path)


def _x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_stream(_stream_units(spark, sf_dir), keep=("source", "ts")).withColumn("uri", F.col("source"))
    return _run_stream(spark, dedup_stream(found, "10 minutes")).select("fingerprint", "uri", "type")


# Micro-batches of the stream below, 1000 seconds apart, and a horizon after which a secret is reported again in the third batch behind it.
SLICES, HORIZON = 8, "400 seconds"

# A few secrets per source that come again and again, in some batches.
REPEATED_TEXT = "concat('secret_token = \"', md5(concat('k', doc_id % 5)), '\"')"


def _x2_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight micro-batches, each with its own time; what is reported, by batch."""
    docs = _table(spark, sf_dir, "documents")
    slices = docs.select(
        "doc_id", "source", F.expr(REPEATED_TEXT).alias("text"), F.expr(f"doc_id % 7 * 3 % {SLICES}").alias("slice"),
        F.expr(f"timestamp_seconds((1 + doc_id % 7 * 3 % {SLICES}) * 1000 + doc_id % 100)").alias("ts"))
    path = scratch_path(spark, "slices")
    for k in range(SLICES):
        # one after the other, as a stream's files come; one file is one micro-batch
        slices.filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(slices.drop("slice").schema).option("maxFilesPerTrigger", 1).parquet(path)
    units = units_from(stream, "doc_id", "text", "source", keep=["source", "ts"])
    found = scan_stream(units, select_rules(RULES, rule_ids=["generic_secret"]), keep=("ts",))
    out = _run_stream(spark, dedup_stream(found, HORIZON))
    return out.select("fingerprint", "uri", (F.floor(F.unix_timestamp("ts") / 1000) - 1).alias("batch"))


def _entropy_spans(text: str) -> list[tuple[int, int]]:
    """40 lower-case hex digits, not part of a longer run, of high entropy."""
    import math
    import re
    from collections import Counter

    def bits(value: str) -> float:
        return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())

    return [m.span() for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])", text) if bits(m.group()) > 3.0]


def _thread_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = _table(spark, sf_dir, "conversations")
    return conv.select(F.concat_ws("/", "conv_id", "turn").alias("src"), F.concat_ws("/", "conv_id", F.col("turn") + 1).alias("dst"))


def _budgeted(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return page_budget(_table(spark, sf_dir, "pages").select("page_id", "url"), n)


def entry(spark: SparkSession) -> DataFrame:
    """Scan summary per source on the smallest tables."""
    sf_dir = "/root/testdata/sf0.001"
    return grp.scan_summary(
        _table(spark, sf_dir, "documents"), detect(_documents(spark, sf_dir), keep=("source",)), "source"
    )


Query = Callable[[SparkSession, str], DataFrame]


def _corpus_modules() -> list:
    """The modules that register corpus queries, if they and what they need are installed."""
    try:
        return _imported()
    except ImportError:
        return []


def _imported() -> list:
    return [importlib.import_module("leaksieve.llm.queries"), importlib.import_module("corpus_pipeline")]


def queries() -> dict[str, Query]:
    corpus = {name: query for module in _corpus_modules() for name, query in module.queries().items()}
    return _scan_queries() | corpus


def oracle_sql() -> dict[str, str]:
    corpus = {name: sql for module in _corpus_modules() for name, sql in module.oracle_sql().items() if sql}
    return _scan_oracle_sql() | corpus


def _scan_queries() -> dict[str, Query]:
    def pages(s, d):
        return _table(s, d, "pages")

    def docs(s, d):
        return _table(s, d, "documents")

    def crossed(s, d):
        return _crossed_pages(s, d)

    def planted_pages(s, d):
        return pages(s, d).withColumn("html", F.expr(PLANTED_HTML))

    def context(name: str) -> Query:
        return lambda s, d: _digest(units_from_pages(planted_pages(s, d), [name]))

    def page_findings(s, d):
        return mask(detect(units_from_pages(pages(s, d))))

    def named(s, d):
        return _documents(s, d, uri=NAMED_URI).drop("source")

    def history(s, d):
        found = detect(units_from_history(_commits(s, d)), keep=(*HISTORY_COLUMNS, "text"))
        return mask(with_line_numbers(found))

    def sourced(s, d, parity=None):
        units = _documents(s, d)
        if parity is not None:
            units = units.filter(F.col("doc_id") % 2 == parity)
        return mask(detect(units, keep=("source", "doc_id"), names_once=True)).withColumnsRenamed({"doc_id": "seq"}).withColumn("commit_id", F.col("unit_id"))

    generic = select_rules(RULES, rule_ids=["generic_secret"])
    return {
        # sources
        "s1_read_file": lambda s, d: _per_source_file(read_file(s, f"{_text_tree(s, d)}/source=*/*.txt")),
        "s2_read_dir": lambda s, d: _per_source_file(read_dir(s, _text_tree(s, d))),
        "s3_units_from_documents": lambda s, d: _digest(_documents(s, d)),
        "s3_units_from_conversations": lambda s, d: _digest(_conversations(s, d)),
        "s3_scan_conversations": lambda s, d: grp.scan_summary(
            _table(s, d, "conversations"), detect(_conversations(s, d), keep=("role",)), "role"),
        "s4_units_from_pages": lambda s, d: _digest(units_from_pages(pages(s, d))),
        "s5_units_from_history": lambda s, d: units_from_history(_commits(s, d)).select(
            "unit_id", "uri", "repo", "commit_id", "seq", "path", "line_no", F.md5("text").alias("digest")),
        "s6_read_domains": _domains_file,
        # sinks
        "k1_report_blocks": lambda s, d: sinks.report_blocks(_findings(s, d)),
        "k1_write_report": _report_roundtrip,
        "k1_verbose_report": lambda s, d: _report_roundtrip(s, d, verbose=True),
        "k2_write_findings": _findings_roundtrip,
        "k3_gate": lambda s, d: grp.gate(_findings(s, d), max_allowed=20),
        # rules and detection
        "d1_rules": lambda s, d: rules(s).drop("regex", "keyword").join(
            _planted(s, d).groupBy("rule_id").agg(F.count("*").alias("n")), "rule_id", "left"
        ).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))),
        "d2_detect": lambda s, d: detect(_documents(s, d)),
        "d2_detect_every_family": _planted,
        "d2_planted_values": _planted_values,
        "d2_detect_conversations": lambda s, d: detect(_conversations(s, d)),
        "d2_detect_config_files": lambda s, d: detect(named(s, d), select_rules(RULES, families=["config_file"]), names_once=True),
        "d3_positions": lambda s, d: detect(_documents(s, d), keep=("text",)).select(
            "unit_id", "start", "end", F.expr("substring(text, int(start + 1), int(`end` - start))").alias("slice")),
        "d4_value_in_context": lambda s, d: detect(_documents(s, d), generic).select("unit_id", "rule_id", "value"),
        "d5_with_rules": lambda s, d: detect(_documents(s, d), with_rules(s, generic, [CUSTOM])),
        "d6_select_rules": lambda s, d: detect(
            _documents(s, d, text=PLANTED_TEXT), select_rules(RULES, families=["aws", "google", "session"])),
        "d7_mask": lambda s, d: mask(_planted(s, d)),
        "d8_best_rule": lambda s, d: best_rule(_planted(s, d)),
        # web contexts
        "c1_scripts": context("script"),
        "c2_css": context("css"),
        "c3_handlers": context("handler"),
        "c4_meta": context("meta"),
        "c5_config": context("config"),
        "c6_json": context("json"),
        "c6_json_leaves": lambda s, d: units_from_json(docs(s, d).withColumn("json", F.to_json(F.struct(
            F.struct("text", F.array(F.struct(F.col("source").alias("from/to"))).alias("a.b")).alias("doc"), F.array("lang", F.col("n_chars").cast("string")).alias("~")
        ))), "doc_id", "json", "source").select("unit_id", "path", "value_at", "named", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest")),
        "c6_scan_json_leaves": lambda s, d: detect(
            units_from_page_json(pages(s, d).withColumn("html", F.expr(JSON_HTML))), select_rules(RULES, rule_ids=[r for r, _, _, _ in JSON_VALUES]), keep=("path", "value_at")
        ).select("uri", "context", "rule_id", "path", "value", (F.col("start") - F.col("value_at")).alias("place")),
        "c7_html": context("html"),
        "c8_decode_entities": lambda s, d: pages(s, d).select(
            "page_id", F.md5(decode_entities(F.expr(PLANTED_HTML))).alias("digest")),
        "c8_stored_places": lambda s, d: stored_places(detect(
            units_from_pages(pages(s, d).withColumn("n", F.length("html")).withColumn("html", F.expr(HIDDEN_HTML)), ["html"], keep=["html", "n"]),
            select_rules(RULES, rule_ids=["aws_access_key_id"]), keep=("html", "n"))).filter("stored_start >= n").select(
            "uri", "value", "stored_start", "stored_end", F.expr("substring(html, int(stored_start + 1), int(stored_end - stored_start))").alias("stored")),
        "c9_scan_pages": page_findings,
        "c9_scan_every_context": lambda s, d: mask(detect(units_from_pages(planted_pages(s, d)))),
        # filters
        "f1_drop_minified": lambda s, d: drop_minified(named(s, d)).select("unit_id", "uri"),
        "f2_drop_assets": lambda s, d: drop_assets(named(s, d)).select("unit_id", "uri"),
        "f3_drop_test_data": lambda s, d: drop_test_data(named(s, d)).select("unit_id", "uri"),
        "f4_drop_noise": lambda s, d: drop_noise(_planted(s, d)),
        "f5_in_scope": lambda s, d: in_scope(pages(s, d), DOMAIN).select("page_id", "url"),
        "f5_in_scope_exact": lambda s, d: in_scope(pages(s, d), "thther.example.org", subdomains=False).select("page_id", "url"),
        "f6_in_list": lambda s, d: in_list(pages(s, d), _even_hosts(s, d)).select("page_id", "url"),
        "f7_include_all": lambda s, d: drop_likely_false_positives(named(s, d), include_all=True).select("unit_id", "uri"),
        "f9_url_names": lambda s, d: drop_likely_false_positives(
            pages(s, d).select(F.col("page_id").cast("string").alias("unit_id"), F.expr(ADDRESSES).alias("uri"))),
        "f8_default_filters": lambda s, d: scan_units(named(s, d)),
        # grouping
        "a1_by_unit": lambda s, d: grp.by_unit(_findings(s, d)).withColumn("types", F.array_join("types", ",")),
        "a1_by_unit_pages": lambda s, d: grp.by_unit(mask(detect(units_from_pages(planted_pages(s, d))))).withColumn("types", F.array_join("types", ",")),
        "a1_listed_by_unit": lambda s, d: grp.listed_by_unit(mask(_planted(s, d))).withColumn("findings", F.array_join(F.transform(
            "findings", lambda f: F.concat_ws("|", f["start"], f["end"], f["type"], f["value_masked"])), ",")),
        "a2_by_type": lambda s, d: grp.by_type(mask(_planted(s, d))),
        "a3_project_brief": lambda s, d: grp.project(_findings(s, d)),
        "a3_project_verbose": lambda s, d: grp.project(_findings(s, d), verbose=True),
        "a4_scan_summary": lambda s, d: grp.scan_summary(docs(s, d), detect(_documents(s, d), keep=("source",)), "source"),
        "a5_shared_secrets": lambda s, d: grp.shared_secrets(_findings(s, d)),
        "a6_clean_units": lambda s, d: grp.clean_units(_documents(s, d), _findings(s, d)),
        "a7_redact": lambda s, d: redact(_documents(s, d)).select("unit_id", F.md5("text").alias("digest")),
        "a7_redact_keys": lambda s, d: redact(_documents(s, d, text=KEY_TEXT)).select("unit_id", "text"),
        "a7_redact_every_family": lambda s, d: redact(_documents(s, d, text=PLANTED_TEXT)).select(
            "unit_id", F.md5("text").alias("digest")),
        # page graph
        "w1_links": lambda s, d: links(pages(s, d)),
        "w1_links_planted": lambda s, d: links(pages(s, d).withColumn("html", F.expr(LINKED_HTML))),
        "w2_subdomains": lambda s, d: subdomains(pages(s, d), DOMAIN),
        "w3_reachable_pages": lambda s, d: reachable(
            links(pages(s, d)), in_scope(pages(s, d), DOMAIN).select(F.regexp_replace("url", "#.*$", "").alias("url")), 2),
        "w3_reachable_threads": lambda s, d: reachable(
            _thread_links(s, d), _table(s, d, "conversations").filter("turn = 0").select(F.concat_ws("/", "conv_id", "turn").alias("url")), 3),
        "w4_page_budget": lambda s, d: _budgeted(s, d, 3),
        "w5_scan_site": lambda s, d: scan_site(pages(s, d), DOMAIN, depth=2, max_pages=60, seeds=in_scope(pages(s, d), DOMAIN).select(
            F.regexp_replace("url", "#.*$", "").alias("url"))),
        "w5_scan_domains": lambda s, d: scan_domains(pages(s, d), _even_hosts(s, d)),
        "w5_sites_pages": lambda s, d: sites_pages(crossed(s, d), _even_hosts(s, d), depth=2, max_pages=3, seeds=crossed(s, d).filter("page_id % 5 = 0").select("url")).select("page_id", F.md5("html").alias("digest")),
        "w5_scan_domains_limited": lambda s, d: scan_domains(crossed(s, d), _even_hosts(s, d), depth=2, max_pages=3, seeds=crossed(s, d).filter("page_id % 5 = 0").select("url")),
        # history
        "h1_added_lines": lambda s, d: added_lines(_commits(s, d)).select(
            "repo", "commit_id", "path", "line_no", F.md5("text").alias("digest")),
        "h1_scan_history": history,
        "h2_first_seen": lambda s, d: first_seen(sourced(s, d)),
        "h3_history_only": lambda s, d: history_only(sourced(s, d, 0), sourced(s, d, 1)),
        "h3_standing_secrets": lambda s, d: standing_secrets(_replayed(s, d)),
        "h3_scan_removed": lambda s, d: scan_removed(_replayed(s, d), generic, include_all=True).select("repo", "commit_id", "path", "line_no", "fingerprint"),
        # streaming and Python rules
        "x1_scan_stream": lambda s, d: _run_stream(s, scan_stream(_stream_units(s, d))),
        "x2_dedup_stream": _x2,
        "x2_dedup_horizon": _x2_horizon,
        "u1_python_rule": lambda s, d: with_python_rule(_documents(s, d), "hex_entropy", _entropy_spans, "Hex Token", "[0-9a-f]{40}"),
    }


def _scan_oracle_sql() -> dict[str, str]:
    docs, conv = duck.DOCUMENTS, duck.CONVERSATIONS
    raw = duck.detect(docs)
    found = duck.masked(raw)
    planted_docs = f"SELECT * REPLACE ({PLANTED_TEXT} AS text) FROM ({docs})"
    planted = duck.detect(planted_docs)
    planted_pages = f"SELECT * REPLACE ({PLANTED_HTML} AS html) FROM pages"
    named = f"SELECT unit_id, {NAMED_URI} AS uri, context, text, doc_id FROM ({docs})"
    generic = select_rules(RULES, rule_ids=["generic_secret"])
    re = duck.lit

    def digest(units: str) -> str:
        return f"SELECT unit_id, uri, context, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM ({units})"

    def summary(units: str, by: str) -> str:
        return f"""SELECT u.{by}, count(*) AS n_units, count(f.unit_id) AS n_units_with_findings, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_findings
          FROM ({units}) u LEFT JOIN (SELECT unit_id, count(*) AS n FROM ({duck.detect(units)}) GROUP BY 1) f USING (unit_id) GROUP BY 1"""

    def redacted(units: str) -> str:
        text = "text"
        for rule in RULES:
            if rule.target == "text":
                text = f"regexp_replace({text}, {re(rule.regex + rule.followed)}, {re(chr(92) + '1[REDACTED:' + rule.type + ']' + rule.followed)}, 'g')"
        return f"SELECT unit_id, md5({text}) AS digest FROM ({units})"

    per_file = f"SELECT source, type, fingerprint, count(*) AS n_findings FROM ({duck.masked(duck.detect(docs, keep=['source']))}) GROUP BY ALL"
    block = """concat('Type: ', type, chr(10), 'Value: ', value_masked, chr(10), 'Position: ', CAST(start AS VARCHAR), '-',
      CAST("end" AS VARCHAR), chr(10), 'File: ', uri, chr(10), repeat('-', 50))"""
    hosts = f"SELECT DISTINCT {duck.host('url')} AS domain FROM pages"
    even = f"SELECT domain FROM ({hosts}) WHERE length(domain) % 2 = 0"
    listed = f"SELECT * FROM pages WHERE EXISTS (SELECT 1 FROM ({even}) e WHERE {duck.host('url')} = e.domain OR ends_with({duck.host('url')}, '.' || e.domain))"
    scope = f"({duck.host('url')} = '{DOMAIN}' OR ends_with({duck.host('url')}, '.{DOMAIN}'))"
    name = duck.name_of("uri")
    minified, tests = f"regexp_matches({name}, {re(duck.flt.MINIFIED)})", f"regexp_matches({name}, {re(duck.flt.TEST_PATH)})"
    asset = f"lower(regexp_extract({name}, {re(duck.flt.EXTENSION)}, 1)) IN ({', '.join(map(re, duck.flt.ASSET_EXTENSIONS))})"
    lines = """SELECT source AS repo, concat('c', doc_id) AS commit_id, doc_id AS seq, concat(lang, '.txt') AS path, text, i, l[i] AS line,
      (i - 1) % 3 AS mark, len(l) AS n, l FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))"""
    added = f"""SELECT repo, commit_id, seq, path, CAST(11 + (i - 1) - i // 3 AS BIGINT) AS line_no, line AS text FROM ({lines}) WHERE mark = 0
      UNION ALL SELECT repo, commit_id, seq, path, CAST(899 + i AS BIGINT) AS line_no, line AS text FROM ({lines})"""
    # every third line stands alone in the first hunk, the second hunk adds the whole text
    runs = f"""SELECT repo, commit_id, seq, path, CAST(11 + (i - 1) - i // 3 AS BIGINT) AS line_no, line AS text FROM ({lines}) WHERE mark = 0
      UNION ALL SELECT source, concat('c', doc_id), doc_id, concat(lang, '.txt'), 900, text FROM documents"""
    hist_units = f"""SELECT concat_ws(':', repo, commit_id, path, CAST(line_no AS VARCHAR)) AS unit_id, concat(repo, '/', path) AS uri,
      'raw' AS context, text, repo, commit_id, seq, path, line_no FROM ({runs})"""
    text_lines = f"SELECT unit_id, uri, context, source, unnest(string_split(text, chr(10))) AS text FROM ({docs})"
    sourced = f"SELECT * EXCLUDE (doc_id), doc_id AS seq, unit_id AS commit_id FROM ({duck.masked(duck.detect(docs, keep=['source', 'doc_id']))})"
    thread = "SELECT concat(conv_id, '/', turn) AS url, turn AS depth FROM conversations"
    page_links = duck.links()
    scoped_address = f"SELECT DISTINCT {duck.address('url')} AS url FROM pages WHERE {scope}"
    site = f"""SELECT * FROM pages WHERE {scope} AND {duck.address('url')} IN
      (SELECT url FROM ({scoped_address}) ORDER BY url LIMIT 60)"""

    crossed = f"""SELECT p.page_id, p.url, {CROSSED_HTML} AS html FROM pages p LEFT JOIN (SELECT page_id - 1 AS page_id, url AS following FROM pages) USING (page_id)
      LEFT JOIN (SELECT page_id - 7 AS page_id, url AS further FROM pages) USING (page_id)"""
    of_site = f"({{0}} = e.domain OR ends_with({{0}}, '.' || e.domain))"
    limited = f"""WITH RECURSIVE crossed AS MATERIALIZED ({crossed}), even AS MATERIALIZED ({even}), hops AS MATERIALIZED ({duck.links(pages='SELECT * FROM crossed')}),
      stored AS MATERIALIZED (SELECT DISTINCT e.domain AS site, {duck.address('url')} AS url FROM crossed JOIN even e ON {of_site.format(duck.host('url'))}),
      walk(site, url, depth) AS (
        SELECT DISTINCT domain, {duck.address('url')}, 0 FROM crossed JOIN even e ON {duck.host('url')} = e.domain WHERE page_id % 5 = 0
        UNION SELECT w.site, h.dst, w.depth + 1 FROM walk w JOIN stored s ON s.site = w.site AND s.url = w.url JOIN hops h ON h.src = w.url
          JOIN even e ON e.domain = w.site AND {of_site.format(duck.host('h.dst'))} WHERE w.depth < 2),
      near AS (SELECT site, url, min(depth) AS depth FROM walk JOIN stored USING (site, url) GROUP BY 1, 2),
      chosen AS (SELECT url FROM near QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth, url) <= 3)
      SELECT * FROM crossed WHERE {duck.address('url')} IN (SELECT url FROM chosen)"""

    def page_scan(pages: str) -> str:
        units = f"SELECT * FROM ({duck.contexts(pages=pages)}) WHERE NOT ({minified} OR {asset} OR {tests})"
        return duck.masked(duck.noise_free(duck.detect(units, named="named")))

    catalogue = ", ".join(f"({re(r.rule_id)}, {re(r.type)}, {re(r.family)}, {re(r.kind)})" for r in RULES)
    out = {
        "s1_read_file": per_file,
        "s2_read_dir": per_file,
        "s3_units_from_documents": digest(docs),
        "s3_units_from_conversations": digest(conv),
        "s3_scan_conversations": summary(conv, "role"),
        "s4_units_from_pages": digest(duck.contexts()),
        "s5_units_from_history": f"SELECT * EXCLUDE (text, context), md5(text) AS digest FROM ({hist_units})",
        "s6_read_domains": hosts,
        "k1_report_blocks": f'SELECT uri, start, "end", type, context, unit_id, {block} AS block FROM ({found})',
        "k1_write_report": f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split({block}, chr(10))) AS line FROM ({found})) GROUP BY 1",
        "k2_write_findings": found,
        "k3_gate": f"SELECT count(*) AS n_findings, count(*) <= 20 AS passed FROM ({raw})",
        "d1_rules": f"""SELECT r.*, coalesce(n, 0) AS n FROM (VALUES {catalogue}) r(rule_id, type, family, kind)
          LEFT JOIN (SELECT rule_id, count(*) AS n FROM ({planted}) GROUP BY 1) USING (rule_id)""",
        "d2_detect": raw,
        "d2_detect_every_family": planted,
        "d2_planted_values": " UNION ALL ".join(
            f"""SELECT CAST(doc_id AS VARCHAR) AS unit_id, '{rule}' AS rule_id, {_render(value)} AS value,
              CAST(length(text) + 1 + length({_render(before)}) AS BIGINT) AS start,
              CAST(length(text) + 1 + length({_render(before)}) + length({_render(value)}) AS BIGINT) AS "end"
              FROM documents WHERE doc_id % {len(PLANTS)} = {_plant(part)}""" for part, rule, before, value in PLANTED_VALUES),
        "d2_detect_conversations": duck.detect(conv),
        "d2_detect_config_files": duck.detect(named, select_rules(RULES, families=["config_file"]), names_once=True),
        "d3_positions": f"""SELECT unit_id, start, "end", substring(text, start + 1, "end" - start) AS slice
          FROM ({duck.detect(docs, keep=['text'])})""",
        "d4_value_in_context": f"SELECT unit_id, rule_id, value FROM ({duck.detect(docs, generic)})",
        "d5_with_rules": duck.detect(docs, [*generic, CUSTOM]),
        "d6_select_rules": duck.detect(planted_docs, select_rules(RULES, families=["aws", "google", "session"])),
        "d7_mask": duck.masked(planted),
        "d8_best_rule": duck.best(planted),
        **{f"c{i}_{label}": digest(duck.contexts([name], planted_pages)) for i, (label, name) in enumerate(
            [("scripts", "script"), ("css", "css"), ("handlers", "handler"), ("meta", "meta"), ("config", "config"), ("json", "json"), ("html", "html")], start=1)},
        "c6_json_leaves": " UNION ALL ".join(
            f"""SELECT concat(CAST(doc_id AS VARCHAR), '#{path}') AS unit_id, '{path}' AS path, CAST(length('{keys}') + 4 AS INTEGER) AS value_at, {path.startswith('/doc/a.b')} AS named,
              CAST(length('{keys}') + 5 + length({value}) AS BIGINT) AS n_chars, md5(concat('{keys} = "', {value}, '"')) AS digest FROM documents WHERE {value} IS NOT NULL"""
            for path, keys, value in [
                ("/doc/text", "doc.text", "text"), ("/doc/a.b/0/from~1to", "doc.a.b.from/to", "source"), ("/~0/0", "~", "lang"), ("/~0/1", "~", "CAST(n_chars AS VARCHAR)")]),
        "c6_scan_json_leaves": " UNION ALL ".join(
            f"SELECT url AS uri, 'leaf' AS context, '{rule}' AS rule_id, '{path}' AS path, {value} AS value, CAST({place} AS BIGINT) AS place FROM pages" for rule, path, value, place in JSON_VALUES),
        "c8_decode_entities": f"SELECT page_id, md5({duck.decode('html')}) AS digest FROM ({planted_pages})",
        "c8_stored_places": f"""SELECT url AS uri, concat('AKIA', upper(left(md5(html), 16))) AS value, CAST(length(html) + {len('<p title=&quot;&amp;lt;&gt; ')} AS BIGINT) AS stored_start,
          CAST(length(html) + {len('<p title=&quot;&amp;lt;&gt; ')} + length({HIDDEN_KEY}) AS BIGINT) AS stored_end, {HIDDEN_KEY} AS stored FROM pages""",
        "c9_scan_pages": duck.masked(duck.detect(duck.contexts(), named="named")),
        "c9_scan_every_context": duck.masked(duck.detect(duck.contexts(pages=planted_pages), named="named")),
        "f1_drop_minified": f"SELECT unit_id, uri FROM ({named}) WHERE NOT {minified}",
        "f2_drop_assets": f"SELECT unit_id, uri FROM ({named}) WHERE NOT {asset}",
        "f3_drop_test_data": f"SELECT unit_id, uri FROM ({named}) WHERE NOT {tests}",
        "f4_drop_noise": duck.noise_free(planted),
        "f5_in_scope": f"SELECT page_id, url FROM pages WHERE {scope}",
        "f5_in_scope_exact": f"SELECT page_id, url FROM pages WHERE {duck.host('url')} = 'thther.example.org'",
        "f6_in_list": f"SELECT page_id, url FROM ({listed})",
        "f7_include_all": f"SELECT unit_id, uri FROM ({named})",
        # by construction: only the appended file name is one
        "f9_url_names": f"SELECT CAST(page_id AS VARCHAR) AS unit_id, {ADDRESSES} AS uri FROM pages WHERE page_id % 6 <> 5",
        "f8_default_filters": duck.masked(duck.noise_free(duck.detect(f"SELECT * FROM ({named}) WHERE NOT ({minified} OR {asset} OR {tests})"))),
        "a1_by_unit_pages": f"""SELECT uri, count(*) AS n_findings, count(DISTINCT fingerprint) AS n_secrets, string_agg(DISTINCT type, ',' ORDER BY type) AS types
          FROM ({duck.masked(duck.detect(duck.contexts(pages=planted_pages), named="named"))}) GROUP BY 1""",
        "k1_verbose_report": f"""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(concat(replace({block}, repeat('-', 50), ''), 'Context: ', context, chr(10),
          'Unit: ', unit_id, chr(10), 'Rule: ', rule_id, chr(10), 'Fingerprint: ', fingerprint, chr(10), repeat('-', 50)), chr(10))) AS line FROM ({found})) GROUP BY 1""",
        "a1_by_unit": f"SELECT uri, count(*) AS n_findings, count(DISTINCT fingerprint) AS n_secrets, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ({found}) GROUP BY 1",
        "a1_listed_by_unit": f"""SELECT uri, unit_id, CAST(start // 65536 AS BIGINT) AS piece, count(*) AS n_findings, string_agg(concat_ws('|',
          CAST(start AS VARCHAR), CAST("end" AS VARCHAR), type, value_masked), ',' ORDER BY start, "end", type, value_masked) AS findings
          FROM ({duck.masked(planted)}) GROUP BY 1, 2, 3""",
        "a2_by_type": f"SELECT type, count(*) AS n_findings, count(DISTINCT fingerprint) AS n_secrets FROM ({duck.masked(planted)}) GROUP BY 1",
        "a3_project_brief": f'SELECT uri, type, value_masked, start, "end" FROM ({found})',
        "a3_project_verbose": f'SELECT uri, type, value_masked, start, "end", context, unit_id, rule_id, fingerprint FROM ({found})',
        "a4_scan_summary": summary(docs, "source"),
        "a5_shared_secrets": f"""SELECT fingerprint, count(DISTINCT uri) AS n_uris, count(*) AS n_findings FROM ({found})
          GROUP BY 1 HAVING count(DISTINCT uri) >= 2""",
        "a6_clean_units": f"SELECT DISTINCT uri FROM ({docs}) WHERE uri NOT IN (SELECT uri FROM ({raw}))",
        "a7_redact": redacted(docs),
        "a7_redact_keys": f"SELECT CAST(doc_id AS VARCHAR) AS unit_id, {KEY_TEXT_LEFT} AS text FROM documents",
        "a7_redact_every_family": redacted(planted_docs),
        "w1_links": page_links,
        "w1_links_planted": " UNION ALL ".join(
            f"SELECT DISTINCT {duck.address('url')} AS src, concat('{before}', {number}, '{after}') AS dst FROM pages" for before, number, after in LINKED_TO),
        "w2_subdomains": f"""SELECT DISTINCT host FROM (SELECT {duck.host('url')} AS host FROM pages UNION ALL
          SELECT {duck.host('dst')} AS host FROM ({page_links})) WHERE host = '{DOMAIN}' OR ends_with(host, '.{DOMAIN}')""",
        "w3_reachable_pages": f"""WITH RECURSIVE l AS MATERIALIZED ({page_links}), r(url, depth) AS (SELECT url, 0 AS depth FROM ({scoped_address}) UNION
          SELECT dst, depth + 1 FROM r JOIN l ON src = r.url WHERE depth < 2) SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1""",
        "w3_reachable_threads": f"""SELECT concat(conv_id, '/', turn) AS url, CAST(turn AS INTEGER) AS depth FROM conversations WHERE turn <= 3
          UNION SELECT concat(conv_id, '/', turn + 1), CAST(turn + 1 AS INTEGER) FROM conversations WHERE turn <= 2""",
        "w4_page_budget": f"""SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY {duck.host('url')} ORDER BY url, page_id) AS rn FROM pages)
          WHERE rn <= 3""",
        "w5_scan_site": page_scan(site),
        "w5_scan_domains": page_scan(listed),
        "w5_sites_pages": f"SELECT page_id, md5(html) AS digest FROM ({limited})",
        "w5_scan_domains_limited": page_scan(limited),
        "h1_added_lines": f"SELECT repo, commit_id, path, line_no, md5(text) AS digest FROM ({added})",
        "h1_scan_history": duck.masked(f"""SELECT * EXCLUDE (text)
          REPLACE (line_no + length(left(text, start)) - length(replace(left(text, start), chr(10), '')) AS line_no)
          FROM ({duck.detect(hist_units, keep=[*HISTORY_COLUMNS, "text"])})"""),
        "h2_first_seen": f"""SELECT fingerprint, n_findings, seq, commit_id, uri, unit_id, start, type FROM (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS n_findings,
          row_number() OVER (PARTITION BY fingerprint ORDER BY seq, commit_id, uri, unit_id, start, type) AS rn FROM ({sourced})) WHERE rn = 1""",
        "h3_history_only": f"""WITH f AS ({sourced}) SELECT * FROM f WHERE seq % 2 = 0 AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE seq % 2 = 1)""",
        # by construction, and what the texts themselves hold
        "h3_standing_secrets": f"""SELECT repo, fingerprint, CAST(sum(n) AS BIGINT) AS n_standing FROM (
            SELECT source AS repo, sha256(md5(concat('s', text))) AS fingerprint, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS n FROM documents
            UNION ALL SELECT source, fingerprint, 1 FROM ({duck.masked(duck.detect(text_lines, [r for r in RULES if r.target == "text"], keep=["source"]))})
          ) GROUP BY 1, 2 HAVING sum(n) > 0""",
        "h3_scan_removed": f"""WITH s AS (SELECT source AS repo, doc_id, concat(lang, '/', doc_id, '.txt') AS path, sha256(md5(concat('s', text))) AS fingerprint FROM documents)
          SELECT repo, concat(doc_id, '-0') AS commit_id, path, CAST(1 AS BIGINT) AS line_no, fingerprint FROM s
          WHERE (repo, fingerprint) NOT IN (SELECT (repo, fingerprint) FROM s WHERE doc_id % 3 <> 1)""",
        "x1_scan_stream": found,
        "u1_python_rule": f"""SELECT uri, 'Hex Token' AS type, value, start, "end", context, unit_id, 'hex_entropy' AS rule_id
          FROM ({duck.detect(docs, [HEX_RUN])}) WHERE list_aggregate(string_split(value, ''), 'entropy') > 3.0""",
        "x2_dedup_horizon": f"""WITH RECURSIVE seen AS (
            SELECT DISTINCT sha256(md5(concat('k', doc_id % 5))) AS fingerprint, source AS uri, doc_id % 7 * 3 % {SLICES} AS batch FROM documents),
          told AS (SELECT fingerprint, uri, min(batch) AS batch FROM seen GROUP BY 1, 2
            UNION ALL SELECT fingerprint, uri, later FROM (SELECT t.fingerprint, t.uri, min(s.batch) AS later FROM told t
              JOIN seen s ON s.fingerprint = t.fingerprint AND s.uri = t.uri AND s.batch >= t.batch + 3 GROUP BY 1, 2))
          SELECT fingerprint, uri, CAST(batch AS BIGINT) AS batch FROM told""",
        "x2_dedup_stream": f"SELECT DISTINCT fingerprint, source AS uri, type FROM ({duck.masked(duck.detect(docs, keep=['source']))})",
    }
    return out
