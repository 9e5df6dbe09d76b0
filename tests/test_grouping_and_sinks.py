from pyspark.sql import functions as F

from leaksieve import sinks
from leaksieve.operators import grouping as grp
from leaksieve.operators.detect import detect, mask
from leaksieve.sources.files import read_dir, read_domains, read_file
from leaksieve.plans.scans import scan_dir, scan_file
from samples import hexes


def skewed(spark, n=3000):
    """Findings of which a third have one uri, and another third one secret."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, F.lit("hot.txt")).otherwise(F.concat(F.lit("f"), i % 100)).alias("uri"),
        F.when(i % 2 == 0, F.lit("Generic Secret")).otherwise(F.lit("JSON Web Token")).alias("type"),
        (i * 50).alias("start"), (i * 50 + 40).alias("end"), F.lit("raw").alias("context"),
        F.concat(F.lit("u"), i % 500).alias("unit_id"), F.lit("r").alias("rule_id"), F.lit("***").alias("value_masked"),
        F.when(i % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("s"), i % 700)).alias("fingerprint"),
    )


def test_groupings_on_skewed_findings(spark):
    df = skewed(spark).cache()
    rows = df.collect()
    by_unit = {r.uri: r for r in grp.by_unit(df).collect()}
    assert by_unit["hot.txt"].n_findings == 1000 and by_unit["hot.txt"].types == ["Generic Secret", "JSON Web Token"]
    assert sum(r.n_findings for r in by_unit.values()) == 3000

    by_type = {r.type: (r.n_findings, r.n_secrets) for r in grp.by_type(df).collect()}
    for t in ("Generic Secret", "JSON Web Token"):
        mine = [r for r in rows if r.type == t]
        assert by_type[t] == (len(mine), len({r.fingerprint for r in mine}))

    shared = {r.fingerprint: (r.n_uris, r.n_findings) for r in grp.shared_secrets(df).collect()}
    assert shared["hot"] == (len({r.uri for r in rows if r.fingerprint == "hot"}), 1000)
    assert all(n > 1 for n, _ in shared.values())

    listed = grp.listed_by_unit(df, span=10_000).collect()
    assert sum(r.n_findings for r in listed) == 3000 == sum(len(r.findings) for r in listed)
    assert max(len(r.findings) for r in listed) <= 200
    assert all(list(r.findings) == sorted(r.findings) for r in listed)


def test_summary_counts_units_without_findings_and_null_sources(spark):
    units = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", None)], "unit_id string, source string")
    found = spark.createDataFrame([("1", "a"), ("1", "a"), ("4", None)], "unit_id string, source string")
    got = {r.source: tuple(r)[1:] for r in grp.scan_summary(units, found, "source").collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 0, 0), None: (1, 1, 1)}


def test_clean_units_gate_and_projection(spark, units):
    df = units([("a", f'token="{hexes(20)}"'), ("b", "nothing"), ("b", "again")])
    found = mask(detect(df))
    assert [r.uri for r in grp.clean_units(df, found).collect()] == ["b"]
    assert grp.gate(found).collect()[0].passed is False
    assert tuple(grp.gate(found, max_allowed=1).collect()[0]) == (1, True)
    assert grp.project(found).columns == list(grp.BRIEF)
    assert grp.project(found, verbose=True).columns == list(grp.VERBOSE)


def test_report_layout(spark, tmp_path):
    rows = [("https://x.com/app.js", "Google API Key", "AIza...c123", 120, 160), ("config.py", "AWS Secret Key", "wJal...EKEY", 45, 85),
            ("config.py", "JSON Web Token", "***", 7, 9)]
    found = spark.createDataFrame(rows, "uri string, type string, value_masked string, start bigint, end bigint")
    sinks.write_report(found, str(tmp_path / "report"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    ruler = "-" * 50 + "\n"
    assert lines == (
        "Type: JSON Web Token\nValue: ***\nPosition: 7-9\nFile: config.py\n" + ruler
        + "Type: AWS Secret Key\nValue: wJal...EKEY\nPosition: 45-85\nFile: config.py\n" + ruler
        + "Type: Google API Key\nValue: AIza...c123\nPosition: 120-160\nURL: https://x.com/app.js\n" + ruler
    )


def test_report_keeps_a_hot_uri_together(spark, tmp_path):
    found = skewed(spark)
    sinks.write_report(found, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    files = [line for line in text.split("\n") if line.startswith("File: ")]
    assert len(files) == 3000
    assert sum(a != b for a, b in zip(files, files[1:])) == len(set(files)) - 1


def test_structured_findings(spark, tmp_path):
    found = skewed(spark)
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        sinks.write_findings(found, path, fmt)
        assert spark.read.format(fmt).load(path).count() == 3000


def tree(tmp_path):
    token = hexes(32)
    files = {"app.js": f'token = "{token}"\n', "sub/deep/b.py": f'\n\nsecret = "{token}"', "app.min.js": f'token="{token}"',
             "tests/x.py": f'token="{token}"', ".env": "A=1\n", "sub/empty.txt": "",
             ".aws/credentials": "[x]\n", "sub/_private/c=d": "x", ".git/config": "[core]"}
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "logo.png").write_bytes(b"\x89PNG\r\n\xff\xfe")
    (tmp_path / "blob").write_bytes(b"\xff\xfet\x00o\x00")
    (tmp_path / "binary").write_bytes(b"\x00\x01token\xff")
    (tmp_path / "latin.py").write_bytes(f'# caf\xe9\ntoken = "{token}"\n'.encode("latin-1"))
    return token


def test_files(spark, tmp_path):
    root = tmp_path / "tests" / "site"  # a root below a folder of tests is not test data
    root.mkdir(parents=True)
    token = tree(root)
    one = read_file(spark, str(root / "app.js")).collect()
    assert len(one) == 1 and one[0].text == f'token = "{token}"\n' and one[0].uri.endswith("/app.js")

    kept = {r.uri.split("/site/")[1]: r.text for r in read_dir(spark, str(root)).collect()}
    assert set(kept) == {"app.js", "sub/deep/b.py", ".env", ".aws/credentials", "sub/_private/c=d", "blob", "latin.py"}
    assert kept["blob"] == "to" and kept["latin.py"].startswith("# café")
    assert set(r.uri.split("/site/")[1] for r in read_dir(spark, str(root), include_all=True).collect()) == set(kept) | {
        "app.min.js", "tests/x.py", "logo.png", "binary", ".git/config"}
    assert set(r.uri.split("/site/")[1] for r in read_dir(spark, str(root), hidden=False).collect()) == {"app.js", "sub/deep/b.py", "blob", "latin.py"}

    found = scan_dir(spark, str(root)).collect()
    assert sorted((r.uri.split("/")[-1], r.type) for r in found) == [
        (".env", "Critical Config File"), ("app.js", "Generic Secret"), ("b.py", "Generic Secret"), ("latin.py", "Generic Secret")]
    assert scan_dir(spark, str(root), include_all=True).filter("type = 'Generic Secret'").count() == 5
    assert scan_file(spark, [str(root / "app.min.js"), str(root / "app.js")]).count() == 2


def test_domain_list(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Example.com\n\n  example.com \nnotexample.com\n \n")
    assert sorted(r.domain for r in read_domains(spark, str(tmp_path / "d.txt")).collect()) == ["example.com", "notexample.com"]
