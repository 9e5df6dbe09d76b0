"""The registered queries against DuckDB, and the shape of their plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

TINY = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
CHECKED = [
    "s1_read_file", "s3_units_from_documents", "s4_units_from_pages", "s5_units_from_history", "s6_read_domains", "k1_write_report", "d2_detect",
    "d2_detect_every_family", "d2_planted_values", "d8_best_rule", "c3_handlers", "c5_config", "c6_json", "c7_html", "c8_decode_entities", "c9_scan_every_context",
    "f4_drop_noise", "f6_in_list", "f8_default_filters", "a1_listed_by_unit", "a4_scan_summary", "a7_redact_every_family", "w1_links", "w2_subdomains",
    "w3_reachable_threads", "w4_page_budget", "w5_scan_site", "w5_scan_domains_limited", "a7_redact_keys", "x2_dedup_horizon", "c8_stored_places", "c6_json_leaves", "c6_scan_json_leaves",
    "h3_standing_secrets", "h3_scan_removed", "h1_added_lines", "h2_first_seen", "x1_scan_stream",
]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_a_known_oracle():
    assert set(ORACLE) <= set(QUERIES)
    own = {name for name in QUERIES if not name.startswith("op") and name != "pipeline"}
    assert own - set(ORACLE) == set()


def test_flagship(spark):
    result = entry.entry(spark).collect()
    assert len(result) == 20 and sum(r.n_units for r in result) == 200


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0 and rows(got) == rows(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    def schema(df):
        return plan(df).split("ReadSchema: ")[1].split(">")[0]

    assert schema(QUERIES["d4_value_in_context"](spark, TINY)) == "struct<doc_id:bigint,text:string"
    assert schema(QUERIES["w4_page_budget"](spark, TINY)) == "struct<page_id:bigint,url:string"
    assert schema(QUERIES["f5_in_scope"](spark, TINY)) == "struct<page_id:bigint,url:string"


@pytest.mark.parametrize("name", ["a1_by_unit", "a2_by_type", "a5_shared_secrets", "h2_first_seen"])
def test_texts_stay_out_of_aggregation_shuffles(spark, name):
    """The only exchange that carries texts is the one that spreads a small input; another spreads the names that rules on names hit."""
    text = plan(QUERIES[name](spark, TINY))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    exchanges = [line for line in text.split("\n") if "Exchange" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in exchanges) == 2
    assert text.count("text:string") == 1 and "partial_" in text
