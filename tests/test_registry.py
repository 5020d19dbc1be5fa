"""Registered queries: names, coverage by checks, agreement with DuckDB and plan shape.

``python tests/compare.py <folder>`` runs all of them; here a fast selection runs by default and
all of them with ``ALL_QUERIES=1``.
"""

import datetime
import os
import pathlib
import re

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from fundtrail.plans import catalog

FAST = (
    "scan_edges hubs peel_links fan_out mixer_adjacent subgraph_stats time_split leakage_report batch_verdicts "
    "attribute_clusters change_address_links scan_tx_json_esplora record_constraints case_outcome alert_history alert_state"
).split()


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(catalog.checks())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_does_without_the_text_operators():
    """Only the entry module knows of the optional subpackage; nothing else in the package imports it."""
    package = pathlib.Path(entry.__file__).parent / "fundtrail"
    users = [p for p in package.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
    assert users == []


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FAST)
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    assert difference(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name]) is None


def test_growth_is_checked_to_five_hops(spark, tmp_path):
    """Orders in a line, each sharing a part with the next; the one customer's first order is at its end."""
    orders = [(i, i % 7, datetime.datetime(2020, 1, 1 + i)) for i in range(1, 8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i, i + d, 1, 1) for i in range(1, 8) for d in (0, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    customer = spark.createDataFrame([(1, "c", 0, 0.0, "s")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    customer.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    row = catalog.queries()["hop_growth_check"](spark, str(tmp_path)).first().asDict()
    assert [row.get(f"nodes_{d}") for d in (1, 2, 3, 5)] == [2, 3, 4, 6] and row["max_hop_reached"] == 5 and row["ok"]


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["rule", "nodes"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["edges_with_labels", "change_address_links", "case_summary", "leakage_report", "attribute_clusters"])
def test_no_pairwise_joins(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_limits_per_key_apply_before_the_exchange(spark, sf_dir):
    text = plan(entry.queries()["newest_txs_per_address"](spark, sf_dir))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange hashpartitioning[\s\S]*WindowGroupLimit.*Partial", text)


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(entry.queries()["labelled_only"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_orderstatus"}
