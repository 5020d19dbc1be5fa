"""Stored tables: what a search moves, hot keys, and searches from many seeds at once."""

import re

import pytest
from pyspark.sql import functions as F

from fundtrail import session
from fundtrail.operators import components, graph, live, rules, stored, utxo


@pytest.fixture
def no_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def line(spark, n=40):
    return spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")


def test_a_hop_has_one_exchange_and_none_above_the_stored_arcs(spark, no_broadcasts):
    index = graph.build_graph_index(line(spark))
    seeds, _ = stored.seed_sets(spark.createDataFrame([(3,), (9,)], "seed long"), 3, 10)
    level = stored.start_level(seeds[0], "node", index.n_buckets)
    assert exchanges(graph.hop_step(index, level, level, 0)) == ["node"]
    assert exchanges(index.expand(level)) == exchanges(index.degrees()) == []


def test_a_stored_table_is_sorted_once_and_read_as_sorted(spark, no_broadcasts, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 100).cast("string")).alias("k"), "id")
    kept = session.write_bucketed(rows, str(tmp_path / "t"), ["k"], 3)
    files = sorted((tmp_path / "t").glob("part-*"))
    assert len(files) == 3
    for f in files:
        keys = [r["k"] for r in spark.read.parquet(str(f)).collect()]
        assert keys == sorted(keys)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
    plan = kept.join(rows.repartition(3, "k").withColumnRenamed("id", "other"), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "SortMergeJoin" in plan
    assert spark.conf.get(session.PLANNED_WRITE) == "true"


def test_components_of_cases_take_their_rows_once(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(utxo, "materialize", lambda df, name: wrote.append(name) or session.materialize(df, name))
    rows = spark.createDataFrame([("s", "t", "in", "a", 1), ("s", "t", "in", "b", 1), ("s", "t", "out", "c", 1)], "seed string, tx_hash string, side string, address string, rows long")
    found = utxo.case_components(rows)
    assert sorted((r["address"], r["occurrences"], r["cluster"]) for r in found.collect()) == [("a", 1, "a"), ("b", 1, "a"), ("c", 1, "c")]
    assert "case-rows" in wrote


def test_a_level_of_a_trace_deals_out_transactions_and_addresses_only(spark, no_broadcasts):
    io = spark.createDataFrame([("t", "in", "a", 1), ("t", "out", "b", 1), ("u", "in", "b", 2), ("u", "out", "c", 2)], "tx_hash string, side string, address string, block_time long")
    index = live.build_tx_index(io)
    seeds, _ = stored.seed_sets(spark.createDataFrame([("a",)], "seed string"), 3, 10)
    level = stored.start_level(seeds[0], "address", index.by_address.n_buckets)
    assert sorted(exchanges(live.expansion_step(index, level, level, 0))) == ["address", "tx_hash"]


def test_a_hub_at_the_rim_is_probed_and_not_expanded(spark):
    """Node 0 has 20,000 neighbours; one of them is within reach of the seed."""
    star = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    edges = star.unionByName(spark.createDataFrame([(5, 30_000), (30_000, 30_001)], "src long, dst long"))
    index = graph.build_graph_index(edges, part_rows=1000)
    assert index.arcs.has_hot
    reach = spark.createDataFrame([(30_001, 30_001), (30_001, 30_000), (30_001, 5), (30_001, 0)], "seed long, node long")
    found = graph.induced_subgraph(reach, index)
    assert sorted(tuple(r) for r in found.collect()) == [(30_001, 0, 5), (30_001, 5, 30_000), (30_001, 30_000, 30_001)]
    assert index.upward.join(reach, "node").count() < 10


@pytest.mark.parametrize("size", [2, 10**6])
def test_sets_of_seeds_find_what_all_seeds_find_together(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "SEED_SET", size)
    pairs = [(i, (7 * i + 3) % 50) for i in range(50)] + [(i, 0) for i in range(20)] + [(4, 4)]
    index = graph.build_graph_index(spark.createDataFrame(pairs, "src long, dst long"), part_rows=4)
    und = {}
    for a, b in pairs:
        und.setdefault(a, set()).add(b)
        und.setdefault(b, set()).add(a)
    want = set()
    for seed in range(12):
        far, depth = {seed: 0}, 1 + seed % 3
        for hop in range(1, depth + 1):
            for x in [x for x, h in far.items() if h == hop - 1]:
                for y in und.get(x, ()):
                    far.setdefault(y, hop)
        want |= {(seed, x, h) for x, h in far.items()}
    seeds = spark.createDataFrame([(i, 1 + i % 3) for i in range(12)], "seed long, hop_depth int")
    assert sorted(tuple(r) for r in graph.khop(seeds, index, 9).collect()) == sorted(want)


def test_keyed_tables_are_read_back_as_stored(spark, tmp_path):
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(1 + 9 * (k == 2))], "k int, v int")
    for n, part_rows in enumerate((4, 100)):
        made = stored.store_keyed(rows, ["k"], "v", f"{tmp_path}/{n}", part_rows)
        read = stored.load_keyed(spark, f"{tmp_path}/{n}")
        assert made.has_hot == read.has_hot == (part_rows == 4)
        for t in (made, read):
            assert sorted(tuple(r) for r in t.rows().collect()) == sorted(tuple(r) for r in rows.collect())
            asked = spark.createDataFrame([(2, "x"), (3, "y"), (77, "z")], "k int, tag string")
            assert t.meet(asked).count() == 11 and t.known(asked).count() == 2
            assert t.grouped(F.count("*").alias("n")).where("n = 10").first()["k"] == 2
    nothing = stored.store_keyed(rows.limit(0), ["k"], "v", f"{tmp_path}/none")
    assert nothing.rows().collect() == [] and stored.load_keyed(spark, f"{tmp_path}/none").rows().collect() == []


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_by_rounds_and_in_one_task_agree(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_EDGES", small)
    links = [(f"n{i}", f"n{i + 1}") for i in range(60) if i % 7] + [("x", "n3"), ("lone", "lone")]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(62)] + [("lone",)], "node string")
    got = {r["node"]: r["component"] for r in components.connected_components(nodes, spark.createDataFrame(links, "src string, dst string")).collect()}
    at = {n: n for n in {x for link in links for x in link} | set(got)}
    for _ in at:
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    assert got == {n: min(m for m in got if at[m] == at[n]) for n in got}


def test_two_mixers_reach_each_other_through_a_hot_node(spark):
    edges = [("m1", "hub"), ("m2", "hub")] + [("hub", f"x{i}") for i in range(12)]
    index = graph.build_graph_index(spark.createDataFrame(edges, "src string, dst string"), part_rows=3)
    got = rules.mixer_adjacent(spark.createDataFrame([("m1",), ("m2",)], "mixer_id string"), index, 2)
    found = {r["tx_id"]: (r["mixer_id"], r["hops_from_mixer"]) for r in got.collect()}
    assert found == {"hub": ("m1", 1), "m1": ("m2", 2), "m2": ("m1", 2)} | {f"x{i}": ("m1", 2) for i in range(12)}
