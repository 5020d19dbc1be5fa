"""What must not grow with the tables: passes over stored tables, and what joins send through the driver."""

from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

from fundtrail import Params
from fundtrail.operators import cases, graph, learn, live, stored, utxo
from fundtrail.operators.ranking import next_in_sequence
from fundtrail.plans import domain, graph_queries, utxo_queries


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def flags(spark):
    return spark.createDataFrame([(1, True, False, False), (2, False, False, True)], "tx_id long, peel_fired boolean, fanout_fired boolean, mixer_fired boolean")


def test_markers_deal_the_rules_of_all_wallets_out(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    got = graph_queries.markers(SimpleNamespace(wallet_rules=flags(spark), edges=edges))
    assert "strategy=merge" in optimized(got)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "PeelChain"), (2, 3, "MixerHop")]


def test_a_ledger_deals_the_rules_of_all_wallets_out(spark):
    reach = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "seed long, node long, hop int")
    got = cases.case_ledger(spark.createDataFrame([(1, 1, 2)], "seed long, src long, dst long"), reach, flags(spark))
    assert "strategy=merge" in optimized(got)
    assert [(r["Hop"], r["From"], r["Marker"]) for r in got.collect()] == [(1, "1", "PeelChain")]


def test_both_landings_come_from_one_pass_and_are_written_once(spark, monkeypatch):
    io = spark.createDataFrame(
        [("t", "in", "a", 5, 10, 1), ("t", "in", "b", 5, 10, 1), ("t", "out", "c", 9, 10, 1), ("u", "in", "d", 4, 11, 2), ("u", "out", None, 4, 11, 2)],
        "tx_hash string, side string, address string, amount_sats long, block_time long, block_height long",
    )
    landed, written = [], []
    components, materialize = utxo.utxo_components, utxo.materialize
    monkeypatch.setattr(utxo, "utxo_components", lambda rows: landed.append(rows) or components(rows))
    monkeypatch.setattr(utxo, "materialize", lambda df, name: written.append(df) or materialize(df, name))
    got = utxo_queries.utxo_clusters_landed_twice(SimpleNamespace(io=io))
    assert optimized(landed[0]).count("Window [") == 1 and landed[0].count() == 10
    assert [df.count() for df in written] == [5]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in components(io).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


def test_the_confirmed_copy_decides_the_address(spark):
    rows = [("t", "in", 0, "old", 1, None), ("t", "in", 0, "new", 1, 7), ("t", "in", 1, "b", 1, 7), ("t", "in", 1, "a", 2, 7)]
    io = spark.createDataFrame(rows, "tx_hash string, side string, ordinal int, address string, amount_sats long, block_time long")
    assert sorted(tuple(r) for r in utxo.utxo_components(io).collect()) == [("b", "b"), ("new", "b")]
    # Where amounts come first they decide among copies of equal time.
    turned = io.select("tx_hash", "side", "ordinal", "amount_sats", "block_time", "address")
    assert sorted(tuple(r) for r in utxo.utxo_components(turned).collect()) == [("a", "a"), ("new", "a")]


def test_a_level_is_one_step_however_many_seeds_there_are(spark, monkeypatch):
    steps = []
    for module, name in ((graph, "hop_step"), (live, "expansion_step")):
        monkeypatch.setattr(module, "SEED_SET", 3)
        step = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, step=step, name=name: steps.append(name) or step(*a))
    ring = spark.range(30).select(F.col("id").alias("src"), ((F.col("id") + 1) % 30).alias("dst"))
    reach = graph.khop(spark.range(30).toDF("seed"), graph.build_graph_index(ring), 2)
    assert steps == ["hop_step"] * 2
    assert sorted(tuple(r) for r in reach.collect()) == sorted((s, (s + d) % 30, abs(d)) for s in range(30) for d in range(-2, 3))

    steps.clear()
    io = ring.select(F.col("src").cast("string").alias("tx_hash"), F.explode(F.array(F.struct(F.lit("in").alias("side"), F.col("src").cast("string").alias("address")), F.struct(F.lit("out").alias("side"), F.col("dst").cast("string").alias("address")))).alias("r")).select("tx_hash", "r.side", "r.address", F.lit(5).alias("block_time"))
    found = live.bounded_expansion(spark.range(30).select(F.col("id").cast("string").alias("seed")), live.build_tx_index(io), 3)
    assert steps == ["expansion_step"] * 2
    assert sorted(tuple(r) for r in found.fetched.collect()) == sorted((str(s), str((s + d) % 30), abs(d)) for s in range(30) for d in range(-2, 3))
    assert found.txs.count() == 30 * 5 * 2


def test_the_transaction_index_deals_each_table_once(spark, monkeypatch):
    io = spark.createDataFrame(
        [("t", "in", "a", 1), ("t", "in", "a", 2), ("t", "out", "b", 1)] + [(f"u{i}", "in", "a", i) for i in range(9)] + [("v", "in", None, 3)],
        "tx_hash string, side string, address string, block_time long",
    )
    plans, write = {}, stored.write_bucketed

    def written(df, path, key, *rest, **how):
        plans[path.rsplit("/", 1)[-1], key[0]] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, path, key, *rest, **how)

    monkeypatch.setattr(stored, "write_bucketed", written)
    index = live.build_tx_index(io, part_rows=4)
    assert plans["cold", "tx_hash"].count("Exchange hashpartitioning") == 1
    assert index.by_address.has_hot
    assert sorted(tuple(r) for r in index.by_address.rows().collect()) == sorted([("a", "t", 2), ("b", "t", 1)] + [("a", f"u{i}", i) for i in range(9)])
    assert sorted(tuple(r) for r in index.by_tx.rows().where("tx_hash = 't'").select("side", "address", "rows").collect()) == [("in", "a", 2), ("out", "b", 1)]


def test_a_sequence_follows_its_rows_where_they_are_stored(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 1, "a"), ("k", 1, "b"), ("k", 3, "c"), ("l", 2, "d")], "k string, d int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = next_in_sequence(rows, ["k"], F.col("d"), ["d", "v"], "v", "after", unique=True)
        assert sorted((r["v"], r["after"]) for r in found.collect()) == [("a", "b"), ("b", "c"), ("c", None), ("d", None)]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only the first rows of the buckets move: to their key's other buckets, and back.
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 2
    again = next_in_sequence(rows, ["k"], F.col("d"), ["d", "v"], "v", "after")
    assert sorted((r["v"], r["after"] or "") for r in again.collect()) == [("a", "a"), ("a", "b"), ("b", "c"), ("c", ""), ("d", "")]


def test_a_forest_of_many_rows_is_fitted_in_groups_of_trees(spark, monkeypatch):
    for name, value in (("FIT_CELLS", 600), ("GROUP_TREES", 3), ("FIT_ROWS", 10)):
        monkeypatch.setattr(learn, name, value)
    assert learn.tree_groups(120, 8) == [4, 4] and learn.tree_groups(10, 8) == [8] and learn.tree_groups(1000, 2) == [2]
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2), float(i % 7), float(i)]) for i in range(120)], "tx_id long, label int, features array<float>")
    model = learn.train_model(rows, Params(forest_trees=8, forest_depth=3))
    assert [f.getNumTrees for f in model.stages] == [4, 4]
    forest = learn.forest_table(model)
    assert {r["tree"] for r in forest.select("tree").distinct().collect()} == set(range(8))
    assert learn.forest_faults(forest, 3).first().asDict() == {"trees": 8, "leaves_less_inner": 8, "bad_values": 0, "bad_links": 0, "bad_splits": 0}
    by_joins = {r["tx_id"]: r["risk"] for r in learn.forest_risk(forest, rows).collect()}
    by_model = {r["tx_id"]: r["risk"] for r in learn.predict_risk(model, rows).collect()}
    assert by_joins.keys() == by_model.keys() == set(range(120))
    assert all(abs(by_joins[i] - by_model[i]) < 1e-9 for i in by_joins) and by_model[1] > 0.5 > by_model[2]


def test_landed_text_is_compressed_in_files_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(domain, "LANDED_ROWS", 1000, raising=False)
    lines = spark.range(5000).select(F.format_string('{"txid":"%d","status":{"block_time":1,"block_height":2}}', "id").alias("json")).coalesce(1)
    path = Path(domain.Tables(spark, str(tmp_path)).landed_text(lines, "feed"))
    files = [f for f in path.iterdir() if f.name.startswith("part-")]
    assert len(files) == 5 and sum(f.stat().st_size for f in files) < sum(len(r[0]) for r in lines.collect()) / 3
    assert sorted(r[0] for r in spark.read.text(str(path)).collect()) == sorted(r[0] for r in lines.collect())
