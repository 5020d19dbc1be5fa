"""UTXO clustering, live traces, correlation, attribution and the learned signal on literal rows."""

import pytest
from pyspark.sql import functions as F

from fundtrail import Params
from fundtrail.functions import records
from fundtrail.operators import clusters, correlate, learn, live, utxo

DAY = 86_400
STEP = 14 * DAY


def io_df(spark, txs):
    """txs: name -> (inputs, outputs, block_time)."""
    rows = []
    for name, (ins, outs, at) in txs.items():
        for side, addresses in (("in", ins), ("out", outs)):
            rows += [(name, side, i, a, 100, at, 1) for i, a in enumerate(addresses)]
    return spark.createDataFrame(
        rows, "tx_hash string, side string, ordinal int, address string, amount_sats long, block_time long, block_height long"
    )


def grouped(spark, txs):
    parts = {}
    for r in utxo.utxo_components(io_df(spark, txs)).collect():
        parts.setdefault(r["cluster"], set()).add(r["address"])
    return sorted(map(sorted, parts.values()))


def test_cospend_joins_inputs_only(spark):
    assert grouped(spark, {"t": (["a1", "a2"], ["a3"], 1)}) == [["a1", "a2"], ["a3"]]


def test_change_goes_to_the_sole_new_output(spark):
    txs = {"t1": (["a1"], ["a3", "a4"], 1), "t2": (["a3"], ["a5"], 2)}
    assert grouped(spark, txs) == [["a1", "a4"], ["a3"], ["a5"]]


def test_single_output_and_two_new_outputs_are_no_change(spark):
    assert grouped(spark, {"t": (["a"], ["b"], 1)}) == [["a"], ["b"]]
    assert grouped(spark, {"t": (["a"], ["b", "c"], 1)}) == [["a"], ["b"], ["c"]]


def test_clusters_are_numbered_by_first_member_with_bounded_samples(spark):
    txs = {"t": ([f"m{i:02d}" for i in range(14)], ["z"], 1), "u": (["b"], ["c"], 1)}
    got = utxo.utxo_clusters(utxo.utxo_components(io_df(spark, txs)), 10).orderBy("cluster_id").collect()
    by_id = {r["cluster_id"]: r for r in got}
    assert by_id["live_cluster_1"]["members_sample"] == ["b"]
    big = by_id["live_cluster_3"]
    assert (big["n_wallets"], big["n_members_truncated"], big["members_sample"][:2]) == (14, 4, ["m00", "m01"])


def test_missing_addresses_are_kept_out(spark):
    io = io_df(spark, {"t": ([None, "a"], ["b", None, ""], 1)})
    assert {r["address"] for r in utxo.with_address(io).collect()} == {"a", "b"}
    got = {(r["address"], r["direction"]) for r in utxo.address_records(io, "blockstream").collect()}
    assert got == {("a", "out"), ("b", "in")}


def test_steps(spark):
    df = spark.createDataFrame([(None,), (0,), (-5,), (STEP - 1,), (STEP,)], "t long")
    got = [r[0] for r in df.select(utxo.tx_time_step(F.col("t"))).collect()]
    assert got == [-1, -1, -1, 0, 1]


CHAIN = {
    "t1": (["seed"], ["a", "b"], 5 * STEP),
    "t2": (["a"], ["c"], 6 * STEP),
    "t3": (["b", "k"], ["d"], None),
    "t4": (["c"], ["e"], 7 * STEP),
}


def traced(spark, txs, hop_depth, **changes):
    io = io_df(spark, txs)
    seeds = spark.createDataFrame([("seed",), ("ghost",)], "seed string")
    p = Params(**changes)
    index = live.build_tx_index(io, part_rows=2)
    return index, live.bounded_expansion(seeds, index, hop_depth, p), p


def test_expansion_levels_caps_and_unknown_seed(spark):
    _, found, p = traced(spark, CHAIN, 2)
    assert {(r["address"], r["level"]) for r in found.fetched.collect()} == {("seed", 0), ("a", 1), ("b", 1)}
    meta = live.expansion_meta(found, p).first()
    assert (meta["seed"], meta["fetch_count"], meta["capped"]) == ("seed", 3, False)
    _, found, p = traced(spark, CHAIN, 3, fetch_cap=2)
    assert {r["address"] for r in found.fetched.collect()} == {"seed", "a"}
    assert live.expansion_meta(found, p).first()["capped"]
    _, found, p = traced(spark, {f"t{i}": (["seed"], [f"o{i}"], i * DAY) for i in range(1, 6)}, 1, tx_cap=2)
    assert {r["tx_hash"] for r in found.txs.collect()} == {"t5", "t4"}


def test_live_graph(spark):
    io, found, _ = traced(spark, CHAIN, 2)
    flows = live.case_flows(found, io)
    seeds = spark.createDataFrame([("seed",)], "seed string")
    nodes = {r["address"]: r for r in live.live_nodes(flows, live.live_hops(flows, seeds)).collect()}
    assert {a: r["hop"] for a, r in nodes.items()} == {"seed": 0, "a": 1, "b": 1, "c": 2, "d": 2, "k": 3}
    assert nodes["a"]["time_step"] == 5 and nodes["c"]["time_step"] == 6 and nodes["d"]["time_step"] == -1
    assert {r["label"] for r in nodes.values()} == {-1}
    edges = {(r["src"], r["dst"]) for r in live.tx_flow_edges(flows, live.live_hops(flows, seeds)).collect()}
    assert edges == {("seed", "a"), ("seed", "b"), ("a", "c"), ("b", "d"), ("k", "d")}
    kept = live.capped_nodes(live.live_hops(flows, seeds), 3)
    assert {r["address"] for r in kept.collect()} == {"seed", "a", "b"}
    assert live.tx_flow_edges(flows, kept).count() == 2


def test_wide_transaction_walks_without_pairs(spark):
    wide = {"w": (["seed"] + [f"i{k}" for k in range(150)], [f"o{k}" for k in range(150)], DAY)}
    io, found, _ = traced(spark, wide, 1)
    flows = live.case_flows(found, io)
    hops = live.live_hops(flows, spark.createDataFrame([("seed",)], "seed string"))
    assert {r["hop"]: r["n"] for r in hops.groupBy("hop").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 150, 2: 150}


def test_a_mixer_behind_many_payees_is_still_found(spark):
    """Six hundred addresses closer in the alphabet than the mixer that paid the seed."""
    wide = {"w": (["seed"], [f"a{k:03d}" for k in range(600)], DAY), "m": (["zmixer"], ["seed"], DAY)}
    io, found, p = traced(spark, wide, 2)
    flows = live.case_flows(found, io)
    nodes = live.live_nodes(flows, live.live_hops(flows, spark.createDataFrame([("seed",)], "seed string")))
    row = live.live_rules(nodes, flows, spark.createDataFrame([("zmixer",)], "mixer_id string"), p).first()
    assert (row["mixer_fired"], row["mixer_id"], row["hops_from_mixer"], row["fanout_fired"], row["out_degree"], row["in_degree"]) == (True, "zmixer", 1, True, 600, 1)


def test_sole_neighbours_leave_the_node_itself_out(spark):
    io, found, _ = traced(spark, {"t1": (["seed", "x"], ["seed", "y"], DAY), "t2": (["y"], ["z", "y"], DAY), "t3": (["q"], ["seed"], DAY)}, 3)
    got = {r["address"]: tuple(r)[2:] for r in live.sole_neighbours(live.case_flows(found, io)).collect()}
    assert got["seed"] == ("y", "y", "q", "x") and got["y"] == ("z", "z", "seed", "x") and got["q"] == ("seed", "seed", None, None)


def test_repeated_landings_count_once(spark):
    io = io_df(spark, {"t1": (["a"], ["b", "c"], DAY)})
    again = io.union(io.withColumn("block_time", F.lit(None).cast("long")))
    assert sorted(map(tuple, utxo.dedupe_io(again).collect())) == sorted(map(tuple, io.collect()))
    assert utxo.change_outputs(utxo.dedupe_io(again)).collect() == utxo.change_outputs(io).collect()


def test_verdicts(spark):
    rules = spark.createDataFrame(
        [("both", ["peel_chain"], 40), ("rule", ["peel_chain"], 40), ("learned", [], 0), ("none", [], 0), ("unscored", ["rapid_fan_out"], 30), ("neither", [], 0)],
        "tx_id string, rules_fired array<string>, rule_score int",
    )
    learned = spark.createDataFrame(
        [("both", True, True), ("rule", True, False), ("learned", True, True), ("none", True, False)],
        "tx_id string, classified boolean, learned_flag boolean",
    )
    got = correlate.correlate(rules, learned)
    assert {r["tx_id"]: r["verdict"] for r in got.collect()} == {
        "both": "confirmed", "rule": "watch", "learned": "watch", "none": "none", "unscored": "watch", "neither": "none"
    }
    capped = correlate.live_verdict_cap(got, F.col("tx_id") != "both")
    assert {r["tx_id"]: r["verdict"] for r in capped.collect()}["both"] == "watch"
    bad = got.withColumn("label", F.lit(1)).withColumn("verdict", F.lit("confirmed"))
    row = correlate.correlation_invariants(bad).first()
    assert row["confirmed_without_both"] == 5 and row["raised_without_signal"] == 2


def entity_rows(spark, pairs):
    return spark.createDataFrame([(t, e, False) for t, e in pairs], "tx_id string, entity_id string, is_hub boolean")


def test_attribution_uses_full_membership_and_keeps_tiers_apart(spark):
    ents = entity_rows(spark, [(f"m{i:02d}", "e1") for i in range(20)] + [("x", "e2"), ("y", "e3")])
    nodes = spark.createDataFrame([(f"m{i:02d}", 1 if i < 5 else 0, 1) for i in range(20)] + [("x", -1, 1), ("y", 0, 1)], "tx_id string, label int, time_step int")
    tags = spark.createDataFrame(
        [("m19", "Late", "s", None, 2), ("m18", "First", "s", "IN", 1), ("addr", "Mapped", "unsourced", None, 3), ("gone", "Gone", "s", None, 4)],
        "address string, name string, source string, jurisdiction string, position int",
    )
    amap = spark.createDataFrame([("addr", "x"), ("addr", "y"), ("addr", "nowhere")], "address string, tx_id string")
    found = clusters.match_tags(tags, amap, ents)
    assert {(r["address"], r["cluster_id"]) for r in found.collect()} == {("m19", "e1"), ("m18", "e1"), ("addr", "e2")}
    assert [r["address"] for r in clusters.unmatched_tags(tags, found).collect()] == ["gone"]
    rows = {r["cluster_id"]: r for r in clusters.attribute_clusters(clusters.cluster_summary(ents, nodes), found).collect()}
    assert rows["e1"]["attributed_name"] == "First" and rows["e1"]["illicit_fraction"] == 0.25
    assert rows["e1"]["confidence_tier"] == "elliptic-derived" and rows["e1"]["attribution_tier"] == "supplementary-source"
    assert rows["e3"]["attributed_name"] is None
    sample = {r["cluster_id"]: r for r in clusters.member_sample(ents, 10).collect()}
    assert len(sample["e1"]["members_sample"]) == 10 and sample["e1"]["n_members_truncated"] == 10


def test_verdict_of_unmapped_wallet_counts_for_the_cluster_of_that_name(spark):
    ents = entity_rows(spark, [("a", "e1")])
    cl = spark.createDataFrame([("e1",), ("e2",)], "cluster_id string")
    v = spark.createDataFrame([("a", "watch"), ("e1", "confirmed"), ("lost", "watch")], "tx_id string, verdict string")
    got = {r["cluster_id"]: (r["confirmed"], r["watch"], r["none"]) for r in clusters.cluster_verdicts(clusters.cluster_verdict_join(v, ents, cl), cl).collect()}
    assert got == {"e1": (1, 1, 0), "e2": (0, 0, 0)}


def test_convergence_needs_two_cases(spark):
    cases = spark.createDataFrame([(1, "s1", 10.0), (2, "s2", 5.5), (3, "s3", 1.0)], "case_id int, seed string, amount double")
    reach = spark.createDataFrame([("s1", "v", 2), ("s1", "w", 1), ("s2", "v", 3), ("s3", "q", 1)], "seed string, node string, hop int")
    ents = entity_rows(spark, [("v", "ex"), ("w", "ex"), ("q", "other")])
    named = spark.createDataFrame([("ex", "VASP"), ("other", "Other")], "cluster_id string, attributed_name string")
    rows = {r["case_id"]: r for r in clusters.convergence(cases, reach, ents, named).collect()}
    assert {c: r["hops"] for c, r in rows.items()} == {1: 1, 2: 3} and rows[1]["total_loss"] == 15.5


def test_metrics_with_empty_denominators(spark):
    scored = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, risk double")
    row = learn.eval_metrics(scored, 0.5).first()
    assert (row["illicit_recall"], row["illicit_precision"], row["illicit_f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    scored = spark.createDataFrame([(1, 0.5), (1, 0.4), (0, 0.9), (0, 0.1)], "label int, risk double")
    row = learn.eval_metrics(scored, 0.5).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 1)


def test_training_uses_labelled_rows_and_leaves_unknown_wallets_unscored(spark, tmp_path):
    rows = [(f"t{i}", i % 2 if i < 60 else -1, 1, [float(i % 2), float(i)]) for i in range(80)]
    nodes = spark.createDataFrame(rows, "tx_id string, label int, time_step int, features array<float>")
    split = nodes.select("tx_id", F.when(F.substring("tx_id", 2, 9).cast("int") < 40, "train").when(F.substring("tx_id", 2, 9).cast("int") < 50, "val").otherwise("test").alias("split"))
    chosen = {r["split"]: r["n"] for r in learn.train_split(nodes, split).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert chosen == {"train": 40, "test": 10}
    path = str(tmp_path / "model")
    _, report = learn.train_and_evaluate(nodes, split, Params(forest_trees=5, forest_depth=3), path, f"{path}-report")
    row = report.first()
    assert row["illicit_recall"] == 1.0 and row["weight_illicit"] == 1.0 and row["n_estimators"] == 5
    risks = learn.forest_risk(learn.load_model(spark, path), nodes)
    assert risks.where("risk < 0 or risk > 1").count() == 0
    asked = spark.createDataFrame([("t1",), ("stranger",)], "tx_id string")
    got = {r["tx_id"]: r for r in learn.learned_signal(asked, risks, Params()).collect()}
    assert got["t1"]["prediction"] == "illicit" and got["t1"]["classified"]
    assert (got["stranger"]["classified"], got["stranger"]["risk_score"], got["stranger"]["learned_flag"]) == (False, None, False)


def test_class_weights(spark):
    rows = spark.createDataFrame([(1,)] + [(0,)] * 3, "label int")
    assert {r["label"]: r["weight"] for r in learn.class_weights(rows).collect()} == {1: 2.0, 0: pytest.approx(0.666667)}


def test_record_rules(spark):
    good_hash = "a" * 64
    schema = "tx_hash string, elliptic_id string, address string, timestamp long, amount_sats long, direction string, source string, block_height long"
    rows = [
        (good_hash, None, "a", 5, 1, "in", "blockstream", 0),
        (None, "id", "a", None, 1, "out", "elliptic", None),
        ("A" * 64, None, "", 0, 0, "sideways", "blockcypher", -1),
        (good_hash, "id", "a", 1, 1, "in", "elliptic", 1),
        (None, "id", "a", 1, 1, "in", "elsewhere", 1),
    ]
    good, bad = records.split_by_problems(spark.createDataFrame(rows, schema), records.record_problems())
    assert good.count() == 2
    assert [set(r["problems"]) for r in bad.collect()] == [
        {"bad_tx_hash", "empty_address", "bad_timestamp", "bad_amount", "bad_direction", "bad_height"},
        {"unexpected_tx_hash"}, {"bad_source"},
    ]
