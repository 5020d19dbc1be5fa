"""The batch jobs on a small dataset folder, from CSV files to case results."""

import pytest
from pyspark.sql import functions as F

from fundtrail import Params
from fundtrail.operators.entities import LeakageError
from fundtrail.plans import jobs

GENESIS = "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
OTHER = "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Twenty peel chains of six nodes, one step each, illicit in the odd chains."""
    folder = tmp_path_factory.mktemp("raw")
    features, classes, edges = [], ["txId,class"], ["txId1,txId2"]
    for c in range(20):
        for i in range(6):
            features.append(f"c{c:02d}n{i},{c + 1},{c % 2 + i / 100}")
            classes.append(f"c{c:02d}n{i},{'unknown' if i == 5 else 2 - c % 2}")
            if i:
                edges.append(f"c{c:02d}n{i - 1},c{c:02d}n{i}")
    for name, rows in (("features", features), ("classes", classes), ("edgelist", edges)):
        (folder / f"txs_{name}.csv").write_text("\n".join(rows) + "\n")
    return str(folder)


def test_from_files_to_cases(spark, raw, tmp_path):
    store, p = str(tmp_path / "store"), Params(forest_trees=5, forest_depth=3)
    audit = jobs.ingest(spark, raw, store, "run-1", p, n_features=2).first()
    assert audit["leakage_free"] and audit["time_span_ok"]
    assert (audit["n_entities"], audit["n_train_txs"], audit["n_val_txs"], audit["n_test_txs"]) == (20, 84, 18, 18)

    report = jobs.train(spark, store, p).first()
    assert report["illicit_recall"] == 1.0 and report["n_train_txids"] == 70

    mixers = spark.createDataFrame([("c01n0",)], "mixer_id string")
    judged = {r["tx_id"]: r for r in jobs.verdicts(spark, store, mixers, p).collect()}
    assert len(judged) == 120 and judged["c01n2"]["verdict"] == "confirmed" and judged["c00n2"]["verdict"] == "watch"
    assert judged["c00n0"]["verdict"] == "none" and judged["c01n1"]["rule_score"] == 70

    tags = spark.createDataFrame([("c03n5", "Exchange", "list", "IN", 1)], "address string, name string, source string, jurisdiction string, position int")
    amap = spark.createDataFrame([], "address string, tx_id string")
    clusters = {r["cluster_id"]: r for r in jobs.report_clusters(spark, store, tags, amap, p).collect()}
    assert len(clusters) == 20 and clusters["entity::c03n0"]["attribution"]["name"] == "Exchange"
    assert clusters["entity::c01n0"]["verdict_counts"]["confirmed"] == 4

    io = spark.createDataFrame(
        [("t", "in", 0, OTHER, 5, 1209600, 1)] + [("t", "out", i, f"out{i}", 5, 1209600, 1) for i in range(12)],
        "tx_hash string, side string, ordinal int, address string, amount_sats long, block_time long, block_height long",
    )
    reports = spark.createDataFrame(
        [(1, "c03n2 ", 10.0), (2, GENESIS, 1.0), (3, OTHER, 2.0), (4, "nonsense", 3.0)], "case_id int, wallet string, amount double"
    )
    traced = jobs.trace_cases(spark, store, reports, io, mixers, p)
    outcomes, summary = traced.outcomes, traced.summaries
    got = {r["case_id"]: (r["source"], r["outcome"], r["verdict"]) for r in outcomes.collect()}
    assert got == {
        1: ("elliptic-indexed", "pipeline", "confirmed"), 2: ("not-found-on-chain", "empty", None),
        3: ("live-lookup", "pipeline", "watch"), 4: ("invalid-address-format", "empty", None),
    }
    rows = {r["case_id"]: r for r in summary.collect()}
    assert (set(rows), rows[3]["verdict"], rows[3]["node_count"], rows[3]["ml_score"]) == ({1, 3}, "watch", 13, None)
    row = rows[1]
    assert (row["case_id"], row["node_count"], row["edge_count"], row["hop_count"]) == (1, 5, 4, 2)
    assert (row["risk_level"], row["attributed_vasp"], row["verdict"]) == ("CRITICAL", "Exchange", "confirmed")

    assert {(r["node"], r["hop"], r["live"]) for r in traced.nodes.where("seed = 'c03n2'").collect()} == {(f"c03n{i}", abs(i - 2), False) for i in range(5)}
    assert sorted((r["src"], r["dst"]) for r in traced.edges.collect()) == [(f"c03n{i}", f"c03n{i + 1}") for i in range(4)]
    assert traced.nodes.where("live").count() == traced.flows.count() == 13
    sizes = sorted((r["n_wallets"], r["occurrences"]) for r in traced.live_clusters.where(F.col("seed") == OTHER).collect())
    assert sizes == [(1, 1)] * 13

    filed = spark.createDataFrame(
        [("A1", "KA", "loan", "c03n2", 100.0, 2), ("A2", "MH", "job", " c03n5", 50.5, 1), ("A3", "KA", "loan", "c09n1", 5.0, 1), ("A4", "DL", "job", OTHER, 0.0, None)],
        "ack_number string, victim_state string, scam_category string, suspect_address string, amount_inr double, hop_depth int",
    )
    bulk = jobs.bulk_trace(spark, store, filed, io, mixers, p)
    assert [(r["cluster_id"], r["attributed_name"], r["n_cases"], r["n_states"], r["total_loss_inr"], r["nearest_hops"]) for r in bulk.totals.collect()] == [("entity::c03n0", "Exchange", 2, 2, 150.5, 0)]
    assert sorted((r["ack_number"], r["hops"], r["scam_category"]) for r in bulk.meetings.collect()) == [("A1", 0, "loan"), ("A2", 0, "job")]
    assert {r["case_id"]: r["outcome"] for r in bulk.traced.outcomes.collect()} == dict.fromkeys(["A1", "A2", "A3", "A4"], "pipeline")
    assert spark.read.csv(f"{store}/bulk/ledger", header=True).where("case_seed = 'c03n5'").count() == 1

    # Everything that can go wrong with a report keeps an outcome of its own.
    reports = spark.createDataFrame(
        [(1, "c03n2", 1.0, 5), (2, GENESIS, 1.0, 2), (3, OTHER, 1.0, 2), (4, OTHER, 1.0, 2), (5, OTHER, 1.0, 2), (6, GENESIS, 1.0, None), (7, OTHER, 1.0, 11), (8, "nonsense", 1.0, 2)],
        "case_id int, wallet string, amount double, hop_depth int",
    )
    attempts = spark.createDataFrame([(GENESIS, 429, False), (GENESIS, None, True)], "address string, status int, timed_out boolean")
    requests = spark.createDataFrame([(3, 400, False, None), (4, None, False, None), (5, None, True, None)], "case_id int, status int, aborted boolean, retryable boolean")
    lost = spark.createDataFrame([("c03n2",)], "wallet string")
    outcomes, summary, *_ = jobs.trace_cases(spark, store, reports, io.union(io), mixers, p, attempts, requests, lost)
    got = {r["case_id"]: r["outcome"] for r in outcomes.collect()}
    assert got == {1: "pipeline", 2: "retryable", 3: "invalid_input", 4: "fallback", 5: "retryable", 6: "retryable", 7: "invalid_input", 8: "empty"}
    row = summary.where("case_id = 1").first()
    assert (row["attributed_vasp"], row["hop_count"]) == ("lookup unavailable", 3)

    unscored = jobs.verdicts(spark, store, mixers, p, scored=False)
    assert unscored.count() == 120 and unscored.where(F.col("classified")).count() == 0


def test_spanning_entities_fail_the_job_but_not_the_audit(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "txs_features.csv").write_text("a,1,0\nb,2,0\n")
    (raw / "txs_classes.csv").write_text("txId,class\na,1\nb,2\n")
    (raw / "txs_edgelist.csv").write_text("txId1,txId2\na,b\n")
    with pytest.raises(LeakageError):
        jobs.ingest(spark, str(raw), str(tmp_path / "store"), "run-1", n_features=2)
    assert spark.read.json(str(tmp_path / "store" / "split_audit")).count() == 1


def test_scratch_tables_can_be_dropped(spark, monkeypatch, tmp_path):
    from fundtrail import session

    monkeypatch.setattr(session, "checkpoint_root", lambda _: str(tmp_path))
    assert session.materialize(spark.range(3), "t").count() == 3 and (tmp_path / "fundtrail").exists()
    session.drop_scratch(spark)
    assert not list((tmp_path / "fundtrail").iterdir())
