"""The batch jobs end to end: dataset to tables, model, verdicts, cluster report and case results.

Each job reads the tables of the one before from ``store``, a folder on shared storage.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import address_quality
from ..functions.status import request_failure
from ..operators import cases, clusters, correlate, entities, graph, learn, live, rules, utxo
from ..params import EXPECTED_EDGE_COUNT, EXPECTED_TX_COUNT, N_FEATURES, Params
from ..session import materialize, prepare
from ..sources import dataset, lists, sinks

MAX_HOPS = 10


def ingest(spark: SparkSession, raw: str, store: str, run_id: str, params: Params = Params(), n_features: int = N_FEATURES, require_span_zero: bool = True) -> DataFrame:
    """Load, group, split, audit and index a dataset; returns the one-row audit.

    A leaking split fails the job after the audit has been logged.
    """
    prepare(spark)
    nodes, edges = dataset.load_dataset(spark, raw, n_features)
    graph.integrity_check(nodes, edges, EXPECTED_TX_COUNT, EXPECTED_EDGE_COUNT).write.mode("overwrite").json(f"{store}/integrity")
    split = entities.time_split(materialize(entities.build_entities(nodes, edges, params.hub_degree), "entities"), nodes, params)
    sinks.write_normalised(store, nodes, edges, split)
    graph.build_graph_index(edges, path=f"{store}/graph")
    nodes, edges, split = sinks.read_normalised(spark, store)
    audit = entities.leakage_report(split, nodes, edges, params, require_span_zero)
    sinks.append_audit(f"{store}/split_audit", audit, run_id)
    entities.verify_no_leakage(audit, require_span_zero)
    return audit


def train(spark: SparkSession, store: str, params: Params = Params()) -> DataFrame:
    """Fit and evaluate the forest on the stored split; returns the one-row report."""
    nodes, _, split = sinks.read_normalised(prepare(spark), store)
    learn.train_and_evaluate(nodes, split, params, f"{store}/model", f"{store}/model_eval")
    return spark.read.json(f"{store}/model_eval")


def verdicts(spark: SparkSession, store: str, mixers: DataFrame, params: Params = Params(), scored: bool = True) -> DataFrame:
    """Rules, risk and verdict of every wallet, written to the store.

    ``scored=False`` leaves the learned signal out: no wallet is classified.
    """
    nodes, _, _ = sinks.read_normalised(prepare(spark), store)
    wallets = nodes.select("tx_id")
    found = rules.run_rules(wallets, nodes, graph.read_graph_index(spark, f"{store}/graph"), mixers, params)
    if scored:
        risks = learn.forest_risk(learn.load_model(spark, f"{store}/model"), nodes)
    else:
        risks = nodes.select("tx_id", F.lit(None).cast("double").alias("risk"))
    result = correlate.correlate(found, learn.learned_signal(wallets, risks, params))
    result.join(nodes.select("tx_id", "label"), "tx_id").write.mode("overwrite").parquet(f"{store}/verdicts")
    return spark.read.parquet(f"{store}/verdicts")


def report_clusters(spark: SparkSession, store: str, tags: DataFrame, address_map: DataFrame, params: Params = Params()) -> DataFrame:
    """Cluster report with attribution and verdict counts, written to the store."""
    nodes, _, split = sinks.read_normalised(prepare(spark), store)
    named = clusters.attribute_clusters(clusters.cluster_summary(split, nodes), clusters.match_tags(tags, address_map, split))
    named = materialize(named, "clusters")
    judged = spark.read.parquet(f"{store}/verdicts")
    report = clusters.cluster_report(split, named, judged, params.member_sample)
    sinks.save_cluster_report(f"{store}/cluster_report", report, clusters.cluster_report_totals(named, tags))
    named.write.mode("overwrite").parquet(f"{store}/attributed")
    return sinks.load_cluster_report(spark, f"{store}/cluster_report", report.schema)


class TracedCases(NamedTuple):
    """What is known of each case. Nodes and edges are tables of all cases: ``edges`` those of the index, ``flows`` the inputs and
    outputs of live transactions, whose product no table holds. ``live_clusters`` are those of a live wallet's own transactions."""

    outcomes: DataFrame       # case_id, wallet, source, reason, outcome, verdict
    summaries: DataFrame      # a row per case with a trace
    nodes: DataFrame          # seed, node, hop, label, time_step, live
    edges: DataFrame          # seed, src, dst
    flows: DataFrame          # seed, tx_hash, side, address, time_step
    live_clusters: DataFrame  # seed, cluster_id, confidence_tier, cluster, n_wallets, occurrences, members_sample, n_members_truncated


class BulkTrace(NamedTuple):
    traced: TracedCases
    meetings: DataFrame  # cluster_id, ack_number and what the report says
    totals: DataFrame    # a row per cluster where reports meet


def bulk_trace(
    spark: SparkSession, store: str, reports: DataFrame, io: DataFrame | live.TxIndex, mixers: DataFrame, params: Params = Params(), min_cases: int = 2, **known: DataFrame,
) -> BulkTrace:
    """Trace a table of reports (ack_number, victim_state, scam_category, suspect_address, amount_inr and optionally hop_depth).

    Outcomes, summaries, where reports meet, and the ledger of all traces are written below ``store``/bulk. ``known`` are the
    lookups, requests and failed clusters that :func:`trace_cases` takes.
    """
    depth = F.col("hop_depth") if "hop_depth" in reports.columns else F.lit(None).cast("int")
    typed = lists.complaints(reports).join(reports.select("ack_number", depth.cast("int").alias("hop_depth")).dropDuplicates(["ack_number"]), "ack_number")
    typed = materialize(typed.withColumn("seed", F.col("suspect_address")), "reports")
    asked = typed.select(F.col("ack_number").alias("case_id"), F.col("seed").alias("wallet"), F.col("amount_inr").alias("amount"), "hop_depth")
    traced = trace_cases(spark, store, asked, io, mixers, params, **known)
    _, _, split = sinks.read_normalised(spark, store)
    reach = traced.nodes.where("not live").select("seed", "node", "hop")
    meetings, totals = clusters.converging_reports(typed, reach, split, spark.read.parquet(f"{store}/attributed"), min_cases)
    ledger = cases.case_ledger(traced.edges, reach, spark.read.parquet(f"{store}/verdicts"))
    sinks.write_ledger_csv(f"{store}/bulk/ledger", ledger)
    for name, table in (("outcomes", traced.outcomes), ("summaries", traced.summaries), ("meetings", meetings), ("totals", totals)):
        table.write.mode("overwrite").parquet(f"{store}/bulk/{name}")
    stored = lambda name: spark.read.parquet(f"{store}/bulk/{name}")
    return BulkTrace(traced._replace(outcomes=stored("outcomes"), summaries=stored("summaries")), stored("meetings"), stored("totals"))


def trace_cases(
    spark: SparkSession, store: str, reports: DataFrame, io: DataFrame | live.TxIndex, mixers: DataFrame, params: Params = Params(),
    attempts: DataFrame | None = None, requests: DataFrame | None = None, failed_clusters: DataFrame | None = None,
) -> TracedCases:
    """What becomes of a table of reports (case_id, wallet, amount and optionally hop_depth).

    Reports with a column ``valid`` have their address formats judged by the caller, as for chains other than Bitcoin.
    Wallets of the index get the full case summary. Others are judged by address format and then traced over the landed
    transactions ``io``, given as rows or as a stored index; with one signal only, their verdict stops at watch. A summary row exists for either kind.

    What could not be found out stays apart from what was not there: ``attempts`` (address, status, timed_out) are the
    lookups behind ``io``, ``requests`` (case_id, status, aborted, retryable) those of whole reports, and ``failed_clusters``
    (wallet) names wallets whose cluster lookup did not complete. Each may be left out if all went well.
    """
    nodes, _, split = sinks.read_normalised(prepare(spark), store)
    index = graph.read_graph_index(spark, f"{store}/graph")
    txs = io if isinstance(io, live.TxIndex) else live.build_tx_index(materialize(utxo.dedupe_io(io), "io"))
    judged = reports.withColumn("wallet", F.trim("wallet"))
    if "valid" in reports.columns:
        judged = judged.withColumn("reason", F.lit(None).cast("string"))
    else:
        judged = address_quality(judged, "wallet", params)
    history = live.known_activity(judged.select(F.col("wallet").alias("address")), txs)
    resolved = cases.resolve_source(judged, nodes, history)
    if "hop_depth" not in resolved.columns:
        resolved = resolved.withColumn("hop_depth", F.lit(params.hop_depth))
    resolved = materialize(resolved.withColumn("hop_depth", F.coalesce("hop_depth", F.lit(params.hop_depth))), "resolved")
    in_range = F.col("hop_depth").between(1, MAX_HOPS)

    indexed = resolved.where(in_range & F.col("indexed")).select("case_id", F.col("wallet").alias("seed"), "amount", "hop_depth")
    seeds = indexed.groupBy("seed").agg(F.max("hop_depth").alias("hop_depth"))
    reach = materialize(graph.khop(seeds, index, params.hop_depth), "reach")
    edges = materialize(graph.induced_subgraph(reach, index), "case-edges")
    stats = graph.subgraph_stats(reach, edges, nodes)
    lost = spark.createDataFrame([], "seed string") if failed_clusters is None else failed_clusters.select(F.col("wallet").alias("seed")).distinct()
    named = cases.seed_attribution(seeds.select("seed"), split, spark.read.parquet(f"{store}/attributed"), lost)
    summary = cases.case_summary(indexed, stats, spark.read.parquet(f"{store}/verdicts"), named)

    live_cases = resolved.where(in_range & (F.col("source") == "live-lookup")).select("case_id", F.col("wallet").alias("seed"), "amount", "hop_depth")
    chain = live_cases.groupBy("seed").agg(F.max("hop_depth").alias("hop_depth"))
    flows = materialize(live.case_flows(live.bounded_expansion(chain, txs, params.hop_depth, params), txs), "flows")
    met = materialize(live.live_nodes(flows, live.live_hops(flows, chain)), "live-nodes")
    fired = materialize(live.live_rules(met, flows, mixers, params), "live-rules")
    size = met.groupBy("seed").agg(F.max("hop").alias("max_hop_reached"), F.count(F.lit(1)).alias("node_count"), F.lit(0).cast("long").alias("illicit_nodes"))
    lone = fired.select(
        F.col("tx_id"), F.when(F.size("rules_fired") > 0, "watch").otherwise("none").alias("verdict"),
        "rule_score", "rule_flag", F.lit(None).cast("double").alias("risk_score"),
    )
    # Flow rows stand in for edges: a transaction's inputs and outputs, not their product.
    rows = flows.groupBy("seed").agg(F.count(F.lit(1)).alias("edge_count"))
    live_named = chain.select("seed", F.lit(None).cast("string").alias("attributed_name")).join(lost.withColumn("_lost", F.lit(True)), "seed", "left").select(
        "seed", "attributed_name", F.when(F.col("_lost"), "lookup-failed").otherwise("no-match").alias("attribution_status")
    )
    summary = summary.unionByName(cases.case_summary(live_cases, size.join(rows, "seed", "left"), lone, live_named))
    summary = materialize(summary, "case-summary")

    failure = F.lit(None).cast("string")
    joined = resolved
    if attempts is not None:
        lookups = cases.lookup_verdict(attempts).select(F.col("address").alias("wallet"), F.when(F.col("lookup") != "answered", F.col("lookup")).alias("lookup_failure"))
        # The index needs no lookup, so a failed one says nothing about its wallets.
        joined = joined.join(lookups, "wallet", "left")
        failure = F.when(~F.col("indexed"), F.col("lookup_failure"))
    request_source = F.lit("pipeline")
    if requests is not None:
        bad = F.col("status").isNull() | (F.col("status") != 200) | F.coalesce("aborted", F.lit(False))
        state = request_failure(F.col("status"), F.coalesce("aborted", F.lit(False)), F.col("retryable"), F.lit(None).cast("string"))["source"]
        asked = requests.select("case_id", F.when(bad, state).otherwise("pipeline").alias("_request"), (F.col("status") == 404).alias("_missed"))
        joined = joined.join(asked, "case_id", "left")
        request_source = F.coalesce("_request", F.lit("pipeline"))
        joined = joined.withColumn("source", F.when(~F.coalesce("_missed", F.lit(False)), F.col("source")))
    joined = joined.join(summary.select("case_id", "verdict"), "case_id", "left").withColumns({
        "request_source": F.when(~in_range, "invalid-input").otherwise(request_source), "failure": failure,
        "has_rules": F.col("verdict").isNotNull(), "has_verdict": F.col("verdict").isNotNull(),
        "reason": F.when(~in_range, f"hop-depth-outside-1-to-{MAX_HOPS}").otherwise(F.col("reason")),
    })
    columns = ["seed", "node", "hop", "label", "time_step"]
    of_index = graph.with_node_attributes(reach, nodes).select(*columns, F.lit(False).alias("live"))
    of_chain = met.withColumnRenamed("address", "node").select(*columns, F.lit(True).alias("live"))
    owned = utxo.case_components(live.own_transactions(chain, txs))
    return TracedCases(
        cases.case_outcomes(joined).select("case_id", "wallet", "source", "reason", "outcome", "verdict"), summary,
        of_index.unionByName(of_chain), edges, flows.select("seed", "tx_hash", "side", "address", "time_step"),
        utxo.case_clusters(owned, params.member_sample),
    )
