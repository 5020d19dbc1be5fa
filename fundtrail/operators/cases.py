"""From reported wallets to case results, for all reports at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import (
    attempt_kind, attribution_status, case_outcome, case_risk_level, display_flag, laundering_marker, source_of,
)
from ..session import by_shuffle


def lookup_verdict(attempts: DataFrame) -> DataFrame:
    """Combine the attempts on an address: any success wins; rate limits and timeouts say nothing
    about the address; it counts as bad only if every source rejected it."""
    kind = attempt_kind(F.col("status"), F.col("timed_out"))
    has = lambda k: F.count_if(F.col("kind") == k)
    return (
        attempts.withColumn("kind", kind)
        .groupBy("address")
        .agg(
            F.count("*").alias("n_sources"),
            F.count_if(F.col("kind").isNull()).alias("n_answered"),
            has("rate-limited").alias("_limited"), has("timeout").alias("_timeout"), has("bad-address").alias("_bad"),
        )
        .select(
            "address", "n_sources", "n_answered",
            F.when(F.col("n_answered") > 0, "answered")
            .when(F.col("_limited") > 0, "rate-limited")
            .when(F.col("_timeout") > 0, "timeout")
            .when((F.col("_bad") == F.col("n_sources")) & (F.col("n_sources") >= 2), "bad-address")
            .otherwise("api-error").alias("lookup"),
        )
    )


def resolve_source(reports: DataFrame, nodes: DataFrame, history: DataFrame) -> DataFrame:
    """Index first, live tables on a miss; ``reports`` carries ``wallet`` and ``valid``."""
    in_index = nodes.select(F.col("tx_id").cast("string").alias("wallet"), F.lit(True).alias("indexed"))
    on_chain = history.select(F.col("address").alias("wallet"), "has_history")
    joined = reports.join(in_index, "wallet", "left").join(on_chain, "wallet", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("indexed", "has_history", "valid")}
    )
    return joined.withColumn("source", source_of(F.col("indexed"), F.col("valid"), F.col("has_history")))


def seed_attribution(seeds: DataFrame, entities: DataFrame, attributed: DataFrame, failed: DataFrame) -> DataFrame:
    """matched / no-match / lookup-failed per seed, over full cluster membership.

    ``failed`` lists the seeds whose cluster lookup did not complete.
    """
    of = entities.select(F.col("tx_id").alias("seed"), F.col("entity_id").alias("cluster_id"))
    named = attributed.select("cluster_id", "attributed_name")
    lost = failed.select("seed", F.lit(True).alias("lookup_failed"))
    return (
        seeds.join(of, "seed", "left").join(named, "cluster_id", "left").join(lost, "seed", "left")
        .withColumn("lookup_failed", F.coalesce("lookup_failed", F.lit(False)))
        .select(
            "seed", "cluster_id",
            F.when(~F.col("lookup_failed"), F.col("attributed_name")).alias("attributed_name"),
            attribution_status(F.when(~F.col("lookup_failed"), F.col("attributed_name")), F.col("lookup_failed")).alias("attribution_status"),
        )
    )


def case_outcomes(reports: DataFrame) -> DataFrame:
    """``reports`` carries request_source, source, failure, has_rules and has_verdict."""
    c = F.col
    return reports.withColumn(
        "outcome",
        case_outcome(c("request_source"), c("source"), c("failure"), c("has_rules"), c("has_verdict")),
    )


def case_summary(cases: DataFrame, stats: DataFrame, verdicts: DataFrame, attribution: DataFrame) -> DataFrame:
    """One row per case, whatever is missing of it: trace size, illicit nodes, verdict, risk level and attributed name.

    A wallet that the model could not classify has no ``ml_score``, which a certain "licit" would share otherwise.
    """
    wallet = verdicts.select(F.col("tx_id").alias("seed"), "verdict", "rule_score", "rule_flag", "risk_score")
    name = attribution.select("seed", "attributed_name", "attribution_status")
    return (
        cases.select("case_id", "seed", "amount")
        .join(stats, "seed", "left").join(wallet, "seed", "left").join(name, "seed", "left")
        .select(
            "case_id", "seed", "amount", F.col("max_hop_reached").alias("hop_count"), "node_count", "edge_count",
            F.col("illicit_nodes"), "verdict", F.when(F.col("verdict").isNotNull(), case_risk_level(F.col("verdict"))).alias("risk_level"),
            "rule_score", display_flag(F.col("rule_score")).alias("display_flag"),
            F.col("risk_score").alias("ml_score"),
            F.when(F.col("attribution_status") == "lookup-failed", "lookup unavailable")
            .otherwise(F.coalesce("attributed_name", F.lit("Unattributed"))).alias("attributed_vasp"),
        )
    )


def case_ledger(case_edges: DataFrame, reach: DataFrame, rules: DataFrame) -> DataFrame:
    """Ledger rows of every case. An edge's hop is that of its farther end and its marker that
    of its source; the dataset has no amounts, so they are 0."""
    hop = reach.select("seed", "node", "hop")
    flags = by_shuffle(rules.select(F.col("tx_id").alias("src"), "peel_fired", "fanout_fired", "mixer_fired"))
    off = lambda c: F.coalesce(c, F.lit(False))
    return (
        case_edges.join(hop.toDF("seed", "src", "h1"), ["seed", "src"])
        .join(hop.toDF("seed", "dst", "h2"), ["seed", "dst"])
        .join(flags, "src", "left")
        .select(
            F.col("seed").alias("case_seed"), F.greatest("h1", "h2").alias("Hop"),
            F.col("src").cast("string").alias("From"), F.col("dst").cast("string").alias("To"),
            F.concat("src", F.lit("->"), "dst").alias("TxHash"),
            F.lit(0.0).alias("AmountBTC"), F.lit(0).alias("AmountINR"), F.lit("unknown").alias("Timestamp"),
            laundering_marker(off("peel_fired"), off("fanout_fired"), off("mixer_fired")).alias("Marker"),
        )
    )


def case_documents(cases: DataFrame) -> DataFrame:
    """One JSON document per case."""
    return cases.select("case_id", F.to_json(F.struct(*cases.columns)).alias("document"))
