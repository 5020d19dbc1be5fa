"""Entity clusters, named-exchange attribution and convergence of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import TIER_DATASET, TIER_SUPPLEMENTARY
from ..session import materialize
from .ranking import top_per_key


def cluster_summary(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Size, label composition and illicit share per entity."""
    members = entities.select("tx_id", "entity_id").join(nodes.select("tx_id", "label"), "tx_id", "left")
    return members.groupBy(F.col("entity_id").alias("cluster_id")).agg(
        F.count("*").alias("n_wallets"),
        F.count_if(F.expr("label = 1")).alias("illicit"),
        F.count_if(F.expr("label = 0")).alias("licit"),
        F.count_if(F.expr("label is null or label not in (0, 1)")).alias("unknown"),
    ).withColumns(
        {
            "illicit_fraction": F.round(F.col("illicit") / F.col("n_wallets"), 4),
            "confidence_tier": F.lit(TIER_DATASET),
        }
    )


def member_sample(entities: DataFrame, size: int) -> DataFrame:
    """First ``size`` members per cluster in order, and how many were left out.

    Members are limited before they are collected, so a list never exceeds ``size``.
    """
    total = entities.groupBy("entity_id").agg(F.count("*").alias("n"))
    first = top_per_key(entities.select("entity_id", "tx_id"), ["entity_id"], [F.col("tx_id")], size)
    lists = first.groupBy("entity_id").agg(F.sort_array(F.collect_list("tx_id")).alias("members_sample"))
    return lists.join(total, "entity_id").select(
        F.col("entity_id").alias("cluster_id"), "members_sample",
        F.greatest(F.col("n") - size, F.lit(0)).alias("n_members_truncated"),
    )


def tag_targets(tags: DataFrame, address_map: DataFrame) -> DataFrame:
    """(address, tx_id): the tagged address itself and every transaction mapped to it."""
    direct = tags.select("address", F.col("address").alias("tx_id"))
    mapped = tags.select("address").join(address_map.select("address", F.col("tx_id").cast("string")), "address")
    return direct.unionByName(mapped).distinct()


def match_tags(tags: DataFrame, address_map: DataFrame, entities: DataFrame) -> DataFrame:
    """Each tag that hits a cluster, over full membership; the smallest cluster if it hits several."""
    hit = tag_targets(tags, address_map).join(
        entities.select(F.col("tx_id").cast("string"), "entity_id"), "tx_id"
    )
    cluster = hit.groupBy("address").agg(F.min("entity_id").alias("cluster_id"))
    return tags.join(cluster, "address").select(
        "cluster_id", "address", "name", "source", "jurisdiction", "position",
        F.lit(TIER_SUPPLEMENTARY).alias("confidence_tier"),
    )


def unmatched_tags(tags: DataFrame, matches: DataFrame) -> DataFrame:
    return tags.join(matches.select("address"), "address", "left_anti")


def attribute_clusters(clusters: DataFrame, matches: DataFrame) -> DataFrame:
    """Attach the earliest listed match; the cluster keeps its own confidence tier."""
    display = matches.groupBy("cluster_id").agg(
        F.min(F.struct("position", "name", "source", "jurisdiction", "address")).alias("m")
    ).select(
        "cluster_id",
        F.col("m.name").alias("attributed_name"),
        F.col("m.source").alias("attribution_source"),
        F.col("m.jurisdiction").alias("jurisdiction"),
        F.lit("VASP").alias("category"),
        F.lit(TIER_SUPPLEMENTARY).alias("attribution_tier"),
    )
    return clusters.join(display, "cluster_id", "left")


def cluster_verdict_join(verdicts: DataFrame, entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, verdict) per wallet; a wallet without a mapping is taken as a cluster id."""
    of = entities.select("tx_id", "entity_id")
    placed = verdicts.select("tx_id", "verdict").join(of, "tx_id", "left").select(
        F.coalesce("entity_id", F.col("tx_id").cast("string")).alias("cluster_id"), "tx_id", "verdict"
    )
    return placed.join(clusters.select("cluster_id"), "cluster_id", "left_semi")


def cluster_verdicts(placed: DataFrame, clusters: DataFrame) -> DataFrame:
    counts = placed.groupBy("cluster_id").agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("confirmed", "watch", "none")]
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return clusters.select("cluster_id").join(counts, "cluster_id", "left").select(
        "cluster_id", zero("confirmed"), zero("watch"), zero("none")
    )


def cluster_report_totals(attributed: DataFrame, tags: DataFrame) -> DataFrame:
    loaded = tags.limit(1).agg((F.count("*") > 0).alias("exchange_list_loaded"))
    return attributed.agg(
        F.count("*").alias("n_clusters"),
        F.count("attributed_name").alias("n_attributed_clusters"),
        F.sum("n_wallets").alias("n_wallets"),
    ).select("*", loaded.scalar().alias("exchange_list_loaded"))


def cluster_report(entities: DataFrame, clusters: DataFrame, verdicts: DataFrame, sample: int) -> DataFrame:
    """The full report: one nested row per cluster of ``clusters``, as :func:`attribute_clusters` gives them."""
    counts = cluster_verdicts(cluster_verdict_join(verdicts, entities, clusters), clusters)
    return clusters.join(member_sample(entities, sample), "cluster_id").join(counts, "cluster_id").select(
        "cluster_id", "confidence_tier", "n_wallets",
        F.struct("illicit", "licit", "unknown").alias("label_counts"),
        "illicit_fraction", "members_sample", "n_members_truncated",
        F.when(
            F.col("attributed_name").isNotNull(),
            F.struct(F.col("attributed_name").alias("name"), "category", F.col("attribution_tier").alias("confidence_tier"),
                     F.col("attribution_source").alias("source_name"), "jurisdiction"),
        ).alias("attribution"),
        F.struct("confirmed", "watch", "none").alias("verdict_counts"),
    )


def convergence(cases: DataFrame, reach: DataFrame, entities: DataFrame, attributed: DataFrame, min_cases: int = 2) -> DataFrame:
    """Independently reported cases whose traces meet in the same cluster, with or without a name.

    One row per (cluster, case) with the fewest hops, kept where at least ``min_cases``
    different cases meet; ``cases`` has case_id, seed and amount.
    """
    named = attributed.select("cluster_id", "attributed_name")
    inside = entities.join(named, F.col("entity_id") == F.col("cluster_id")).select(
        F.col("tx_id").alias("node"), "cluster_id", "attributed_name"
    )
    seeds = reach.join(inside, "node").groupBy("seed", "cluster_id", "attributed_name").agg(F.min("hop").alias("hops"))
    per_case = cases.select("case_id", "seed", "amount").join(seeds, "seed").groupBy(
        "cluster_id", "attributed_name", "case_id"
    ).agg(F.min("hops").alias("hops"), F.max("amount").alias("amount"))
    totals = per_case.groupBy("cluster_id").agg(
        F.count("*").alias("n_cases"), F.round(F.sum("amount"), 2).alias("total_loss")
    ).where(F.col("n_cases") >= min_cases)
    return per_case.join(totals, "cluster_id")


def converging_reports(reports: DataFrame, reach: DataFrame, entities: DataFrame, attributed: DataFrame, min_cases: int = 2) -> tuple[DataFrame, DataFrame]:
    """Where the traces of reports meet: (meetings, totals).

    ``reports`` has ack_number, seed, victim_state, scam_category, amount_inr and amount_btc. A meeting is a row per
    cluster and report with what the report says and its fewest hops; totals have, per cluster with at least ``min_cases`` reports, its
    name and jurisdiction, how many reports, states and kinds of fraud meet there, and the joint loss in rupees and bitcoin.
    """
    of = entities.select(F.col("tx_id").alias("node"), F.col("entity_id").alias("cluster_id"))
    met = reach.join(of, "node").groupBy("seed", "cluster_id").agg(F.min("hop").alias("hops"))
    rows = reports.select("ack_number", "seed", "victim_state", "scam_category", "amount_inr", "amount_btc").join(met, "seed")
    once = rows.groupBy("cluster_id", "ack_number").agg(
        F.min(F.struct("hops", "seed", "victim_state", "scam_category", "amount_inr", "amount_btc")).alias("r")
    ).select("cluster_id", "ack_number", "r.*")
    totals = once.groupBy("cluster_id").agg(
        F.count("*").alias("n_cases"), F.countDistinct("victim_state").alias("n_states"), F.countDistinct("scam_category").alias("n_scam_types"),
        F.round(F.sum("amount_inr"), 2).alias("total_loss_inr"), F.round(F.sum("amount_btc"), 4).alias("total_loss_btc"), F.min("hops").alias("nearest_hops"),
    ).where(F.col("n_cases") >= min_cases)
    totals = materialize(totals.join(attributed.select("cluster_id", "attributed_name", "jurisdiction"), "cluster_id", "left"), "converging")
    return once.join(totals.select("cluster_id"), "cluster_id", "left_semi"), totals
