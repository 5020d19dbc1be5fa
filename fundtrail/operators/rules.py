"""The three structural rules, evaluated for every node at once, and their composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import RULE_FANOUT, RULE_MIXER, RULE_PEEL, Params
from ..session import materialize, materialize_bucketed
from .chains import forwarding_nodes, peel_chains, peel_links
from .graph import GraphIndex, graph_degrees, induced_subgraph, khop, with_node_attributes


def fan_out(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, min_out: int, max_in: int, window: int) -> DataFrame:
    """Nodes with few inputs and many outputs whose known successor steps lie close together.

    ``edges`` are simple; only those of nodes with fitting degrees meet the steps.
    """
    bursts = degrees.where((F.col("out_degree") >= min_out) & (F.col("in_degree") <= max_in))
    successors = fan_out_successors(edges.join(bursts.select(F.col("node").alias("src")), "src", "left_semi"), nodes)
    spread = (
        successors.where("succ_step >= 0")
        .groupBy("tx_id")
        .agg((F.max("succ_step") - F.min("succ_step")).alias("time_step_spread"))
        .where(F.col("time_step_spread") <= window)
    )
    own = nodes.select("tx_id", F.col("time_step").alias("seed_time_step"))
    return (
        bursts.select(F.col("node").alias("tx_id"), "in_degree", "out_degree")
        .join(spread, "tx_id")
        .join(own, "tx_id", "left")
        .withColumn("seed_time_step", F.coalesce("seed_time_step", F.lit(-1)))
    )


def fan_out_successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with every successor over simple edges and its step (-1 if unknown)."""
    step = nodes.select(F.col("tx_id").alias("dst"), F.col("time_step").alias("succ_step"))
    return edges.select("src", "dst").join(step, "dst", "left").select(
        F.col("src").alias("tx_id"), F.col("dst").alias("successor"),
        F.coalesce("succ_step", F.lit(-1)).alias("succ_step"),
    )


def mixers_in_graph(mixers: DataFrame, nodes: DataFrame) -> DataFrame:
    return mixers.select("mixer_id").join(nodes.select(F.col("tx_id").alias("mixer_id")), "mixer_id", "left_semi")


def mixer_adjacent(mixers: DataFrame, index: GraphIndex, max_hops: int) -> DataFrame:
    """(tx_id, mixer_id, hops_from_mixer): the nearest mixer within ``max_hops`` undirected hops.

    All mixers spread at once. A node keeps its two nearest distinct mixers in one row, which is enough for its
    neighbours' nearest one, and lets a mixer be adjacent to another but not to itself. Arcs and rows kept are stored by node:
    a hop deals out the two first mixers that reach a node from a task, and nothing else.
    """
    own = mixers.select(F.col("mixer_id").alias("node")).distinct()
    near = own.select("node", F.array(F.struct(F.lit(0).alias("hops"), F.col("node").alias("mixer_id"))).alias("near"))
    near = materialize_bucketed(near, "mixers", ["node"], index.n_buckets)
    first_two = Window.partitionBy("node").orderBy("mixer_id")
    for hop in range(1, max_hops + 1):
        going = near.select("node", F.filter("near", lambda m: m["hops"] == hop - 1)["mixer_id"].alias("ids")).where("size(ids) > 0")
        met = index.expand(going).select(F.col("nbr").alias("node"), F.explode("ids").alias("mixer_id"))
        met = met.withColumn("place", F.dense_rank().over(first_two)).where("place <= 2")
        found = met.groupBy("node").agg(F.collect_set("mixer_id").alias("found"))
        both = near.join(found, "node", "full_outer").select(
            "node", F.coalesce("near", F.expr("filter(array(struct(0 as hops, node as mixer_id)), m -> false)")).alias("near"), F.coalesce("found", F.filter(F.array("node"), lambda m: F.lit(False))).alias("found")
        )
        fresh = F.transform(F.array_except("found", F.col("near")["mixer_id"]), lambda m: F.struct(F.lit(hop).alias("hops"), m.alias("mixer_id")))
        near = both.select("node", F.slice(F.array_sort(F.concat("near", fresh)), 1, 2).alias("near"))
        if hop < max_hops:
            near = materialize_bucketed(near, "mixers", ["node"], index.n_buckets, dealt=True)
    met = near.select("node", F.get(F.filter("near", lambda m: m["hops"] > 0), F.lit(0)).alias("m")).where("m is not null")
    return met.select(F.col("node").alias("tx_id"), "m.mixer_id", F.col("m.hops").alias("hops_from_mixer"))


def rule_score(params: Params) -> Column:
    weight = lambda fired, w: F.when(F.col(fired), w).otherwise(0)
    return (
        weight("peel_fired", params.weight_peel)
        + weight("fanout_fired", params.weight_fanout)
        + weight("mixer_fired", params.weight_mixer)
    )


def rule_flag(score: Column, params: Params) -> Column:
    return (
        F.when(score >= params.flag_high, "high")
        .when(score >= params.flag_medium, "medium")
        .when(score > 0, "low")
        .otherwise("none")
    )


def rules_fired() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("peel_fired"), RULE_PEEL),
            F.when(F.col("fanout_fired"), RULE_FANOUT),
            F.when(F.col("mixer_fired"), RULE_MIXER),
        )
    )


def contributing_signals(params: Params) -> Column:
    """Rule name -> fired, weight and evidence, the audit form of the typed columns."""
    text = lambda *cols: F.map_filter(
        F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()
    )
    entry = lambda fired, weight, evidence: F.struct(
        F.col(fired).alias("fired"), F.lit(weight).alias("weight"), evidence.alias("evidence")
    )
    return F.create_map(
        F.lit(RULE_PEEL), entry("peel_fired", params.weight_peel, text("chain_length_hops", "position", "peel_time_step")),
        F.lit(RULE_FANOUT), entry("fanout_fired", params.weight_fanout, text("in_degree", "out_degree", "time_step_spread", "seed_time_step")),
        F.lit(RULE_MIXER), entry("mixer_fired", params.weight_mixer, text("mixer_id", "hops_from_mixer")),
    )


def score_rules(wallets: DataFrame, peel: DataFrame, burst: DataFrame, mixer: DataFrame, params: Params) -> DataFrame:
    """Left-join the three findings, one row per wallet and per finding, and score them."""
    hit = lambda df, flag: df.withColumn(flag, F.lit(True))
    joined = (
        wallets.select("tx_id")
        .join(hit(peel.select("tx_id", "chain_length_hops", "position", F.col("time_step").alias("peel_time_step")), "peel_fired"), "tx_id", "left")
        .join(hit(burst, "fanout_fired"), "tx_id", "left")
        .join(hit(mixer, "mixer_fired"), "tx_id", "left")
    )
    flags = {f: F.coalesce(f, F.lit(False)) for f in ("peel_fired", "fanout_fired", "mixer_fired")}
    return (
        joined.withColumns(flags)
        .withColumn("rule_score", rule_score(params))
        .withColumns({"rule_flag": rule_flag(F.col("rule_score"), params), "rules_fired": rules_fired()})
    )


def run_rules(wallets: DataFrame, nodes: DataFrame, index: GraphIndex, mixers: DataFrame, params: Params, peel: DataFrame | None = None) -> DataFrame:
    """Rules for every wallet of the table.

    A rule looks at a wallet's neighbourhood of ``hop_depth`` hops. At depths of at least
    ``peel_min_hops`` the whole graph gives the wallet the same result, so each rule runs
    once over the graph; shallower depths go through :func:`run_rules_shallow`.
    """
    if params.hop_depth < params.peel_min_hops:
        return run_rules_shallow(wallets, nodes, index, mixers, params)
    degrees = materialize(index.degrees(), "degrees")
    if peel is None:
        peel = peel_chains(nodes, degrees, params.peel_min_hops, params.peel_max_gap)
    burst = fan_out(nodes, index.simple_edges(), degrees, params.fanout_min_out, params.fanout_max_in, params.fanout_window)
    linked = degrees.select(F.col("node").alias("tx_id"))  # a mixer may be known as the end of an edge only
    mixer = mixer_adjacent(mixers_in_graph(mixers, linked), index, min(params.mixer_max_hops, params.hop_depth))
    return score_rules(wallets, peel, burst, mixer, params)


def run_rules_shallow(wallets: DataFrame, nodes: DataFrame, index: GraphIndex, mixers: DataFrame, params: Params) -> DataFrame:
    """Rules when the neighbourhood is too small for the peel rule to see the whole graph.

    The same chain operator runs on (seed, node) pairs, so degrees stop at the rim. A wallet's own edges all lie within its
    neighbourhood, so only wallets that pass on to one node can be in a chain; the others have no neighbourhood worked out.
    """
    degrees = materialize(index.degrees(), "degrees")
    passing = degrees.where("out_degree = 1 and in_degree >= 1").select(F.col("node").alias("seed"))
    reach = materialize(khop(wallets.select(F.col("tx_id").alias("seed")).join(passing, "seed", "left_semi"), index, params.hop_depth), "reach")
    pair = lambda c: F.struct(F.col("seed"), F.col(c).alias("node"))
    local_nodes = with_node_attributes(reach, nodes).select(pair("node").alias("tx_id"), "time_step")
    local_edges = induced_subgraph(reach, index).select(pair("src").alias("src"), pair("dst").alias("dst"))
    peel = peel_chains(local_nodes, graph_degrees(local_edges), params.peel_min_hops, params.peel_max_gap)
    own = peel.where("tx_id.seed = tx_id.node").withColumn("tx_id", F.col("tx_id.seed"))
    burst = fan_out(nodes, index.simple_edges(), degrees, params.fanout_min_out, params.fanout_max_in, params.fanout_window)
    linked = degrees.select(F.col("node").alias("tx_id"))
    mixer = mixer_adjacent(mixers_in_graph(mixers, linked), index, min(params.mixer_max_hops, params.hop_depth))
    return score_rules(wallets, own, burst, mixer, params)


def rule_report(scored: DataFrame, mixers: DataFrame, params: Params) -> DataFrame:
    """Scored wallets with the thresholds in force and whether a mixer list was there."""
    thresholds = F.create_map(*[F.lit(x) for kv in params.as_dict().items() for x in (kv[0], str(kv[1]))])
    loaded = mixers.limit(1).agg(F.count("*") > 0)
    return scored.withColumns({"engine_params": thresholds, "mixer_list_loaded": loaded.scalar()})


def peel_peers(reach: DataFrame, peel: DataFrame) -> DataFrame:
    """Peel-chain nodes near each seed that is itself in no chain."""
    flagged = peel.select(F.col("tx_id").alias("node"))
    near = reach.join(flagged, "node", "left_semi").select("seed", F.col("node").alias("peer"))
    return near.join(flagged.toDF("seed"), "seed", "left_anti")


def rule_hits(rules: DataFrame) -> DataFrame:
    return rules.select("tx_id", F.explode("rules_fired").alias("rule"))


def rule_hit_counts(rules: DataFrame) -> DataFrame:
    return rule_hits(rules).groupBy("rule").agg(F.count("*").alias("nodes"))


def rule_false_positive_rate(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of known licit nodes that each rule flags."""
    licit = rules.join(nodes.where("label = 0").select("tx_id"), "tx_id", "left_semi")
    rates = licit.agg(
        *[F.avg(F.col(f).cast("int")).alias(r) for f, r in (("peel_fired", RULE_PEEL), ("fanout_fired", RULE_FANOUT), ("mixer_fired", RULE_MIXER))],
        F.count("*").alias("licit_nodes"),
    )
    return rates.unpivot("licit_nodes", [RULE_PEEL, RULE_FANOUT, RULE_MIXER], "rule", "false_positive_rate")
