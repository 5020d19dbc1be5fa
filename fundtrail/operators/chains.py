"""Peel chains: runs of nodes that each pass everything on to exactly one next node."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_empty, materialize


def forwarding_nodes(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Nodes with one output and at least one input, with step and sole neighbours."""
    step = nodes.select(F.col("tx_id").alias("node"), "time_step")
    return (
        degrees.where((F.col("out_degree") == 1) & (F.col("in_degree") >= 1))
        .join(step, "node", "left")
        .withColumn("time_step", F.coalesce("time_step", F.lit(-1)))
    )


def peel_links(forwarding: DataFrame, max_gap: int) -> DataFrame:
    """(src, dst) between consecutive forwarding nodes.

    The join is on the (src, dst) pair: the source's only output against the target's only
    input. Both sides are unique, so a hub on either end cannot make a hot key.
    """
    u = forwarding.select(
        F.col("node").alias("src"), F.col("any_dst").alias("dst"), F.col("time_step").alias("src_step")
    )
    v = forwarding.where("in_degree = 1").select(
        F.col("any_src").alias("src"), F.col("node").alias("dst"), F.col("time_step").alias("dst_step")
    )
    known = (F.col("src_step") >= 0) & (F.col("dst_step") >= 0)
    too_far = known & (F.col("dst_step") - F.col("src_step") > max_gap)
    return u.join(v, ["src", "dst"]).where(~too_far).select("src", "dst", "src_step", "dst_step")


def chain_positions(links: DataFrame) -> DataFrame:
    """(node, head, position, is_cycle) for the disjoint paths formed by ``links``.

    Pointer doubling: each round an unfinished node adopts the ancestor of its ancestor.
    Unfinished nodes of one path always point at different ancestors, so the keys of every
    join are unique. Nodes still unfinished after enough rounds for the longest possible
    path lie on a cycle.
    """
    prev = materialize(links.select(F.col("dst").alias("node"), F.col("src").alias("anc")), "chain")
    has_prev = prev.select(F.col("node").alias("anc"), F.lit(False).alias("at_head"))
    state = prev.join(has_prev, "anc", "left").select(
        "node", "anc", F.lit(1).cast("long").alias("dist"), F.coalesce("at_head", F.lit(True)).alias("at_head")
    )
    state = materialize(state, "chain")
    finished = state.where("at_head")
    active = state.where("not at_head")
    for _ in range(math.ceil(math.log2(prev.count() + 2)) + 1):
        if is_empty(active):
            break
        known = finished.unionByName(active).select(
            F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("dist").alias("more"), "at_head"
        )
        state = materialize(
            active.drop("at_head").join(known, "anc").select(
                "node", F.col("far").alias("anc"), (F.col("dist") + F.col("more")).alias("dist"), "at_head"
            ),
            "chain",
        )
        finished = finished.unionByName(state.where("at_head"))
        active = state.where("not at_head")
    heads = finished.where("dist = 1").select("anc").distinct()
    none = F.lit(None)
    return (
        finished.select("node", F.col("anc").alias("head"), F.col("dist").alias("position"), F.lit(False).alias("is_cycle"))
        .unionByName(heads.select(F.col("anc").alias("node"), F.col("anc").alias("head"), F.lit(0).cast("long").alias("position"), F.lit(False).alias("is_cycle")))
        .unionByName(active.select("node", none.cast(active.schema["anc"].dataType).alias("head"), none.cast("long").alias("position"), F.lit(True).alias("is_cycle")))
    )


def peel_chains(nodes: DataFrame, degrees: DataFrame, min_hops: int, max_gap: int) -> DataFrame:
    """Every node of a chain of at least ``min_hops`` forwarding nodes, measured from its head."""
    return peel_chains_of(forwarding_nodes(nodes, degrees), min_hops, max_gap)


def peel_chains_of(forwarding: DataFrame, min_hops: int, max_gap: int) -> DataFrame:
    """The chains among given forwarding nodes (node, any_src, any_dst, in_degree, time_step)."""
    forwarding = materialize(forwarding, "forwarding")
    placed = materialize(chain_positions(peel_links(forwarding, max_gap)), "chain")
    length = placed.where("not is_cycle").groupBy("head").agg((F.max("position") + 1).alias("chain_length"))
    return (
        forwarding.select("node", "time_step")
        .join(placed, "node", "left")
        .join(length, "head", "left")
        .select(
            F.col("node").alias("tx_id"),
            F.when(~F.coalesce("is_cycle", F.lit(False)), F.coalesce("head", "node")).alias("head"),
            F.when(~F.coalesce("is_cycle", F.lit(False)), F.coalesce("chain_length", F.lit(1).cast("long"))).alias("chain_length_hops"),
            F.when(~F.coalesce("is_cycle", F.lit(False)), F.coalesce("position", F.lit(0).cast("long"))).alias("position"),
            "time_step",
            F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"),
        )
        .where(F.col("is_cycle") | (F.col("chain_length_hops") >= min_hops))
    )


def peel_members(links: DataFrame) -> DataFrame:
    """Nodes flagged at the default of two hops: exactly the ends of links, no iteration."""
    return links.select(F.explode(F.array("src", "dst")).alias("tx_id")).distinct()
