"""Transaction graph: simple edges, degrees, the adjacency index and k-hop neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_empty, materialize_bucketed, read_bucketed, scratch_path, write_bucketed
from .ranking import global_rank, top_per_key
from .stored import (
    PART_ROWS, KeyedTable, level_key, load_keyed, pack, seed_sets, start_level, still_going, store_keyed, store_level, take_off,
)

# Seeds that share a row, which bounds the set packed into it.
SEED_SET = 100_000
# Depths at which a neighbourhood's growth is checked.
GROWTH_DEPTHS = (1, 2, 3, 5)


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def undirected_edges(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst")
    return pairs.union(edges.select("dst", "src")).toDF("node", "nbr").distinct()


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Degree over raw edge rows: parallel edges and self-loops count each time."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def graph_degrees(edges: DataFrame) -> DataFrame:
    """Distinct in- and out-degree per node, with the sole neighbour where there is one."""
    simple = simple_edges(edges)
    sides = simple.select("src", "dst", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    out = F.col("side") == 0
    return (
        sides.select(
            F.when(out, F.col("src")).otherwise(F.col("dst")).alias("node"),
            F.when(out, F.col("dst")).alias("to"),
            F.when(~out, F.col("src")).alias("from"),
        )
        .groupBy("node")
        .agg(
            F.count("from").alias("in_degree"),
            F.count("to").alias("out_degree"),
            F.min("from").alias("any_src"),
            F.min("to").alias("any_dst"),
        )
    )


def hubs(degrees: DataFrame, threshold: int) -> DataFrame:
    return degrees.where(F.col("degree") > threshold)


def non_hub_edges(edges: DataFrame, hub_nodes: DataFrame) -> DataFrame:
    hub = hub_nodes.select(F.col("node").alias("_hub"))
    return edges.join(hub, edges["src"] == hub["_hub"], "left_anti").join(
        hub, F.col("dst") == F.col("_hub"), "left_anti"
    )


@dataclass(frozen=True)
class GraphIndex:
    """Both directions of every edge, stored by node. A row says which way the simple edges between ``node`` and ``nbr`` go, so
    degrees and simple edges come from the index without another pass over the raw edges.

    ``upward`` keeps each pair of neighbours once, at the end of lower degree, bucketed by that end.
    """

    arcs: KeyedTable
    upward: DataFrame

    @property
    def n_buckets(self) -> int:
        return self.arcs.n_buckets

    @property
    def adjacency(self) -> DataFrame:
        return self.arcs.rows().select("node", "nbr", "is_out", "is_in")

    def simple_edges(self) -> DataFrame:
        return self.adjacency.where("is_out").select(F.col("node").alias("src"), F.col("nbr").alias("dst"))

    def degrees(self) -> DataFrame:
        """In- and out-degree of each node, with the sole neighbour where there is one."""
        return self.arcs.grouped(
            F.count_if("is_in").alias("in_degree"),
            F.count_if("is_out").alias("out_degree"),
            F.min(F.when(F.col("is_in"), F.col("nbr"))).alias("any_src"),
            F.min(F.when(F.col("is_out"), F.col("nbr"))).alias("any_dst"),
        )

    def expand(self, frontier: DataFrame) -> DataFrame:
        """Join a frontier (node, ...) to its neighbours."""
        return self.arcs.meet(frontier)


def build_graph_index(edges: DataFrame, part_rows: int = PART_ROWS, path: str | None = None) -> GraphIndex:
    """Index ``edges`` in ``path``, or in a folder of the session."""
    both = edges.select("src", "dst", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd"))
    arcs = (
        both.select(
            F.when(F.col("fwd"), F.col("src")).otherwise(F.col("dst")).alias("node"),
            F.when(F.col("fwd"), F.col("dst")).otherwise(F.col("src")).alias("nbr"),
            "fwd",
        )
        .groupBy("node", "nbr")
        .agg(F.max("fwd").alias("is_out"), (~F.min("fwd")).alias("is_in"))
    )
    # A node has no more neighbours than edge ends, so hot nodes show in the edges already.
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    stored = store_keyed(arcs, ["node"], "nbr", path and f"{path}/arcs", part_rows, counted=ends)
    # Of a pair's two arcs the one that starts at the lower end by (degree, name); a loop is its own pair.
    degree = materialize_bucketed(stored.grouped(F.count("*").alias("degree")), "arc-counts", ["node"], stored.n_buckets)
    ends = stored.meet(degree.withColumnRenamed("degree", "own")).join(degree.toDF("nbr", "other"), "nbr")
    upward = ends.where(F.struct("own", "node") <= F.struct("other", "nbr")).select("node", "nbr", "is_out", "is_in")
    folder = f"{path}/upward" if path else scratch_path(edges.sparkSession, "upward")
    return GraphIndex(stored, write_bucketed(upward, folder, ["node"], stored.n_buckets))


def read_graph_index(spark: SparkSession, path: str) -> GraphIndex:
    arcs = load_keyed(spark, f"{path}/arcs")
    kind = arcs.cold.schema["node"].dataType.simpleString()
    columns = f"node {kind}, nbr {kind}, is_out boolean, is_in boolean"
    return GraphIndex(arcs, read_bucketed(spark, f"{path}/upward", columns, ["node"], arcs.n_buckets))


def known_seeds(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    return seeds.join(nodes.select(F.col("tx_id").alias("seed")), "seed", "left_semi")


def unknown_seeds(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    return seeds.join(nodes.select(F.col("tx_id").alias("seed")), "seed", "left_anti")


def khop(seeds: DataFrame, index: GraphIndex, hop_depth: int) -> DataFrame:
    """(seed, node, hop) for every node within ``hop_depth`` undirected hops of each seed.

    All seeds spread together, a node's seeds packed in one row. A hop joins the frontier to the stored arcs where it lies,
    unites the seeds that arrive at a node ahead of the exchange, and deals one row per node: the only exchange of a
    level. What arrives from a level lies in it, in the one before or in the next, so the seeds of two levels are taken off,
    without moving them. Above SEED_SET seeds, a node has a row for each part of the seeds, which bounds a row; all parts
    meet the arcs together, and a level is dealt by node and part, then by node.
    A ``hop_depth`` column on the seeds replaces ``hop_depth`` for each seed that has a value there.
    """
    sets, deepest = seed_sets(seeds, hop_depth, SEED_SET)
    return reduce(DataFrame.unionByName, [_khop(mine, index, deepest) for mine in sets])


def hop_step(index: GraphIndex, level: DataFrame, before: DataFrame | None, hop: int) -> DataFrame:
    """The next level (node, seeds), from the last one and the one before it, each with a row per node and part of the seeds."""
    key = level_key(level, "node")
    reached = index.expand(still_going(level, hop)).select(F.col("nbr").alias("node"), *key[1:], F.explode("seeds").alias("s"))
    arrived = take_off(pack(reached, key, "s", "seeds"), level, key, "seeds")
    if before is not None:
        arrived = take_off(arrived, before, key, "seeds")
    return arrived.where("size(seeds) > 0")


def _khop(seeds: DataFrame, index: GraphIndex, deepest: int) -> DataFrame:
    level, before = start_level(seeds, "node", index.n_buckets), None
    levels = [level]
    for hop in range(deepest):
        after = store_level(hop_step(index, level, before, hop), "khop", "node", index.n_buckets)
        if is_empty(after):
            break
        levels.append(after)
        before, level = level, after
    rows = [df.select(F.explode("seeds.seed").alias("seed"), "node", F.lit(hop).alias("hop")) for hop, df in enumerate(levels)]
    return reduce(DataFrame.unionByName, rows)


def induced_subgraph(reach: DataFrame, index: GraphIndex) -> DataFrame:
    """(seed, src, dst) for every edge with both ends among the seed's nodes.

    Edges are looked up at their end of lower degree and probed at the other, so a hub at the rim of a neighbourhood
    costs its neighbours there and never its arcs.
    """
    pairs = index.upward.join(reach.select("seed", "node"), "node")
    ends = reach.select("seed", F.col("node").alias("nbr"))
    met = pairs.join(ends, ["seed", "nbr"], "left_semi")
    way = lambda flag, src, dst: F.when(F.col(flag), F.struct(F.col(src).alias("src"), F.col(dst).alias("dst")))
    both = F.array_distinct(F.array_compact(F.array(way("is_out", "node", "nbr"), way("is_in", "nbr", "node"))))
    return met.select("seed", F.explode(both).alias("e")).select("seed", "e.src", "e.dst")


def with_node_attributes(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """Label and step per reached node; ends of dangling edges get -1 for both."""
    attrs = nodes.select(F.col("tx_id").alias("node"), "label", "time_step")
    return reach.join(attrs, "node", "left").withColumns(
        {
            "label": F.coalesce("label", F.lit(-1)),
            "time_step": F.coalesce("time_step", F.lit(-1)),
        }
    )


def edges_with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    label = nodes.select("tx_id", "label")
    return (
        edges.join(label.toDF("src", "src_label"), "src", "left")
        .join(label.toDF("dst", "dst_label"), "dst", "left")
        .select(
            "src", "dst",
            F.coalesce("src_label", F.lit(-1)).alias("src_label"),
            F.coalesce("dst_label", F.lit(-1)).alias("dst_label"),
        )
    )


def subgraph_stats(reach: DataFrame, sub_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    by_node = (
        with_node_attributes(reach, nodes)
        .groupBy("seed")
        .agg(
            F.count("*").alias("node_count"),
            F.max("hop").alias("max_hop_reached"),
            F.count_if(F.col("label") == 1).alias("illicit_nodes"),
            F.count_if(F.col("label") == 0).alias("licit_nodes"),
            F.count_if(F.col("label") == -1).alias("unknown_nodes"),
        )
    )
    by_edge = sub_edges.groupBy("seed").agg(F.count("*").alias("edge_count"))
    return by_node.join(by_edge, "seed", "left").withColumn(
        "edge_count", F.coalesce("edge_count", F.lit(0))
    )


def hop_histogram(reach: DataFrame) -> DataFrame:
    return reach.groupBy("seed", "hop").agg(F.count("*").alias("nodes"))


def hop_growth_check(reach: DataFrame, depths: tuple[int, ...] = GROWTH_DEPTHS) -> DataFrame:
    """Node counts at growing depths from one pass over the deepest neighbourhood."""
    sizes = reach.groupBy("seed").agg(
        F.max("hop").alias("max_hop_reached"),
        *[F.count_if(F.col("hop") <= d).alias(f"nodes_{d}") for d in depths],
    )
    cols = [F.col(f"nodes_{d}") for d in depths]
    monotonic = F.lit(True)
    for a, b in zip(cols, cols[1:]):
        monotonic = monotonic & (a <= b)
    return sizes.select(
        "*",
        monotonic.alias("monotonic"),
        (cols[-1] > cols[0]).alias("grows_with_hop"),
        (cols[1] == cols[0]).alias("saturated"),
    ).withColumn(
        "ok",
        F.col("monotonic")
        & (F.col("grows_with_hop") | F.col("saturated"))
        & (F.col("max_hop_reached") <= max(depths)),
    )


def trace_view(
    reach: DataFrame, sub_edges: DataFrame, max_hop: int, verdict: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes up to ``max_hop`` (and of one verdict, if asked), and the edges among them."""
    kept = reach.where(F.col("hop") <= max_hop)
    if verdict is not None:
        kept = kept.where(F.col("verdict") == verdict)
    ends = kept.select("seed", "node")
    edges = sub_edges.join(ends.toDF("seed", "src"), ["seed", "src"], "left_semi").join(
        ends.toDF("seed", "dst"), ["seed", "dst"], "left_semi"
    )
    return kept, edges


def node_transactions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Incoming and outgoing edges of every node, with the neighbour's label."""
    sides = edges.select("src", "dst", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("direction"))
    incoming = F.col("direction") == "in"
    flows = sides.select(
        F.when(incoming, F.col("dst")).otherwise(F.col("src")).alias("node"),
        "direction",
        F.when(incoming, F.col("src")).otherwise(F.col("dst")).alias("counterparty"),
    )
    label = nodes.select(F.col("tx_id").alias("counterparty"), F.col("label").alias("counterparty_label"))
    return flows.join(label, "counterparty", "left").select(
        "node", "direction", "counterparty",
        F.coalesce("counterparty_label", F.lit(-1)).alias("counterparty_label"),
    )


def node_cap(reach: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` nodes per seed, nearest first; the seed is always kept."""
    return top_per_key(reach, ["seed"], [F.col("hop"), F.col("node")], cap)


def total_degree(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    d = degrees.select(F.col("node").alias("tx_id"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return nodes.select("tx_id").join(d, "tx_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def seed_spread(degree: DataFrame, n_seeds: int) -> DataFrame:
    """``n_seeds`` nodes evenly spaced down the degree ranking."""
    ranked = global_rank(degree, [F.col("degree").desc(), F.col("tx_id")], "position")
    total = ranked.count()
    stride = max(1, total // max(1, n_seeds))
    return (
        ranked.where((F.col("position") - 1) % stride == 0)
        .where(F.col("position") <= stride * n_seeds)
        .select("tx_id", "degree", "position")
    )


def degree_extremes(degree: DataFrame, n_low: int = 25) -> DataFrame:
    """The lowest-degree nodes and the node of highest degree."""
    low = degree.orderBy("degree", "tx_id").limit(n_low).withColumn("extreme", F.lit("low"))
    top = degree.orderBy(F.desc("degree"), "tx_id").limit(1).withColumn("extreme", F.lit("hub"))
    return low.unionByName(top)


def integrity_check(nodes: DataFrame, edges: DataFrame, expected_tx: int, expected_edges: int) -> DataFrame:
    """Actual against expected row counts. A mismatch is reported, never raised."""
    counts = nodes.agg(F.lit("tx_count").alias("name"), F.count("*").alias("actual"), F.lit(expected_tx).cast("long").alias("expected"))
    counts = counts.unionByName(
        edges.agg(F.lit("edge_count").alias("name"), F.count("*").alias("actual"), F.lit(expected_edges).cast("long").alias("expected"))
    )
    ok = F.col("actual") == F.col("expected")
    return counts.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))
