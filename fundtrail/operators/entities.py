"""Entities (hub-safe components), the time-ordered split of whole entities, and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from .components import connected_components
from .graph import edge_degrees, hubs, non_hub_edges
from .ranking import global_rank, one_row


class LeakageError(RuntimeError):
    pass


def build_entities(nodes: DataFrame, edges: DataFrame, hub_threshold: int) -> DataFrame:
    """(tx_id, entity_id, is_hub). A hub is an entity of its own; edges at hubs do not connect.

    The entity is named after its smallest member, so names do not depend on row order.
    """
    hub = hubs(edge_degrees(edges), hub_threshold).select("node")
    parts = connected_components(nodes.select(F.col("tx_id").alias("node")), non_hub_edges(edges, hub))
    flagged = hub.select(F.col("node"), F.lit(True).alias("is_hub"))
    name = F.when(F.col("is_hub"), F.concat(F.lit("hub::"), "node")).otherwise(
        F.concat(F.lit("entity::"), "component")
    )
    return parts.join(flagged, "node", "left").withColumn("is_hub", F.coalesce("is_hub", F.lit(False))).select(
        F.col("node").alias("tx_id"), name.alias("entity_id"), "is_hub"
    )


def entity_times(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    return entities.join(nodes.select("tx_id", "time_step"), "tx_id")


def entity_min_step(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    return entity_times(entities, nodes).groupBy("entity_id").agg(F.min("time_step").alias("min_step"))


def entity_span(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    return entity_times(entities, nodes).groupBy("entity_id").agg(
        (F.max("time_step") - F.min("time_step")).alias("span")
    )


def time_split(entities: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Add ``split`` to every row of ``entities``: earliest entities train, then val, then test.

    Steps wholly on one side of a boundary are assigned from counts per step, a table as
    small as the calendar. Only entities of a step that straddles a boundary are ranked, and
    that ranking is range partitioned.
    """
    steps = entity_min_step(entities, nodes)
    everything = Window.partitionBy()
    upto = Window.orderBy("min_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = (
        steps.groupBy("min_step").agg(F.count("*").alias("n"))
        .select("min_step", "n", F.sum("n").over(upto).alias("last"), F.sum("n").over(everything).alias("total"))
        .select(
            "min_step",
            (F.col("last") - F.col("n")).alias("before"),
            "last",
            F.rint(F.col("total") * params.train_fraction).cast("long").alias("n_train"),
            F.rint(F.col("total") * params.val_fraction).cast("long").alias("n_val"),
        )
        .withColumn("n_fit", F.col("n_train") + F.col("n_val"))
    )
    straddles = lambda cut: (F.col("before") < F.col(cut)) & (F.col("last") > F.col(cut))
    placed = steps.join(bounds, "min_step").withColumn(
        "mixed", straddles("n_train") | straddles("n_fit")
    )
    side = lambda rank: (
        F.when(rank <= F.col("n_train"), "train").when(rank <= F.col("n_fit"), "val").otherwise("test")
    )
    whole = placed.where("not mixed").select("entity_id", side(F.col("last")).alias("split"))
    ranked = global_rank(placed.where("mixed"), [F.col("min_step"), F.col("entity_id")], "place")
    per_step = ranked.groupBy("min_step").agg((F.min("place") - 1).alias("skipped"))
    edge_rows = ranked.join(per_step, "min_step").select(
        "entity_id", side(F.col("place") - F.col("skipped") + F.col("before")).alias("split")
    )
    return entities.join(whole.unionByName(edge_rows), "entity_id").select(
        "tx_id", "entity_id", "is_hub", "split"
    )


def entity_numbering(entities: DataFrame) -> DataFrame:
    """Dense entity numbers in order of the smallest member, for display."""
    names = entities.groupBy("entity_id").agg(F.min("tx_id").alias("first_member"))
    return global_rank(names, [F.col("first_member")], "entity_no").select("entity_id", "first_member", "entity_no")


def split_counts(split: DataFrame) -> DataFrame:
    per_entity = split.groupBy("split", "entity_id").agg(F.count("*").alias("n"))
    return per_entity.groupBy("split").agg(F.count("*").alias("entities"), F.sum("n").alias("txs"))


def cross_split_edges(edges: DataFrame, split: DataFrame) -> DataFrame:
    of = split.select("tx_id", "split")
    return (
        edges.select("src", "dst")
        .join(of.toDF("src", "src_split"), "src")
        .join(of.toDF("dst", "dst_split"), "dst")
        .where("src_split <> dst_split")
    )


def split_overlap(split: DataFrame) -> DataFrame:
    """Ids shared by two splits, per pair of splits, for transactions and entities."""
    result = None
    for kind in ("tx_id", "entity_id"):
        ids = {s: split.where(F.col("split") == s).select(kind) for s in ("train", "val", "test")}
        for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
            shared = ids[a].intersect(ids[b]).agg(F.count("*").alias("shared")).select(
                F.lit(kind).alias("kind"), F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), "shared"
            )
            result = shared if result is None else result.unionByName(shared)
    return result


def leakage_report(split: DataFrame, nodes: DataFrame, edges: DataFrame, params: Params, require_span_zero: bool = True) -> DataFrame:
    """One row: overlaps, edges across splits, entity spans and the thresholds used."""
    per_id = lambda c: split.groupBy(c).agg((F.min("split") != F.max("split")).alias("mixed"))
    tx = split.groupBy("tx_id").agg(F.min("split").alias("split"), (F.min("split") != F.max("split")).alias("mixed")).agg(
        F.count_if("mixed").alias("tx_overlap_count"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}_txs") for s in ("train", "val", "test")],
    )
    entity = per_id("entity_id").agg(F.count("*").alias("n_entities"), F.count_if("mixed").alias("entity_overlap_count"))
    cross = cross_split_edges(edges, split).agg(F.count("*").alias("cross_split_edge_count"))
    span = entity_span(split, nodes).agg(
        F.count_if(F.expr("span > 0")).alias("entity_time_span_violations"), F.count_if(F.expr("span = 0")).alias("n_entities_span0"),
        F.coalesce(F.max("span"), F.lit(0)).alias("max_entity_time_span"),
    )
    return one_row(tx, entity, cross, span).select(
        "*",
        ((F.col("tx_overlap_count") == 0) & (F.col("entity_overlap_count") == 0)).alias("leakage_free"),
        (F.col("entity_time_span_violations") == 0).alias("time_span_ok"),
        F.lit(params.hub_degree).alias("hub_degree_threshold"),
        F.lit(params.train_fraction).alias("train_fraction"),
        F.lit("time_respecting").alias("split_type"), F.lit(require_span_zero).alias("require_span_zero"),
    )


def verify_no_leakage(report: DataFrame, require_span_zero: bool = True) -> None:
    row = report.first()
    if not row["leakage_free"]:
        raise LeakageError(
            f"splits share {row['tx_overlap_count']} transactions and {row['entity_overlap_count']} entities"
        )
    if require_span_zero and not row["time_span_ok"]:
        raise LeakageError(
            f"{row['entity_time_span_violations']} entities span several steps (max {row['max_entity_time_span']})"
        )
