"""Connected components by randomised contraction.

Every round each node picks the neighbour (or itself) with the smallest hash, and the
graph shrinks to the picked nodes; a fresh hash per round keeps the expected number of
rounds logarithmic on any shape, long chains included. Picks aggregate map-side, and
parallel edges collapse after each contraction, so a hot node stays a set of small rows.
What remains once few edges are left goes to one task, whose size is bounded by SMALL_EDGES, instead of many small rounds.
The maps of all rounds are then composed from the smallest back to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import materialize

#: Edges, both directions counted, that one task takes to the end.
SMALL_EDGES = 400_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, pick) for all edges of a small graph: every node of a component picks the same member."""
    edges = pa.Table.from_batches(list(batches))
    ends = pa.chunked_array([*edges.column("src").chunks, *edges.column("dst").chunks]).combine_chunks().dictionary_encode()
    a, b = np.split(np.asarray(ends.indices, dtype=np.int64), 2)
    root = np.arange(len(ends.dictionary))
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high > low
        if not apart.any():
            break
        # Roots hook to the smallest root beside them; then every node points at its root again.
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([ends.dictionary, ends.dictionary.take(pa.array(root))], names=["node", "pick"])


def connected_components(nodes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) with component = smallest member.

    ``nodes`` has a ``node`` column; ``links`` has ``src`` and ``dst``. Ends of links that are
    no nodes still connect their neighbours. Without ``nodes``, they are the ends of links to another node, each once.
    """
    both = links.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    edges = both.select("e.src", "e.dst").where("src <> dst").distinct()
    edges = materialize(edges, "cc-edges")
    maps: list[DataFrame] = []
    left = edges.count()
    while left > SMALL_EDGES:
        # Equal hashes may pick either node; the next round's hash tells them apart.
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(maps)))
        best = edges.groupBy("src").agg(F.min_by("dst", order("dst")).alias("nbr"), F.min(order("dst")).alias("h"))
        picks = best.select(
            F.col("src").alias("node"), F.when(F.col("h") < order("src"), F.col("nbr")).otherwise(F.col("src")).alias("pick")
        )
        picks = materialize(picks, "cc-picks")
        maps.append(picks)
        edges = materialize(
            edges.join(picks.toDF("src", "a"), "src")
            .join(picks.toDF("dst", "b"), "dst")
            .where("a <> b")
            .select(F.col("a").alias("src"), F.col("b").alias("dst"))
            .distinct(),
            "cc-edges",
        )
        left = edges.count()
    if left:
        kind = edges.schema["src"].dataType
        maps.append(materialize(edges.coalesce(1).mapInArrow(_finish, StructType([StructField("node", kind), StructField("pick", kind)])), "cc-picks"))
    if not maps:
        alone = edges.select(F.col("src").alias("node")) if nodes is None else nodes
        return alone.select("node", F.col("node").alias("component"))
    roots = maps[-1].toDF("node", "root")
    for picks in reversed(maps[:-1]):
        roots = picks.join(roots.toDF("pick", "root"), "pick", "left").select(
            "node", F.coalesce("root", "pick").alias("root")
        )
    roots = materialize(roots, "cc-roots") if len(maps) > 1 else roots
    smallest = roots.groupBy("root").agg(F.min("node").alias("component"))
    member = roots.join(smallest, "root").select("node", "component")
    if nodes is None:
        return member
    return nodes.select("node").join(member, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
