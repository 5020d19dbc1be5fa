"""Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

A leaf is the digest of a row's columns, each as its UTF-8 length and value. The leaves of a group, in order of key, are
joined in runs of FANOUT level by level up to the group's subroot; the subroots, in order of group, likewise up to the root.
Each level is stored as records (digest, children): a digest is its own address, so equal subtrees are stored once.

Proofs don't climb. The places asked for go down from the root in batches, one row for each node on a wanted path:
a row finds its node's children by digest, the next digit of the wanted ranks (base FANOUT) says which child to go on with,
and the children not selected become one segment of the path. At the lowest node the requests join in, and the
segments are reversed, so that they lead from the leaf up. All of it is built-in functions. A level's frontier is an eighth
of the next one's, and whole paths are only formed where the last join hands them out.

Results: null columns are told apart from empty ones. Rows with equal keys are ordered by digest; equal rows are interchangeable
and each has its own leaf and proof. Null groups and null keys come first. A group with one row has its leaf for a subroot, a
dataset with one group the subroot for a root. An empty table has no leaves and a null root. Names of columns can't clash,
since rows are read into names of this module's own. The length of a text only matters to its digest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import materialize

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "array<struct<before: string, after: string>>"


@dataclass(frozen=True)
class Manifest:
    """``levels[k]`` holds the records (digest, children) of height k + 1 in groups, ``top`` likewise above the subroots."""

    leaves: DataFrame  # key, leaf, grp_no, place, and what else was carried
    groups: DataFrame  # grp_no, grp, n, height, subroot
    levels: list[DataFrame]
    top: list[DataFrame]
    n_groups: int
    root: str | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def digest_all(parts: Column) -> Column:
    return F.sha2(F.concat_ws("", parts), 256)


def leaf_digest(columns: Mapping[str, Column] | Sequence[str] = COLUMNS) -> Column:
    """Digest of a row: each column as ``-`` if null, else as its UTF-8 byte count, a colon and its value."""
    values = columns.values() if isinstance(columns, Mapping) else [F.col(f"`{c}`") for c in columns]
    text = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def height_of(n: Column) -> Column:
    """Levels above n leaves until one node remains: how many powers of FANOUT lie below n."""
    powers = [FANOUT**i for i in range(21)]
    return sum(((n > p).cast("int") for p in powers[1:]), (n > 1).cast("int"))


def _grow(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of every level over ``nodes`` (grp_no, n, place, digest), and the last node (grp_no, digest) of each group.

    ``n`` is how many nodes the group has on this level, so no level needs counting; a run has at most FANOUT rows.
    """
    levels, ends = [], nodes.where("n = 1").select("grp_no", "digest")
    while largest > 1:
        runs = nodes.where("n > 1").groupBy("grp_no", F.ceil(F.col("n") / FANOUT).alias("n"), F.floor(F.col("place") / FANOUT).alias("place"))
        grown = runs.agg(F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"].alias("children"))
        grown = materialize(grown.withColumn("digest", digest_all(F.col("children"))), f"merkle-level-{len(levels) + 1}")
        levels.append(grown.select("digest", "children").dropDuplicates(["digest"]))
        nodes = grown.select("grp_no", "n", "place", "digest")
        ends = ends.unionByName(nodes.where("n = 1").select("grp_no", "digest"))
        largest = -(-largest // FANOUT)
    return levels, ends


def build_manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS, carry: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` adds columns worked out from a row to its leaf.

    Texts are read once. What is sorted has a digest and a key per row; rows equal in all of it are told apart by their
    place in the scan, so that no range is larger than the others.
    """
    carried = dict(carry or {})
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("grp"), leaf_digest(columns).alias("leaf"), *[c.alias(name) for name, c in carried.items()]
    )
    rows = materialize(rows.withColumn("scan", F.monotonically_increasing_id()), "merkle-leaf")
    ranked = global_rank(rows, [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.col("leaf"), F.col("scan")], "position").drop("scan")
    sizes = materialize(ranked.groupBy("grp").agg(F.min("position").alias("start"), F.count("*").alias("n")), "merkle-sizes")
    n_groups, largest = sizes.agg(F.count("*"), F.max("n")).first()
    groups = global_rank(sizes, [F.col("start")], "grp_no").withColumn("grp_no", F.col("grp_no") - 1)
    groups = materialize(groups.withColumn("height", height_of(F.col("n"))), "merkle-groups")
    start = groups.select(F.col("grp").alias("g"), "start", "n", "grp_no")
    leaves = ranked.join(start, F.col("grp").eqNullSafe(F.col("g"))).select(
        "key", "leaf", "grp_no", (F.col("position") - F.col("start")).alias("place"), "n", *carried
    )
    leaves = materialize(leaves, "merkle-leaves")
    levels, ends = _grow(leaves.select("grp_no", "n", "place", F.col("leaf").alias("digest")), largest or 0)
    groups = materialize(groups.join(ends.withColumnRenamed("digest", "subroot"), "grp_no").select("grp_no", "grp", "n", "height", "subroot"), "merkle-subroots")
    above = groups.select(F.lit(0).cast("long").alias("grp_no"), F.lit(n_groups).cast("long").alias("n"), F.col("grp_no").alias("place"), F.col("subroot").alias("digest"))
    top, last = _grow(above, n_groups)
    found = last.select("digest").first()
    return Manifest(leaves.drop("n"), groups, levels, top, n_groups, found[0] if found else None)


def _unselected(children: str, digit: Column) -> Column:
    """The children on either side of the selected one, as one segment of a path."""
    c = F.col(children)
    return F.struct(
        F.concat_ws("", F.slice(c, F.lit(1), digit.cast("int"))).alias("before"),
        F.concat_ws("", F.slice(c, (digit + 2).cast("int"), F.lit(FANOUT))).alias("after"),
    )


def _descend(frontier: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One level down: frontier rows (grp_no, prefix, digest, path, ...) become those of their wanted children (grp_no, prefix)."""
    rest = [c for c in frontier.columns if c not in ("prefix", "digest", "path")]
    opened = frontier.join(records, "digest").select(*rest, "prefix", "path", "children", F.posexplode("children").alias("digit", "child"))
    stepped = opened.select(
        *rest, (F.col("prefix") * FANOUT + F.col("digit")).alias("prefix"), F.col("child").alias("digest"),
        F.concat("path", F.array(_unselected("children", F.col("digit")))).alias("path"),
    )
    return stepped.join(wanted, ["grp_no", "prefix"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Each request (grp_no, place, ...) with its ``subroot`` and ``proof``, the segments from the leaf up to the root.

    ``requests`` defaults to all leaves. Places that don't exist have no row in the result.
    """
    requests = manifest.leaves if requests is None else requests
    lowest = F.floor(F.col("place") / FANOUT)
    depth = len(manifest.levels)
    groups = manifest.groups.select("grp_no", "height", "subroot")

    # Prefixes of the places asked for, from the lowest nodes up: node k levels above the leaves.
    prefixes = {1: requests.select("grp_no", lowest.alias("prefix")).distinct()}
    if depth > 1:
        prefixes[1] = materialize(prefixes[1], "merkle-wanted")
    for k in range(2, depth + 1):
        prefixes[k] = materialize(prefixes[k - 1].select("grp_no", F.floor(F.col("prefix") / FANOUT).alias("prefix")).distinct(), "merkle-wanted")

    # From the root to the subroots asked for: one tree, whose places are the groups' numbers.
    asked = prefixes[max(depth, 1)].select(F.col("grp_no").alias("prefix")).distinct()
    frontier = manifest.leaves.sparkSession.createDataFrame([(0, 0, manifest.root)] if manifest.root else [], "grp_no long, prefix long, digest string")
    frontier = frontier.withColumn("path", F.array().cast(SEGMENT))
    for k in range(len(manifest.top) - 1, -1, -1):
        reached = asked.select(F.lit(0).cast("long").alias("grp_no"), F.floor(F.col("prefix") / FANOUT**k).alias("prefix")).distinct()
        frontier = _descend(frontier, manifest.top[k], reached)
    starts = frontier.select(F.col("prefix").alias("grp_no"), "path").join(groups, "grp_no")
    starts = starts.select("grp_no", F.lit(0).cast("long").alias("prefix"), F.col("subroot").alias("digest"), "path", "height", "subroot")
    starts = materialize(starts, "merkle-subpaths")

    # From the subroots to the lowest nodes; a lower tree joins in at its own level.
    frontier = starts.where(F.col("height") == depth)
    for k in range(depth, 1, -1):
        frontier = _descend(frontier, manifest.levels[k - 1], prefixes[k - 1]).unionByName(starts.where(F.col("height") == k - 1))

    nodes = starts.where("height = 0").withColumn("children", F.array("digest"))
    if depth:
        nodes = nodes.unionByName(frontier.join(manifest.levels[0], "digest"))
    nodes = nodes.select("grp_no", F.col("prefix").alias("node"), "path", "children", "height", "subroot")
    here = F.pmod(F.col("place"), F.lit(FANOUT))
    met = requests.withColumn("node", lowest).join(nodes, ["grp_no", "node"]).where(here < F.size("children"))
    whole = F.when(F.col("height") > 0, F.concat("path", F.array(_unselected("children", here)))).otherwise(F.col("path"))
    return met.select(*requests.columns, "subroot", F.reverse(whole).alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to along a proof."""
    return F.aggregate(proof, leaf, lambda at, s: digest(s["before"], at, s["after"]))


def proof_digest(proof: Column) -> Column:
    return digest_all(F.transform(proof, lambda s: F.concat(s["before"], s["after"])))


def verify(manifest: Manifest, claims: DataFrame, claim: str = "claim") -> DataFrame:
    """Claimed digests (grp_no, place, claim, ...) with ``folded_root`` and whether that is the manifest's root."""
    proved = prove(manifest, claims).withColumn("folded_root", fold(F.col(claim), F.col("proof")))
    return proved.withColumn("verified", F.col("folded_root").eqNullSafe(F.lit(manifest.root)))
