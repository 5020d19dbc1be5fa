"""Tables stored by a key, so that a search moves its frontier and never the table it searches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import buckets, by_shuffle, is_empty, materialize, materialize_bucketed, read_bucketed, scratch_path, write_bucketed

#: Rows that one key, or one part of a hot key, holds at most.
PART_ROWS = 100_000

#: The column of a level that says which part of the seeds a row packs.
SEED_PART = "seed_part"


@dataclass(frozen=True)
class KeyedTable:
    """``cold`` holds the rows of most keys, bucketed by key. Keys with more than PART_ROWS rows are in ``hot``, bucketed by
    key and part, and their number of parts in ``parts``, which has a row for each hot key only."""

    key: list[str]
    cold: DataFrame
    hot: DataFrame
    parts: DataFrame
    n_buckets: int
    has_hot: bool

    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot.drop("part")) if self.has_hot else self.cold

    def grouped(self, *aggregates) -> DataFrame:
        """One row per key; cold keys need no exchange."""
        cold = self.cold.groupBy(*self.key).agg(*aggregates)
        return cold.unionByName(self.hot.groupBy(*self.key).agg(*aggregates)) if self.has_hot else cold

    def meet(self, frontier: DataFrame) -> DataFrame:
        """Join a frontier to the rows of its keys. A frontier dealt by key stays where it is.

        Only its rows at hot keys are dealt anew, one for each part.
        """
        near = frontier.join(self.cold, self.key)
        if not self.has_hot:
            return near
        salted = frontier.join(self.parts, self.key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")
        return near.unionByName(salted.join(self.hot, [*self.key, "part"]).drop("part"))

    def known(self, frontier: DataFrame) -> DataFrame:
        """The rows of a frontier whose key the table has."""
        near = frontier.join(self.cold, self.key, "left_semi")
        return near.unionByName(frontier.join(self.parts, self.key, "left_semi")) if self.has_hot else near


def store_keyed(
    rows: DataFrame, key: Sequence[str], spread_by: str, path: str | None = None, part_rows: int | None = PART_ROWS, counted: DataFrame | None = None,
    group: Callable[..., DataFrame] | None = None,
) -> KeyedTable:
    """Store ``rows`` by ``key`` in ``path``, or in a folder of the session; a hot key's rows are dealt by ``spread_by``.

    Hot keys are found ahead, so that no task ever writes one whole: in ``counted`` if that holds at least the rows of every
    key and is cheaper to read. Without ``part_rows`` keys are known to be small, and nothing is counted.

    ``group(dealt, *more)`` makes the stored rows from ``rows`` where these lie after they are dealt, by groups that hold the key,
    ``spread_by`` and the columns ``more``. So rows that are grouped before they are stored move once.
    """
    spark, key = rows.sparkSession, list(key)
    grouped = group or (lambda dealt, *more: dealt)
    schema = grouped(rows).schema
    folder, n = path or scratch_path(spark, "keyed"), buckets(spark)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    parts, hot, has_hot = spark.createDataFrame([], f"{kinds}, n_parts int"), None, False
    if part_rows is not None:
        counts = (rows if counted is None else counted).groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > part_rows)
        parts = materialize(counts.select(*key, F.ceil(F.col("rows") / part_rows).cast("int").alias("n_parts")), "hot-keys")
        has_hot = not is_empty(parts)
    if path:
        parts.write.parquet(f"{path}/parts")
    whole = rows
    if has_hot:
        part = F.pmod(F.xxhash64(spread_by), F.col("n_parts")).cast("int").alias("part")
        dealt = rows.join(parts, key).select(*rows.columns, part).repartition(n, *key, "part")
        hot = write_bucketed(grouped(dealt, "part").select(*schema.names, "part"), f"{folder}/hot", [*key, "part"], n, dealt=True)
        whole = rows.join(parts, key, "left_anti")
    cold = write_bucketed(grouped(whole.repartition(n, *key)), f"{folder}/cold", key, n, dealt=True)
    if path:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        layout = spark.createDataFrame([(",".join(key), n, has_hot, columns)], "key string, n_buckets int, has_hot boolean, columns string")
        layout.coalesce(1).write.parquet(f"{path}/layout")
    return KeyedTable(key, cold, hot if has_hot else cold.withColumn("part", F.lit(0)).limit(0), parts, n, has_hot)


def load_keyed(spark: SparkSession, path: str) -> KeyedTable:
    key, n, has_hot, columns = spark.read.parquet(f"{path}/layout").first()
    key = key.split(",")
    cold = read_bucketed(spark, f"{path}/cold", columns, key, n)
    hot = read_bucketed(spark, f"{path}/hot", f"{columns}, part int", [*key, "part"], n) if has_hot else cold.withColumn("part", F.lit(0)).limit(0)
    kinds = ", ".join(f"`{k}` {cold.schema[k].dataType.simpleString()}" for k in key)
    return KeyedTable(key, cold, hot, spark.read.schema(f"{kinds}, n_parts int").parquet(f"{path}/parts"), n, has_hot)


def pack(rows: DataFrame, key: Sequence[str], item: str, name: str) -> DataFrame:
    """One row per key with the set of its items. Sets are united ahead of the exchange, so a task sends a key once."""
    return rows.groupBy(*key).agg(F.collect_set(item).alias(name))


def take_off(arrived: DataFrame, old: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Remove from each key's set what ``old`` has there; both sides lie by key, so nothing moves."""
    known = old.select(*key, F.col(name).alias("_old"))
    rest = F.when(F.col("_old").isNull(), F.col(name)).otherwise(F.array_except(name, "_old"))
    return arrived.join(known, list(key), "left").select(*key, rest.alias(name))


def seed_sets(seeds: DataFrame, hop_depth: int, size: int) -> tuple[list[DataFrame], int]:
    """The tables of seeds (seed, depth) that are searched one after the other, here one, and the largest depth.

    More than ``size`` seeds get a column ``part`` with about ``size`` seeds to a value, which bounds what is packed into one
    row. All parts go together, so a stored table is met once a level however many seeds there are.
    ``depth`` is the seed's own ``hop_depth`` where there is a column with a value, else the call's.
    """
    own = "hop_depth" in seeds.columns
    asked = seeds.select("seed", (F.coalesce("hop_depth", F.lit(hop_depth)) if own else F.lit(hop_depth)).alias("depth"))
    asked = materialize(asked.groupBy("seed").agg(F.max("depth").alias("depth"), F.min("depth").alias("least")), "seeds")
    n, least, deepest = asked.agg(F.count("*"), F.min("least"), F.max("depth")).first()
    if (least if n else hop_depth) < 1:
        raise ValueError(f"hop_depth must be at least 1, got {least if n else hop_depth}")
    asked, sets = asked.select("seed", "depth"), max(1, -(-n // size))
    return [asked if sets == 1 else asked.withColumn(SEED_PART, F.pmod(F.xxhash64("seed"), F.lit(sets)).cast("int"))], deepest or 0


def level_key(level: DataFrame, node: str) -> list[str]:
    """What tells the rows of a level apart: the node, and the part of the seeds if these come in parts."""
    return [node, SEED_PART] if SEED_PART in level.columns else [node]


def store_level(level: DataFrame, name: str, node: str, n_buckets: int) -> DataFrame:
    """Store a level by node. Without parts it lies that way after its group and is written without another exchange.

    Parts mean many seeds: joins with such a level deal it out, as packed seeds take far more memory than their files tell.
    """
    in_parts = SEED_PART in level.columns
    stored = materialize_bucketed(level, name, [node], n_buckets, dealt=not in_parts)
    return by_shuffle(stored) if in_parts else stored


def start_level(seeds: DataFrame, node: str, n_buckets: int) -> DataFrame:
    """The first level of a search: each seed at the node of its name."""
    first = seeds.select(F.col("seed").alias(node), *level_key(seeds, node)[1:], F.array(F.struct("seed", "depth")).alias("seeds"))
    return store_level(first.repartition(n_buckets, node), "level", node, n_buckets)


def still_going(level: DataFrame, hop: int) -> DataFrame:
    """A level with the seeds that go further than ``hop``."""
    return level.withColumn("seeds", F.filter("seeds", lambda s: s["depth"] > hop)).where("size(seeds) > 0")
