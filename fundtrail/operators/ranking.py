"""Ordering helpers that keep a hot key, or a whole table, from being sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import buckets, materialize, materialize_bucketed


#: Bits of a row's place within its partition, as monotonically_increasing_id has them.
PLACE_BITS = 33


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based rank over the whole table with one range exchange.

    Rows are range partitioned, sorted and numbered in the write itself, so a row knows its range and its place
    there. Ranks add the rows of the ranges before, a table with one row per range, which bounds the broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    which, place = F.shiftright("_place", PLACE_BITS), F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(which.alias("_range")).agg(F.max(place).alias("_last"))
    offsets = offsets.select("_range", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_range", which)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, place + F.col("_offset") + 1)
        .drop("_range", "_offset", "_place")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. The limit is applied before the exchange, so a hot key
    sends at most ``n`` rows per map task."""
    return (
        df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )


def next_in_sequence(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, out: str, unique: bool = False
) -> DataFrame:
    """``lead(value)`` per key, worked out bucket by bucket; with ``unique``, equal rows count once.

    ``bucket`` must not decrease along ``order``. Each window group is one bucket of one
    key; the last row of a bucket takes the first value of the key's next bucket. Rows are dealt
    once, by key and bucket, and are made unique, stored and followed where they lie.
    """
    by, n = [*keys, "_bucket"], buckets(df.sparkSession)
    dealt = df.withColumn("_bucket", bucket).repartition(n, *by)
    rows = materialize_bucketed(dealt.distinct() if unique else dealt, "sequence", by, n, dealt=True)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    first = rows.groupBy(*keys, "_bucket").agg(
        F.min(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_first")
    )
    follow = first.select(
        *keys,
        "_bucket",
        F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_next"),
    )
    return (
        rows.withColumn("_lead", F.lead(value).over(inner))
        .join(follow, [*keys, "_bucket"])
        .withColumn(out, F.coalesce("_lead", "_next"))
        .drop("_bucket", "_lead", "_next")
    )


def running_last(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Replace each column of ``values`` by its last non-null value up to the row.

    The carry into a bucket comes from a table with one row per (key, bucket).
    """
    rows = materialize(df.withColumn("_bucket", bucket), "history")
    inner = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy(*keys, "_bucket").agg(
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_last_{v}")
            for v in values
        ]
    )
    carry = lasts.select(
        *keys,
        "_bucket",
        *[F.last(f"_last_{v}", ignorenulls=True).over(outer).alias(f"_carry_{v}") for v in values],
    )
    filled = rows.select(
        *[c for c in rows.columns if c not in values],
        *[F.last(v, ignorenulls=True).over(inner).alias(v) for v in values],
    )
    return filled.join(carry, [*keys, "_bucket"]).select(
        *[F.coalesce(c, f"_carry_{c}").alias(c) if c in values else F.col(c) for c in df.columns]
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row results side by side."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
