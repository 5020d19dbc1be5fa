"""The watch list: wallets with a verdict other than none, added once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

WATCH_SCHEMA = "address string, verdict string"


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """The list as it is now; one that was never written is empty."""
    reader = spark.read.schema(WATCH_SCHEMA)
    return reader.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], WATCH_SCHEMA)


def new_watch_items(verdicts: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Flagged wallets not on the list yet; addresses are compared without regard to case."""
    listed = watchlist.select(F.lower("address").alias("_key")).distinct()
    flagged = verdicts.where("verdict <> 'none'").withColumn("_key", F.lower("address"))
    once = flagged.groupBy("_key").agg(F.min(F.struct("address", "verdict")).alias("w"))
    return once.join(listed, "_key", "left_anti").select("w.address", "w.verdict")


def watchlist_insert(verdicts: DataFrame, watchlist: DataFrame) -> DataFrame:
    return watchlist.select("address", "verdict").unionByName(new_watch_items(verdicts, watchlist))


def stream_watchlist(verdicts: DataFrame, path: str, checkpoint: str, trigger: dict):
    """Feed a stream of (address, verdict) into the watch-list table at ``path``.

    The table is read afresh in each batch, so a repeated batch adds nothing twice, and need not exist at the start.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        new_watch_items(batch, read_watchlist(batch.sparkSession, path)).write.mode("append").parquet(path)

    return verdicts.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**trigger).start()
