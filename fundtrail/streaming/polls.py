"""Watch-list polling: landed poll envelopes to alerts and per-address alert state.

The functions taking a ``polls`` table work on batch and streaming tables alike, except where
the name says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import fee_rate, sats_to_btc, sats_to_inr
from ..operators.ranking import running_last
from ..session import materialize, path_exists, remove_path
from .watchlist import read_watchlist

COMPACT_EVERY = 100

# Fixed format: one poll of one address.
POLL_SCHEMA = """
    poll_id bigint, address string, poll_ts bigint, success boolean, reason string,
    txs array<struct<
        txid: string, fee: bigint, weight: bigint,
        vin: array<struct<prevout: struct<scriptpubkey_address: string, value: bigint>>>,
        vout: array<struct<scriptpubkey_address: string, value: bigint>>>>
"""


def stream_polls(spark: SparkSession, landing_dir: str, max_files: int = 1000) -> DataFrame:
    """Poll envelopes as they are landed by any fetcher."""
    return spark.readStream.schema(POLL_SCHEMA).option("maxFilesPerTrigger", max_files).json(landing_dir)


def watched_polls(polls: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Polls of listed addresses; polls of removed addresses fall away."""
    return polls.join(watchlist.select("address").distinct(), "address")


def _sum_own(items: Column, own) -> Column:
    return F.aggregate(F.filter(items, own), F.lit(0).cast("long"), lambda s, i: s + _value(i))


def _value(item: Column) -> Column:
    return F.coalesce(item["value"], F.lit(0).cast("long"))


def alert_of(tx: Column, address: Column, case_insensitive: bool = False) -> Column:
    """The alert one transaction raises for an address, or null when it does not touch it.

    An address on the output side makes it incoming, whatever the inputs; the amount adds the
    address's share of both sides. Base58 addresses differ by case, so the comparison is exact
    unless asked otherwise.
    """
    norm = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    me = norm(address)
    own_out = lambda o: F.coalesce(norm(o["scriptpubkey_address"]) == me, F.lit(False))
    own_in = lambda i: F.coalesce(norm(i["prevout"]["scriptpubkey_address"]) == me, F.lit(False))
    incoming = F.exists(tx["vout"], own_out)
    outgoing = F.exists(tx["vin"], own_in)
    own_inputs = F.transform(F.filter(tx["vin"], own_in), lambda i: i["prevout"])
    sats = _sum_own(tx["vout"], own_out) + F.aggregate(own_inputs, F.lit(0).cast("long"), lambda s, i: s + _value(i))
    sender = F.get(tx["vin"], F.lit(0))["prevout"]["scriptpubkey_address"]
    receiver = F.get(F.filter(tx["vout"], lambda o: ~own_out(o)), F.lit(0))["scriptpubkey_address"]
    return F.when(
        incoming | outgoing,
        F.struct(
            tx["txid"].alias("tx_hash"),
            F.when(incoming, "incoming").otherwise("outgoing").alias("direction"),
            sats_to_btc(sats).alias("amount_btc"),
            sats_to_inr(sats).alias("amount_inr"),
            fee_rate(tx["fee"], tx["weight"]).alias("fee_rate"),
            F.coalesce(F.when(incoming, sender).otherwise(receiver), F.lit("Unknown")).alias("counterparty"),
        ),
    )


def read_polls(polls: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Outcome of each poll: ok, number of transactions, failure reason and first alert.

    An unreadable body counts as a failure, and a failure without a reason as an api error;
    an empty answer and a failed poll never look alike.
    """
    ok = F.coalesce(F.col("success"), F.col("txs").isNotNull())
    alerts = F.filter(
        F.transform("txs", lambda t: alert_of(t, F.col("address"), case_insensitive)), lambda a: a.isNotNull()
    )
    return polls.select(
        "poll_id", "address", "poll_ts",
        ok.alias("ok"),
        F.when(~ok, F.coalesce("reason", F.lit("api-error"))).alias("reason"),
        F.when(ok, F.greatest(F.size("txs"), F.lit(0))).alias("n_txs"),
        F.when(ok, F.get(alerts, F.lit(0))).alias("alert"),
    )


def mempool_alerts(outcomes: DataFrame) -> DataFrame:
    """One row per poll that raises an alert."""
    return outcomes.where(F.col("alert").isNotNull()).select("poll_id", "address", "poll_ts", "alert.*")


def _changes_alert() -> Column:
    """Successful polls that settle the alert: empty ones clear it, relevant ones replace it."""
    return F.col("ok") & ((F.col("n_txs") <= 0) | F.col("alert").isNotNull())


def state_parts(outcomes: DataFrame) -> DataFrame:
    """What some polls say about each address: the newest settling poll and its alert, the newest success, the newest poll.

    Parts of any polls add up to the state after all of them, in any order and however often: see :func:`merge_states`.
    """
    at, settles = F.struct("poll_ts", "poll_id"), _changes_alert()
    return outcomes.groupBy("address").agg(
        F.max(F.when(settles, at)).alias("settled_at"),
        F.max_by("alert", F.when(settles, at)).alias("alert"),
        F.max(F.when(F.col("ok"), F.col("poll_ts"))).alias("last_ok_ts"),
        F.max(at).alias("newest_at"),
        F.max_by(F.struct("reason"), at)["reason"].alias("reason"),
    )


def merge_states(parts: DataFrame) -> DataFrame:
    return parts.groupBy("address").agg(
        F.max("settled_at").alias("settled_at"),
        F.max_by("alert", "settled_at").alias("alert"),
        F.max("last_ok_ts").alias("last_ok_ts"),
        F.max("newest_at").alias("newest_at"),
        F.max_by(F.struct("reason"), "newest_at")["reason"].alias("reason"),
    )


def alert_state(outcomes: DataFrame) -> DataFrame:
    """Current state per address.

    The newest settling poll decides the alert, the newest success the freshness and the
    newest poll the error. Order of arrival does not matter.
    """
    return shown_state(state_parts(outcomes))


def shown_state(state: DataFrame) -> DataFrame:
    return state.select("address", "alert", "last_ok_ts", "reason", F.col("newest_at.poll_ts").alias("last_poll_ts"))


def alert_history(outcomes: DataFrame, bucket: Column) -> DataFrame:
    """State of each address as of every poll (batch). ``bucket`` splits long histories in time."""
    settled = F.when(_changes_alert(), F.struct("alert"))
    rows = outcomes.select(
        "poll_id", "address", "poll_ts", "ok", "reason",
        settled.alias("settled"), F.when(F.col("ok"), F.col("poll_ts")).alias("last_ok_ts"),
    )
    filled = running_last(rows, ["address"], bucket, ["poll_ts", "poll_id"], ["settled", "last_ok_ts"])
    return filled.select("poll_id", "address", "poll_ts", F.col("settled.alert").alias("alert"), "reason", "last_ok_ts")


def stream_alert_state(polls: DataFrame, sink: str, checkpoint: str, trigger: dict, compact_every: int = COMPACT_EVERY, watchlist: str | None = None):
    """Start the monitoring query.

    The stream itself holds no state. Each batch writes what its polls say about their addresses under its own folder, so a
    repeated batch replaces itself, and late polls add up like any others. Every ``compact_every`` batches the folders
    become one with one row per address.

    With a ``watchlist`` only polls of wallets that are on the list at the time count, and a wallet that has left it loses its
    state with the next compaction; back on the list it starts anew. Without one every polled address is kept.
    """
    outcomes = read_polls(polls)

    def listed(rows: DataFrame) -> DataFrame:
        return rows if watchlist is None else rows.join(read_watchlist(rows.sparkSession, watchlist).select("address").distinct(), "address", "left_semi")

    def write(batch: DataFrame, n: int) -> None:
        store_batch(state_parts(listed(batch)), sink, n, compact_every, lambda rows: listed(merge_states(rows)))

    return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def store_batch(rows: DataFrame, sink: str, n: int, compact_every: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Write the rows of batch ``n`` to its folder; every ``compact_every`` batches merge the folders before it into this one.

    The merged rows are written elsewhere first and the older folders go last, so at any time readers find every row at least once;
    ``merge`` must not mind finding one twice.
    """
    spark = rows.sparkSession
    older = [] if n == 0 or n % compact_every else [p for p in batch_folders(spark, sink) if p[0] <= n]
    if older:
        known = spark.read.schema(rows.schema).option("basePath", sink).parquet(*[p for _, p in older])
        rows = materialize(merge(rows.unionByName(known.select(*rows.columns))), "batches")
    rows.write.mode("overwrite").parquet(f"{sink}/batch={n}")
    for m, path in older:
        if m < n:
            remove_path(spark, path)


def batch_folders(spark: SparkSession, sink: str) -> list[tuple[int, str]]:
    """Number and path of the batch folders; at most ``compact_every`` of them between two compactions."""
    if not path_exists(spark, sink):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    paths = [s.getPath() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    named = [(p.getName(), p.toString()) for p in paths]
    return sorted((int(name.removeprefix("batch=")), path) for name, path in named if name.startswith("batch="))


def read_alert_state(spark: SparkSession, sink: str, watchlist: str) -> DataFrame:
    """The state of every address that is on the list now, from the batches written so far."""
    rows = spark.read.parquet(sink).drop("batch")
    return shown_state(merge_states(rows.join(read_watchlist(spark, watchlist).select("address"), "address", "left_semi")))


def stream_alerts(polls: DataFrame, watchlist: str, sink: str, checkpoint: str, trigger: dict, compact_every: int = COMPACT_EVERY):
    """Start the alert feed: one row per poll with a relevant transaction of a wallet that is on the list at the time.

    Each batch has its own folder below ``sink``; a repeated batch replaces itself. Every ``compact_every`` batches the folders become one.
    """
    alerts = mempool_alerts(read_polls(polls))

    def write(batch: DataFrame, n: int) -> None:
        found = watched_polls(batch, read_watchlist(batch.sparkSession, watchlist))
        store_batch(found, sink, n, compact_every, lambda rows: rows.dropDuplicates(["poll_id", "address"]))

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
