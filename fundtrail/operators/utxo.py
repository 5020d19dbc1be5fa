"""UTXO records: validation, address activity, co-spend and change clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import STEP_SECONDS, TIER_LIVE_UTXO
from ..session import materialize
from .components import connected_components
from .ranking import global_rank, top_per_key

# Flat form used everywhere below: one row per input or output of a transaction,
# (tx_hash, side 'in'/'out', ordinal, address or null, amount_sats, block_time, block_height).


def tx_time_step(block_time: Column) -> Column:
    return F.when(block_time > 0, F.floor(block_time / STEP_SECONDS)).otherwise(F.lit(-1)).cast("long")


def flatten_transactions(txs: DataFrame) -> DataFrame:
    """Transactions with ``inputs`` and ``outputs`` lists -> the flat form."""
    keys = [c for c in ("tx_hash", "timestamp", "block_height") if c in txs.columns]
    item = lambda tag: lambda x, i: F.struct(
        F.lit(tag).alias("side"), i.alias("ordinal"), x["address"].alias("address"), x["amount_sats"].alias("amount_sats")
    )
    items = F.concat(F.transform("inputs", item("in")), F.transform("outputs", item("out")))
    return txs.select(*keys, F.explode(items).alias("item")).select(*keys, "item.*")


def with_address(io: DataFrame) -> DataFrame:
    """Drop coinbase inputs and data-only outputs, which carry no address."""
    return io.where(F.col("address").isNotNull() & (F.col("address") != ""))


def address_records(io: DataFrame, source: str) -> DataFrame:
    """One record per paying or receiving side: an output is 'in' for its address, an input 'out'."""
    return with_address(io).where("amount_sats > 0").select(
        "tx_hash", "address", F.col("block_time").alias("timestamp"), "amount_sats",
        F.when(F.col("side") == "out", "in").otherwise("out").alias("direction"),
        F.lit(source).alias("source"), "block_height",
    )


def dedupe_txs(refs: DataFrame) -> DataFrame:
    """One reference per (address, tx_hash): the first by ``ordinal``."""
    return refs.groupBy("address", "tx_hash").agg(F.min("ordinal").alias("ordinal"))


def dedupe_io(io: DataFrame) -> DataFrame:
    """Each input and output once, however often its transaction was landed; the confirmed copy counts.

    Comes ahead of every count over ``io``. The place within its side identifies a row.
    """
    rest = [c for c in io.columns if c not in ("tx_hash", "side", "ordinal")]
    newest = F.max(F.struct(F.coalesce("block_time", F.lit(0)).alias("_t"), *rest)).alias("r")
    return io.groupBy("tx_hash", "side", "ordinal").agg(newest).select("tx_hash", "side", "ordinal", *[f"r.{c}" for c in rest]).select(*io.columns)


def all_tx_refs(confirmed: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """Confirmed references first, then unconfirmed ones."""
    return confirmed.withColumn("pending", F.lit(0)).unionByName(unconfirmed.withColumn("pending", F.lit(1)))


def tx_addresses(io: DataFrame) -> DataFrame:
    return with_address(io).select("tx_hash", "address").distinct()


def address_transactions(io: DataFrame) -> DataFrame:
    """(address, tx_hash, block_time) once per pair."""
    return with_address(io).groupBy("address", "tx_hash").agg(F.max("block_time").alias("block_time"))


def newest_txs_per_address(addr_txs: DataFrame, cap: int) -> DataFrame:
    return top_per_key(addr_txs, ["address"], [F.col("block_time").desc_nulls_last(), F.col("tx_hash")], cap)


def address_frequency(io: DataFrame) -> DataFrame:
    return with_address(io).groupBy("address").agg(F.count("*").alias("occurrences"))


def address_activity(addresses: DataFrame, io: DataFrame) -> DataFrame:
    """Number of transactions per address of interest; 0 means no on-chain history."""
    counts = address_transactions(io).groupBy("address").agg(F.count("*").alias("tx_count"))
    return addresses.select("address").distinct().join(counts, "address", "left").select(
        "address", F.coalesce("tx_count", F.lit(0)).alias("tx_count"), F.col("tx_count").isNotNull().alias("has_history")
    )


def change_outputs(io: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(tx_hash, change_address): the one output address of a several-output transaction that
    occurs nowhere else. Occurrences are counted per address, so only addresses seen exactly
    once reach the per-transaction step. With ``scope`` columns everything holds within each value of them;
    a ``rows`` column says how many inputs or outputs a row stands for."""
    rows = with_address(io)
    n = F.col("rows") if "rows" in io.columns else F.lit(1)
    once = rows.groupBy(*scope, "address").agg(
        F.sum(n).alias("n"), F.min("side").alias("side"), F.min("tx_hash").alias("tx_hash")
    ).where("n = 1 and side = 'out'")
    sole = once.groupBy(*scope, "tx_hash").agg(F.count("*").alias("n_new"), F.min("address").alias("change_address")).where("n_new = 1")
    shape = rows.groupBy(*scope, "tx_hash").agg(F.sum(F.when(F.col("side") == "out", n).otherwise(0)).alias("n_out"))
    return sole.join(shape.where("n_out >= 2"), [*scope, "tx_hash"]).select(*scope, "tx_hash", "change_address")


def change_address_links(io: DataFrame) -> DataFrame:
    """(tx_hash, address, change_address) from every input address to the change address."""
    inputs = with_address(io).where("side = 'in'").select("tx_hash", "address").distinct()
    return inputs.join(change_outputs(io), "tx_hash").select("tx_hash", "address", "change_address")


def ownership_links(io: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A star per transaction: smallest input address to its other inputs and to its change."""
    inputs = with_address(io).where("side = 'in'").select(*scope, "tx_hash", "address")
    first = inputs.groupBy(*scope, "tx_hash").agg(F.min("address").alias("src"))
    owned = inputs.unionByName(change_outputs(io, scope).withColumnRenamed("change_address", "address"))
    return owned.join(first, [*scope, "tx_hash"]).where("address <> src").select(*scope, "src", F.col("address").alias("dst"))


def utxo_components(io: DataFrame) -> DataFrame:
    """(address, cluster) over co-spend and change links, addresses without links included.

    Transactions landed more than once count once, where rows have the ``ordinal`` that tells their places apart.
    """
    if "ordinal" in io.columns:
        # The columns up to the address decide which copy counts, and the rest of a row is not needed.
        ahead = [c for c in io.columns[: io.columns.index("address")] if c not in ("tx_hash", "side", "ordinal")]
        places = io.select("tx_hash", "side", "ordinal", *ahead, "address", *({"block_time"} - {*ahead}))
        io = materialize(dedupe_io(places).select("tx_hash", "side", "address"), "io-once")
    nodes = with_address(io).select(F.col("address").alias("node")).distinct()
    return connected_components(nodes, ownership_links(io)).toDF("address", "cluster")


#: Parts a case and an address within one name; neither has the character.
JOINT = "\0"


def case_components(case_rows: DataFrame) -> DataFrame:
    """(seed, address, occurrences, cluster) of all cases at once, over ``case_rows`` (seed, tx_hash, side, address, rows).

    An address counts, and links, within each case on its own: nodes are pairs of a case and an address, so cases that share
    addresses can't join. A cluster is named after its smallest address.
    """
    node = lambda c: F.concat_ws(JOINT, F.col("seed").cast("string"), F.col(c))
    case_rows = materialize(case_rows, "case-rows")  # counts, links and change read them seven times
    seen = with_address(case_rows).groupBy("seed", "address").agg(F.sum("rows").alias("occurrences"))
    seen = materialize(seen.withColumn("node", node("address")), "case-addresses")
    links = ownership_links(case_rows, ["seed"]).select(node("src").alias("src"), node("dst").alias("dst"))
    found = connected_components(seen.select("node"), links)
    return seen.join(found, "node").select("seed", "address", "occurrences", F.element_at(F.split("component", JOINT), -1).alias("cluster"))


def case_clusters(components: DataFrame, sample: int) -> DataFrame:
    """Each case's clusters, numbered within the case by name, with size, occurrences and a bounded member sample.

    Numbers come from one ranking of all clusters less the rank of the case's first, so a case of any size is spread out.
    """
    sizes = components.groupBy("seed", "cluster").agg(F.count("*").alias("n_wallets"), F.sum("occurrences").alias("occurrences"))
    ranked = global_rank(sizes, [F.col("seed"), F.col("cluster")], "place")
    first = ranked.groupBy("seed").agg(F.min("place").alias("first"))
    members = top_per_key(components.select("seed", "cluster", "address"), ["seed", "cluster"], [F.col("address")], sample).groupBy("seed", "cluster").agg(
        F.sort_array(F.collect_list("address")).alias("members_sample")
    )
    return ranked.join(first, "seed").join(members, ["seed", "cluster"]).select(
        "seed", F.concat(F.lit("live_cluster_"), F.col("place") - F.col("first") + 1).alias("cluster_id"),
        F.lit(TIER_LIVE_UTXO).alias("confidence_tier"), "cluster", "n_wallets", "occurrences", "members_sample",
        F.greatest(F.col("n_wallets") - sample, F.lit(0)).alias("n_members_truncated"),
    )


def utxo_clusters(components: DataFrame, sample: int) -> DataFrame:
    """Numbered clusters with size and a bounded member sample."""
    sizes = components.groupBy("cluster").agg(F.count("*").alias("n_wallets"))
    numbered = global_rank(sizes, [F.col("cluster")], "number")
    members = top_per_key(components, ["cluster"], [F.col("address")], sample).groupBy("cluster").agg(
        F.sort_array(F.collect_list("address")).alias("members_sample")
    )
    return numbered.join(members, "cluster").select(
        F.concat(F.lit("live_cluster_"), "number").alias("cluster_id"),
        F.lit(TIER_LIVE_UTXO).alias("confidence_tier"),
        "n_wallets", "members_sample",
        F.greatest(F.col("n_wallets") - sample, F.lit(0)).alias("n_members_truncated"),
    )
