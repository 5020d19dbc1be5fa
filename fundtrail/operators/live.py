"""Tracing of addresses over landed transaction tables.

The flow graph of a case is kept as (seed, tx_hash, side, address) rows. Walking it goes from
an address to its transactions and on to the opposite side, so the work grows with the rows
of a transaction and never with the number of its input-output pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import Params
from ..session import is_empty, materialize, materialize_bucketed
from .chains import peel_chains_of
from .ranking import top_per_key
from .rules import score_rules
from .stored import (
    PART_ROWS, KeyedTable, level_key, load_keyed, pack, seed_sets, start_level, still_going, store_keyed, store_level, take_off,
)
from .utxo import newest_txs_per_address, tx_time_step, with_address

# Seeds that share a row, which bounds the set packed into it.
SEED_SET = 100_000


@dataclass(frozen=True)
class Expansion:
    fetched: DataFrame  # seed, address, level
    txs: DataFrame      # seed, level, address, block_time, tx_hash


@dataclass(frozen=True)
class TxIndex:
    """Landed transactions stored twice: the transactions of each address, and the inputs and outputs of each transaction.

    An address may have any number of transactions, and a hot one is split; a transaction's rows are bounded by the
    size of a block.
    """

    by_address: KeyedTable  # address, tx_hash, block_time
    by_tx: KeyedTable       # tx_hash, side, address, time_step, rows

    def flow_rows(self) -> DataFrame:
        return self.by_tx.rows()


def build_tx_index(io: DataFrame, path: str | None = None, part_rows: int = PART_ROWS) -> TxIndex:
    """Index the flat transactions in ``path``, or in a folder of the session: one exchange for each of the two tables.

    Both are grouped where their rows lie after it.
    """
    rows = with_address(io)
    sides = rows.select("tx_hash", "side", "address", tx_time_step(F.col("block_time")).alias("time_step"))
    txs = lambda dealt, *more: dealt.groupBy("address", "tx_hash", *more).agg(F.max("block_time").alias("block_time"))
    by_address = store_keyed(rows.select("address", "tx_hash", "block_time"), ["address"], "tx_hash", path and f"{path}/by_address", part_rows, group=txs)
    flows = lambda dealt, *more: dealt.groupBy("tx_hash", "side", "address", "time_step", *more).agg(F.count("*").alias("rows"))
    return TxIndex(by_address, store_keyed(sides, ["tx_hash"], "address", path and f"{path}/by_tx", None, group=flows))


def read_tx_index(spark: SparkSession, path: str) -> TxIndex:
    return TxIndex(load_keyed(spark, f"{path}/by_address"), load_keyed(spark, f"{path}/by_tx"))


def known_activity(addresses: DataFrame, index: TxIndex) -> DataFrame:
    """Number of transactions per address of interest; 0 means no on-chain history."""
    asked = addresses.select("address").distinct()
    counts = index.by_address.meet(asked).groupBy("address").agg(F.count("*").alias("tx_count"))
    return asked.join(counts, "address", "left").select(
        "address", F.coalesce("tx_count", F.lit(0)).alias("tx_count"), F.col("tx_count").isNotNull().alias("has_history")
    )


def own_transactions(seeds: DataFrame, index: TxIndex) -> DataFrame:
    """(seed, tx_hash, side, address, rows): inputs and outputs of the transactions that each seed itself is in."""
    mine = index.by_address.meet(seeds.select("seed", F.col("seed").alias("address")).distinct()).select("seed", "tx_hash")
    return index.by_tx.meet(mine).select("seed", "tx_hash", "side", "address", "rows")


def bounded_expansion(seeds: DataFrame, index: TxIndex, hop_depth: int, params: Params = Params()) -> Expansion:
    """Look up each seed address, then all its counterparties, level by level.

    Whole by default. The caps of a tracer that pays per lookup can be set in ``params``: an address then brings
    its ``tx_cap`` newest transactions and a seed the first ``fetch_cap`` addresses in order; :func:`expansion_meta`
    reports a cap that was reached. A ``hop_depth`` column on the seeds replaces ``hop_depth`` for each seed that has a value.

    All seeds go together, an address's seeds packed in one row. A level meets the two stored tables where they lie and
    deals out one row per transaction and one per address; an address of a level can only have been met in that level or
    the one before it. Above SEED_SET seeds, an address has a row for each part of the seeds.
    """
    if params.tx_cap is not None or params.fetch_cap is not None:
        return _capped_expansion(seeds, index, hop_depth, params)
    sets, deepest = seed_sets(seeds, hop_depth, SEED_SET)
    found = [_expansion(mine, index, deepest) for mine in sets]
    return Expansion(reduce(DataFrame.unionByName, [f for f, _ in found]), reduce(DataFrame.unionByName, [t for _, t in found]))


def expansion_step(index: TxIndex, level: DataFrame, before: DataFrame | None, hop: int) -> DataFrame:
    """The next level (address, seeds), from the last one and the one before it, each with a row per address and part of the seeds."""
    key = level_key(level, "address")
    entered = index.by_address.meet(still_going(level, hop)).select("tx_hash", *key[1:], F.explode("seeds").alias("s"))
    entered = pack(entered, ["tx_hash", *key[1:]], "s", "seeds")
    reached = index.by_tx.meet(entered).select("address", *key[1:], F.explode("seeds").alias("s"))
    arrived = take_off(pack(reached, key, "s", "seeds"), level, key, "seeds")
    if before is not None:
        arrived = take_off(arrived, before, key, "seeds")
    return arrived.where("size(seeds) > 0")


def _expansion(seeds: DataFrame, index: TxIndex, deepest: int) -> tuple[DataFrame, DataFrame]:
    n = index.by_address.n_buckets
    level = store_level(index.by_address.known(start_level(seeds, "address", n)), "live-level", "address", n)
    levels, before = [level], None
    for hop in range(1, deepest):
        after = store_level(expansion_step(index, level, before, hop), "live-level", "address", n)
        if is_empty(after):
            break
        levels.append(after)
        before, level = level, after
    packed = [df.withColumn("level", F.lit(i)) for i, df in enumerate(levels)]
    one = lambda df, *rest: df.select(F.explode("seeds.seed").alias("seed"), *rest)
    fetched = reduce(DataFrame.unionByName, [one(df, "address", "level") for df in packed])
    txs = reduce(DataFrame.unionByName, [one(index.by_address.meet(df), "level", "address", "block_time", "tx_hash") for df in packed])
    return fetched, txs


def _capped_expansion(seeds: DataFrame, index: TxIndex, hop_depth: int, params: Params) -> Expansion:
    """Capped lookups depend on each seed's order, so its levels go row by row."""
    txs_of, rows = index.by_address.rows(), index.flow_rows()
    own = "hop_depth" in seeds.columns
    limit = F.coalesce("hop_depth", F.lit(hop_depth)) if own else F.lit(hop_depth)
    start = seeds.select("seed", limit.alias("_limit")).groupBy("seed").agg(F.max("_limit").alias("_limit"))
    hop_depth = (start.agg(F.max("_limit")).first()[0] or hop_depth) if own else hop_depth
    level = start.select("seed", F.col("seed").alias("address"), F.lit(0).alias("level"), "_limit").join(txs_of.select("address"), "address", "left_semi")
    level = materialize(level.select("seed", "address", "level", "_limit"), "live-level")
    fetched, txs, depth = level, None, 0
    while True:
        here = txs_of.join(level.select("address").distinct(), "address", "left_semi")
        if params.tx_cap is not None:
            here = newest_txs_per_address(here, params.tx_cap)
        here = materialize(level.join(here, "address").select("seed", "level", "address", "block_time", "tx_hash", "_limit"), "live-txs")
        txs = here if txs is None else txs.unionByName(here)
        depth += 1
        if depth >= hop_depth:
            break
        entered = here.where(F.col("_limit") > depth).select("seed", "tx_hash", "_limit").distinct()
        level = (
            entered.join(rows.select("tx_hash", "address"), "tx_hash").select("seed", "address", "_limit").distinct()
            .join(fetched.select("seed", "address"), ["seed", "address"], "left_anti")
        )
        if params.fetch_cap is not None:
            used = fetched.groupBy("seed").agg(F.count("*").alias("used"))
            level = top_per_key(level, ["seed"], [F.col("address")], params.fetch_cap).withColumn(
                "place", F.row_number().over(Window.partitionBy("seed").orderBy("address"))
            ).join(used, "seed").where(F.col("place") + F.col("used") <= params.fetch_cap)
        level = materialize(level.select("seed", "address", F.lit(depth).alias("level"), "_limit"), "live-level")
        if is_empty(level):
            break
        fetched = fetched.unionByName(level)
    return Expansion(fetched.drop("_limit"), txs.drop("_limit"))


def case_flows(expansion: Expansion, index: TxIndex) -> DataFrame:
    """(seed, tx_hash, side, address, time_step, fetch_order) for every transaction of a case.

    These rows are the case's flow graph, an edge leading from every input to every output of a transaction.
    ``fetch_order`` is where the case first met the transaction: by level, then looked-up
    address, then newest first.
    """
    newest = (-F.coalesce("block_time", F.lit(0))).alias("newest")
    known = expansion.txs.groupBy("seed", "tx_hash").agg(
        F.min(F.struct("level", "address", newest, "tx_hash")).alias("fetch_order")
    )
    return index.by_tx.meet(known).select("seed", "tx_hash", "side", "address", "time_step", "fetch_order")


def expansion_meta(expansion: Expansion, params: Params) -> DataFrame:
    """Per seed: addresses looked up, transactions seen and whether a cap was set and reached."""
    per_address = expansion.txs.groupBy("seed", "address").agg(F.count("*").alias("n"))
    reached = lambda c, cap: F.lit(False) if cap is None else F.col(c) >= cap
    return per_address.groupBy("seed").agg(
        F.count("*").alias("fetch_count"), F.sum("n").alias("txs_fetched"), F.max("n").alias("max_txs")
    ).select(
        "seed", "fetch_count", "txs_fetched",
        (reached("fetch_count", params.fetch_cap) | reached("max_txs", params.tx_cap)).alias("capped"),
    )


def live_hops(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Hop of every address of a case's flow graph from its seed; -1 where no flow connects it.

    One hop leads from an input to the outputs of the same transaction or back. The addresses
    of one side lie at most two hops apart, so a (case, transaction, side) is entered at most
    twice, however many of its addresses are reached.

    The flow rows are stored by (seed, address) and by (seed, transaction) first. A hop meets both where they lie and deals
    out its doors and the addresses reached; what it reaches lies in the last two levels or is new.
    """
    flows = materialize(flows.select("seed", "tx_hash", "side", "address").distinct(), "live-flows")
    by_address = store_keyed(flows, ["seed", "address"], "tx_hash")
    by_tx = store_keyed(flows, ["seed", "tx_hash"], "address", part_rows=None)
    key, n = ["seed", "address"], by_address.n_buckets
    level = materialize_bucketed(seeds.select("seed", F.col("seed").alias("address")).distinct(), "live-hop", key, n, dealt=True)
    levels, before = [level], None
    while True:
        met = by_address.meet(level).groupBy("seed", "tx_hash").agg(
            F.max(F.col("side") == "in").alias("entered_in"), F.max(F.col("side") == "out").alias("entered_out")
        )
        crossed = by_tx.meet(met).where(F.when(F.col("side") == "in", F.col("entered_out")).otherwise(F.col("entered_in")))
        fresh = crossed.select(*key).distinct().join(level, key, "left_anti")
        if before is not None:
            fresh = fresh.join(before, key, "left_anti")
        fresh = materialize_bucketed(fresh, "live-hop", key, n, dealt=True)
        if is_empty(fresh):
            break
        levels.append(fresh)
        before, level = level, fresh
    visited = reduce(DataFrame.unionByName, [df.withColumn("hop", F.lit(i)) for i, df in enumerate(levels)])
    unreached = flows.select(*key).distinct().withColumn("hop", F.lit(None).cast("int"))
    return visited.unionByName(unreached).groupBy(*key).agg(F.coalesce(F.min("hop"), F.lit(-1)).alias("hop"))


def live_nodes(flows: DataFrame, hops: DataFrame) -> DataFrame:
    """Nodes of a case with hop and the step of the first transaction that has one; no labels."""
    step = flows.where("time_step >= 0").groupBy("seed", "address").agg(
        F.min_by("time_step", "fetch_order").alias("time_step")
    )
    return hops.join(step, ["seed", "address"], "left").select(
        "seed", "address", "hop", F.coalesce("time_step", F.lit(-1)).alias("time_step"), F.lit(-1).alias("label")
    )


def capped_nodes(nodes: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` nodes per case for display: nearest first, unreached ones last. No rule looks at these."""
    unreached = (F.col("hop") < 0).cast("int")
    return top_per_key(nodes, ["seed"], [unreached, F.col("hop"), F.col("address")], cap)


def tx_flow_edges(flows: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(seed, src, dst): every input address to every other output address of a transaction.

    With ``kept`` only among those nodes. This writes the pairs of each transaction; the rules work on the flow rows instead.
    """
    inside = flows if kept is None else flows.join(kept.select("seed", "address"), ["seed", "address"], "left_semi")
    side = lambda tag, name: inside.where(F.col("side") == tag).select("seed", "tx_hash", F.col("address").alias(name)).distinct()
    return side("in", "src").join(side("out", "dst"), ["seed", "tx_hash"]).where("src <> dst").select("seed", "src", "dst").distinct()


def sole_neighbours(flows: DataFrame) -> DataFrame:
    """(seed, address, succ_min, succ_max, pred_min, pred_max) without forming a pair.

    A node has one successor if the smallest and the largest address on the output side of its transactions, itself
    left out, are the same; likewise for predecessors. Two smallest and two largest addresses of a side are
    enough to leave any one out.
    """
    rows = flows.select("seed", "tx_hash", "side", "address").distinct()
    key = ["seed", "tx_hash", "side"]
    ends = rows.groupBy(*key).agg(F.min("address").alias("lo"), F.max("address").alias("hi"))
    next_lo, next_hi = F.when(F.col("address") > F.col("lo"), F.col("address")), F.when(F.col("address") < F.col("hi"), F.col("address"))
    ends = rows.join(ends, key).groupBy(*key, "lo", "hi").agg(F.min(next_lo).alias("lo2"), F.max(next_hi).alias("hi2"))
    facing = ends.withColumn("side", F.when(F.col("side") == "in", "out").otherwise("in"))
    met = rows.join(facing, key).select(
        "seed", "address", "side",
        F.when(F.col("lo") != F.col("address"), F.col("lo")).otherwise(F.col("lo2")).alias("a"),
        F.when(F.col("hi") != F.col("address"), F.col("hi")).otherwise(F.col("hi2")).alias("b"),
    )
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    return met.groupBy("seed", "address").agg(
        F.min(of("in", "a")).alias("succ_min"), F.max(of("in", "b")).alias("succ_max"),
        F.min(of("out", "a")).alias("pred_min"), F.max(of("out", "b")).alias("pred_max"),
    )


def live_rules(nodes: DataFrame, flows: DataFrame, mixers: DataFrame, params: Params) -> DataFrame:
    """The rule results of every case's seed on the case's whole flow graph.

    ``nodes`` has (seed, address, hop, time_step). All cases go through together, with (seed, address) pairs as node
    ids, so they cannot touch each other.
    """
    seeds = nodes.where("address = seed").select("seed", "time_step")
    steps = nodes.select("seed", "address", "time_step")
    node = lambda c: F.struct(F.col("seed"), F.col(c).alias("address"))

    sole = materialize(sole_neighbours(flows), "live-neighbours")
    forwarding = (
        sole.where("succ_min = succ_max and pred_min is not null").join(steps, ["seed", "address"], "left")
        .select(
            node("address").alias("node"), node("succ_min").alias("any_dst"), node("pred_min").alias("any_src"),
            F.when(F.col("pred_min") == F.col("pred_max"), 1).otherwise(2).alias("in_degree"), F.coalesce("time_step", F.lit(-1)).alias("time_step"),
        )
    )
    chains = peel_chains_of(forwarding, params.peel_min_hops, params.peel_max_gap)
    peel = chains.where("tx_id.seed = tx_id.address").withColumn("tx_id", F.col("tx_id.seed"))

    own = flows.where("address = seed").select("seed", "tx_hash", "side").distinct()
    facing = own.withColumn("side", F.when(F.col("side") == "in", "out").otherwise("in"))
    around = flows.join(facing, ["seed", "tx_hash", "side"]).where("address <> seed").select("seed", "side", "address").distinct()
    degree = around.join(steps, ["seed", "address"], "left").groupBy("seed").agg(
        F.count_if(F.col("side") == "in").alias("in_degree"), F.count_if(F.col("side") == "out").alias("out_degree"),
        (F.max(F.expr("if(side = 'out' and time_step >= 0, time_step, null)")) - F.min(F.expr("if(side = 'out' and time_step >= 0, time_step, null)"))).alias("time_step_spread"),
    )
    burst = degree.where(
        (F.col("out_degree") >= params.fanout_min_out) & (F.col("in_degree") <= params.fanout_max_in) & (F.col("time_step_spread") <= params.fanout_window)
    ).join(seeds, "seed").select(F.col("seed").alias("tx_id"), "in_degree", "out_degree", "time_step_spread", F.col("time_step").alias("seed_time_step"))

    near = nodes.where(F.col("hop").between(1, min(params.mixer_max_hops, params.hop_depth))).join(
        mixers.select(F.col("mixer_id").alias("address")).distinct(), "address", "left_semi"
    )
    nearest = near.groupBy("seed").agg(F.min(F.struct("hop", "address")).alias("n"))
    mixer = nearest.select(F.col("seed").alias("tx_id"), F.col("n.address").alias("mixer_id"), F.col("n.hop").alias("hops_from_mixer"))
    return score_rules(seeds.select(F.col("seed").alias("tx_id")), peel, burst, mixer, params)
