"""Transaction, address and live-trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..functions.addresses import address_quality, quality_counts
from ..operators import live, utxo
from ..session import materialize, spread
from ..sources import explorer
from . import views  # noqa: F401
from .domain import Tables
from .registry import query, view

# The list-form transactions as flat rows, for the parsers' checks.
FLAT = """
    with base as (select sha256(concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)) as tx_hash,
                         case when l_returnflag <> 'N' then cast(epoch(l_shipdate) as bigint) end as ts,
                         case when l_returnflag <> 'N' then l_orderkey + 1 end as height, cast(round(l_extendedprice * 100) as bigint) as sats, *
                  from lineitem)
    select tx_hash, ts as timestamp, height as block_height, 'in' as side, 0 as ordinal, case when l_discount <> 0 then 'p' || l_partkey end as address,
           case when l_discount <> 0 then sats end as amount_sats from base
    union all select tx_hash, ts, height, 'out', 0, 's' || l_suppkey, sats - 100 from base
    union all select tx_hash, ts, height, 'out', 1, case when l_tax <> 0 then 'c' || l_orderkey end, 100 from base"""


@query("scan_tx_json_esplora", FLAT)
def scan_tx_json_esplora(t: Tables):
    path = t.landed_text(explorer.to_esplora_json(t.listed_txs), "esplora")
    return utxo.flatten_transactions(explorer.parse_esplora(t.spark.read.text(path).toDF("json")))


@query("scan_tx_json_blockcypher", FLAT)
def scan_tx_json_blockcypher(t: Tables):
    path = t.landed_text(explorer.to_blockcypher_json(t.listed_txs), "blockcypher")
    return utxo.flatten_transactions(explorer.parse_blockcypher(t.spark.read.text(path).toDF("json")))


@query("tx_time_step", "select tx_hash, max(floor(block_time / 1209600)::bigint) as time_step from io group by 1")
def tx_time_step(t: Tables):
    return t.io.groupBy("tx_hash").agg(F.max(utxo.tx_time_step(F.col("block_time"))).alias("time_step"))


def candidate_records(t: Tables):
    """Records with the faults real feeds have, spread by the values of the line items."""
    explorer_row = F.col("l_returnflag") != "N"
    return t.read("lineitem").select(
        F.when(explorer_row, F.when(F.col("l_tax") == 0, "not-a-hash").otherwise(F.sha2(F.col("l_orderkey").cast("string"), 256))).alias("tx_hash"),
        F.when(~explorer_row, F.when(F.col("l_tax") == 0.01, "").otherwise(F.col("l_orderkey").cast("string"))).alias("elliptic_id"),
        F.when(F.col("l_discount") > 0, F.col("l_partkey").cast("string")).alias("address"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 2).alias("timestamp"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") - 100000).alias("amount_sats"),
        F.when(F.col("l_linenumber") == 7, "both").when(F.col("l_linenumber") > 3, "in").otherwise("out").alias("direction"),
        F.when(F.col("l_returnflag") == "A", "blockstream").when(F.col("l_returnflag") == "R", "blockcypher").otherwise("elliptic").alias("source"),
        (F.col("l_suppkey") - 1).alias("block_height"),
    )


@query("record_constraints", """
    select * from (
    select 'bad_tx_hash' as problem, count(*) as records from lineitem where l_returnflag <> 'N' and l_tax = 0
    union all select 'missing_dataset_id', count(*) from lineitem where l_returnflag = 'N' and l_tax = 0.01
    union all select 'empty_address', count(*) from lineitem where l_discount = 0
    union all select 'bad_timestamp', count(*) from lineitem where l_linenumber = 2
    union all select 'bad_amount', count(*) from lineitem where round(l_extendedprice * 100) <= 100000
    union all select 'bad_direction', count(*) from lineitem where l_linenumber = 7
    union all select 'bad_height', count(*) from lineitem where l_suppkey = 0) where records > 0""")
def record_constraints(t: Tables):
    return records.problem_counts(candidate_records(t), records.record_problems())


@query("record_quarantine", """
    with bad as (select ((l_returnflag <> 'N' and l_tax = 0) or (l_returnflag = 'N' and l_tax = 0.01) or l_discount = 0 or l_linenumber in (2, 7)
        or round(l_extendedprice * 100) <= 100000 or l_suppkey = 0) as b from lineitem)
    select 'good' as part, count(*) filter (not b) as records from bad union all select 'quarantine', count(*) filter (b) from bad""")
def record_quarantine(t: Tables):
    good, bad = records.split_by_problems(candidate_records(t), records.record_problems())
    part = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("records"))
    return part(good, "good").unionByName(part(bad, "quarantine"))


@query("utxo_constraints", """
    select * from (
    select 'bad_output_amount' as problem, count(*) as records from lineitem where round(l_extendedprice * 100) < 100000
    union all select 'bad_timestamp', count(*) from lineitem where l_linenumber = 1
    union all select 'bad_input_index', count(*) from lineitem where l_linenumber = 2) where records > 0""")
def utxo_constraints(t: Tables):
    shift = lambda o: F.struct(o["address"].alias("address"), F.when(o["amount_sats"] == 100, 100).otherwise(o["amount_sats"] - 99900).alias("amount_sats"))
    line = F.col("inputs")[0]["vout"]
    inputs = F.transform("inputs", lambda i: F.struct(i["txid"].alias("txid"), F.when(i["vout"] == 2, -1).otherwise(i["vout"]).alias("vout"), i["address"].alias("address"), i["amount_sats"].alias("amount_sats")))
    faulty = t.listed_txs.select(
        "tx_hash", F.when(line == 1, 0).otherwise(F.col("timestamp")).alias("timestamp"), "block_height",
        inputs.alias("inputs"), F.transform("outputs", shift).alias("outputs"),
    )
    return records.problem_counts(faulty, records.utxo_problems())


@query("utxo_address_filter", "select tx_hash, side, address, amount_sats from ioa")
def utxo_address_filter(t: Tables):
    return utxo.with_address(t.io).select("tx_hash", "side", "address", "amount_sats")


@query("address_records", """
    select tx_hash, address, block_time as timestamp, amount_sats, case side when 'out' then 'in' else 'out' end as direction,
           'blockstream' as source, block_height from ioa where amount_sats > 0""")
def address_records(t: Tables):
    return utxo.address_records(t.io, "blockstream")


# Published addresses (BIP-173, BIP-350, first block, developer guide) with their kinds, and the same with one
# character changed or of another network.
VECTORS = [
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "p2pkh", None),
    ("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "p2sh", None),
    ("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4", "p2wpkh", None),
    ("bc1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3qccfmv3", "p2wsh", None),
    ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "witness-v1-plus", None),
    ("BC1SW50QGDZ25J", "witness-v1-plus", None),
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNZ", None, "bad-checksum"),
    ("bc1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3qccfmv5", None, "bad-checksum"),
    ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj2", None, "bad-checksum"),
    ("tb1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3q0sl5k7", None, "wrong-network"),
    ("bc1qrp33g0q5C5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3qccfmv3", None, "malformed"),
]
_quoted = lambda x: "null" if x is None else f"'{x}'"
_expected = ", ".join(f"({i}, {_quoted(kind)}, {_quoted(reason)})" for i, (_, kind, reason) in enumerate(VECTORS))


@query("address_quality", f"""
    with v(i, kind, reason) as (values {_expected}),
    r as (select kind, reason from lineitem join v on i = l_orderkey % {len(VECTORS)}
          union all select null, unnest(['malformed', 'non-ascii-or-whitespace', 'empty']) from lineitem)
    select kind is not null as valid, kind, reason, count(*) as addresses from r group by 1, 2, 3""")
def quality(t: Tables):
    """Format verdicts over whole tables: a published vector for each row, its part number, a text with a gap and a blank."""
    vector = F.element_at(F.array(*[F.lit(text) for text, _, _ in VECTORS]), (F.col("l_orderkey") % len(VECTORS) + 1).cast("int"))
    texts = F.array(vector, F.col("l_partkey").cast("string"), F.concat(F.lit(" "), "l_returnflag", F.lit(" x")), F.lit(" "))
    keys = spread(t.read("lineitem").select("l_orderkey", "l_partkey", "l_returnflag"))
    return quality_counts(address_quality(keys.select(F.explode(texts).alias("address"))))


@query("address_guards", """
    select reason, count(*) as addresses from (
        select unnest(['empty', case when c_acctbal < 0 then 'too-long' else 'non-ascii-or-whitespace' end, 'malformed']) as reason from customer) group by 1""")
def address_guards(t: Tables):
    long = F.when(F.col("c_acctbal") < 0, F.repeat("c_name", 8)).otherwise(F.concat("c_name", F.lit(" "), "c_name"))
    texts = t.read("customer").select(F.explode(F.array(F.lit("  \n"), long, F.col("c_name"))).alias("address"))
    return address_quality(texts).groupBy("reason").agg(F.count("*").alias("addresses"))


@query("dedupe_txs", "select address, tx_hash, min(l) as ordinal from (select address, tx_hash, block_time as l from ioa) group by 1, 2")
def dedupe_txs(t: Tables):
    return utxo.dedupe_txs(utxo.with_address(t.io).select("address", "tx_hash", F.col("block_time").alias("ordinal")))


@query("all_tx_refs", "select tx_hash, address, case side when 'in' then 0 else 1 end as pending from ioa")
def all_tx_refs(t: Tables):
    rows = utxo.with_address(t.io)
    part = lambda side: rows.where(F.col("side") == side).select("tx_hash", "address")
    return utxo.all_tx_refs(part("in"), part("out"))


@query("tx_addresses", "select tx_hash, address from txpair")
def tx_addresses(t: Tables):
    return utxo.tx_addresses(t.io)


@query("newest_txs_per_address", "select address, tx_hash, block_time from newest")
def newest_txs_per_address(t: Tables):
    return utxo.newest_txs_per_address(utxo.address_transactions(t.io), 2)


@query("address_frequency", "select address, occurrences from addrfreq")
def address_frequency(t: Tables):
    return utxo.address_frequency(t.io)


@query("address_activity", """
    select a.address, coalesce(n, 0) as tx_count, n is not null as has_history
    from (select c_name as address from customer union select seed from liveseeds) a
    left join (select address, count(*) as n from addrtx group by 1) using (address)""")
def address_activity(t: Tables):
    asked = t.read("customer").select(F.col("c_name").alias("address")).union(t.live_seeds)
    return utxo.address_activity(asked, t.io)


@query("change_address_links", "select tx_hash, address, change_address from changelink")
def change_address_links(t: Tables):
    return utxo.change_address_links(t.io)


@query("utxo_clusters", "select address, cluster from utxocc")
def utxo_clusters(t: Tables):
    return utxo.utxo_components(t.io)


@query("utxo_clusters_landed_twice", "select address, cluster from utxocc")
def utxo_clusters_landed_twice(t: Tables):
    """The same clusters when every transaction was landed twice, once unconfirmed."""
    from pyspark.sql import Window

    place = Window.partitionBy("tx_hash", "side").orderBy("address", "amount_sats")
    once = t.io.withColumn("ordinal", F.row_number().over(place))
    # Both landings of a row come from one pass over the places.
    return utxo.utxo_components(once.withColumn("block_time", F.explode(F.array("block_time", F.lit(None).cast("long")))))


@query("utxo_cluster_numbering", """
    select 'live_cluster_' || row_number() over (order by cluster) as cluster_id, 'live-traced-utxo' as confidence_tier, count(*) as n_wallets,
           array_to_string(list_sort(list(address))[1:10], ',') as members, greatest(count(*) - 10, 0) as n_members_truncated
    from utxocc group by cluster""")
def utxo_cluster_numbering(t: Tables):
    numbered = utxo.utxo_clusters(t.utxo_components, t.params.member_sample)
    return numbered.select("cluster_id", "confidence_tier", "n_wallets", F.concat_ws(",", "members_sample").alias("members"), "n_members_truncated")


@query("utxo_clusters_per_case", """
    select seed, 'live_cluster_' || row_number() over (partition by seed order by cluster) as cluster_id, cluster, count(*) as n_wallets,
           sum(occurrences)::bigint as occurrences, array_to_string(list_sort(list(address))[1:10], ',') as members, greatest(count(*) - 10, 0) as n_members_truncated
    from owncc join ownfreq using (seed, address) group by seed, cluster""")
def utxo_clusters_per_case(t: Tables):
    """Clusters of each live wallet over its own transactions, all wallets at once."""
    found = utxo.case_components(live.own_transactions(t.live_seeds, t.tx_index))
    return utxo.case_clusters(found, t.params.member_sample).select(
        "seed", "cluster_id", "cluster", "n_wallets", "occurrences", F.concat_ws(",", "members_sample").alias("members"), "n_members_truncated"
    )


def expansion(t: Tables):
    return live.bounded_expansion(t.live_seeds, t.tx_index, 3, t.params)


def flows(t: Tables):
    return materialize(live.case_flows(expansion(t), t.tx_index), "flows")


def known_seeds(t: Tables):
    """Seeds with any history; the others have no case to trace."""
    return t.live_seeds.join(utxo.with_address(t.io).select(F.col("address").alias("seed")), "seed", "left_semi")


@query("bounded_expansion", "select seed, address, level from got2")
def bounded_expansion(t: Tables):
    return expansion(t).fetched


@query("expansion_order", "select seed, address, row_number() over (partition by seed order by level, address) as place from got2")
def expansion_order(t: Tables):
    from pyspark.sql import Window

    order = Window.partitionBy("seed").orderBy("level", "address")
    return expansion(t).fetched.select("seed", "address", F.row_number().over(order).cast("long").alias("place"))


@query("expansion_meta", """
    with n as (select seed, g.address, count(*) as n from got2 g join addrtx using (address) group by 1, 2)
    select seed, count(*) as fetch_count, sum(n)::bigint as txs_fetched, false as capped from n group by 1""")
def expansion_meta(t: Tables):
    return live.expansion_meta(expansion(t), t.params)


@query("live_hops", "select seed, address, hop, time_step, -1 as label from livenode")
def live_hops(t: Tables):
    f = flows(t)
    return live.live_nodes(f, live.live_hops(f, known_seeds(t)))


@query("tx_flow_edges", "select seed, src, dst from flowpair")
def tx_flow_edges(t: Tables):
    return live.tx_flow_edges(flows(t))


view("mixaddr", """
    select distinct a as mixer_id from (select min(address) as a from ioa
        where side = 'out' and tx_hash in (select sha256(cast(mixer_id as varchar)) from mixerset) group by tx_hash)""")
view("liveedge", "select seed, src, dst from flowpair")
view("livedeg", """
    select seed, address, count(*) filter (k = 'i') as i, count(*) filter (k = 'o') as o
    from (select seed, src as address, 'o' as k from liveedge union all select seed, dst, 'i' from liveedge) group by 1, 2""")
view("livefwd", "select d.seed, d.address, i, time_step from livedeg d join livenode n on n.seed = d.seed and n.address = d.address where o = 1 and i >= 1")
view("livelink", """
    select e.seed, src, dst from liveedge e join livefwd a on a.seed = e.seed and a.address = src
    join livefwd b on b.seed = e.seed and b.address = dst
    where b.i = 1 and not (a.time_step >= 0 and b.time_step >= 0 and b.time_step - a.time_step > 52)""")
view("livenear", """
    with u as (select seed, src as a, dst as b from liveedge union select seed, dst, src from liveedge)
    select seed from u where a = seed and b in (select mixer_id from mixaddr)
    union select x.seed from u x join u y on y.seed = x.seed and y.a = x.b where x.a = x.seed and y.b <> x.seed and y.b in (select mixer_id from mixaddr)""")
view("livefan", """
    select d.seed from livedeg d join liveedge e on e.seed = d.seed and e.src = d.address join livenode n on n.seed = e.seed and n.address = e.dst
    where d.address = d.seed and d.o >= 3 and d.i <= 1 and n.time_step >= 0 group by 1 having max(n.time_step) - min(n.time_step) <= 60""")


def live_mixers(t: Tables):
    """The smallest output address of each mixer's transaction."""
    first = t.mixers.select(F.sha2(F.col("mixer_id").cast("string"), 256).alias("tx_hash"))
    outs = t.tx_index.by_tx.meet(first).where("side = 'out'")
    return outs.groupBy("tx_hash").agg(F.min("address").alias("mixer_id")).select("mixer_id").distinct()


@query("live_rules", """
    select seed as tx_id, seed in (select seed from livelink where seed in (src, dst)) as peel_fired, seed in (select seed from livefan) as fanout_fired,
           seed in (select seed from livenear) as mixer_fired from livenode where address = seed""")
def live_rules(t: Tables):
    f = flows(t)
    nodes = materialize(live.live_nodes(f, live.live_hops(f, known_seeds(t))), "live-nodes")
    return live.live_rules(nodes, f, live_mixers(t), t.params).select("tx_id", "peel_fired", "fanout_fired", "mixer_fired")


@query("live_node_cap", "select seed, address, hop from keptnode")
def live_node_cap(t: Tables):
    return live.capped_nodes(live.live_hops(flows(t), known_seeds(t)), t.params.node_cap)
