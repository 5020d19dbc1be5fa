"""Transaction-graph views over the test tables, and the tables derived from them once per session.

A node is an order, an edge joins consecutive orders that use the same part, supplier group
and line, and a transaction side is a line item. Everything is built by Spark from the given
tables, whole. Tables that many queries share are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, entities, graph, learn, live, rules, utxo
from ..operators.correlate import correlate
from ..operators.ranking import next_in_sequence
from ..params import Params
from ..session import by_shuffle, materialize, prepare, scratch_path, spread
from ..sources import lists

# Thresholds fitted to the shape of the test tables; the library defaults stay as they are.
TEST_PARAMS = Params(
    hub_degree=4, peel_max_gap=52, fanout_min_out=3, fanout_window=60, node_cap=12, forest_depth=5,
)

# Lines of a landed text file, which compression keeps whole.
LANDED_ROWS = 1_000_000

_WRITTEN: dict[tuple[str, str, str], Any] = {}


def epoch(column: str):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = TEST_PARAMS):
        self.spark, self.dir, self.params = prepare(spark), sf_dir.rstrip("/"), params

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def once(self, name: str, build: Callable[[], Any]) -> Any:
        """What ``build`` returns, built once per session; a table is written, an index is stored already."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _WRITTEN:
            built = build()
            _WRITTEN[key] = materialize(built, name) if isinstance(built, DataFrame) else built
        return _WRITTEN[key]

    # transaction graph ---------------------------------------------------------------

    @property
    def nodes(self) -> DataFrame:
        label = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(-1)
        return self.read("orders").select(
            F.col("o_orderkey").alias("tx_id"), label.alias("label"),
            F.floor(epoch("o_orderdate") / 1209600).cast("long").alias("time_step"),
        )

    @property
    def raw_edges(self) -> DataFrame:
        def build() -> DataFrame:
            lines = self.read("lineitem").select(
                "l_orderkey", F.col("l_partkey").alias("p"), (F.col("l_suppkey") % 20).alias("s"), F.col("l_linenumber").alias("n")
            )
            orders = self.read("orders").select("o_orderkey", F.col("o_orderdate").alias("d"))
            uses = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
                "p", "s", "n", F.col("o_orderkey").alias("src"), "d"
            )
            month = F.year("d") * 12 + F.month("d")
            return next_in_sequence(uses, ["p", "s", "n"], month, ["d", "src"], "src", "dst", unique=True).where(
                "dst is not null"
            ).select("src", "dst")

        return self.once("raw_edges", build)

    @property
    def edges(self) -> DataFrame:
        return self.index.simple_edges()

    @property
    def index(self) -> graph.GraphIndex:
        return self.once("index", lambda: graph.build_graph_index(self.raw_edges))

    @property
    def degrees(self) -> DataFrame:
        return self.index.degrees()

    def reach(self, hops: int) -> DataFrame:
        """Neighbourhoods of all reported seeds, written because every caller reads them twice."""
        return materialize(graph.khop(self.seeds, self.index, hops), "reach")

    @property
    def mixers(self) -> DataFrame:
        """First order of every customer in debt."""
        debtors = self.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
        first = self.read("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("mixer_id"))
        return first.join(debtors, "o_custkey", "left_semi").select("mixer_id")

    # entities ------------------------------------------------------------------------

    @property
    def entities(self) -> DataFrame:
        return self.once("entities", lambda: entities.build_entities(self.nodes, self.raw_edges, self.params.hub_degree))

    @property
    def split(self) -> DataFrame:
        return self.once("split", lambda: entities.time_split(self.entities, self.nodes, self.params))

    @property
    def peel(self) -> DataFrame:
        p = self.params
        return self.once("peel", lambda: chains.peel_chains(self.nodes, self.degrees, p.peel_min_hops, p.peel_max_gap))

    @property
    def wallet_rules(self) -> DataFrame:
        return self.once("wallet_rules", lambda: self.run_rules(self.peel))

    def run_rules(self, peel: DataFrame | None = None) -> DataFrame:
        return rules.run_rules(self.nodes, self.nodes, self.index, self.mixers, self.params, peel=peel)

    # learned signal ------------------------------------------------------------------

    @property
    def features(self) -> DataFrame:
        """Nodes with line items and eight features; the first is the step."""
        per_order = self.read("lineitem").groupBy(F.col("l_orderkey").alias("tx_id")).agg(
            F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"),
            F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.countDistinct("l_suppkey").alias("suppliers"),
        )
        total = self.read("orders").select(F.col("o_orderkey").alias("tx_id"), "o_totalprice")
        cols = ["time_step", "o_totalprice", "lines", "quantity", "price", "discount", "tax", "suppliers"]
        return self.nodes.join(per_order, "tx_id").join(total, "tx_id").select(
            "tx_id", "label", "time_step", F.array(*[F.col(c).cast("float") for c in cols]).alias("features")
        )

    @property
    def stand_in_risk(self) -> DataFrame:
        """A deterministic score for every order with line items, so that checks are exact."""
        known = self.read("lineitem").select(F.col("l_orderkey").alias("tx_id")).distinct()
        return known.select("tx_id", (F.pmod(F.col("tx_id") * 7919, F.lit(1000)) / 1000.0).alias("risk"))

    @property
    def verdicts(self) -> DataFrame:
        signal = learn.learned_signal(self.nodes, self.stand_in_risk, self.params)
        return correlate(self.wallet_rules, signal).join(self.nodes.select("tx_id", "label"), "tx_id")

    # reports and lists ---------------------------------------------------------------

    @property
    def cases(self) -> DataFrame:
        """A complaint per customer with orders; the suspect is the customer's first order."""
        return self.once("cases", self._cases)

    def _cases(self) -> DataFrame:
        first = self.read("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("seed"))
        c = self.read("customer")
        return c.join(first, F.col("c_custkey") == F.col("o_custkey")).select(
            F.col("c_custkey").alias("case_id"), "seed", F.col("c_acctbal").alias("amount"), "c_nationkey", "c_mktsegment", "c_name"
        )

    @property
    def seeds(self) -> DataFrame:
        return self.cases.select("seed").distinct()

    @property
    def tag_lines(self) -> DataFrame:
        """A tag list in its text form: one line per supplier, some commented out or broken."""
        return self.once("tag_lines", self._tag_lines)

    def _tag_lines(self) -> DataFrame:
        first = self.read("lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_tx"))
        s = self.read("supplier").join(first, F.col("s_suppkey") == F.col("l_suppkey")).join(
            self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        address = F.when(F.col("s_nationkey") < 12, F.col("first_tx").cast("string")).otherwise(F.col("s_name"))
        source = F.when(F.col("s_acctbal") < 0, "").otherwise("registry")
        line = F.concat_ws(" , ", address, "s_name", source, "n_name")
        text = (
            F.when(F.col("s_acctbal") > 9500, F.concat(F.lit("# "), line))
            .when(F.col("s_acctbal") > 9000, F.concat(F.lit("  "), address))
            .otherwise(line)
        )
        return s.select(F.col("s_suppkey").alias("position"), text.alias("line"))

    @property
    def tags(self) -> DataFrame:
        return lists.parse_exchange_tags(self.tag_lines)

    @property
    def address_map(self) -> DataFrame:
        """Each supplier name with the first and last order it served."""
        return self.once("address_map", self._address_map)

    def _address_map(self) -> DataFrame:
        ends = self.read("lineitem").groupBy("l_suppkey").agg(
            F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last")
        ).select("l_suppkey", F.explode(F.array("first", "last")).alias("tx_id"))
        return ends.join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("s_name").alias("address"), "tx_id"
        ).distinct()

    @property
    def attempts(self) -> DataFrame:
        """Two lookup attempts per customer: (address, origin, status, timed_out)."""
        seg, nat = F.col("c_mktsegment"), F.col("c_nationkey")
        first = F.when(seg == "BUILDING", 200).when(seg == "AUTOMOBILE", 429).when(seg == "MACHINERY", 404).when(seg == "HOUSEHOLD", 500)
        second = F.when(nat < 5, 200).when(nat < 10, 429).when(nat < 15, 400).when(nat < 20, 503)
        both = F.array(
            F.struct(F.lit("primary").alias("origin"), first.alias("status")),
            F.struct(F.lit("fallback").alias("origin"), second.alias("status")),
        )
        return self.read("customer").select(F.col("c_name").alias("address"), F.explode(both).alias("a")).select(
            "address", "a.origin", "a.status", F.col("a.status").isNull().alias("timed_out")
        )

    # addresses and transactions ------------------------------------------------------

    @property
    def io(self) -> DataFrame:
        """Flat inputs and outputs; a side without discount has no address."""
        return self.once("io", self._io)

    def _io(self) -> DataFrame:
        qty = F.col("l_quantity").cast("int") % 10
        address = F.concat_ws("-", F.col("l_partkey").cast("string"), (F.col("l_suppkey") % 20).cast("string"), qty.cast("string"))
        orders = self.read("orders").select("o_orderkey", epoch("o_orderdate").alias("block_time"))
        return self.read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.sha2(F.col("l_orderkey").cast("string"), 256).alias("tx_hash"),
            F.when(F.col("l_linenumber") <= 3, "in").otherwise("out").alias("side"),
            F.when(F.col("l_discount") > 0, address).alias("address"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_sats"),
            "block_time", F.col("l_orderkey").alias("block_height"),
        )

    @property
    def tx_index(self) -> live.TxIndex:
        return self.once("tx_index", lambda: live.build_tx_index(self.io))

    @property
    def live_seeds(self) -> DataFrame:
        """The smallest output address of each customer's first order."""
        return self.once("live_seeds", self._live_seeds)

    def _live_seeds(self) -> DataFrame:
        first = self.seeds.select(F.sha2(F.col("seed").cast("string"), 256).alias("tx_hash"))
        outs = utxo.with_address(self.io).where("side = 'out'")
        return outs.join(by_shuffle(first), "tx_hash", "left_semi").groupBy("tx_hash").agg(F.min("address").alias("seed")).select("seed").distinct()

    @property
    def utxo_components(self) -> DataFrame:
        return self.once("utxo", lambda: utxo.utxo_components(self.io))

    @property
    def listed_txs(self) -> DataFrame:
        """Transactions in list form, one per line item: one input and two outputs."""
        sats = F.round(F.col("l_extendedprice") * 100).cast("long")
        who = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
        coinbase, data = F.col("l_discount") == 0, F.col("l_tax") == 0
        spent = F.struct(
            F.sha2(F.col("l_partkey").cast("string"), 256).alias("txid"), F.col("l_linenumber").cast("long").alias("vout"),
            F.when(~coinbase, who("p", "l_partkey")).alias("address"), F.when(~coinbase, sats).alias("amount_sats"),
        )
        paid = F.struct(who("s", "l_suppkey").alias("address"), (sats - F.lit(100)).alias("amount_sats"))
        change = F.struct(F.when(~data, who("c", "l_orderkey")).alias("address"), F.lit(100).cast("long").alias("amount_sats"))
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])
        needed = self.read("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"
        )
        return spread(needed).select(
            F.sha2(key, 256).alias("tx_hash"),
            F.when(F.col("l_returnflag") != "N", epoch("l_shipdate")).alias("timestamp"),
            F.when(F.col("l_returnflag") != "N", F.col("l_orderkey") + 1).alias("block_height"),
            F.array(spent).alias("inputs"), F.array(paid, change).alias("outputs"),
        )

    @property
    def polls(self) -> DataFrame:
        """Polls of watched wallets: error = failed, view = empty, click = nothing relevant,
        purchase = outgoing after an irrelevant one, signup = incoming with own change."""
        kind = F.col("event_type")
        me = F.concat(F.lit("w"), F.col("user_id").cast("string"))
        sats = F.round(F.col("value") * 1000000).cast("long")
        vin = lambda a, v: F.array(F.struct(F.struct(a.alias("scriptpubkey_address"), v.alias("value")).alias("prevout")))
        vout = lambda *pairs: F.array(*[F.struct(a.alias("scriptpubkey_address"), v.alias("value")) for a, v in pairs])
        weight = F.when(F.col("value") > 40, 0).otherwise(F.col("user_id") + 400).cast("long")
        tx = lambda tag, i, o: F.struct(
            F.concat(F.lit(tag), F.col("event_id").cast("string")).alias("txid"), F.round(F.col("value") * 100).cast("long").alias("fee"),
            weight.alias("weight"), i.alias("vin"), o.alias("vout"),
        )
        other, third = F.lit("x1"), F.lit("x2")
        noise = tx("n", vin(other, sats), vout((third, sats)))
        spend = tx("o", vin(me, sats), vout((me, sats - 7), (third, F.lit(7).cast("long"))))
        pay = tx("o", vin(me, sats), vout((third, sats)))
        gain = tx("i", vin(other, sats), vout((third, F.lit(5).cast("long")), (me, sats)))
        txs = (
            F.when(kind == "view", F.filter(F.array(noise), lambda t: F.lit(False)))
            .when(kind == "click", F.array(noise))
            .when(kind == "purchase", F.array(noise, pay))
            .when(kind == "signup", F.when(F.col("value") > 25, F.array(spend, gain)).otherwise(F.array(gain)))
        )
        reason = F.when(kind == "error", F.when(F.col("value") > 50, "rate-limited").when(F.col("value") > 20, "timeout"))
        return spread(self.read("events").select("event_id", "ts", "user_id", "event_type", "value")).select(
            F.col("event_id").alias("poll_id"), me.alias("address"), F.unix_micros(F.col("ts").cast("timestamp")).alias("poll_ts"),
            (kind != "error").alias("success"), reason.alias("reason"), txs.alias("txs"),
        )

    @property
    def watchlist(self) -> DataFrame:
        """Wallets of users with at least one signup or purchase worth more than 30."""
        hits = self.read("events").where("event_type in ('signup', 'purchase') and value > 30")
        return hits.select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address")).distinct()

    # files ---------------------------------------------------------------------------

    def dataset_folder(self) -> str:
        """The graph as CSV files, in the layout a loader finds."""
        root = scratch_path(self.spark, "dataset")
        feature_cols = [F.col("features")[i].alias(f"f{i}") for i in range(8)]
        self.features.select("tx_id", *feature_cols).write.csv(f"{root}/raw/graph_txs_features.csv")
        name = F.when(F.col("label") == 1, "1").when(F.col("label") == 0, " 2").otherwise("Unknown")
        known = self.features.select("tx_id", "label")
        known.select(F.col("tx_id").alias("txId"), name.alias("class")).write.csv(
            f"{root}/raw/graph_txs_classes.csv", header=True, ignoreLeadingWhiteSpace=False
        )
        self.raw_edges.toDF("txId1", "txId2").write.csv(f"{root}/raw/graph_txs_edgelist.csv", header=True)
        self.address_map.toDF("Address", "TX_ID").write.csv(f"{root}/extra/address_map.csv", header=True)
        return root

    def landed(self, frame: DataFrame, name: str) -> str:
        path = scratch_path(self.spark, name)
        frame.write.json(path)
        return path

    def landed_text(self, frame: DataFrame, name: str) -> str:
        """Text files as feeds leave them: compressed, and of at most LANDED_ROWS lines, since one task reads each."""
        path = scratch_path(self.spark, name)
        frame.write.option("maxRecordsPerFile", LANDED_ROWS).text(path, compression="gzip")
        return path
