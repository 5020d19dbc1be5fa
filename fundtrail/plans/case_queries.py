"""Case, outcome, watch-list and poll queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..functions.status import (
    attempt_kind, case_risk_level, display_flag, poll_failure_kind, poll_status, request_failure,
)
from ..operators import cases, clusters, graph
from ..session import scratch_path
from ..sources import sinks
from ..streaming import polls as watch
from ..streaming import watchlist as lists
from . import views  # noqa: F401
from .domain import Tables
from .entity_queries import attributed
from .registry import query, view

view("walletset", """
    select case_id, case when c_nationkey < 10 then cast(seed as varchar)
                         when c_nationkey < 18 then coalesce((select min(address) from ioa where tx_hash = sha256(cast(seed as varchar)) and side = 'out'), c_name)
                         else c_name end as wallet from caseset""")
view("resolved", """
    select case_id, wallet, case when wallet in (select cast(tx_id as varchar) from nodes) then 'elliptic-indexed'
        when not regexp_matches(wallet, '^[0-9-]+$') then 'invalid-address-format'
        when wallet in (select address from ioa) then 'live-lookup' else 'not-found-on-chain' end as source from walletset""")
view("requests", """
    select case_id, case c_mktsegment when 'BUILDING' then 200 when 'AUTOMOBILE' then 429 when 'MACHINERY' then 503 when 'HOUSEHOLD' then 404 end as status,
           c_nationkey = 24 as aborted, c_nationkey < 12 as retryable from caseset""")
view("caseattr", """
    select s.seed, e.entity_id as cluster_id, case when l.lookup = 'answered' then a.attributed_name end as attributed_name,
           case when l.lookup <> 'answered' then 'lookup-failed' when a.attributed_name is not null then 'matched' else 'no-match' end as attribution_status
    from (select seed, min(c_name) as c_name from caseset group by 1) s left join ent e on e.tx_id = s.seed
    left join attributed a on a.cluster_id = e.entity_id join lookups l on l.address = s.c_name""")
view("pollstate", """
    select *, event_type in ('view', 'purchase', 'signup') as settles,
           last_value(case when event_type in ('view', 'purchase', 'signup') then poll_id end ignore nulls) over w as settled_by,
           max(case when ok then poll_ts end) over w as last_ok_ts
    from pollset where address in (select address from watchers)
    window w as (partition by address order by poll_ts, poll_id rows between unbounded preceding and current row)""")
view("history", """
    select p.poll_id, p.address, p.poll_ts, a.tx_hash, p.reason, p.last_ok_ts from pollstate p left join alerts a on a.poll_id = p.settled_by""")
view("finalstate", "select * from history qualify row_number() over (partition by address order by poll_ts desc, poll_id desc) = 1")


def wallets(t: Tables):
    """One reported wallet text per case: an indexed id, a chain address or something malformed."""
    outs = t.io.where("side = 'out' and address is not null").groupBy("tx_hash").agg(F.min("address").alias("first_out"))
    joined = t.cases.withColumn("tx_hash", F.sha2(F.col("seed").cast("string"), 256)).join(outs, "tx_hash", "left")
    nation = F.col("c_nationkey")
    wallet = F.when(nation < 10, F.col("seed").cast("string")).when(nation < 18, F.coalesce("first_out", "c_name")).otherwise(F.col("c_name"))
    return joined.select("case_id", wallet.alias("wallet")).withColumn("valid", F.col("wallet").rlike("^[0-9-]+$"))


def resolved(t: Tables):
    from ..operators.utxo import address_activity

    asked = wallets(t)
    history = address_activity(asked.select(F.col("wallet").alias("address")), t.io)
    return cases.resolve_source(asked, t.nodes, history)


@query("resolve_source", "select case_id, wallet, source from resolved")
def resolve_source(t: Tables):
    return resolved(t).select("case_id", "wallet", "source")


@query("attempt_kind", "select address, origin, kind from attemptkind")
def attempt_kinds(t: Tables):
    return t.attempts.select("address", "origin", attempt_kind(F.col("status"), F.col("timed_out")).alias("kind"))


@query("lookup_verdict", "select address, n_sources, n_answered, lookup from lookups")
def lookup_verdict(t: Tables):
    return cases.lookup_verdict(t.attempts)


def requests(t: Tables):
    seg = F.col("c_mktsegment")
    status = F.when(seg == "BUILDING", 200).when(seg == "AUTOMOBILE", 429).when(seg == "MACHINERY", 503).when(seg == "HOUSEHOLD", 404)
    return t.cases.select(
        "case_id", status.alias("status"), (F.col("c_nationkey") == 24).alias("aborted"), (F.col("c_nationkey") < 12).alias("retryable")
    )


@query("request_failure_kind", """
    select case_id, case when status = 404 then 'pipeline' when aborted or status = 429 or (status = 503 and retryable) then 'retryable' else 'fallback' end as source,
           case when status = 404 then 'dataset-miss' when aborted then 'timeout' when status = 429 then 'rate-limited' when status = 503 and retryable then 'api-error'
                when status is not null then 'service-error' else 'unreachable' end as kind from requests where status is null or status <> 200""")
def request_failure_kind(t: Tables):
    failed = requests(t).where("status is null or status <> 200")
    state = request_failure(F.col("status"), F.col("aborted"), F.col("retryable"), F.lit(None).cast("string"))
    return failed.select("case_id", state.alias("s")).select("case_id", "s.source", "s.kind")


@query("case_outcome", """
    select case_id, case when q.status is null and not q.aborted then 'fallback' when q.status = 404 then 'empty' when q.aborted or q.status = 429 or (q.status = 503 and q.retryable) then 'retryable'
                         when q.status = 503 then 'fallback' when source = 'invalid-address-format' then 'empty' when source = 'not-found-on-chain' then 'empty'
                         when source = 'live-lookup' then 'incomplete' else 'pipeline' end as outcome
    from requests q join resolved using (case_id)""")
def case_outcome(t: Tables):
    """Wallets of the index have both signals here; live ones have no verdict yet. A request
    that missed the dataset brings no trace."""
    state = request_failure(F.col("status"), F.col("aborted"), F.col("retryable"), F.lit(None).cast("string"))["source"]
    asked = requests(t).select("case_id", "status", F.when(F.col("status").isNull() | (F.col("status") != 200) | F.col("aborted"), state).otherwise("pipeline").alias("request_source"))
    missed = F.col("status") == 404
    joined = asked.join(resolved(t), "case_id").withColumns(
        {"source": F.when(~F.coalesce(missed, F.lit(False)), F.col("source")), "failure": F.lit(None).cast("string"), "has_rules": F.lit(True), "has_verdict": F.col("indexed")}
    )
    return cases.case_outcomes(joined).select("case_id", "outcome")


@query("case_risk_level", """
    select tx_id, case verdict when 'confirmed' then 'CRITICAL' when 'watch' then 'ELEVATED' else 'LOW' end as risk_level,
           case when rule_score >= 60 then 'high' when rule_score > 0 then 'low' else 'none' end as flag from verdictset""")
def risk_level(t: Tables):
    return t.verdicts.select("tx_id", case_risk_level(F.col("verdict")).alias("risk_level"), display_flag(F.col("rule_score")).alias("flag"))


def attribution(t: Tables):
    per_seed = t.cases.groupBy("seed").agg(F.min("c_name").alias("address"))
    failed = cases.lookup_verdict(t.attempts).where("lookup <> 'answered'").join(per_seed, "address").select("seed")
    return cases.seed_attribution(t.seeds, t.entities, attributed(t), failed)


@query("attribution_status", "select seed, cluster_id, attributed_name, attribution_status from caseattr")
def attribution_status(t: Tables):
    return attribution(t)


@query("case_summary", """
    select c.case_id, c.seed, c.amount, r.hop_count, r.node_count, coalesce(s.edge_count, 0) as edge_count, r.illicit_nodes, v.verdict,
           case v.verdict when 'confirmed' then 'CRITICAL' when 'watch' then 'ELEVATED' else 'LOW' end as risk_level, v.rule_score,
           case when v.rule_score >= 60 then 'high' when v.rule_score > 0 then 'low' else 'none' end as display_flag,
           v.risk_score as ml_score,
           case when a.attribution_status = 'lookup-failed' then 'lookup unavailable' else coalesce(a.attributed_name, 'Unattributed') end as attributed_vasp
    from caseset c join (select seed, max(hop) as hop_count, count(*) as node_count, count(*) filter (label = 1) as illicit_nodes
                         from reach2 join nodes on tx_id = node group by 1) r using (seed)
    left join (select seed, count(*) as edge_count from sub2 group by 1) s using (seed) join verdictset v on v.tx_id = c.seed join caseattr a on a.seed = c.seed""")
def case_summary(t: Tables):
    reach = t.reach(2)
    stats = graph.subgraph_stats(reach, graph.induced_subgraph(reach, t.index), t.nodes)
    return cases.case_summary(t.cases, stats, t.verdicts, attribution(t))


@query("case_ledger_export", """
    select cast(s.seed as varchar) as case_seed, cast(greatest(a.hop, b.hop) as varchar) as "Hop", cast(src as varchar) as "From", cast(dst as varchar) as "To",
           src || '->' || dst as "TxHash", '0.0' as "AmountBTC", '0' as "AmountINR", 'unknown' as "Timestamp",
           case when peel_fired then 'PeelChain' when fanout_fired then 'FanOut' when mixer_fired then 'MixerHop' else 'Standard' end as "Marker"
    from sub2 s join reach2 a on a.seed = s.seed and a.node = src join reach2 b on b.seed = s.seed and b.node = dst join ruleset on tx_id = src""")
def case_ledger_export(t: Tables):
    reach = t.reach(2)
    ledger = cases.case_ledger(graph.induced_subgraph(reach, t.index), reach, t.wallet_rules)
    path = scratch_path(t.spark, "ledger")
    sinks.write_ledger_csv(path, ledger)
    return t.spark.read.csv(path, header=True)


@query("case_documents", "select cast(case_id as varchar) as case_id, cast(seed as varchar) as seed, c_name from caseset")
def case_documents(t: Tables):
    path = scratch_path(t.spark, "documents")
    sinks.write_case_json(path, cases.case_documents(t.cases))
    document = F.col("value")
    pick = lambda k: F.get_json_object(document, f"$.{k}").alias(k)
    return t.spark.read.text(path).select(pick("case_id"), pick("seed"), pick("c_name"))


@query("convergence", """
    with hit as (select r.seed, a.cluster_id, a.attributed_name, min(hop) as hops from reach3 r join ent e on e.tx_id = r.node
                 join attributed a on a.cluster_id = e.entity_id group by 1, 2, 3),
         pc as (select cluster_id, attributed_name, case_id, hops, amount from hit join caseset using (seed)),
         tot as (select cluster_id, count(*) as n_cases, round(sum(amount), 2) as total_loss from pc group by 1 having count(*) >= 2)
    select * from pc join tot using (cluster_id)""")
def convergence(t: Tables):
    reach = graph.khop(t.seeds, t.index, 3)
    return clusters.convergence(t.cases, reach, t.entities, attributed(t))


@query("converging_reports", """
    with hit as (select r.seed, e.entity_id as cluster_id, min(hop) as hops from reach3 r join ent e on e.tx_id = r.node group by 1, 2),
         pc as (select * from hit join caseset using (seed))
    select pc.cluster_id, attributed_name, jurisdiction, count(*) as n_cases, count(distinct c_nationkey) as n_states, count(distinct c_mktsegment) as n_scam_types,
           round(sum(amount), 2) as total_loss_inr, round(sum(round(amount / 894800, 4)), 4) as total_loss_btc, min(hops) as nearest_hops
    from pc left join attributed a on a.cluster_id = pc.cluster_id group by 1, 2, 3 having count(*) >= 2""")
def converging_reports(t: Tables):
    reports = t.cases.select(
        F.col("case_id").alias("ack_number"), "seed", F.col("c_nationkey").alias("victim_state"), F.col("c_mktsegment").alias("scam_category"),
        F.col("amount").alias("amount_inr"), money.inr_to_btc(F.col("amount")).alias("amount_btc"),
    )
    return clusters.converging_reports(reports, graph.khop(t.seeds, t.index, 3), t.entities, attributed(t))[1]


# watch list and polls ----------------------------------------------------------------


@query("mempool_alerts", """
    select poll_id, address, poll_ts, tx_hash, direction, cast(sats / 100000000 as double) as amount_btc,
           cast(floor(sats / 100000000 * 894800 + 0.5) as bigint) as amount_inr, fee_rate, counterparty from alerts""")
def mempool_alerts(t: Tables):
    return watch.mempool_alerts(watch.read_polls(t.polls)).withColumn("amount_btc", F.col("amount_btc").cast("double"))


@query("first_relevant_tx", "select poll_id, tx_hash from alerts")
def first_relevant_tx(t: Tables):
    return watch.mempool_alerts(watch.read_polls(t.polls)).select("poll_id", "tx_hash")


@query("watched_polls", "select poll_id, address from pollset where address in (select address from watchers)")
def watched_polls(t: Tables):
    return watch.watched_polls(t.polls, t.watchlist).select("poll_id", "address")


@query("alert_history", "select poll_id, address, poll_ts, tx_hash, reason, last_ok_ts from history")
def alert_history(t: Tables):
    outcomes = watch.read_polls(watch.watched_polls(t.polls, t.watchlist))
    day = F.floor(F.col("poll_ts") / 86_400_000_000)
    return watch.alert_history(outcomes, day).select("poll_id", "address", "poll_ts", F.col("alert.tx_hash"), "reason", "last_ok_ts")


STATE = "select address, tx_hash, reason, last_ok_ts, poll_ts as last_poll_ts from finalstate"


def flat_state(state):
    return state.select("address", F.col("alert.tx_hash"), "reason", "last_ok_ts", "last_poll_ts")


def landed_watchlist(t: Tables) -> str:
    path = scratch_path(t.spark, "watchers")
    t.watchlist.withColumn("verdict", F.lit("watch")).write.parquet(path)
    return path


@query("alert_state_batch", STATE)
def alert_state_batch(t: Tables):
    return flat_state(watch.alert_state(watch.read_polls(watch.watched_polls(t.polls, t.watchlist))))


@query("alert_state", STATE)
def alert_state(t: Tables):
    """The same state, kept by a stream over landed poll files."""
    landing, sink, checkpoint = t.landed(t.polls, "polls"), scratch_path(t.spark, "state"), scratch_path(t.spark, "state-cp")
    stream = watch.stream_polls(t.spark, landing, max_files=4)
    listed = landed_watchlist(t)
    watch.stream_alert_state(stream, sink, checkpoint, {"availableNow": True}, compact_every=2, watchlist=listed).awaitTermination()
    return flat_state(watch.read_alert_state(t.spark, sink, listed))


@query("stream_alerts", """
    select poll_id, address, tx_hash, direction, fee_rate, counterparty from alerts where address in (select address from watchers)""")
def stream_alerts(t: Tables):
    landing, sink, checkpoint = t.landed(t.polls, "polls"), scratch_path(t.spark, "alerts"), scratch_path(t.spark, "alerts-cp")
    stream = watch.stream_polls(t.spark, landing, max_files=4)
    watch.stream_alerts(stream, landed_watchlist(t), sink, checkpoint, {"availableNow": True}).awaitTermination()
    return t.spark.read.parquet(sink).select("poll_id", "address", "tx_hash", "direction", "fee_rate", "counterparty")


@query("stream_polls", "select poll_id, address, ok, reason, cast(case when ok then n_txs end as int) as n_txs from pollset")
def stream_polls(t: Tables):
    landing, sink, checkpoint = t.landed(t.polls, "polls"), scratch_path(t.spark, "seen"), scratch_path(t.spark, "seen-cp")
    seen = watch.read_polls(watch.stream_polls(t.spark, landing)).select("poll_id", "address", "ok", "reason", "n_txs")
    writer = seen.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink)


@query("poll_status", """
    select address, case when tx_hash is not null then 'UNCONFIRMED TX' when reason is not null then 'CHECK FAILED (' || reason || ')' else 'Idle / Monitoring' end as status,
           case when last_ok_ts is not null then 'checked' when reason is not null then 'never checked successfully' else 'not yet polled' end as freshness
    from watchers left join finalstate using (address)""")
def status_of_polls(t: Tables):
    state = watch.alert_state(watch.read_polls(watch.watched_polls(t.polls, t.watchlist)))
    status, freshness = poll_status(F.col("alert"), F.col("reason"), F.col("last_ok_ts"))
    return t.watchlist.join(state, "address", "left").select("address", status.alias("status"), freshness.alias("freshness"))


@query("poll_failure_kind", """
    select address, origin, case when status is null then 'timeout' when status = 429 then 'rate-limited' when status <> 200 or origin = 'primary' then 'api-error' end as reason
    from attemptset""")
def failed_polls(t: Tables):
    """Answers of the primary source are no lists here."""
    kind = poll_failure_kind(F.col("status"), F.col("timed_out"), F.col("origin") != "primary")
    return t.attempts.select("address", "origin", kind.alias("reason"))


def flagged(t: Tables):
    name = F.concat(F.lit("Order-"), F.col("tx_id"))
    return t.verdicts.select(name.alias("address"), "verdict")


def listed(t: Tables):
    """A list that already holds the reported seeds, in another letter case."""
    return t.seeds.select(F.concat(F.lit("ORDER-"), F.col("seed")).alias("address"), F.lit("watch").alias("verdict"))


INSERTED = """
    select 'ORDER-' || seed as address, 'watch' as verdict from seedset
    union all select 'Order-' || tx_id, verdict from verdictset where verdict <> 'none' and tx_id not in (select seed from seedset)"""


@query("watchlist_insert", INSERTED)
def watchlist_insert(t: Tables):
    return lists.watchlist_insert(flagged(t), listed(t))


@query("watchlist_upsert", INSERTED)
def watchlist_upsert(t: Tables):
    path, checkpoint = scratch_path(t.spark, "watchlist"), scratch_path(t.spark, "watchlist-cp")
    # The list doesn't exist yet; its present wallets come first, as a stream of their own.
    for name, rows in (("listed", listed(t)), ("flagged", flagged(t))):
        feed(t, rows, name, path, f"{checkpoint}-{name}")
    return lists.read_watchlist(t.spark, path)


def feed(t: Tables, rows, name: str, path: str, checkpoint: str) -> None:
    landing = t.landed(rows, name)
    verdicts = t.spark.readStream.schema(lists.WATCH_SCHEMA).option("maxFilesPerTrigger", 4).json(landing)
    lists.stream_watchlist(verdicts, path, checkpoint, {"availableNow": True}).awaitTermination()


@query("hop_depth_clamp", "select case_id, least(greatest(c_nationkey, 1), 10) as hop_depth from caseset")
def hop_depth_clamp(t: Tables):
    return t.cases.select("case_id", money.clamp_hops(F.col("c_nationkey")).alias("hop_depth"))
