"""Batch jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import scratch_path
from ..sources import sinks
from . import jobs
from .case_queries import requests, wallets
from .domain import Tables
from .entity_queries import attributed
from .registry import query, view
from .utxo_queries import live_mixers

view("casestats", """
    select seed, max(hop) as hop_count, count(*) as node_count, count(*) filter (label = 1) as illicit_nodes
    from reach2 join nodes on tx_id = node group by 1""")
view("livefired", """
    select seed from livelink where seed in (src, dst) union select seed from livefan union select seed from livenear""")
view("livestats", "select seed, max(hop) as hop_count, count(*) as node_count from livenode group by 1")


def stored(t: Tables) -> str:
    """What ``ingest``, ``verdicts`` and ``report_clusters`` leave in a store."""
    store = scratch_path(t.spark, "store")
    text = lambda df, *ids: df.withColumns({c: F.col(c).cast("string") for c in ids})
    sinks.write_normalised(store, text(t.nodes, "tx_id"), text(t.edges, "src", "dst"), text(t.split, "tx_id"))
    graph.build_graph_index(text(t.raw_edges, "src", "dst"), path=f"{store}/graph")
    text(t.verdicts, "tx_id").write.parquet(f"{store}/verdicts")
    attributed(t).write.parquet(f"{store}/attributed")
    return store


@query("trace_cases", """
    select w.case_id, w.wallet, case when q.status = 404 then null else r.source end as source,
           case when q.status is null and not q.aborted then 'fallback' when q.status = 404 then 'empty'
                when q.aborted or q.status = 429 or (q.status = 503 and q.retryable) then 'retryable' when q.status = 503 then 'fallback'
                when r.source in ('invalid-address-format', 'not-found-on-chain') then 'empty' else 'pipeline' end as outcome,
           case r.source when 'elliptic-indexed' then v.verdict
                         when 'live-lookup' then case when w.wallet in (select seed from livefired) then 'watch' else 'none' end end as verdict,
           coalesce(s.hop_count, l.hop_count) as hop_count, coalesce(s.node_count, l.node_count) as node_count,
           case r.source when 'elliptic-indexed' then s.illicit_nodes when 'live-lookup' then 0 end as illicit_nodes,
           case when r.source in ('elliptic-indexed', 'live-lookup') then coalesce(a.attributed_name, 'Unattributed') end as attributed_vasp
    from walletset w join resolved r using (case_id) join requests q using (case_id)
    left join verdictset v on r.source = 'elliptic-indexed' and cast(v.tx_id as varchar) = w.wallet
    left join casestats s on s.seed = v.tx_id left join ent e on e.tx_id = v.tx_id left join attributed a on a.cluster_id = e.entity_id
    left join livestats l on r.source = 'live-lookup' and l.seed = w.wallet""")
def trace_cases(t: Tables):
    """Every report through the whole job; wallets of the index are traced two hops, live ones three."""
    asked = wallets(t).join(t.cases.select("case_id", "amount", F.when(F.col("c_nationkey") < 10, 2).otherwise(3).alias("hop_depth")), "case_id")
    traced = jobs.trace_cases(t.spark, stored(t), asked, t.tx_index, live_mixers(t), t.params, requests=requests(t))
    about = traced.summaries.select("case_id", "hop_count", "node_count", "illicit_nodes", "attributed_vasp")
    return traced.outcomes.select("case_id", "wallet", "source", "outcome", "verdict").join(about, "case_id", "left")
