"""Sources, graph, rule and chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import decode_label, is_labelled, time_step_of
from ..functions.status import laundering_marker
from ..operators import chains, graph, rules
from ..params import EXPECTED_EDGE_COUNT, EXPECTED_TX_COUNT
from ..session import by_shuffle, scratch_path
from ..sources import dataset, lists
from . import views  # noqa: F401
from .domain import Tables
from .registry import query, view

KNOWN = "(select distinct l_orderkey as tx_id from lineitem)"


@query("scan_nodes", f"select cast(tx_id as varchar) as tx_id, label, cast(time_step as int) as time_step from nodes where tx_id in {KNOWN}")
def scan_nodes(t: Tables):
    nodes, _ = dataset.load_dataset(t.spark, t.dataset_folder(), n_features=8)
    return nodes.select("tx_id", "label", "time_step")


@query("scan_features", f"""
    select cast(tx_id as varchar) as tx_id, 8 as n_features, cast(time_step as int) as first_feature, cast(count(*) as int) as lines
    from nodes join lineitem on tx_id = l_orderkey group by tx_id, time_step""")
def scan_features(t: Tables):
    path = dataset.matching_files(t.spark, t.dataset_folder(), "features")
    rows = dataset.scan_features(t.spark, path, n_features=8)
    return rows.select(
        "tx_id", F.size("features").alias("n_features"), time_step_of(F.col("features")).alias("first_feature"),
        F.col("features")[2].cast("int").alias("lines"),
    )


@query("scan_labels", f"select cast(tx_id as varchar) as tx_id, label from nodes where tx_id in {KNOWN}")
def scan_labels(t: Tables):
    path = dataset.matching_files(t.spark, t.dataset_folder(), "classes")
    return dataset.scan_labels(t.spark, path).select("tx_id", "label")


@query("scan_edges", "select cast(src as varchar) as src, cast(dst as varchar) as dst from raw_edges")
def scan_edges(t: Tables):
    path = dataset.matching_files(t.spark, t.dataset_folder(), "edgelist")
    return dataset.scan_edges(t.spark, path)


@query("scan_address_map", "select address, cast(tx_id as varchar) as tx_id from addrmap")
def scan_address_map(t: Tables):
    return dataset.scan_address_map(t.spark, t.dataset_folder())


@query("scan_mixers", "select distinct cast(mixer_id as varchar) as mixer_id from mixerset")
def scan_mixers(t: Tables):
    lines = t.mixers.select(F.explode(F.array(
        F.concat(F.lit("  "), F.col("mixer_id"), F.lit(" ")), F.concat(F.lit("# seen "), F.col("mixer_id")), F.lit("")
    )).alias("value"))
    return lists.read_mixers(t.spark, t.landed_text(lines, "mixers"))


@query("scan_exchange_tags", "select address, name, source, jurisdiction from tagset")
def scan_exchange_tags(t: Tables):
    path = t.landed_text(t.tag_lines.select(F.col("line").alias("value")), "tags")
    return lists.read_exchange_tags(t.spark, path).drop("position")


@query("rejected_tags", "select position, address as line from taglines where s_acctbal > 9000 and s_acctbal <= 9500")
def rejected_tags(t: Tables):
    return lists.rejected_tags(t.tag_lines)


@query("scan_complaints", "select c_name as suspect_address from customer union all select c_mktsegment from customer where length(c_mktsegment) > 10")
def scan_complaints(t: Tables):
    lines = t.read("customer").select(
        F.explode(F.array(F.concat(F.lit(" "), "c_name"), "c_mktsegment", F.lit("short"))).alias("value")
    )
    return lists.parse_bulk_complaints(lists.read_lines(t.spark, t.landed_text(lines, "complaints")))


@query("complaint_intake", """
    select cast(case_id as varchar) as ack_number, cast(seed as varchar) as suspect_address, amount as amount_inr,
           round(amount / 894800, 4) as amount_btc from caseset where amount <> 0
    union all select cast(case_id as varchar), cast(seed as varchar), 100000.0, round(100000.0 / 894800, 4) from caseset where amount = 0""")
def complaint_intake(t: Tables):
    rows = t.cases.select(
        F.col("case_id").cast("string").alias("ack_number"), F.lit("n/a").alias("victim_state"), F.col("c_mktsegment").alias("scam_category"),
        F.concat(F.col("seed").cast("string"), F.lit("  ")).alias("suspect_address"), F.col("amount").alias("amount_inr"),
    )
    return lists.complaints(rows).drop("victim_state", "scam_category")


@query("label_decode", "select tx_id, label from nodes")
def label_decode(t: Tables):
    text = F.when(F.col("label") == 1, " 1").when(F.col("label") == 0, "2 ").otherwise("UNKNOWN")
    return t.nodes.select("tx_id", decode_label(text).alias("label"))


@query("labelled_only", "select tx_id, label from nodes where label in (0, 1)")
def labelled_only(t: Tables):
    return t.nodes.where(is_labelled(F.col("label"))).select("tx_id", "label")


@query("time_step_project", f"select tx_id, cast(time_step as int) as time_step from nodes where tx_id in {KNOWN}")
def time_step_project(t: Tables):
    return t.features.select("tx_id", time_step_of(F.col("features")).alias("time_step"))


@query("align_features", f"""
    select count(*) filter (tx_id in {KNOWN}) as matched, cast(0 as bigint) as features_only,
           count(*) filter (tx_id not in {KNOWN}) as labels_only from nodes""")
def align_features(t: Tables):
    return dataset.alignment_counts(t.features, t.nodes)


@query("id_set_diff", f"select tx_id, 'labels' as only_in from nodes where tx_id not in {KNOWN}")
def id_set_diff(t: Tables):
    return dataset.id_set_diff(t.features, t.nodes)


@query("integrity_check", """
    select 'tx_count' as name, count(*) as actual, 203769::bigint as expected, if(count(*) = 203769, 'PASS', 'FAIL') as status from nodes
    union all select 'edge_count', count(*), 234355, if(count(*) = 234355, 'PASS', 'FAIL') from raw_edges""")
def integrity_check(t: Tables):
    return graph.integrity_check(t.nodes, t.raw_edges, EXPECTED_TX_COUNT, EXPECTED_EDGE_COUNT)


@query("simple_edges", "select src, dst from edges")
def simple_edges(t: Tables):
    return graph.simple_edges(t.raw_edges)


@query("undirected_edges", "select node, nbr from und")
def undirected_edges(t: Tables):
    return graph.undirected_edges(t.raw_edges)


@query("degrees", """
    select node, degree, in_degree, out_degree from rawdeg join gdeg using (node)""")
def degrees(t: Tables):
    return graph.edge_degrees(t.raw_edges).join(
        graph.graph_degrees(t.raw_edges).select("node", "in_degree", "out_degree"), "node"
    )


@query("hubs", "select node, degree from rawdeg where degree > 4")
def hubs(t: Tables):
    return graph.hubs(graph.edge_degrees(t.raw_edges), t.params.hub_degree)


@query("non_hub_edges", "select src, dst from raw_edges where src not in (select node from hubset) and dst not in (select node from hubset)")
def non_hub_edges(t: Tables):
    return graph.non_hub_edges(t.raw_edges, graph.hubs(graph.edge_degrees(t.raw_edges), t.params.hub_degree))


@query("edges_with_labels", """
    select src, dst, a.label as src_label, b.label as dst_label from edges join nodes a on a.tx_id = src join nodes b on b.tx_id = dst""")
def edges_with_labels(t: Tables):
    return graph.edges_with_labels(t.edges, t.nodes)


@query("sink_graph", "select node, nbr, exists (select 1 from edges where src = node and dst = nbr) as is_out from und")
def sink_graph(t: Tables):
    path = scratch_path(t.spark, "graph-index")
    graph.build_graph_index(t.raw_edges, path=path)
    return graph.read_graph_index(t.spark, path).adjacency.select("node", "nbr", "is_out")


@query("khop_neighbourhood", "select seed, node, hop from reach3")
def khop_neighbourhood(t: Tables):
    return graph.khop(graph.known_seeds(t.seeds, t.nodes), t.index, 3)


view("asked", "select seed, max(1 + c_nationkey % 5) as d from caseset group by 1")
view("ownwalk", """
    select seed, seed, 0 from asked union
    select w.seed, nbr, hop + 1 from ownwalk w join und u on u.node = w.node join asked a on a.seed = w.seed where hop < d""", "seed, node, hop")


@query("khop_own_depth", "select seed, node, min(hop) as hop from ownwalk group by 1, 2")
def khop_own_depth(t: Tables):
    """Each seed to its own depth of one to five hops, deeper than the call's default of two."""
    asked = t.cases.select("seed", (F.col("c_nationkey") % 5 + 1).alias("hop_depth"))
    return graph.khop(asked, t.index, 2)


@query("induced_subgraph", "select seed, src, dst from sub2")
def induced_subgraph(t: Tables):
    return graph.induced_subgraph(t.reach(2), t.index)


@query("subgraph_stats", """
    select r.seed, count(*) as node_count, max(hop) as max_hop_reached, count(*) filter (label = 1) as illicit_nodes,
           count(*) filter (label = 0) as licit_nodes, count(*) filter (label = -1) as unknown_nodes,
           coalesce((select count(*) from sub2 s where s.seed = r.seed), 0) as edge_count
    from reach2 r join nodes on tx_id = node group by r.seed""")
def subgraph_stats(t: Tables):
    reach = t.reach(2)
    return graph.subgraph_stats(reach, graph.induced_subgraph(reach, t.index), t.nodes)


@query("hop_histogram", "select seed, hop, count(*) as nodes from reach3 group by 1, 2")
def hop_histogram(t: Tables):
    return graph.hop_histogram(graph.khop(t.seeds, t.index, 3))


view("walk5", """
    select seed, seed, 0 from seedset union
    select seed, nbr, hop + 1 from walk5 join und using (node) where hop < 5""", "seed, node, hop")
view("reach5", "select seed, node, min(hop) as hop from walk5 group by 1, 2")


@query("hop_growth_check", """
    select seed, max(hop) as max_hop_reached, count(*) filter (hop <= 1) as nodes_1, count(*) filter (hop <= 2) as nodes_2,
           count(*) filter (hop <= 3) as nodes_3, count(*) as nodes_5,
           true as monotonic, count(*) > count(*) filter (hop <= 1) as grows_with_hop,
           count(*) filter (hop <= 2) = count(*) filter (hop <= 1) as saturated,
           count(*) > count(*) filter (hop <= 1) or count(*) filter (hop <= 2) = count(*) filter (hop <= 1) as ok
    from reach5 group by 1""")
def hop_growth_check(t: Tables):
    return graph.hop_growth_check(graph.khop(t.seeds, t.index, max(graph.GROWTH_DEPTHS)))


@query("trace_view_filter", """
    with kept as (select seed, node from reach2 join verdictset on tx_id = node where hop <= 1 and verdict = 'watch')
    select s.seed, s.src, s.dst from sub2 s join kept a on a.seed = s.seed and a.node = s.src join kept b on b.seed = s.seed and b.node = s.dst""")
def trace_view_filter(t: Tables):
    reach = t.reach(2)
    sub = graph.induced_subgraph(reach, t.index)
    tagged = reach.join(t.verdicts.select(F.col("tx_id").alias("node"), "verdict"), "node")
    return graph.trace_view(tagged, sub, 1, "watch")[1]


@query("node_transactions", """
    select dst as node, 'in' as direction, src as counterparty, label as counterparty_label from edges join nodes on tx_id = src
    union all select src, 'out', dst, label from edges join nodes on tx_id = dst""")
def node_transactions(t: Tables):
    return graph.node_transactions(t.edges, t.nodes)


@query("node_cap", "select seed, node, hop from (select *, row_number() over (partition by seed order by hop, node) as rn from reach3) where rn <= 12")
def node_cap(t: Tables):
    return graph.node_cap(graph.khop(t.seeds, t.index, 3), t.params.node_cap)


@query("seed_spread", """
    select tx_id, degree, position from (
        select tx_id, coalesce(in_degree + out_degree, 0) as degree, count(*) over () as n,
               row_number() over (order by coalesce(in_degree + out_degree, 0) desc, tx_id) as position
        from nodes left join gdeg on node = tx_id)
    where (position - 1) % greatest(1, n // 20) = 0 and position <= greatest(1, n // 20) * 20""")
def seed_spread(t: Tables):
    spread = graph.seed_spread(graph.total_degree(t.nodes, t.degrees), 20)
    return spread.withColumn("position", F.col("position").cast("long"))


@query("degree_extremes", """
    with d as (select tx_id, coalesce(in_degree + out_degree, 0) as degree from nodes left join gdeg on node = tx_id)
    (select tx_id, degree, 'low' as extreme from d order by degree, tx_id limit 25)
    union all (select tx_id, degree, 'hub' from d order by degree desc, tx_id limit 1)""")
def degree_extremes(t: Tables):
    return graph.degree_extremes(graph.total_degree(t.nodes, t.degrees))


@query("peel_links", "select src, dst, src_step, dst_step from plink")
def peel_links(t: Tables):
    return chains.peel_links(chains.forwarding_nodes(t.nodes, t.degrees), t.params.peel_max_gap)


@query("peel_chains", "select tx_id, head, position, chain_length_hops, time_step, false as is_cycle from peel")
def peel_chains(t: Tables):
    p = t.params
    return chains.peel_chains(t.nodes, t.degrees, p.peel_min_hops, p.peel_max_gap)


@query("peel_chains_long", "select tx_id, head, position, chain_length_hops from peel where chain_length_hops >= 3")
def peel_chains_long(t: Tables):
    found = chains.peel_chains(t.nodes, t.degrees, 3, t.params.peel_max_gap)
    return found.select("tx_id", "head", "position", "chain_length_hops")


@query("fan_out_successors", "select src as tx_id, dst as successor, time_step as succ_step from edges join nodes on tx_id = dst")
def fan_out_successors(t: Tables):
    return rules.fan_out_successors(t.edges, t.nodes)


@query("fan_out", "select tx_id, in_degree, out_degree, time_step_spread, seed_time_step from burst")
def fan_out(t: Tables):
    p = t.params
    return rules.fan_out(t.nodes, t.edges, t.degrees, p.fanout_min_out, p.fanout_max_in, p.fanout_window)


@query("mixers_in_graph", "select mixer_id from mixerset where mixer_id in (select node from gdeg)")
def mixers_in_graph(t: Tables):
    linked = t.degrees.select(F.col("node").alias("tx_id"))
    return rules.mixers_in_graph(t.mixers, linked)


@query("mixer_adjacent", "select tx_id, mixer_id, hops_from_mixer from nearmix")
def mixer_adjacent(t: Tables):
    return rules.mixer_adjacent(rules.mixers_in_graph(t.mixers, t.nodes), t.index, t.params.mixer_max_hops)


@query("run_rules", """
    select tx_id, rule_score, case when rule_score >= 60 then 'high' when rule_score >= 30 then 'medium' when rule_score > 0 then 'low' else 'none' end as rule_flag,
           concat_ws(',', case when peel_fired then 'peel_chain' end, case when fanout_fired then 'rapid_fan_out' end, case when mixer_fired then 'mixer_adjacent' end) as rules_fired,
           chain_length_hops, position, out_degree, time_step_spread, mixer_id, hops_from_mixer from ruleset""")
def run_rules(t: Tables):
    return t.run_rules().select(
        "tx_id", "rule_score", "rule_flag", F.concat_ws(",", "rules_fired").alias("rules_fired"),
        "chain_length_hops", "position", "out_degree", "time_step_spread", "mixer_id", "hops_from_mixer",
    )


@query("run_rules_shallow", """
    with pair as (select distinct seed, node from walk3 where hop <= 1),
         e as (select a.seed, src, dst from edges join pair a on a.node = src join pair b on b.node = dst and b.seed = a.seed),
         d as (select seed, node, count(*) filter (k = 'i') as i, count(*) filter (k = 'o') as o
               from (select seed, src as node, 'o' as k from e union all select seed, dst, 'i' from e) group by 1, 2),
         f as (select seed, node, i, time_step from d join nodes on tx_id = node where o = 1 and i >= 1),
         l as (select e.seed, src, dst from e join f a on a.seed = e.seed and a.node = src join f b on b.seed = e.seed and b.node = dst
               where b.i = 1 and b.time_step - a.time_step <= 52),
         p as (select distinct seed from l where seed in (src, dst))
    select seed as tx_id, seed in (select seed from p) as peel_fired,
           seed in (select tx_id from burst) as fanout_fired,
           seed in (select tx_id from nearmix where hops_from_mixer <= 1) as mixer_fired from seedset""")
def run_rules_shallow(t: Tables):
    wallets = t.seeds.select(F.col("seed").alias("tx_id"))
    found = rules.run_rules(wallets, t.nodes, t.index, t.mixers, t.params.with_(hop_depth=1))
    return found.select("tx_id", "peel_fired", "fanout_fired", "mixer_fired")


@query("rule_score", "select tx_id, rule_score from ruleset where rule_score > 0")
def rule_score(t: Tables):
    return t.wallet_rules.where("rule_score > 0").select("tx_id", "rule_score")


@query("rule_flag", """
    select case when rule_score >= 60 then 'high' when rule_score >= 30 then 'medium' when rule_score > 0 then 'low' else 'none' end as rule_flag,
           count(*) as wallets from ruleset group by 1""")
def rule_flag(t: Tables):
    return t.wallet_rules.groupBy("rule_flag").agg(F.count("*").alias("wallets"))


@query("contributing_signals", """
    select tx_id, 'peel_chain' as rule, peel_fired as fired, 40 as weight, cast(chain_length_hops as varchar) as detail from ruleset
    union all select tx_id, 'rapid_fan_out', fanout_fired, 30, cast(out_degree as varchar) from ruleset
    union all select tx_id, 'mixer_adjacent', mixer_fired, 30, cast(mixer_id as varchar) from ruleset""")
def contributing_signals(t: Tables):
    detail = F.coalesce(*[F.try_element_at("s.evidence", F.lit(k)) for k in ("chain_length_hops", "out_degree", "mixer_id")])
    signals = t.wallet_rules.select("tx_id", F.explode(rules.contributing_signals(t.params)).alias("rule", "s"))
    return signals.select("tx_id", "rule", "s.fired", "s.weight", detail.alias("detail"))


@query("rule_report", """
    select tx_id, rule_score, '4' as hub_degree, '3' as fanout_min_out, true as mixer_list_loaded from ruleset""")
def rule_report(t: Tables):
    report = rules.rule_report(t.wallet_rules, t.mixers, t.params)
    threshold = lambda k: F.col("engine_params")[k].alias(k)
    return report.select("tx_id", "rule_score", threshold("hub_degree"), threshold("fanout_min_out"), "mixer_list_loaded")


@query("peel_peers", "select seed, node as peer from reach2 join peel on tx_id = node where seed not in (select tx_id from peel)")
def peel_peers(t: Tables):
    return rules.peel_peers(graph.khop(t.seeds, t.index, 2), t.peel)


@query("rule_hit_counts", """
    select * from (select 'peel_chain' as rule, count(*) filter (peel_fired) as nodes from ruleset
    union all select 'rapid_fan_out', count(*) filter (fanout_fired) from ruleset
    union all select 'mixer_adjacent', count(*) filter (mixer_fired) from ruleset) where nodes > 0""")
def rule_hit_counts(t: Tables):
    return rules.rule_hit_counts(t.wallet_rules)


@query("rule_false_positive_rate", """
    with l as (select r.* from ruleset r join nodes using (tx_id) where label = 0)
    select 'peel_chain' as rule, avg(peel_fired::int::double) as false_positive_rate, count(*) as licit_nodes from l
    union all select 'rapid_fan_out', avg(fanout_fired::int::double), count(*) from l
    union all select 'mixer_adjacent', avg(mixer_fired::int::double), count(*) from l""")
def rule_false_positive_rate(t: Tables):
    return rules.rule_false_positive_rate(t.wallet_rules, t.nodes)


@query("laundering_marker", """
    select src, dst, case when peel_fired then 'PeelChain' when fanout_fired then 'FanOut' when mixer_fired then 'MixerHop' else 'Standard' end as marker
    from edges join ruleset on tx_id = src""")
def markers(t: Tables):
    flags = by_shuffle(t.wallet_rules.select(F.col("tx_id").alias("src"), "peel_fired", "fanout_fired", "mixer_fired"))
    marker = laundering_marker(F.col("peel_fired"), F.col("fanout_fired"), F.col("mixer_fired"))
    return t.edges.join(flags, "src").select("src", "dst", marker.alias("marker"))
