"""Shared SQL views for the checks, written independently of the Spark operators."""

from __future__ import annotations

from .registry import view

view("nodes", """
    select o_orderkey as tx_id, case o_orderstatus when 'F' then 1 when 'O' then 0 else -1 end as label,
           cast(floor(epoch(o_orderdate) / 1209600) as bigint) as time_step
    from orders""")
view("raw_edges", """
    select src, dst from (
        select k as src, lead(k) over (partition by p, s, n order by d, k) as dst
        from (select distinct l_partkey p, l_suppkey % 20 s, l_linenumber n, o_orderkey k, o_orderdate d
              from lineitem join orders on l_orderkey = o_orderkey)) where dst is not null""")
view("edges", "select distinct src, dst from raw_edges")
view("und", "select src as node, dst as nbr from edges union select dst, src from edges")
view("rawdeg", """
    select node, count(*) as degree from (select src as node from raw_edges union all select dst from raw_edges) group by node""")
view("hubset", "select node from rawdeg where degree > 4")
view("gdeg", """
    select node, count(*) filter (d = 'i') as in_degree, count(*) filter (d = 'o') as out_degree
    from (select src as node, 'o' as d from edges union all select dst, 'i' from edges) group by node""")
view("seedset", "select distinct seed from (select min(o_orderkey) as seed from orders group by o_custkey)")
view("caseset", """
    select c_custkey as case_id, seed, c_acctbal as amount, c_nationkey, c_mktsegment, c_name
    from customer join (select o_custkey, min(o_orderkey) as seed from orders group by 1) on c_custkey = o_custkey""")
view("mixerset", """
    select min(o_orderkey) as mixer_id from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)
    group by o_custkey""")
view("walk3", """
    select seed, seed, 0 from seedset union
    select seed, nbr, hop + 1 from walk3 join und using (node) where hop < 3""", "seed, node, hop")
view("reach3", "select seed, node, min(hop) as hop from walk3 group by 1, 2")
view("reach2", "select * from reach3 where hop <= 2")
view("sub2", """
    select a.seed, e.src, e.dst from edges e join reach2 a on a.node = e.src join reach2 b on b.node = e.dst and b.seed = a.seed""")
view("nhund", """
    select u.node, u.nbr from und u where u.node not in (select node from hubset) and u.nbr not in (select node from hubset)""")
view("spread", """
    select tx_id, tx_id from nodes where tx_id not in (select node from hubset) union
    select nbr, root from spread join nhund using (node) where root < nbr""", "node, root")
view("ent", """
    select node as tx_id, 'entity::' || min(root) as entity_id, false as is_hub from spread group by node
    union all select node, 'hub::' || node, true from hubset""")
view("entstep", "select entity_id, min(time_step) as min_step from ent join nodes using (tx_id) group by 1")
view("entrank", """
    select entity_id, row_number() over (order by min_step, entity_id) as rk, count(*) over () as n from entstep""")
view("splits", """
    select tx_id, entity_id, is_hub,
           case when rk <= round_even(n * 0.70::double, 0) then 'train'
                when rk <= round_even(n * 0.70::double, 0) + round_even(n * 0.15::double, 0) then 'val' else 'test' end as split
    from ent join entrank using (entity_id)""")
view("fwd", """
    select tx_id, time_step, in_degree from gdeg join nodes on tx_id = node where out_degree = 1 and in_degree >= 1""")
view("plink", """
    select e.src, e.dst, a.time_step as src_step, b.time_step as dst_step
    from edges e join fwd a on a.tx_id = e.src join fwd b on b.tx_id = e.dst
    where b.in_degree = 1 and not (a.time_step >= 0 and b.time_step >= 0 and b.time_step - a.time_step > 52)""")
view("chainwalk", """
    select tx_id, tx_id, cast(0 as bigint) from fwd where tx_id not in (select dst from plink) union all
    select dst, head, position + 1 from chainwalk join plink on src = tx_id""", "tx_id, head, position")
view("chainlen", "select head, max(position) + 1 as chain_length_hops from chainwalk group by 1")
view("peel", """
    select tx_id, head, position, chain_length_hops, time_step from chainwalk join chainlen using (head) join fwd using (tx_id)
    where chain_length_hops >= 2""")
view("burst", """
    select g.node as tx_id, in_degree, out_degree, max(s.time_step) - min(s.time_step) as time_step_spread, any_value(o.time_step) as seed_time_step
    from gdeg g join nodes o on o.tx_id = g.node join edges e on e.src = g.node join nodes s on s.tx_id = e.dst
    where out_degree >= 3 and in_degree <= 1 group by 1, 2, 3 having max(s.time_step) - min(s.time_step) <= 60""")
view("mixwalk", """
    select mixer_id, mixer_id, 0 from mixerset union
    select mixer_id, nbr, hop + 1 from mixwalk join und using (node) where hop < 2""", "mixer_id, node, hop")
view("nearmix", """
    select tx_id, mixer_id, hops_from_mixer from (
        select node as tx_id, mixer_id, hop as hops_from_mixer, row_number() over (partition by node order by hop, mixer_id) as rn
        from (select mixer_id, node, min(hop) as hop from mixwalk where node <> mixer_id group by 1, 2)) where rn = 1""")
view("ruleset", """
    select n.tx_id, p.tx_id is not null as peel_fired, b.tx_id is not null as fanout_fired, m.tx_id is not null as mixer_fired,
           case when p.tx_id is not null then 40 else 0 end + case when b.tx_id is not null then 30 else 0 end
           + case when m.tx_id is not null then 30 else 0 end as rule_score,
           p.chain_length_hops, p.position, b.out_degree, b.time_step_spread, m.mixer_id, m.hops_from_mixer
    from nodes n left join peel p using (tx_id) left join burst b using (tx_id) left join nearmix m using (tx_id)""")
view("riskset", "select distinct l_orderkey as tx_id, (l_orderkey * 7919 % 1000) / 1000.0::double as risk from lineitem")
view("verdictset", """
    select tx_id, label, rule_score, rule_score > 0 as rule_flagged, risk is not null as classified, round(risk, 6) as risk_score,
           coalesce(risk >= 0.5, false) as learned_flag,
           case when rule_score > 0 and coalesce(risk >= 0.5, false) then 'confirmed'
                when rule_score > 0 or coalesce(risk >= 0.5, false) then 'watch' else 'none' end as verdict
    from ruleset join nodes using (tx_id) left join riskset using (tx_id)""")
view("taglines", """
    select s_suppkey as position, s_acctbal,
           case when s_nationkey < 12 then cast(first_tx as varchar) else s_name end as address, s_name as name,
           case when s_acctbal < 0 then 'unsourced' else 'registry' end as source, n_name as jurisdiction
    from supplier join (select l_suppkey, min(l_orderkey) as first_tx from lineitem group by 1) on s_suppkey = l_suppkey
    join nation on s_nationkey = n_nationkey""")
view("tagset", "select position, address, name, source, jurisdiction from taglines where s_acctbal <= 9000")
view("addrmap", """
    select distinct s_name as address, tx_id from supplier join (
        select l_suppkey, unnest([min(l_orderkey), max(l_orderkey)]) as tx_id from lineitem group by 1) on l_suppkey = s_suppkey""")
view("tagmatch", """
    select min(entity_id) as cluster_id, t.address, name, source, jurisdiction, position from tagset t
    join (select address, address as tx_id from tagset union select address, cast(tx_id as varchar) from addrmap) x using (address)
    join (select cast(tx_id as varchar) as tx_id, entity_id from ent) e using (tx_id)
    group by t.address, name, source, jurisdiction, position""")
view("clusterset", """
    select entity_id as cluster_id, count(*) as n_wallets, count(*) filter (label = 1) as illicit, count(*) filter (label = 0) as licit,
           count(*) filter (label = -1) as unknown, round(count(*) filter (label = 1) / count(*), 4) as illicit_fraction
    from ent join nodes using (tx_id) group by 1""")
view("attributed", """
    select c.*, m.name as attributed_name, m.source as attribution_source, m.jurisdiction from clusterset c left join (
        select * from tagmatch qualify row_number() over (partition by cluster_id order by position) = 1) m using (cluster_id)""")
view("io", """
    select sha256(cast(l_orderkey as varchar)) as tx_hash, case when l_linenumber <= 3 then 'in' else 'out' end as side,
           case when l_discount > 0 then l_partkey || '-' || (l_suppkey % 20) || '-' || (cast(l_quantity as int) % 10) end as address,
           cast(round(l_extendedprice * 100) as bigint) as amount_sats, cast(epoch(o_orderdate) as bigint) as block_time, l_orderkey as block_height
    from lineitem join orders on l_orderkey = o_orderkey""")
view("ioa", "select * from io where address is not null")
view("liveseeds", """
    select distinct seed from (select tx_hash, min(address) as seed from ioa where side = 'out'
        and tx_hash in (select sha256(cast(seed as varchar)) from seedset) group by 1)""")
view("addrfreq", "select address, count(*) as occurrences from ioa group by 1")
view("changeout", """
    select o.tx_hash, min(o.address) filter (f.occurrences = 1) as change_address from ioa o join addrfreq f using (address)
    where side = 'out' group by 1 having count(*) >= 2 and count(*) filter (f.occurrences = 1) = 1""")
view("changelink", """
    select distinct i.tx_hash, i.address, c.change_address from ioa i join changeout c using (tx_hash) where side = 'in'""")
view("colink", """
    select address as a, change_address as b from changelink union
    select a.address, b.address from ioa a join ioa b using (tx_hash) where a.side = 'in' and b.side = 'in' and a.address < b.address""")
view("counder", "select a as node, b as nbr from colink union select b, a from colink")
view("cospread", """
    select address, address from addrfreq union
    select nbr, root from cospread join counder using (node) where root < nbr""", "node, root")
view("utxocc", "select node as address, min(root) as cluster from cospread group by 1")
view("addrtx", "select address, tx_hash, max(block_time) as block_time from ioa group by 1, 2")
view("newest", """
    select * from (select *, row_number() over (partition by address order by block_time desc, tx_hash) as rn from addrtx) where rn <= 2""")
view("txpair", "select distinct tx_hash, address from ioa")
view("live0", "select seed, seed as address, 0 as level from liveseeds where seed in (select address from addrtx)")
view("cand1", """
    select distinct l.seed, p.address from live0 l join addrtx t using (address) join txpair p on p.tx_hash = t.tx_hash
    where p.address <> l.seed""")
view("live1", "select seed, address, 1 as level from cand1")
view("got1", "select * from live0 union all select * from live1")
view("cand2", """
    select distinct l.seed, p.address from live1 l join addrtx t using (address) join txpair p on p.tx_hash = t.tx_hash
    where (l.seed, p.address) not in (select (seed, address) from got1)""")
view("live2", "select seed, address, 2 as level from cand2")
view("got2", "select * from got1 union all select * from live2")
view("casetx", """
    select seed, tx_hash, min(row(level, g.address, -block_time, tx_hash)) as fetch_order from got2 g join addrtx t using (address)
    group by 1, 2""")
view("flows", """
    select distinct seed, c.tx_hash, side, address, floor(block_time / 1209600)::bigint as time_step, fetch_order
    from casetx c join ioa i using (tx_hash)""")
view("flowpair", """
    select distinct a.seed, a.address as src, b.address as dst from flows a join flows b using (seed, tx_hash)
    where a.side = 'in' and b.side = 'out' and a.address <> b.address""")
view("flowund", "select seed, src as node, dst as nbr from flowpair union select seed, dst, src from flowpair")
# Three levels of lookups reach at most two hops each, so a walk of eight hops is never cut short.
view("flowwalk", """
    select seed, seed, 0 from live0 union
    select w.seed, nbr, hop + 1 from flowwalk w join flowund u on u.seed = w.seed and u.node = w.node where hop < 8""", "seed, node, hop")
view("livehop", """
    select f.seed, f.address, coalesce(min(hop), -1) as hop from (select distinct seed, address from flows union select seed, seed from live0) f
    left join flowwalk w on w.seed = f.seed and w.node = f.address group by 1, 2""")
view("livenode", """
    select h.seed, h.address, h.hop, coalesce(arg_min(time_step, fetch_order), -1) as time_step
    from livehop h left join flows f on f.seed = h.seed and f.address = h.address group by 1, 2, 3""")
view("keptnode", """
    select * from (select *, row_number() over (partition by seed order by (hop < 0)::int, hop, address) as rn from livenode) where rn <= 12""")
view("attemptset", """
    select c_name as address, unnest([
        {'origin': 'primary', 'status': case c_mktsegment when 'BUILDING' then 200 when 'AUTOMOBILE' then 429 when 'MACHINERY' then 404 when 'HOUSEHOLD' then 500 end},
        {'origin': 'fallback', 'status': case when c_nationkey < 5 then 200 when c_nationkey < 10 then 429 when c_nationkey < 15 then 400 when c_nationkey < 20 then 503 end}
    ], recursive := true) from customer""")
view("attemptkind", """
    select *, case when status is null then 'timeout' when status = 200 then null when status = 429 then 'rate-limited'
                   when status in (400, 404) then 'bad-address' else 'api-error' end as kind from attemptset""")
view("lookups", """
    select address, count(*) as n_sources, count(*) filter (kind is null) as n_answered,
           case when count(*) filter (kind is null) > 0 then 'answered' when bool_or(coalesce(kind, '') = 'rate-limited') then 'rate-limited'
                when bool_or(coalesce(kind, '') = 'timeout') then 'timeout' when bool_and(coalesce(kind, '') = 'bad-address') then 'bad-address'
                else 'api-error' end as lookup from attemptkind group by 1""")
view("watchers", "select distinct 'w' || user_id as address from events where event_type in ('signup', 'purchase') and value > 30")
view("pollset", """
    select event_id as poll_id, 'w' || user_id as address, epoch_us(ts) as poll_ts, event_type <> 'error' as ok,
           case when event_type = 'error' then case when value > 50 then 'rate-limited' when value > 20 then 'timeout' else 'api-error' end end as reason,
           case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then case when value > 25 then 2 else 1 end else 0 end as n_txs,
           event_type, value, cast(round(value * 1000000) as bigint) as sats,
           case when value > 40 then 0 else cast(round(round(value * 100) / (user_id + 400) * 4) as bigint) end as fee_rate
    from events""")
view("alerts", """
    select poll_id, address, poll_ts,
           case when event_type = 'purchase' or value > 25 then 'o' || poll_id else 'i' || poll_id end as tx_hash,
           case when event_type = 'purchase' then 'outgoing' else 'incoming' end as direction,
           case when event_type = 'purchase' then sats when value > 25 then 2 * sats - 7 else sats end as sats,
           fee_rate, case when event_type = 'purchase' then 'x2' when value > 25 then address else 'x1' end as counterparty
    from pollset where event_type in ('purchase', 'signup')""")
# Clusters of each case on its own transactions.
view("ownrow", "select distinct l.seed, i.* from liveseeds l join addrtx t on t.address = l.seed join (select *, row_number() over () as r from ioa) i on i.tx_hash = t.tx_hash")
view("ownfreq", "select seed, address, count(*) as occurrences from ownrow group by 1, 2")
view("ownchange", """
    select o.seed, o.tx_hash, min(o.address) filter (f.occurrences = 1) as change_address from ownrow o join ownfreq f on f.seed = o.seed and f.address = o.address
    where side = 'out' group by 1, 2 having count(*) >= 2 and count(*) filter (f.occurrences = 1) = 1""")
view("ownlink", """
    select i.seed, i.address as a, c.change_address as b from ownrow i join ownchange c on c.seed = i.seed and c.tx_hash = i.tx_hash where side = 'in' union
    select a.seed, a.address, b.address from ownrow a join ownrow b on a.seed = b.seed and a.tx_hash = b.tx_hash where a.side = 'in' and b.side = 'in' and a.address < b.address""")
view("ownund", "select seed, a as node, b as nbr from ownlink union select seed, b, a from ownlink")
view("ownspread", """
    select seed, address, address from ownfreq union
    select s.seed, nbr, root from ownspread s join ownund u on u.seed = s.seed and u.node = s.node where root < nbr""", "seed, node, root")
view("owncc", "select seed, node as address, min(root) as cluster from ownspread group by 1, 2")
