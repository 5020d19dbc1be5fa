"""Graph and rule operators on literal graphs and against brute force on random ones."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from fundtrail import Params
from fundtrail.operators import chains, components, entities, graph, rules


def nodes_df(spark, rows):
    return spark.createDataFrame(rows, "tx_id string, label int, time_step long")


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def chain(n, jump_at=None):
    """A path c0 -> ... -> cn with rising steps, optionally with a jump in time."""
    nodes = [(f"c{i}", -1, 10 + i + (40 if jump_at is not None and i >= jump_at else 0)) for i in range(n + 1)]
    return nodes, [(f"c{i}", f"c{i + 1}") for i in range(n)]


def burst(tight=True):
    nodes = [("src", -1, 5), ("burst", -1, 6)] + [(f"out{i}", -1, 7 if tight else 7 + 3 * i) for i in range(11)]
    return nodes, [("src", "burst")] + [("burst", f"out{i}") for i in range(11)]


def peeled(spark, nodes, edges, min_hops=2, gap=1):
    return {r["tx_id"]: r for r in chains.peel_chains(nodes_df(spark, nodes), graph.graph_degrees(edges_df(spark, edges)), min_hops, gap).collect()}


def test_chain_is_flagged_and_measured_from_its_head(spark):
    found = peeled(spark, *chain(5), min_hops=3)
    assert set(found) == {"c1", "c2", "c3", "c4"}
    assert {r["chain_length_hops"] for r in found.values()} == {4}
    assert [found[f"c{i}"]["position"] for i in range(1, 5)] == [0, 1, 2, 3]


def test_short_and_broken_chains_are_not_flagged(spark):
    assert not peeled(spark, *chain(2), min_hops=3)
    assert not peeled(spark, *chain(5, jump_at=3), min_hops=3)


def test_unknown_and_backward_steps_do_not_break_a_chain(spark):
    nodes, edges = chain(5)
    nodes[3] = ("c3", -1, -1)
    assert set(peeled(spark, nodes, edges, min_hops=4)) == {"c1", "c2", "c3", "c4"}
    nodes[2] = ("c2", -1, 1)
    assert set(peeled(spark, nodes, edges, min_hops=4)) == {"c1", "c2", "c3", "c4"}


def test_a_cycle_ends_and_is_marked(spark):
    nodes = [(x, -1, 5) for x in "abc"] + [("loop", -1, 5)]
    found = peeled(spark, nodes, [("a", "b"), ("b", "c"), ("c", "a"), ("loop", "loop")])
    assert set(found) == {"a", "b", "c", "loop"} and all(r["is_cycle"] for r in found.values())


def test_long_chain(spark):
    found = peeled(spark, *chain(300))
    assert found["c299"]["position"] == 298 and found["c1"]["chain_length_hops"] == 299


def fan(spark, nodes, edges, p=Params()):
    e = edges_df(spark, edges)
    got = rules.fan_out(nodes_df(spark, nodes), graph.simple_edges(e), graph.graph_degrees(e), p.fanout_min_out, p.fanout_max_in, p.fanout_window)
    return {r["tx_id"]: r for r in got.collect()}


def test_fan_out(spark):
    found = fan(spark, *burst())
    assert set(found) == {"burst"} and found["burst"]["out_degree"] == 11
    assert not fan(spark, *burst(tight=False))
    many_in = [("m", -1, 5)] + [(f"i{k}", -1, 4) for k in range(12)] + [(f"o{k}", -1, 6) for k in range(12)]
    flows = [(f"i{k}", "m") for k in range(12)] + [("m", f"o{k}") for k in range(12)]
    assert not fan(spark, many_in, flows)
    unknown = [(n, l, -1) for n, l, _ in burst()[0]]
    assert not fan(spark, unknown, burst()[1])


def mixed(spark, edges, ids, hops=2, part_rows=graph.PART_ROWS):
    index = graph.build_graph_index(edges_df(spark, edges), part_rows)
    got = rules.mixer_adjacent(spark.createDataFrame([(i,) for i in ids], "mixer_id string"), index, hops)
    return {r["tx_id"]: (r["mixer_id"], r["hops_from_mixer"]) for r in got.collect()}


def test_mixer_adjacency_stops_at_the_bound(spark):
    line = [("mixer", "m_out"), ("m_out", "cust"), ("cust", "shop")]
    assert mixed(spark, line, ["mixer"]) == {"m_out": ("mixer", 1), "cust": ("mixer", 2)}
    assert mixed(spark, line, ["mixer", "cust"]) == {
        "mixer": ("cust", 2), "m_out": ("cust", 1), "cust": ("mixer", 2), "shop": ("cust", 1)
    }


def run(spark, nodes, edges, mixers=(), **changes):
    n, e = nodes_df(spark, nodes), edges_df(spark, edges)
    m = spark.createDataFrame([(x,) for x in mixers], "mixer_id string")
    got = rules.run_rules(n, n, graph.build_graph_index(e), m, Params(**changes))
    return {r["tx_id"]: r for r in got.collect()}


def test_composite_score(spark):
    nodes, edges = burst()
    got = run(spark, nodes + [("mixer", -1, 4)], edges + [("mixer", "src")], ["mixer", "absent"])
    assert (got["burst"]["rule_score"], got["burst"]["rule_flag"]) == (60, "high")
    assert got["burst"]["rules_fired"] == ["rapid_fan_out", "mixer_adjacent"]
    assert (got["out0"]["rule_score"], got["out0"]["rule_flag"]) == (0, "none")
    alone = run(spark, *chain(5))["c2"]
    assert (alone["rule_score"], alone["rule_flag"], alone["rules_fired"]) == (40, "medium", ["peel_chain"])


def random_graph(seed, n=60, m=75):
    rng = random.Random(seed)
    nodes = [(f"n{i:02d}", rng.choice([1, 0, -1]), rng.choice([-1, i // 8])) for i in range(n)]
    pairs = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)]
    return nodes, [(f"n{a:02d}", f"n{b:02d}") for a, b in pairs]


def neighbours(edges):
    und = defaultdict(set)
    for a, b in edges:
        und[a].add(b)
        und[b].add(a)
    return und


def distances(und, start, bound):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in und[x] if seen[x] < bound else ():
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


@pytest.mark.parametrize("part_rows", [graph.PART_ROWS, 2])
def test_khop_and_induced_edges(spark, part_rows):
    """The small part size splits every node of degree above two into salted parts."""
    nodes, edges = random_graph(3)
    index = graph.build_graph_index(edges_df(spark, edges), part_rows)
    assert part_rows > 2 or index.arcs.has_hot
    seeds = spark.createDataFrame([(n[0],) for n in nodes], "seed string")
    reach = graph.khop(seeds, index, 3)
    got = {(r["seed"], r["node"]): r["hop"] for r in reach.collect()}
    und = neighbours(edges)
    want = {(s[0], n): d for s in nodes for n, d in distances(und, s[0], 3).items()}
    assert got == want
    sub = {tuple(r) for r in graph.induced_subgraph(reach, index).select("seed", "src", "dst").collect()}
    assert sub == {(s[0], a, b) for s in nodes for a, b in set(edges) if (s[0], a) in want and (s[0], b) in want}


def test_mixer_against_brute_force_with_salted_parts(spark):
    nodes, edges = random_graph(5)
    ids = [n[0] for n in nodes[::9]]
    und, want = neighbours(edges), {}
    for m in ids:
        for n, d in distances(und, m, 2).items():
            if d:
                want[n] = min(want.get(n, (99, "")), (d, m))
    assert mixed(spark, edges, ids, part_rows=2) == {n: (m, d) for n, (d, m) in want.items()}


def test_index_gives_the_same_degrees_and_edges(spark):
    edges = edges_df(spark, random_graph(4)[1] + [("n01", "n01"), ("n02", "n01"), ("n01", "n02")])
    index = graph.build_graph_index(edges, 2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.simple_edges()) == rows(graph.simple_edges(edges))
    columns = ["node", "in_degree", "out_degree", "any_src", "any_dst"]
    assert rows(index.degrees().select(columns)) == rows(graph.graph_degrees(edges).select(columns))


def test_bad_depth_and_unknown_seed(spark):
    nodes, edges = chain(3)
    index = graph.build_graph_index(edges_df(spark, edges))
    seeds = spark.createDataFrame([("c0",), ("nowhere",)], "seed string")
    with pytest.raises(ValueError):
        graph.khop(seeds, index, 0)
    n = nodes_df(spark, nodes)
    assert [r["seed"] for r in graph.known_seeds(seeds, n).collect()] == ["c0"]
    assert [r["seed"] for r in graph.unknown_seeds(seeds, n).collect()] == ["nowhere"]


def test_dangling_ends_have_unknown_attributes(spark):
    n, e = nodes_df(spark, [("a", 1, 3)]), edges_df(spark, [("a", "ghost")])
    row = graph.edges_with_labels(e, n).first()
    assert (row["src_label"], row["dst_label"]) == (1, -1)


def brute_components(nodes, edges):
    und = neighbours(edges)
    return {n: min(distances(und, n, 10**9)) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    nodes, edges = random_graph(seed, n=120, m=90)
    ids = [n[0] for n in nodes]
    got = components.connected_components(spark.createDataFrame([(i,) for i in ids], "node string"), edges_df(spark, edges))
    assert {r["node"]: r["component"] for r in got.collect()} == brute_components(ids, edges)


def test_components_of_a_sorted_path_need_few_rounds(spark, monkeypatch):
    """Ids rise along the path, the worst order for passing on the smallest label."""
    writes = []
    original = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: writes.append(name) or original(df, name))
    path = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = components.connected_components(spark.range(401).toDF("node"), path)
    assert got.agg(F.max("component")).first()[0] == 0 and got.count() == 401
    assert writes.count("cc-picks") <= 16


def star(leaves):
    nodes = [("hub", 0, 1)] + [(f"l{i:03d}", -1, 1 + i % 3) for i in range(leaves)] + [("x", 1, 1), ("y", -1, 1)]
    return nodes, [("hub", f"l{i:03d}") for i in range(leaves)] + [("x", "y"), ("x", "l000")]


def test_hub_does_not_merge_entities(spark):
    nodes, edges = star(60)
    n, e = nodes_df(spark, nodes), edges_df(spark, edges)
    got = {r["tx_id"]: r for r in entities.build_entities(n, e, 50).collect()}
    assert got["hub"]["entity_id"] == "hub::hub" and got["hub"]["is_hub"]
    assert got["x"]["entity_id"] == got["y"]["entity_id"] == got["l000"]["entity_id"] == "entity::l000"
    assert len({r["entity_id"] for r in got.values()}) == 61
    merged = {r["entity_id"] for r in entities.build_entities(n, e, 100).collect()}
    assert merged == {"entity::hub"}


def test_parallel_edges_count_towards_the_hub_degree(spark):
    nodes = [("a", 0, 1), ("b", 0, 1)]
    got = entities.build_entities(nodes_df(spark, nodes), edges_df(spark, [("a", "b")] * 3), 2)
    assert all(r["is_hub"] for r in got.collect())


def test_split_is_leakage_free_and_time_ordered(spark):
    nodes, edges = random_graph(8, n=100, m=60)
    nodes = [(n, l, max(s, 0)) for n, l, s in nodes]
    n, e, p = nodes_df(spark, nodes), edges_df(spark, edges), Params()
    ents = entities.build_entities(n, e, p.hub_degree)
    split = entities.time_split(ents, n, p)
    rows = split.join(entities.entity_min_step(ents, n), "entity_id").collect()
    per_entity = {r["entity_id"]: (r["min_step"], r["entity_id"], r["split"]) for r in rows}
    ordered = [s for _, _, s in sorted(per_entity.values())]
    count = len(ordered)
    n_train, n_val = round(count * 0.7), round(count * 0.15)
    assert ordered == ["train"] * n_train + ["val"] * n_val + ["test"] * (count - n_train - n_val)
    report = entities.leakage_report(split, n, e, p)
    row = report.first()
    assert row["leakage_free"] and row["n_train_txs"] + row["n_val_txs"] + row["n_test_txs"] == 100
    entities.verify_no_leakage(report, require_span_zero=False)
    if not row["time_span_ok"]:
        with pytest.raises(entities.LeakageError):
            entities.verify_no_leakage(report)
    leaky = split.unionByName(split.limit(1).withColumn("split", F.lit("other")))
    with pytest.raises(entities.LeakageError):
        entities.verify_no_leakage(entities.leakage_report(leaky, n, e, p), require_span_zero=False)


def local_peel(und, edges, nodes, seed, depth, min_hops, gap):
    """The peel rule on one seed's neighbourhood, step by step."""
    keep = set(distances(und, seed, depth))
    out, inn, step = defaultdict(set), defaultdict(set), {n: s for n, _, s in nodes}
    for a, b in set(edges):
        if a in keep and b in keep:
            out[a].add(b)
            inn[b].add(a)
    forward = {n for n in keep if len(out[n]) == 1 and inn[n]}
    flagged = set()
    for start in forward:
        run_, cur = [start], start
        while True:
            (nxt,) = out[cur]
            known = step[cur] >= 0 and step[nxt] >= 0
            if nxt not in forward or len(inn[nxt]) != 1 or (known and step[nxt] - step[cur] > gap):
                break
            run_.append(nxt)
            cur = nxt
        if len(run_) >= min_hops:
            flagged |= set(run_)
    return seed in flagged


def paths_with_noise(seed):
    """Paths of several lengths, some crossed by extra edges, some with late or unknown steps."""
    rng = random.Random(seed)
    nodes, edges = [], []
    for p in range(12):
        length = 3 + p % 6
        nodes += [(f"p{p:02d}n{i}", -1, rng.choice([i, i, i, -1, i + 5])) for i in range(length)]
        edges += [(f"p{p:02d}n{i}", f"p{p:02d}n{i + 1}") for i in range(length - 1)]
    for _ in range(8):
        a, b = sorted(rng.sample(nodes, 2))
        edges.append((a[0], b[0]))
    return nodes, edges


@pytest.mark.parametrize("depth,min_hops", [(2, 2), (2, 3)])
def test_global_rules_equal_the_seed_neighbourhood(spark, depth, min_hops):
    """At (2, 3) the neighbourhood is too small for the whole graph to give the same result."""
    nodes, edges = paths_with_noise(11)
    got = run(spark, nodes, edges, hop_depth=depth, peel_min_hops=min_hops, peel_max_gap=2)
    und = neighbours(edges)
    want = {n[0] for n in nodes if local_peel(und, edges, nodes, n[0], depth, min_hops, 2)}
    assert {t for t, r in got.items() if r["peel_fired"]} == want and want


def test_seed_spread_and_extremes(spark):
    nodes, edges = star(40)
    degree = graph.total_degree(nodes_df(spark, nodes), graph.graph_degrees(edges_df(spark, edges)))
    spread = graph.seed_spread(degree, 5).orderBy("position").collect()
    assert len(spread) == 5 and spread[0]["tx_id"] == "hub"
    extremes = graph.degree_extremes(degree, 3).collect()
    assert [r["tx_id"] for r in extremes if r["extreme"] == "hub"] == ["hub"] and len(extremes) == 4
