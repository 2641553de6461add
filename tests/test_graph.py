"""Graph measures against plain Python on random graphs, and small graphs worked out by hand."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from specweave.operators import communities as C
from specweave.operators import graph as G


def brute(edges, n):
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def bfs(near, s):
    dist, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for u in near[v]:
            if u not in dist:
                dist[u], paths[u] = dist[v] + 1, 0
                queue.append(u)
            if dist[u] == dist[v] + 1:
                paths[u] += paths[v]
    return dist, paths, order


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(24)})
    nodes = spark.createDataFrame([(v, "port" if v % 2 else "module", f"n{v}") for v in range(16)], "node_id long, type string, name string")
    pairs = spark.createDataFrame(edges, "a long, b long").withColumns({"relation": F.lit("drives"), "relationship": F.lit(None).cast("string")})
    return nodes, pairs, brute(edges, 16), edges


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_triangle_with_tail(spark):
    nodes = spark.createDataFrame([(x, "t", x) for x in "abcd"], "node_id string, type string, name string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "a string, b string")
    assert column(G.clustering(nodes, pairs), "node_id", "clustering") == pytest.approx({"a": 1, "b": 1, "c": 1 / 3, "d": 0})
    assert G.density(nodes, pairs).first()["density"] == pytest.approx(2 / 3)
    between = column(G.betweenness(nodes, pairs), "node_id", "betweenness")
    assert between["c"] > 0 and between["a"] == between["b"] == between["d"] == 0


def test_parallel_edges(spark):
    e = spark.createDataFrame([("a", "b", 1, "x"), ("a", "b", 2, "y"), ("b", "a", 3, None), ("c", "c", 4, "z")], "src string, dst string, edge_seq long, relation string")
    got = {(r["a"], r["b"]): (r["relation"], r["n_edges"]) for r in G.undirected(e, "relation").collect()}
    assert got == {("a", "b"): ("y", 3), ("c", "c"): ("z", 1)}
    assert column(G.degrees(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node_id string"), G.undirected(e)), "node_id", "degree") == {"a": 1, "b": 1, "c": 2, "d": 0}


def test_clustering_and_centralities(random_graph):
    nodes, pairs, near, _ = random_graph
    n = len(near)
    want = {v: (2 * sum(1 for x, y in itertools.combinations(near[v], 2) if y in near[x]) / (len(near[v]) * (len(near[v]) - 1)) if len(near[v]) > 1 else 0) for v in near}
    assert column(G.clustering(nodes, pairs), "node_id", "clustering") == pytest.approx(want)
    close, between = {}, dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = bfs(near, s)
        total = sum(dist.values())
        close[s] = (len(dist) - 1) / total * (len(dist) - 1) / (n - 1) if total else 0
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if dist.get(u) == dist[v] + 1:
                    dep[v] += paths[v] / paths[u] * (1 + dep[u])
            if v != s:
                between[v] += dep[v]
    assert column(G.closeness(nodes, pairs), "node_id", "closeness") == pytest.approx(close)
    assert column(G.betweenness(nodes, pairs), "node_id", "betweenness") == pytest.approx({v: b / ((n - 1) * (n - 2)) for v, b in between.items()})


def test_paths_and_cycles(random_graph):
    nodes, pairs, near, _ = random_graph
    starts = nodes.where("node_id in (0, 1)").select(F.col("node_id").alias("start"))

    def walk(path, depth):
        if len(path) > 1:
            yield tuple(path)
        if len(path) <= depth:
            for u in near[path[-1]]:
                if u not in path:
                    yield from walk([*path, u], depth)

    got = {tuple(r["path"]) for r in G.simple_paths(pairs, starts, 3).collect()}
    assert got == {p for s in (0, 1) for p in walk([s], 3)}
    cyc = {p for s in near for p in walk([s], 4) if 3 <= len(p) <= 5 and p[0] in near[p[-1]] and p[0] == min(p) and p[1] < p[-1]}
    assert {tuple(r["cycle"]) for r in G.cycles(pairs, 5).collect()} == cyc
    through = {tuple(r["cycle"]) for r in G.cycles(pairs, 5, starts).collect()}
    assert through == {c for c in cyc if {0, 1} & set(c)}


def test_path_metrics(random_graph):
    nodes, pairs, near, edges = random_graph
    starts = nodes.where("node_id = 0").select(F.col("node_id").alias("start"))
    rows = G.path_metrics(G.simple_paths(pairs, starts, 3), nodes, pairs).collect()
    for r in rows:
        p = set(r["path"])
        m = sum(a in p and b in p for a, b in edges)
        local = {v: near[v] & p for v in p}
        c = sum(2 * sum(1 for x, y in itertools.combinations(local[v], 2) if y in near[x]) / (len(local[v]) * (len(local[v]) - 1)) if len(local[v]) > 1 else 0 for v in p) / len(p)
        assert r["edge_density"] == pytest.approx(2 * m / (len(p) * (len(p) - 1)))
        assert r["path_clustering"] == pytest.approx(c)
        assert r["mean_degree"] == pytest.approx(sum(len(near[v]) for v in p) / len(p))


def test_expansion_stops_after_a_level(random_graph):
    nodes, pairs, near, _ = random_graph
    starts = nodes.where("node_id = 0").select(F.col("node_id").alias("start"))
    got = {r["node"]: r["dist"] for r in G.expansion(pairs, starts, 4, 2).collect()}
    assert got == {0: 0} | {v: 1 for v in near[0]}


def test_endpoints(random_graph):
    nodes, pairs, *_ = random_graph
    starts = nodes.where("node_id in (0, 1)").select(F.col("node_id").alias("start"))
    got = G.endpoints(nodes, pairs, starts, most=5).collect()
    assert got and all(r["start"] != r["node"] for r in got)
    assert max(sum(r["start"] == s for r in got) for s in (0, 1)) <= 5


def test_greedy_modularity():
    two = [(a, b) for a, b in itertools.combinations(range(5), 2)] + [(a, b) for a, b in itertools.combinations(range(5, 10), 2)] + [(0, 5)]
    assert C.greedy_modularity(two) == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 10), 5)}


def test_communities(spark, random_graph):
    nodes, pairs, *_ = random_graph
    for found in (C.modularity_communities(nodes, pairs), C.label_propagation(nodes, pairs)):
        assert found.count() == 16 and found.where("node_id = community").count() >= 2
    with pytest.raises(ValueError):
        C.modularity_communities(nodes, pairs, largest=3)


def test_node_connectivity():
    assert C.node_connectivity([(0, 1), (1, 2)], [0, 1, 2]) == 1
    assert C.node_connectivity(list(itertools.combinations(range(4), 2)), [0, 1, 2, 3]) == 3
    assert C.node_connectivity([(0, 1), (1, 2), (2, 3), (3, 0)], [0, 1, 2, 3]) == 2


def test_walks(random_graph):
    nodes, pairs, near, _ = random_graph
    signals = nodes.where("type = 'port'").select(F.col("name").alias("signal"), "node_id")
    starts = nodes.where("node_id = 0").select(F.col("node_id").alias("start"))
    make = lambda: C.guided_walks(nodes, pairs, signals, starts, ["n1", "n3", "n5"], walks=8, budget=20)
    one, two = (sorted((r["walk_id"], tuple(r["path"]), tuple(r["discovered"])) for r in make().collect()) for _ in range(2))
    assert one == two and len(one) == 8
    assert all(len(p) <= 21 and p[0] == 0 for _, p, _ in one)
    ranked = C.ranked_walks(C.walk_quality(make(), nodes, pairs), 3).collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: r["rank"])] == list(range(1, len(ranked) + 1))
    assert all(0 <= r["edge_quality"] <= 1 for r in ranked)


def test_gateways(spark):
    p = spark.createDataFrame([("s", "t", ["s", "x", "y", "t"]), ("s", "u", ["s", "x", "u"]), ("s", "v", ["s", "v"])], "source string, target string, path array<string>")
    got = {(r["target"], r["node"]): (r["score"], r["rank"]) for r in G.gateways(p).collect()}
    assert got == {("t", "x"): (1.0, 1), ("t", "y"): (0.5, 2), ("u", "x"): (1.0, 1)}


def metrics(spark, run, name="number of output rows"):
    """The values of a metric in all operators of the queries that ``run`` starts."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    n = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    out, done = {}, store.executionsList(n, 1000)
    for e in [done.apply(i) for i in range(done.size())]:
        values, found = store.executionMetrics(e.executionId()), e.metrics()
        for m in [found.apply(i) for i in range(found.size())]:
            if m.name() == name and values.contains(m.accumulatorId()):
                out[m.accumulatorId()] = int(values.apply(m.accumulatorId()).replace(",", ""))
    return list(out.values())


def test_triangles_make_no_table_of_wedges(spark):
    # 60 low nodes linked to 60 high ones each, and the high ones to a hub: 106,200 wedges at the low nodes, no triangle but one
    edges = [(f"p{i}", f"s{j}") for i in range(60) for j in range(60)] + [("n", f"s{j}") for j in range(60)] + [("n", f"c{j}") for j in range(30)] + [("n", "p0")]
    high = [(f"s{j}", f"d{j}_{i}") for j in range(60) for i in range(9)]
    pairs = spark.createDataFrame([(min(e), max(e)) for e in edges + high], "a string, b string")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    got = []
    assert max(metrics(spark, lambda: got.extend(G.clustering(nodes, pairs).where("tri > 0").collect()))) < 40_000
    assert {r["node_id"]: (r["degree"], r["tri"]) for r in got} == {"n": (91, 60), "p0": (61, 60)} | {f"s{j}": (70, 1) for j in range(60)}
