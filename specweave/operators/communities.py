"""Communities, motifs scored by them, and seeded guided walks.

Louvain and label propagation scale with the graph. Greedy modularity and node connectivity have no set-oriented form; they run on one
bounded graph a group, and refuse larger ones instead of cutting them.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict, deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.operators import graph as G
from specweave.scratch import discard, small_batches, written

LARGEST = 200_000  # edges that one task may hold
MOST_SENT = 1 << 22  # nodes whose communities are sent to all tasks, 64 MB


def label_propagation(nodes: DataFrame, pairs: DataFrame, rounds: int = 10) -> DataFrame:
    """(node_id, community): each node takes the commonest label around it, the least of several; a fixed number of rounds."""
    steps = written(G.both_ways(pairs.where("a <> b")).distinct(), "lp-steps")
    labels = nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("label"))
    for _ in range(rounds):
        votes = steps.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
        labels = written(labels.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label")), "lp")
    return labels.select(F.col("node").alias("node_id"), F.col("label").alias("community"))


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node_id, num) with numbers from 0 in order of the ids, and how many. Written."""
    apart = written(nodes.select("node_id").distinct().orderBy("node_id").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "louvain-order")
    parts = sorted(apart.groupBy("_p").agg(F.min("_i"), F.count("*")).collect())  # one row a partition
    before, shifts = 0, []
    for p, least, n in parts:
        shifts.append((p, before - least))
        before += n
    shift = nodes.sparkSession.createDataFrame(shifts, "_p int, _by long")
    out = written(apart.join(F.broadcast(shift), "_p").select("node_id", (F.col("_i") + F.col("_by")).alias("num")), "louvain-nodes")
    discard(apart)
    return out, before


def _number_links(pairs: DataFrame, numbers: DataFrame) -> tuple[DataFrame, int, bool]:
    """(node, other, w) of different pairs both ways, by number; how many; whether all ends have a number."""
    num = lambda e, to: numbers.select(F.col("node_id").alias(e), F.col("num").alias(to))
    half = written(pairs.where("a <> b").select("a", "b").distinct().join(num("a", "x"), "a", "left").select("x", "b"), "louvain-half")
    flat = half.join(num("b", "y"), "b").where("x is not null")
    ways = F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other")))
    links = written(flat.select(F.explode(ways).alias("e")).select("e.*", F.lit(1.0).alias("w")), "louvain")
    ends, n = links.count(), half.count()
    discard(half)
    return links, ends, ends == 2 * n


def best_moves(node, k, counts, other, w, label, total, ends: float):
    """(nodes, communities they move to) of nodes with weights ``k`` and ``counts`` links each to ``other`` of weight ``w``."""
    own, rows = label[node], np.arange(len(node))
    row, c, into = np.concatenate([np.repeat(rows, counts), rows]), np.concatenate([label[other], own]), np.concatenate([w, np.zeros(len(node))])
    order = np.argsort(row * len(label) + c, kind="stable")
    row, c = row[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (c[1:] != c[:-1])]))
    into, row, c = np.add.reduceat(into[order], first), row[first], c[first]
    home = c == own[row]
    gain = np.floor((into - k[row] * (total[c] - np.where(home, k[row], 0.0)) / ends) * 1e9 + 0.5)
    most = np.maximum.reduceat(gain, np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])))
    top = np.flatnonzero(gain == most[row])
    top = top[np.concatenate([[True], row[top[1:]] != row[top[:-1]]])]  # the least community of several
    moves = most > gain[home]
    return node[moves], c[top][moves]


def _may(seed: int, level: int, turn: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit(turn), F.col("node")), F.lit(2)) == 0


def _labels_sent(links: DataFrame, degree: DataFrame, n: int, ends: int, level: int, rounds: int, seed: int) -> np.ndarray:
    """Community of each number after the rounds of a level; communities and their weights go to the tasks as arrays."""
    spark = links.sparkSession
    found = degree.toArrow()
    k, label = np.zeros(n), np.arange(n)
    k[found.column("node").to_numpy()] = found.column("k").to_numpy()
    lists = links.where("node <> other").groupBy("node").agg(F.collect_list(F.struct("other", "w")).alias("l"))
    near = written(lists.join(degree, "node").select("node", "k", F.col("l.other").alias("other"), F.col("l.w").alias("w")), "louvain-near")
    still = 0
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((label, np.bincount(label, k, n)))

        def run(batches, sent=sent):
            label, total = sent.value
            for batch in batches:
                node, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                counts = np.diff(batch.column(2).offsets.to_numpy())
                ends_at = np.cumsum(counts)
                at = 0
                while at < len(node):  # a million links at a time, or one node's
                    to = max(at + 1, int(np.searchsorted(ends_at, (ends_at[at - 1] if at else 0) + (1 << 20), "right")))
                    other, w = (batch.column(i).slice(at, to - at).flatten().to_numpy() for i in (2, 3))
                    moved = best_moves(node[at:to], k[at:to], counts[at:to], other, w, label, total, float(ends))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in moved], ["node", "c"])
                    at = to

        with small_batches(spark):
            moved = near.where(_may(seed, level, turn)).mapInArrow(run, "node long, c long").toArrow()
        sent.destroy()
        label = label.copy()
        label[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
        still = 0 if moved.num_rows else still + 1
        if still == 3:  # every node had its turn, most likely several
            break
    discard(near)
    return label


def _labels_joined(links: DataFrame, degree: DataFrame, ends: int, level: int, rounds: int, seed: int) -> DataFrame:
    """(node, c) after the rounds of a level, as joins."""
    labels, still = written(degree.select("node", "k", F.col("node").alias("c")), "louvain-labels"), 0
    outer = links.where("node <> other")
    for turn in range(rounds):
        total = labels.groupBy("c").agg(F.sum("k").alias("total"))
        own = labels.where(_may(seed, level, turn)).select("node", "k", F.col("c").alias("own"))
        into = outer.where(_may(seed, level, turn)).join(labels.select(F.col("node").alias("other"), "c"), "other").groupBy("node", "c").agg(F.sum("w").alias("into"))
        stay = own.select("node", F.col("own").alias("c"), F.lit(0.0).alias("into"))
        choice = into.unionByName(stay).groupBy("node", "c").agg(F.sum("into").alias("into")).join(total, "c").join(own, "node")
        gain = F.col("into") - F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.lit(float(ends))
        choice = choice.withColumn("gain", F.floor(gain * 1e9 + 0.5))
        best = choice.groupBy("node").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("now"), F.max("gain").alias("most"), F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("to"))
        moved = best.where("most > now").select("node", "to")
        new = labels.join(moved, "node", "left").select("node", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved"))
        before, labels = labels, written(new, "louvain-labels")
        discard(before)
        still = still + 1 if labels.where("moved").isEmpty() else 0
        if still == 3:
            break
    return labels.select("node", "c")


def louvain(nodes: DataFrame, pairs: DataFrame, levels: int = 8, rounds: int = 12, seed: int = 0, most_sent: int = MOST_SENT) -> DataFrame:
    """(node_id, community): modularity raised by moving nodes, then by moving whole communities, level by level.

    In a round a hash picks half of the nodes; each of them moves to the community around it with the largest gain, the least of
    several. So neighbours seldom swap places, and reruns agree. A community is named by its least member; isolated nodes are alone.
    Nodes are numbered first. With up to ``most_sent`` of them the communities go to all tasks as two arrays, and a round reads the links where
    they are; with more, a round is joins. The moves are the same.
    """
    known, (numbers, n) = nodes.select("node_id").distinct(), _numbered(nodes)
    links, ends, whole = _number_links(pairs, numbers)
    if not whole:  # ends that are no nodes take part, but get no row
        discard(links, numbers)
        numbers, n = _numbered(known.union(pairs.where("a <> b").select(F.explode(F.array("a", "b")))))
        links, ends, _ = _number_links(pairs, numbers)
    home = numbers if whole else numbers.join(known, "node_id", "left_semi")
    home = written(home.select("num", F.col("num").alias("c")), "louvain-homes")
    for level in range(levels if ends else 0):
        degree = written(links.groupBy("node").agg(F.sum("w").alias("k")), "louvain-degrees")
        if n <= most_sent:
            label = _labels_sent(links, degree, n, ends, level, rounds, seed)
            sent = numbers.sparkSession.sparkContext.broadcast(label)
            pick = lambda *at: lambda batches: (pa.RecordBatch.from_arrays([pa.array(sent.value[c.to_numpy()]) if i in at else c for i, c in enumerate(b.columns)], names=b.schema.names) for b in batches)  # noqa: B023, E731
            next_home = written(home.mapInArrow(pick(1), "num long, c long"), "louvain-homes")
            done = bool((label == np.arange(n)).all())
            ends_of = links.mapInArrow(pick(0, 1), "node long, other long, w double")
        else:
            merged = _labels_joined(links, degree, ends, level, rounds, seed)
            next_home = written(home.join(merged.select(F.col("node").alias("c"), F.col("c").alias("n")), "c", "left").select("num", F.coalesce("n", "c").alias("c")), "louvain-homes")
            done = merged.where("node <> c").isEmpty()
            ends_of = links.join(merged, "node").join(merged.select(F.col("node").alias("other"), F.col("c").alias("d")), "other").select(F.col("c").alias("node"), F.col("d").alias("other"), "w")
        discard(home, degree)
        home = next_home
        if done:
            break
        before, links = links, written(ends_of.groupBy("node", "other").agg(F.sum("w").alias("w")), "louvain")
        discard(before)
        if n <= most_sent:
            sent.destroy()
    least = home.groupBy("c").agg(F.min("num").alias("least"))  # the least number is the least id
    named = home.join(least, "c").select("num", "least").join(numbers, "num").select("node_id", "least")
    named = named.join(numbers.select(F.col("node_id").alias("community"), F.col("num").alias("least")), "least").drop("least")
    found = written(nodes.select("node_id").join(named, "node_id"), "louvain-found")
    discard(home, links, numbers)
    return found


def modularity(pairs: DataFrame, communities: DataFrame) -> float:
    """Share of edges inside communities less that expected by degrees."""
    flat = pairs.where("a <> b").select("a", "b").distinct()
    m = flat.count()
    c = lambda x: communities.select(F.col("node_id").alias(x), F.col("community").alias("c" + x))
    inside = flat.join(c("a"), "a").join(c("b"), "b").where("ca = cb").count()
    ends = G.both_ways(flat).join(communities, F.col("node") == F.col("node_id")).groupBy("community").agg(F.count("*").alias("d"))
    return (inside / m - (ends.agg(F.sum(F.pow("d", F.lit(2.0)))).first()[0] or 0.0) / (4 * m * m)) if m else 0.0


def greedy_modularity(edges: list[tuple]) -> dict:
    """Node -> least member of its community, merging the pair with the largest gain in modularity while there is one."""
    near: dict = defaultdict(dict)
    for a, b in edges:
        if a != b:
            near[a][b] = near[b][a] = 1.0
    m = sum(len(x) for x in near.values()) / 2
    weight = {v: len(x) / (2 * m) for v, x in near.items()} if m else {}
    gain = {v: {u: 1 / m - 2 * weight[v] * weight[u] for u in x} for v, x in near.items()}
    heap = [(-g, min(v, u), max(v, u)) for v, x in gain.items() for u, g in x.items() if v < u]
    heapq.heapify(heap)
    group = {v: [v] for v in near}
    while heap:
        g, a, b = heapq.heappop(heap)
        if a not in gain or gain[a].get(b) != -g:
            continue
        if -g <= 1e-12:
            break
        for c in {*gain[a], *gain[b]} - {a, b}:
            if c in gain[a] and c in gain[b]:
                new = gain[a][c] + gain[b][c]
            elif c in gain[a]:
                new = gain[a][c] - 2 * weight[b] * weight[c]
            else:
                new = gain[b][c] - 2 * weight[a] * weight[c]
            gain[a][c] = gain[c][a] = new
            gain[c].pop(b, None)
            heapq.heappush(heap, (-new, min(a, c), max(a, c)))
        gain[a].pop(b, None)
        del gain[b]
        weight[a] += weight.pop(b)
        group[a] += group.pop(b)
    return {v: min(x) for x in group.values() for v in x}


def modularity_communities(nodes: DataFrame, pairs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(node_id, community) by greedy modularity, in one task, of a graph of at most ``largest`` edges; isolated nodes alone."""
    own = pairs.select("a", "b")
    total = pairs.count()
    if total > largest:
        raise ValueError(f"greedy modularity takes at most {largest} edges; use louvain")
    kind = dict(nodes.dtypes)["node_id"]

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        found = greedy_modularity(list(zip(frame["a"], frame["b"], strict=True)))
        return pd.DataFrame({"node_id": list(found), "community": list(found.values())})

    # modularity depends on the whole graph's edge count, so the components are merged in one group
    found = own.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(merge, f"node_id {kind}, community {kind}")
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("community", "node_id").alias("community"))


def community_contexts(nodes: DataFrame, pairs: DataFrame, communities: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, community, size, score): mean of the community's share of the graph and the start's centrality inside."""
    size = communities.groupBy("community").agg(F.count("*").alias("size"))
    mine = communities.join(starts, F.col("node_id") == F.col("start")).select("start", "community").join(size, "community")
    other = communities.select(F.col("node_id").alias("other"), F.col("community").alias("oc"))
    inside = G.both_ways(pairs).distinct().join(communities.withColumnRenamed("node_id", "node"), "node").join(other, "other").where("community = oc").groupBy(F.col("node").alias("start")).agg(F.count("*").alias("d"))
    n = nodes.agg(F.count("*").alias("total"))
    central = F.when(F.col("size") > 1, F.coalesce("d", F.lit(0)) / (F.col("size") - 1)).otherwise(1.0)
    return mine.join(inside, "start", "left").crossJoin(F.broadcast(n)).select("start", "community", "size", ((F.col("size") / F.col("total") + central) / 2).alias("score"))


def fallback_contexts(pairs: DataFrame, starts: DataFrame, most: int = 20, score: float = 0.4) -> DataFrame:
    """(start, node, score): a start and its first neighbours, for starts without a community."""
    near = G.both_ways(pairs).distinct().join(starts, F.col("node") == F.col("start")).withColumn("r", F.row_number().over(W.partitionBy("start").orderBy("other"))).where(F.col("r") <= most)
    return starts.select("start", F.col("start").alias("node")).union(near.select("start", F.col("other").alias("node"))).distinct().withColumn("score", F.lit(score))


def dense_motifs(nodes: DataFrame, pairs: DataFrame, communities: DataFrame, starts: DataFrame, least: int = 3, density: float = 0.5) -> DataFrame:
    """(start, community, size, density): communities of starts that are large and dense enough."""
    members = communities.select(F.col("community"), F.col("node_id").alias("node"))
    stats = G.group_metrics(members, pairs, nodes, "community").where((F.col("n") >= least) & (F.col("density") > density))
    return communities.join(starts, F.col("node_id") == F.col("start")).select("start", "community").join(stats.select("community", F.col("n").alias("size"), "density"), "community").select("start", "community", "size", "density")


def node_connectivity(edges: list[tuple], nodes: list) -> float:
    """Mean over pairs of nodes of the number of node-disjoint paths between them, by unit max-flow on split nodes."""
    near: dict = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def flow(s, t) -> int:
        used, total = set(), 0
        if t in near[s]:
            total += 1
        while True:
            start, parent, queue = (s, 1), {(s, 1): None}, deque([(s, 1)])
            hit = None
            while queue and hit is None:
                v, side = queue.popleft()
                steps = []
                if side == 1:
                    steps += [(u, 0) for u in near[v] if not ({v, u} == {s, t}) and ((v, 1), (u, 0)) not in used]
                    if ((v, 0), (v, 1)) in used:
                        steps.append((v, 0))
                else:
                    if ((v, 0), (v, 1)) not in used:
                        steps.append((v, 1))
                    steps += [(u, 1) for u in near[v] if ((u, 1), (v, 0)) in used]
                for nxt in steps:
                    if nxt not in parent:
                        parent[nxt] = (v, side)
                        if nxt == (t, 0):
                            hit = nxt
                            break
                        if nxt[0] != s:
                            queue.append(nxt)
            if hit is None:
                return total
            while parent[hit] is not None:
                before = parent[hit]
                if (hit, before) in used:
                    used.discard((hit, before))
                else:
                    used.add((before, hit))
                hit = before
            assert hit == start
            total += 1

    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]
    return sum(flow(a, b) for a, b in pairs) / len(pairs) if pairs else 0.0


def motif_importance(members: DataFrame, nodes: DataFrame, pairs: DataFrame, largest: int = 2_000) -> DataFrame:
    """(motif, structural, connectivity, centrality, importance) of ``members(motif, node)``.

    structural: mean of density, average degree inside and average node connectivity (motifs of at most ``largest`` edges);
    connectivity: share of all edge ends; centrality: mean of degree, betweenness and closeness centrality.
    """
    inside = G.induced(members, pairs, "motif")
    stats = G.group_metrics(members, pairs, nodes, "motif")
    kind = dict(members.dtypes)["motif"]

    def connect(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > largest:
            raise ValueError(f"motif {key[0]} has {len(frame)} edges; the most is {largest}")
        e = list(zip(frame["a"], frame["b"], strict=True))
        return pd.DataFrame({"motif": [key[0]], "conn": [node_connectivity(e, sorted({x for p in e for x in p}))], "linked": [len({x for p in e for x in p})]})

    conn = inside.groupBy("motif").applyInPandas(connect, f"motif {kind}, conn double, linked long")
    joined = stats.join(conn, "motif", "left")
    # nodes without an edge inside have no paths: scale from linked pairs to all pairs
    all_pairs = F.col("n") * (F.col("n") - 1)
    mean_conn = F.when(all_pairs > 0, F.coalesce("conn", F.lit(0.0)) * F.coalesce("linked", F.lit(0)) * (F.coalesce("linked", F.lit(0)) - 1) / all_pairs).otherwise(0.0)
    structural = (F.col("density") + 2.0 * F.col("m") / F.col("n") + mean_conn) / 3
    deg = G.degrees(nodes, pairs)
    central = G.degree_centrality(nodes, pairs).join(G.betweenness(nodes, pairs), "node_id").join(G.closeness(nodes, pairs), "node_id").join(deg, "node_id")
    total = pairs.agg(F.count("*").alias("edges"))
    per = members.join(central.withColumnRenamed("node_id", "node"), "node").groupBy("motif").agg(((F.avg("centrality") + F.avg("betweenness") + F.avg("closeness")) / 3).alias("centrality"), F.sum("degree").alias("ends"))
    out = joined.join(per, "motif").crossJoin(F.broadcast(total)).withColumn("structural", structural)
    out = out.withColumn("connectivity", F.least(F.lit(1.0), F.when(F.col("edges") > 0, F.col("ends") / (2 * F.col("edges"))).otherwise(0.0)))
    return out.select("motif", "structural", "connectivity", "centrality", ((F.col("structural") + F.col("connectivity") + F.col("centrality")) / 3).alias("importance"))


#: What a relation is worth on a walk.
RELATION_WORTH = {"assigns": 1.0, "drives": 1.0, "connects": 1.0, "contains": 0.8, "has_port": 0.8}
OTHER_WORTH = 0.5


def guided_walks(nodes: DataFrame, pairs: DataFrame, signal_nodes: DataFrame, starts: DataFrame, targets: list[str], walks: int = 70, budget: int = 100, teleport: float = 0.1, alpha: float = 0.3, beta: float = 0.5, gamma: float = 0.2, most_targets: int = 10, seed: int = 0, radius: int = 6) -> DataFrame:
    """(start, walk_id, path, discovered): seeded walks that lean towards nodes of target signals.

    Each start's neighbourhood within ``radius`` is a group, with the importance and signal of its nodes and a shortest path to each
    signal. All walks of a start step at once, as arrays: every walk's edges get the key -ln(u) / w, and the least one is
    taken, which is a draw by the weights w. ``nodes`` needs type; ``signal_nodes(signal, node_id)``.
    """
    near = written(G.distances(pairs, starts, radius).select("start", "node"), "walk-near")
    importance = G.node_importance(nodes, pairs).select(F.col("node_id").alias("node"), "importance")
    signal = signal_nodes.groupBy(F.col("node_id").alias("node")).agg(F.max("signal").alias("signal"))
    routes = G.shortest_paths(pairs, starts, radius).select("start", "node", "path")
    kind, absent = dict(pairs.dtypes)["a"], lambda t: F.lit(None).cast(t)
    about = near.join(importance, "node").join(signal, "node", "left").join(routes, ["start", "node"], "left")
    about = about.select("start", F.col("node").alias("a"), absent(kind).alias("b"), "importance", "signal", F.when(F.col("signal").isNotNull(), F.col("path")).alias("path"))
    edges = G.induced(near, pairs).where("a <> b").select("start", "a", "b", absent("double").alias("importance"), absent("string").alias("signal"), absent(f"array<{kind}>").alias("path"))
    goals = sorted(targets)

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _walked(key[0], frame, goals, walks, budget, teleport, (alpha, beta, gamma), most_targets, seed)

    return about.unionByName(edges).groupBy("start").applyInPandas(walk, f"start {kind}, walk_id int, path array<{kind}>, discovered array<string>")


def _walked(start, frame: pd.DataFrame, goals: list[str], walks: int, budget: int, teleport: float, lean: tuple[float, float, float], most_targets: int, seed: int) -> pd.DataFrame:
    draw = np.random.default_rng(zlib.crc32(f"{seed}|{start}".encode()))
    info = frame[frame["b"].isna()].sort_values("a", ignore_index=True)
    names, n = info["a"].tolist(), len(info)
    place = {x: i for i, x in enumerate(names)}
    own = frame[frame["b"].notna()]
    ends = np.array([(place[x], place[y]) for x, y in zip(own["a"], own["b"], strict=True)], np.int64).reshape(-1, 2)
    ends = np.unique(np.concatenate([ends, ends[:, ::-1]]), axis=0)
    first = np.searchsorted(ends[:, 0], np.arange(n + 1))
    worth = info["importance"].fillna(0.1).to_numpy(float)
    goal_of = np.array([goals.index(s) if isinstance(s, str) and s in goals else -1 for s in info["signal"]])
    home = info["signal"][place[start]]
    at_home_node = np.array([isinstance(home, str) and s == home for s in info["signal"]])
    # for each goal: the first steps of shortest paths to it, and the inner nodes that most paths share
    routes = [[place[x] for x in p] for p in info["path"] if p is not None and len(p) > 1]
    hits = np.bincount([x for p in routes for x in p[1:-1]], minlength=n)
    step_to, doors = np.zeros((len(goals), n), bool), np.zeros((len(goals), n), bool)
    for p in routes:
        if (g := goal_of[p[-1]]) >= 0:
            step_to[g, p[1]] = True
            doors[g, sorted(p[1:-1], key=lambda x: (-hits[x], x))[:5]] = True
    left = np.zeros((walks, len(goals)), bool)
    for w in range(walks):
        left[w, draw.permutation(len(goals))[:most_targets]] = True
    here, all_ = np.full(walks, place[start]), np.arange(walks)
    seen = np.zeros((walks, n), bool)
    seen[:, place[start]] = True
    paths, found = [[start] for _ in all_], [[] for _ in all_]
    for _ in range(budget):
        go = all_[left.any(1) & (first[here + 1] > first[here])]
        if not len(go):
            break
        size = first[here[go] + 1] - first[here[go]]
        head = np.cumsum(size) - size
        who = np.repeat(go, size)
        to = ends[np.arange(len(who)) - np.repeat(head - first[here[go]], size), 1]
        new, inside = ~seen[who, to], at_home_node[here[who]]
        toward = (left[who] & step_to[:, to].T).sum(1) / left[who].sum(1) * inside
        weight = np.maximum(0.01, lean[0] * worth[to] + lean[1] * toward + lean[2] * new)
        cost = -np.log(1 - draw.random(len(who))) / weight
        cost += np.where(new, 0, cost.max() + 1)  # what was visited comes after all that was not
        pick = np.lexsort((cost, who))[head]
        target = to[pick]
        open_ = (left[go].astype(int) @ doors.astype(int) > 0) & ~seen[go]
        jump = (draw.random(len(go)) < teleport) & at_home_node[here[go]] & open_.any(1)
        target = np.where(jump, np.argmax(np.where(open_, draw.random(open_.shape), -1), axis=1), target)
        here[go], seen[go, target] = target, True
        for w, t in zip(go.tolist(), target.tolist(), strict=True):
            paths[w].append(names[t])
            if (g := goal_of[t]) >= 0 and left[w, g]:
                left[w, g] = False
                found[w].append(goals[g])
    return pd.DataFrame({"start": [start] * walks, "walk_id": np.arange(walks, dtype=np.int32), "path": paths, "discovered": found})


def walk_quality(walks: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``walks`` with diversity, importance, edge_quality and quality. pairs: with ``relationship`` and ``relation``."""
    worth = F.create_map(*[F.lit(x) for kv in RELATION_WORTH.items() for x in kv])
    relation = F.coalesce("relationship", "relation")
    edges = pairs.select("a", "b", F.coalesce(F.try_element_at(worth, F.coalesce(relation, F.lit(""))), F.lit(OTHER_WORTH)).alias("worth"))
    keyed = walks.withColumn("length", F.size("path"))
    on = keyed.select("start", "walk_id", F.posexplode("path").alias("pos", "node"))
    imp = G.node_importance(nodes, pairs).join(nodes.select("node_id", "type"), "node_id").withColumnRenamed("node_id", "node")
    by_node = on.join(imp, "node").groupBy("start", "walk_id").agg(F.countDistinct("type").alias("types"), F.avg("importance").alias("importance"))
    hops = keyed.select("start", "walk_id", F.explode(F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("x"), F.get("path", i).alias("y"))))).alias("h"))
    hops = hops.select("start", "walk_id", F.least("h.x", "h.y").alias("a"), F.greatest("h.x", "h.y").alias("b"))
    by_edge = hops.join(edges, ["a", "b"]).groupBy("start", "walk_id").agg(F.avg("worth").alias("edge_quality"))
    out = keyed.join(by_node, ["start", "walk_id"]).join(by_edge, ["start", "walk_id"], "left").withColumn("edge_quality", F.coalesce("edge_quality", F.lit(0.0)))
    out = out.withColumn("diversity", F.col("types") / F.greatest(F.lit(5.0), F.col("length") / 2.0))
    return out.withColumn("quality", 0.3 * F.col("diversity") + 0.3 * F.col("importance") + 0.4 * F.col("edge_quality")).drop("types")


def ranked_walks(scored: DataFrame, n_targets: int, keep: int = 50) -> DataFrame:
    """Distinct paths a start, those that discover nothing dropped unless none does, by 10 * found + quality + 1 / length."""
    first = scored.withColumn("r", F.row_number().over(W.partitionBy("start", "path").orderBy("walk_id"))).where("r = 1").drop("r")
    found = F.size("discovered")
    best = F.max(found).over(W.partitionBy("start"))
    kept = first.withColumn("best", best).where((found > 0) | (F.col("best") == 0)).drop("best")
    rank = F.row_number().over(W.partitionBy("start").orderBy(F.desc(10 * found + F.col("quality") + 1.0 / F.col("length")), "walk_id"))
    score = 0.6 * found / F.greatest(F.lit(1), F.lit(n_targets)) + 0.4 * F.col("quality")
    return kept.withColumn("rank", rank).where(F.col("rank") <= keep).withColumn("score", score)
