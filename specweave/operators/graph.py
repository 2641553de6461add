"""Property graphs as tables: nodes(node_id, type, name, ...) and edges(src, dst, edge_seq, relation, ...).

Measures are those of the undirected simple graph: one edge a pair of different nodes. Searches advance a whole frontier
at a time and write it to the scratch folder, so that plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.operators.components import components
from specweave.scratch import discard, written

HUB_RATIO = 1.5


def undirected(edges: DataFrame, *attributes: str) -> DataFrame:
    """(a, b, n_edges, attributes): a <= b, of parallel edges each attribute's latest value that is not null wins."""
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "edge_seq", *attributes)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edge_seq"))).alias(c) for c in attributes]
    return pair.groupBy("a", "b").agg(F.count("*").alias("n_edges"), *latest)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(node, other): each edge from both ends; a self-loop twice."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, degree), isolated nodes with 0."""
    n = both_ways(pairs).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(n, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def density(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (n, m, density, avg_degree)."""
    n, m = nodes.agg(F.count("*").alias("n")), pairs.agg(F.count("*").alias("m"))
    d = F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return n.crossJoin(m).select("n", "m", d.alias("density"), F.when(F.col("n") > 0, 2.0 * F.col("m") / F.col("n")).otherwise(0.0).alias("avg_degree"))


def _node_degrees(edges: DataFrame) -> DataFrame:
    """(node, d, num): degrees, and a number for each node, so that later steps move numbers instead of ids. Written."""
    d = both_ways(edges).groupBy("node").agg(F.count("*").alias("d"))
    return written(d.withColumn("num", F.monotonically_increasing_id()), "degrees")


def _triangles(edges: DataFrame, d: DataFrame) -> DataFrame:
    """(num, tri) of different pairs ``edges(a, b)`` with ``d`` of ``_node_degrees``."""
    end = lambda e: d.select(F.col("node").alias(e), F.col("d").alias("d" + e), F.col("num").alias("n" + e))
    half = written(edges.join(end("a"), "a").select("b", "da", "na"), "half")
    up = F.struct("da", "na") < F.struct("db", "nb")
    out = half.join(end("b"), "b").select(F.when(up, F.col("na")).otherwise(F.col("nb")).alias("x"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("y"))
    out = written(out, "arrows")
    discard(half)
    # an edge's third corners are ends of arrows from both its ends; those of the end with fewer arrows are tried
    fan = written(out.groupBy("x").agg(F.collect_list("y").alias("ends")).withColumn("n", F.size("ends")), "fans")
    sizes = fan.select("x", "n")
    open_ = out.join(sizes, "x").join(sizes.select(F.col("x").alias("y"), F.col("n").alias("m")), "y").where("n > 1")
    less = F.col("n") < F.col("m")
    turns = written(open_.select(F.when(less, F.col("x")).otherwise(F.col("y")).alias("by"), F.when(less, F.col("y")).otherwise(F.col("x")).alias("to")), "turns")
    tried = turns.join(fan.select(F.col("x").alias("by"), "ends"), "by").select("by", "to", F.explode("ends").alias("z")).where("z <> to")
    closed = tried.join(out.select(F.col("x").alias("to"), F.col("y").alias("z")), ["to", "z"])
    tri = closed.select(F.explode(F.array("by", "to", "z")).alias("num")).groupBy("num").agg(F.count("*").alias("tri"))
    tri = written(tri, "triangles")
    discard(out, fan, turns)
    return tri


def triangles(pairs: DataFrame) -> DataFrame:
    """(node, tri): triangles at each node. Edges point to the end of higher degree, so that hubs have few arrows; an edge tries the
    arrows of that end which has fewer, so that no table of all wedges is made."""
    edges = written(pairs.where("a <> b").select("a", "b"), "edges")
    d = _node_degrees(edges)
    return _triangles(edges, d).join(d, "num").select("node", "tri")


def clustering(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, degree, tri, clustering): self-loops do not count, fewer than two neighbours give 0."""
    edges = written(pairs.where("a <> b").select("a", "b"), "edges")
    d = _node_degrees(edges)
    at = d.join(_triangles(edges, d), "num", "left")
    discard(edges)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    t = nodes.select("node_id").join(at, F.col("node_id") == F.col("node"), "left").select("node_id", zero("d").alias("degree"), zero("tri"))
    c = F.when(F.col("degree") > 1, 2.0 * F.col("tri") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return t.select("node_id", "degree", "tri", c.alias("clustering"))


def degree_centrality(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    return degrees(nodes, pairs).crossJoin(F.broadcast(n)).select("node_id", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0).alias("centrality"))


def distances(pairs: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, dist) of all nodes within ``depth`` steps of ``starts(start)``, themselves included."""
    steps = both_ways(pairs).distinct()
    seen = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("dist")).distinct(), "bfs")
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        reached = front.join(steps, "node").select("start", F.col("other").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        front = written(reached.withColumn("dist", F.lit(level)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = written(seen, "bfs")
    return seen


def directed_distances(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, dist) along ``edges(src, dst)``; a start is at distance 0 from itself."""
    steps = written(edges.select("src", "dst").distinct(), "steps")
    seen = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("dist")).distinct(), "reach")
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        reached = front.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        front = written(reached.withColumn("dist", F.lit(level)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = written(seen, "reach")
    return seen


def _few_enough(nodes: DataFrame, most: int) -> None:
    if len(nodes.limit(most + 1).select(F.lit(1)).take(most + 1)) > most:
        raise ValueError(f"this measure has a row for each pair of nodes and takes at most {most} nodes; pass most_nodes to allow more")


def closeness(nodes: DataFrame, pairs: DataFrame, most_nodes: int = 20_000) -> DataFrame:
    """(node_id, closeness), scaled by the share of nodes that are reached. A row for each reachable pair; larger graphs are refused."""
    _few_enough(nodes, most_nodes)
    d = distances(pairs, nodes.select(F.col("node_id").alias("start"))).groupBy("start").agg(F.sum("dist").alias("total"), (F.count("*") - 1).alias("reached"))
    n = nodes.agg(F.count("*").alias("n"))
    c = F.when((F.col("total") > 0) & (F.col("n") > 1), F.col("reached") / F.col("total") * F.col("reached") / (F.col("n") - 1)).otherwise(0.0)
    return d.crossJoin(F.broadcast(n)).select(F.col("start").alias("node_id"), c.alias("closeness"))


def betweenness(nodes: DataFrame, pairs: DataFrame, most_nodes: int = 20_000) -> DataFrame:
    """(node_id, betweenness) by dependency accumulation over levels, all sources at once, as joins.

    Forward: numbers of shortest paths, level by level; backward: the dependencies. For exact values every node is a source, so
    the tables hold a row for each reachable pair: meant for neighbourhoods; larger graphs are refused.
    """
    _few_enough(nodes, most_nodes)
    steps = written(both_ways(pairs.where("a <> b")).distinct(), "steps")
    levels = [written(nodes.select(F.col("node_id").alias("s"), F.col("node_id").alias("node"), F.lit(1.0).alias("paths")), "paths")]
    seen = levels[0].select("s", "node")
    while True:
        nxt = levels[-1].join(steps, "node").groupBy("s", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        nxt = written(nxt.join(seen, ["s", "node"], "left_anti"), "paths")
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = written(seen.union(nxt.select("s", "node")), "seen")
    total, back = None, None
    for level in range(len(levels) - 1, 0, -1):
        here = levels[level]
        if back is None:
            here = here.withColumn("dep", F.lit(0.0))
        else:
            here = here.join(back, ["s", "node"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        here = written(here, "dep")
        own = here.select("node", "dep")
        total = own if total is None else total.union(own)
        up = here.join(steps, "node").select("s", F.col("other"), F.col("paths").alias("p"), "dep")
        before = levels[level - 1].select("s", F.col("node").alias("other"), F.col("paths").alias("q"))
        back = up.join(before, ["s", "other"]).groupBy("s", F.col("other").alias("node")).agg(F.sum(F.col("q") / F.col("p") * (1 + F.col("dep"))).alias("dep"))
    n = nodes.agg(F.count("*").alias("n"))
    summed = nodes.select("node_id").withColumn("dep", F.lit(0.0)) if total is None else nodes.select("node_id").join(total.groupBy(F.col("node").alias("node_id")).agg(F.sum("dep").alias("dep")), "node_id", "left")
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    return summed.crossJoin(F.broadcast(n)).select("node_id", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness"))


def global_metrics(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (n, m, density, avg_degree, avg_clustering)."""
    return density(nodes, pairs).crossJoin(clustering(nodes, pairs).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("avg_clustering")))


def node_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, component), isolated nodes alone."""
    own = components(pairs.select("a", "b")).withColumnRenamed("node", "node_id")
    return nodes.select("node_id").join(own, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def top_hubs(nodes: DataFrame, pairs: DataFrame, k: int = 5, samples: int = 5) -> DataFrame:
    """(node_id, degree, neighbours): the nodes of highest degree with their first neighbours."""
    top = degrees(nodes, pairs).orderBy(F.desc("degree"), "node_id").limit(k)
    near = both_ways(pairs).join(F.broadcast(top), F.col("node") == F.col("node_id"), "left_semi").distinct()
    near = near.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("other"))).where(F.col("r") <= samples)
    near = near.groupBy(F.col("node").alias("node_id")).agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
    return top.join(near, "node_id", "left")


def expansion(pairs: DataFrame, starts: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """(start, node, dist): levels around each start; the size cap is tested after a whole level."""
    near = distances(pairs, starts, depth)
    sizes = near.groupBy("start", "dist").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("start").orderBy("dist")))
    full = sizes.where(F.col("upto") >= most).groupBy("start").agg(F.min("dist").alias("last"))
    return near.join(full, "start", "left").where("last is null or dist <= last").select("start", "node", "dist")


def induced(members: DataFrame, pairs: DataFrame, key: str = "start") -> DataFrame:
    """(key, a, b): edges between members of the same group."""
    m = members.select(key, "node")
    one = pairs.select("a", "b").join(m.withColumnRenamed("node", "a"), "a")
    return one.join(m.withColumnRenamed("node", "b"), [key, "b"]).select(key, "a", "b").distinct()


def group_metrics(members: DataFrame, pairs: DataFrame, nodes: DataFrame, key: str = "start") -> DataFrame:
    """(key, n, m, density, types, avg_clustering) of each group's induced subgraph."""
    inside = written(induced(members, pairs, key), "induced")
    counts = members.join(nodes.select(F.col("node_id").alias("node"), "type"), "node", "left").groupBy(key).agg(F.countDistinct("node").alias("n"), F.countDistinct("type").alias("types"))
    m = inside.groupBy(key).agg(F.count("*").alias("m"))
    ways = inside.where("a <> b")
    ways = ways.select(key, "a", "b").union(ways.select(key, F.col("b"), F.col("a")))
    deg = ways.groupBy(key, F.col("a").alias("node")).agg(F.count("*").alias("d"))
    x, y, z = ways.alias("x"), ways.alias("y"), ways.alias("z")
    tri = (
        x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.a") != F.col("y.b")))
        .join(z, (F.col(f"x.{key}") == F.col(f"z.{key}")) & (F.col("y.b") == F.col("z.a")) & (F.col("z.b") == F.col("x.a")))
        .groupBy(F.col(f"x.{key}").alias(key), F.col("x.a").alias("node")).agg(F.count("*").alias("t2"))
    )
    local = deg.join(tri, [key, "node"], "left").withColumn("c", F.when(F.col("d") > 1, F.coalesce("t2", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0))
    c = local.groupBy(key).agg(F.sum("c").alias("c"))
    out = counts.join(m, key, "left").join(c, key, "left").withColumn("m", F.coalesce("m", F.lit(0)).cast("long"))
    dens = F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return out.select(key, "n", "m", dens.alias("density"), "types", (F.coalesce("c", F.lit(0.0)) / F.col("n")).alias("avg_clustering"))


def expansion_score(n="n", types="types", dens="density"):
    return F.least(F.lit(0.5), F.col(n) / 100.0) + F.least(F.lit(0.2), F.col(types) / 10.0) + F.least(F.lit(0.3), F.col(dens))


def endpoints(nodes: DataFrame, pairs: DataFrame, starts: DataFrame, hops: int = 3, most_near: int = 200, others: int = 20, most: int = 30, seed: int = 0) -> DataFrame:
    """(start, node): nodes worth a path from each start.

    Candidates are the neighbourhood and, where more than ``others`` nodes lie outside, that many of them in hash order.
    One is kept if its degree or clustering is above average, its degree above that of its neighbours on average, it is
    a port, module or assignment, or one name contains the other (both not empty). Beyond ``most``, hash order decides.
    """
    near = expansion(pairs, starts, hops, most_near + 1).select("start", "node")
    order = F.xxhash64("node_id", F.lit(seed))
    pool = nodes.select("node_id").orderBy(order, "node_id").limit(others + most_near * 4)  # enough that some lie outside
    outside = starts.select("start").distinct().crossJoin(F.broadcast(pool.select(F.col("node_id").alias("node")))).join(near, ["start", "node"], "left_anti")
    outside = outside.withColumn("r", F.row_number().over(W.partitionBy("start").orderBy(F.xxhash64("node", F.lit(seed)), "node"))).where(F.col("r") <= others).select("start", "node")
    both = near.union(outside).where("start <> node")
    info = written(clustering(nodes, pairs), "clustering").select(F.col("node_id").alias("node"), "degree", "clustering")
    mean_near = both_ways(pairs).join(info.select(F.col("node").alias("other"), F.col("degree").alias("od")), "other").groupBy("node").agg(F.avg("od").alias("near_degree"))
    g = info.agg(F.avg("degree").alias("avg_degree"), F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("avg_clustering"))
    both = written(both, "candidates")
    named = nodes.select(F.col("node_id").alias("node"), "type", "name")
    rows = both.join(info, "node").join(mean_near, "node", "left").join(named, "node").join(nodes.select(F.col("node_id").alias("start"), F.col("name").alias("start_name")), "start").crossJoin(F.broadcast(g))
    same = (F.coalesce("name", F.lit("")) != "") & (F.coalesce("start_name", F.lit("")) != "") & (F.contains("name", "start_name") | F.contains("start_name", "name"))
    keep = (F.col("degree") > F.col("avg_degree")) | (F.col("clustering") > F.col("avg_clustering")) | (F.col("degree") > F.col("near_degree")) | F.col("type").isin("port", "module", "assignment") | same
    kept = rows.where(F.coalesce(keep, F.lit(False))).select("start", "node").distinct()
    rank = F.row_number().over(W.partitionBy("start").orderBy(F.xxhash64("node", F.lit(seed)), "node"))
    return kept.withColumn("r", rank).where(F.col("r") <= most).select("start", "node")


def simple_paths(pairs: DataFrame, starts: DataFrame, depth: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """(start, node, path): all paths of 1 to ``depth`` edges without a repeated node, to ``targets(start, node)`` if given."""
    steps = both_ways(pairs.where("a <> b")).distinct()
    front = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    out = None
    for _ in range(depth):
        front = written(front.join(steps, "node").where(~F.array_contains("path", F.col("other"))).select("start", F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path")), "paths")
        hit = front if targets is None else front.join(targets, ["start", "node"], "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return out


def path_metrics(paths: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``paths`` with length (nodes), edge_density, path_clustering, mean_degree, mean_centrality, importance, significant."""
    keyed = written(paths.withColumn("pid", F.array_join(F.transform("path", lambda x: x.cast("string")), "\u0001")), "path-ids")
    members = keyed.select("pid", F.explode("path").alias("node"))
    info = degrees(nodes, pairs).select(F.col("node_id").alias("node"), "degree")
    g = written(global_metrics(nodes, pairs), "global")
    sub = group_metrics(members, pairs, nodes, "pid").select("pid", F.col("n").alias("length"), F.col("density").alias("edge_density"), F.col("avg_clustering").alias("path_clustering"))
    mean = members.join(info, "node").groupBy("pid").agg(F.avg("degree").alias("mean_degree"))
    out = keyed.join(sub, "pid").join(mean, "pid").crossJoin(F.broadcast(g)).withColumn("mean_centrality", F.when(F.col("n") > 1, F.col("mean_degree") / (F.col("n") - 1)).otherwise(1.0))
    significant = (F.col("mean_degree") > F.col("avg_degree")) | (F.col("path_clustering") > F.col("avg_clustering")) | (F.col("edge_density") > F.col("density"))
    ratio = F.when(F.col("avg_clustering") > 0, F.least(F.lit(1.0), F.col("path_clustering") / F.col("avg_clustering"))).otherwise(0.0)
    importance = (1.0 / (F.abs(F.col("length") - 3) + 1) + F.col("edge_density") + ratio + F.col("mean_centrality")) / 4
    return out.withColumn("significant", significant).withColumn("importance", importance).select(*paths.columns, "length", "edge_density", "path_clustering", "mean_degree", "mean_centrality", "importance", "significant")


def cycles(pairs: DataFrame, longest: int = 5, starts: DataFrame | None = None) -> DataFrame:
    """(cycle, length): simple cycles of 3 to ``longest`` nodes, each once, from its least node towards the lesser neighbour.

    ``starts(start)``: only cycles through one of them. Without starts all paths go upwards from the least node.
    """
    steps = both_ways(pairs.where("a <> b")).distinct()
    least_first = F.col("other") > F.col("path")[0] if starts is None else F.lit(True)
    if starts is None:
        front = pairs.where("a <> b").select(F.col("a").alias("start"), F.col("b").alias("node"), F.array("a", "b").alias("path"))
    else:
        front = starts.select("start").distinct().join(steps, F.col("start") == F.col("node")).select("start", F.col("other").alias("node"), F.array("start", "other").alias("path"))
    out = None
    for _ in range(3, longest + 1):
        front = written(front.join(steps, "node").where(least_first & ~F.array_contains("path", F.col("other"))).select("start", F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path")), "cycles")
        closed = front.join(steps.select("node", F.col("other").alias("start")), ["node", "start"], "left_semi").select("path")
        out = closed if out is None else out.union(closed)
    # canonical form: turned to begin with the least, in the direction of the lesser second node
    at = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at - 1))
    t = out.select(turned.alias("p"))
    back = F.concat(F.slice("p", 1, 1), F.reverse(F.slice("p", F.lit(2), F.size("p"))))
    return t.select(F.when(F.col("p")[1] <= F.element_at("p", -1), F.col("p")).otherwise(back).alias("cycle")).distinct().withColumn("length", F.size("cycle"))


def hub_motifs(nodes: DataFrame, pairs: DataFrame, starts: DataFrame, ratio: float = HUB_RATIO) -> DataFrame:
    """(start, center, degree, degree_ratio, neighbour_avg_degree): starts that are hubs, and hubs next to them."""
    deg = degrees(nodes, pairs)
    mean = deg.agg(F.avg("degree").alias("avg"))
    hubs = deg.crossJoin(F.broadcast(mean)).where(F.col("degree") > F.col("avg") * ratio).select(F.col("node_id").alias("center"), "degree", (F.col("degree") / F.col("avg")).alias("degree_ratio"))
    own = starts.select("start", F.col("start").alias("center"))
    beside = both_ways(pairs).distinct().join(starts, F.col("node") == F.col("start")).select("start", F.col("other").alias("center")).join(starts.select(F.col("start").alias("center")), "center", "left_anti").select("start", "center")
    around = both_ways(pairs).join(deg.select(F.col("node_id").alias("other"), F.col("degree").alias("od")), "other").groupBy(F.col("node").alias("center")).agg(F.avg("od").alias("neighbour_avg_degree"))
    return own.union(beside).distinct().join(hubs, "center").join(around, "center", "left").select("start", "center", "degree", "degree_ratio", "neighbour_avg_degree")


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between a node of source ``rtl`` and one of source ``spec``."""
    s = nodes.select("node_id", "source")
    ends = edges.join(s.select(F.col("node_id").alias("src"), F.col("source").alias("src_source")), "src").join(s.select(F.col("node_id").alias("dst"), F.col("source").alias("dst_source")), "dst")
    return ends.where("src_source <> dst_source and src_source in ('rtl', 'spec') and dst_source in ('rtl', 'spec')")


def node_importance(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, importance) = 0.4 * degree / largest degree + 0.6 * worth of the type."""
    deg = degrees(nodes, pairs)
    top = deg.agg(F.max("degree").alias("top"))
    worth = F.when(F.col("type").isin("port", "signal"), 0.9).when(F.col("type").isin("register", "fsm_state"), 0.8).when(F.col("type").isin("module", "instance"), 0.7).when(F.col("type") == "assignment", 0.6).otherwise(0.0)
    return deg.join(nodes.select("node_id", "type"), "node_id").crossJoin(F.broadcast(top)).select("node_id", (0.4 * F.when(F.col("top") > 0, F.col("degree") / F.col("top")).otherwise(0.0) + 0.6 * worth).alias("importance"))


def shortest_paths(pairs: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, dist, path): one shortest path each, by the least predecessor."""
    steps = both_ways(pairs.where("a <> b")).distinct()
    seen = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("dist"), F.array("start").alias("path")).distinct(), "sp")
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        reached = front.join(steps, "node").groupBy("start", F.col("other").alias("to")).agg(F.min_by("path", "node").alias("path"))
        reached = reached.select("start", F.col("to").alias("node"), F.lit(level).alias("dist"), F.concat("path", F.array("to")).alias("path"))
        front = written(reached.join(seen, ["start", "node"], "left_anti"), "sp")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def gateways(paths: DataFrame, top: int = 5) -> DataFrame:
    """(source, target, node, score, rank): inner nodes of ``paths(source, target, path)`` by how many paths they are on."""
    long_ = paths.where(F.size("path") > 2)
    inner = long_.select("source", "target", F.posexplode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("pos", "node"))
    total = long_.agg(F.count("*").alias("total"))
    score = inner.groupBy("node").agg(F.count("*").alias("hits")).crossJoin(F.broadcast(total)).select("node", (F.col("hits") / F.greatest("total", F.lit(1))).alias("score"))
    rank = F.row_number().over(W.partitionBy("source", "target").orderBy(F.desc("score"), "pos"))
    return inner.join(score, "node").withColumn("rank", rank).where(F.col("rank") <= top).select("source", "target", "node", "score", "rank")


def depth_first(pairs: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` of each start. A depth-first search with one visited set can miss some; this does not."""
    return distances(pairs, starts, depth)


def node_info(nodes: DataFrame, node_id) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def edge_info(edges: DataFrame, one, other) -> DataFrame:
    """Edges between two nodes, in either direction."""
    return edges.where(((F.col("src") == one) & (F.col("dst") == other)) | ((F.col("src") == other) & (F.col("dst") == one)))
