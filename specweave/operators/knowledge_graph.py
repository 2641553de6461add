"""From RTL facts to a property graph, and its links with a specification graph.

Nodes: NODE_COLUMNS; edges: EDGE_COLUMNS. ``relation`` is set by the RTL side and ``relationship`` by links; both stay.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.functions.text import tokens
from specweave.operators import graph as G
from specweave.operators.components import components

NODE_COLUMNS = ["node_id", "source", "type", "subtype", "name", "module", "direction", "width", "pattern_type", "description", "suggestion", "condition", "case_expression", "assignment_type", "expression", "signal_type", "signed", "initial_value", "code_preview", "text", "attrs"]
EDGE_COLUMNS = ["src", "dst", "relation", "relationship", "weight", "match_type", "instance_name"]
PREVIEW = 100


def _typed(name: str) -> str:
    return {"signed": "boolean", "attrs": "map<string,string>", "weight": "double"}.get(name, "string")


def _node(df: DataFrame, node_id: Column, kind: str, **cols: Column) -> DataFrame:
    fields = {"node_id": node_id, "source": F.lit("rtl"), "type": F.lit(kind)} | cols
    return df.select(*[fields[c].cast(_typed(c)).alias(c) if c in fields else F.lit(None).cast(_typed(c)).alias(c) for c in NODE_COLUMNS])


def _edge(df: DataFrame, src: Column, dst: Column, **cols: Column) -> DataFrame:
    fields = {"src": src, "dst": dst} | cols
    return df.select(*[fields[c].cast(_typed(c)).alias(c) if c in fields else F.lit(None).cast(_typed(c)).alias(c) for c in EDGE_COLUMNS])


def port_id(module: str = "module", port: str = "port") -> Column:
    return F.concat_ws(".", module, port)


def rtl_graph(facts: dict[str, DataFrame], include_internal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). ``include_internal``: also control flow and signals that are no ports."""
    mods, ports, inst, conns = facts["modules"].select("module").distinct(), facts["ports"], facts["instances"], facts["connections"]
    known = ports.select("module", "port", "direction")
    nodes = [
        _node(mods, F.col("module"), "module", name=F.col("module"), module=F.col("module")),
        _node(ports, port_id(), "port", name=F.col("port"), module=F.col("module"), direction=F.col("direction"), width=F.col("width")),
    ]
    is_in = F.col("direction") == "input"
    edges = [
        _edge(ports, F.when(is_in, port_id()).otherwise(F.col("module")), F.when(is_in, F.col("module")).otherwise(port_id()), relation=F.when(is_in, "input_to").otherwise("outputs")),
        _edge(inst, F.col("parent"), F.col("module"), relation=F.lit("instantiates"), instance_name=F.col("instance")),
    ]
    wired = conns.join(known, ["module", "port"]).join(known.select(F.col("module").alias("parent"), F.col("port").alias("signal")), ["parent", "signal"])
    up, down = port_id("parent", "signal"), port_id()
    edges.append(_edge(wired, F.when(is_in, up).otherwise(down), F.when(is_in, down).otherwise(up), relation=F.lit("drives"), instance_name=F.col("instance")))

    fsm = facts["fsms"]
    nodes.append(_node(fsm, F.col("fsm_id"), "fsm", name=F.col("fsm_id"), module=F.col("module"), subtype=F.col("detection_method"), code_preview=F.left(F.coalesce("matched_text", F.lit("")), F.lit(PREVIEW))))
    edges.append(_edge(fsm, F.col("fsm_id"), F.col("module"), relation=F.lit("part_of")))

    pattern = facts["protocol_patterns"].withColumn("id", F.concat_ws("_", "module", "pattern_type"))
    nodes.append(_node(pattern, F.col("id"), "protocol_pattern", module=F.col("module"), pattern_type=F.col("pattern_type")))
    edges.append(_edge(pattern, F.col("id"), F.col("module"), relation=F.lit("found_in")))
    in_pattern = pattern.select("id", "module", F.explode("signals").alias("port")).join(known, ["module", "port"])
    edges.append(_edge(in_pattern, F.col("id"), port_id(), relation=F.lit("includes")))

    point = facts["verification_points"].withColumn("id", F.concat_ws("_", "module", "type"))
    nodes.append(_node(point, F.col("id"), "verification_point", module=F.col("module"), subtype=F.col("type"), description=F.col("description"), suggestion=F.col("suggestion")))
    edges.append(_edge(point, F.col("id"), F.col("module"), relation=F.lit("targets")))
    in_point = point.select("id", "module", F.explode("signals").alias("port")).join(known, ["module", "port"])
    edges.append(_edge(in_point, F.col("id"), port_id(), relation=F.lit("involves")))

    assigned = facts["assignments"].withColumn("k", F.row_number().over(W.partitionBy("module").orderBy("always_block", "idx", "lhs")))
    assigned = assigned.withColumn("id", F.concat_ws("_", F.col("module"), F.lit("assignment"), F.col("k")))
    nodes.append(_node(assigned, F.col("id"), "assignment", name=F.concat("lhs", F.lit("_assignment")), module=F.col("module"), assignment_type=F.col("type"), expression=F.concat_ws(" = ", "lhs", "rhs")))
    edges.append(_edge(assigned, F.col("id"), F.col("module"), relation=F.lit("part_of")))
    left = assigned.withColumn("port", F.regexp_extract("lhs", r"^\w+", 0)).join(known, ["module", "port"])
    edges.append(_edge(left, F.col("id"), port_id(), relation=F.lit("assigns_to")))
    right = assigned.select("id", "module", F.explode("rhs_signals").alias("port")).join(known, ["module", "port"])
    edges.append(_edge(right, port_id(), F.col("id"), relation=F.lit("used_in")))

    if include_internal:
        flow = facts["control_flow"].where("kind in ('if', 'case')").withColumn("id", F.concat_ws("_", "module", "kind", "idx"))
        nodes.append(_node(flow, F.col("id"), "control_flow", module=F.col("module"), subtype=F.col("kind"), condition=F.when(F.col("kind") == "if", F.col("expr")), case_expression=F.when(F.col("kind") == "case", F.col("expr"))))
        edges.append(_edge(flow, F.col("id"), F.col("module"), relation=F.lit("part_of")))
        named = flow.select("id", "module", "kind", F.explode(F.array_distinct(F.regexp_extract_all("expr", F.lit(r"\w+"), F.lit(0)))).alias("port")).join(known, ["module", "port"])
        edges.append(_edge(named, F.col("id"), port_id(), relation=F.when(F.col("kind") == "case", "switches_on").otherwise("references")))
        attrs = facts["signal_attributes"]
        inside = attrs.where("not is_port").withColumn("id", F.concat_ws(".", "module", "name"))
        nodes.append(_node(inside, F.col("id"), "signal", name=F.col("name"), module=F.col("module"), signal_type=F.col("type"), width=F.col("width"), signed=F.col("signed"), initial_value=F.coalesce("initial_value", "value")))
        edges.append(_edge(inside, F.col("id"), F.col("module"), relation=F.lit("part_of")))
        # attributes of ports go into their nodes
        of_ports = attrs.where("is_port").select(F.concat_ws(".", "module", "name").alias("node_id"), F.col("type").alias("_t"), F.col("signed").alias("_s"), F.col("initial_value").alias("_i"))
        merged = nodes[1].join(of_ports, "node_id", "left").withColumns({"signal_type": F.col("_t"), "signed": F.col("_s"), "initial_value": F.col("_i")})
        nodes[1] = merged.select(*NODE_COLUMNS)
    all_nodes = functools.reduce(DataFrame.unionByName, nodes).dropDuplicates(["node_id"])
    return all_nodes, numbered(functools.reduce(DataFrame.unionByName, edges))


def numbered(edges: DataFrame) -> DataFrame:
    """With ``edge_seq``, an order of the edges that reruns repeat."""
    return edges.withColumn("edge_seq", F.row_number().over(W.partitionBy("src").orderBy("dst", "relation", "relationship", "instance_name")).cast("long"))


def spec_node(df: DataFrame) -> DataFrame:
    """Nodes of a specification graph in NODE_COLUMNS; what has no column goes into attrs."""
    have = [c for c in NODE_COLUMNS if c in df.columns]
    return df.select(*[F.col(c).cast(_typed(c)).alias(c) if c in have else F.lit(None).cast(_typed(c)).alias(c) for c in NODE_COLUMNS]).withColumn("source", F.lit("spec"))


def name_hits(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name_id, text_id): whole-word, case-insensitive occurrences of ``names(name_id, name)`` in ``texts(text_id, text)``.

    A name of word characters is in a text exactly if it is one of its words, so that is an equi-join on words. Other names
    are looked for by pattern, which compares each of them with each text.
    """
    plain = names.where(F.col("name").rlike(r"^[\p{L}\p{N}_]+$")).select("name_id", F.lower("name").alias("token"))
    words = texts.select("text_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    hit = words.join(plain, "token").select("name_id", "text_id")
    odd = names.where(~F.col("name").rlike(r"^[\p{L}\p{N}_]+$") & (F.col("name") != ""))
    quoted = F.regexp_replace(F.lower("name"), r"([^\p{L}\p{N}_\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), quoted, F.lit(r"($|[^\p{L}\p{N}_])"))
    loose = odd.join(texts, F.expr("true") & F.regexp_like(F.lower("text"), pattern)).select("name_id", "text_id")
    return hit.union(loose).distinct()


def linked(rtl_nodes: DataFrame, rtl_edges: DataFrame, spec_nodes: DataFrame, spec_edges: DataFrame, text_cols: tuple[str, ...] = ("text", "description")) -> tuple[DataFrame, DataFrame]:
    """The combined graph: RTL ids get the prefix ``rtl_``; a design root holds both sides; names found in texts link them."""
    pre = lambda c: F.concat(F.lit("rtl_"), F.col(c))
    rtl_n = rtl_nodes.withColumn("node_id", pre("node_id")).withColumn("source", F.lit("rtl"))
    rtl_e = rtl_edges.select(*EDGE_COLUMNS).withColumn("src", pre("src")).withColumn("dst", pre("dst"))
    spec_n = spec_node(spec_nodes)
    spec_e = spec_edges.select(*[F.col(c).cast(_typed(c)).alias(c) if c in spec_edges.columns else F.lit(None).cast(_typed(c)).alias(c) for c in EDGE_COLUMNS])
    spark = rtl_nodes.sparkSession
    root = _node(spark.range(1), F.lit("design_root"), "root", name=F.lit("design_root"), source=F.lit("root"))
    half = F.lit(0.5)
    to_spec = _edge(spec_n, F.lit("design_root"), F.col("node_id"), relationship=F.lit("contains_spec"), weight=half)
    to_rtl = _edge(rtl_n.where("type = 'module'"), F.lit("design_root"), F.col("node_id"), relationship=F.lit("contains_implementation"), weight=half)
    texts = spec_n.select(F.col("node_id").alias("text_id"), F.coalesce(*[F.col(c) for c in text_cols]).alias("text")).where("text is not null")
    hits = name_hits(rtl_n.where("type in ('module', 'port', 'signal') and name is not null").select(F.col("node_id").alias("name_id"), "name"), texts)
    hits = hits.join(rtl_n.select(F.col("node_id").alias("name_id"), "type"), "name_id")
    is_module = F.col("type") == "module"
    link = _edge(hits, F.col("text_id"), F.col("name_id"), relationship=F.when(is_module, "describes").otherwise("references"), weight=F.lit(1.0), match_type=F.when(is_module, "name_in_text").otherwise("signal_in_text"))
    nodes = spec_n.unionByName(rtl_n).unionByName(root)
    edges = functools.reduce(DataFrame.unionByName, [spec_e, rtl_e, to_spec, to_rtl, link])
    return nodes, numbered(edges)


def connected(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With a knowledge root joined to the least node of each component, if there is more than one."""
    comp = nodes.select("node_id").join(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "node_id"), "node_id", "left").select(F.coalesce("component", "node_id").alias("component")).distinct()
    if comp.limit(2).count() < 2:
        return nodes, edges
    root = _node(nodes.sparkSession.range(1), F.lit("knowledge_root"), "root", name=F.lit("knowledge_root"), source=F.lit("root"))
    ties = _edge(comp, F.lit("knowledge_root"), F.col("component"), relationship=F.lit("connects"), weight=F.lit(0.1))
    return nodes.unionByName(root, True), numbered(edges.select(*EDGE_COLUMNS).unionByName(ties))


def connectivity_report(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """components (component, size), bridges between the sides, hubs with sample neighbours."""
    pairs = G.undirected(edges)
    return {
        "components": G.node_components(nodes, pairs).groupBy("component").agg(F.count("*").alias("size")),
        "bridges": G.bridges(nodes, edges),
        "hubs": G.top_hubs(nodes, pairs),
    }


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def signal_nodes(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signal, node_id): ports, signals and assignments of exactly that name, and expressions that hold it as a word."""
    wanted = nodes.where("type in ('port', 'signal', 'assignment')")
    by_name = wanted.select(F.replace("name", F.lit("_assignment"), F.lit("")).alias("signal"), "node_id").join(signals, "signal", "left_semi").select("signal", "node_id")
    words = wanted.where("expression is not null").select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("signal"))
    return by_name.union(words.join(signals, "signal", "left_semi").select("signal", "node_id")).distinct()


def suffix_nodes(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signal, node_id): nodes of that name or of a path that ends with it."""
    last = nodes.where("name is not null").select("node_id", F.explode(F.array_distinct(F.array(F.col("name"), F.element_at(F.split("name", r"\."), -1)))).alias("signal"))
    return last.join(signals, "signal", "left_semi").select("signal", "node_id").distinct()


def start_nodes(signals: DataFrame, mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signal, start): mapped nodes, else the signal itself as an id, if in the graph."""
    joined = signals.join(mapping, "signal", "left").select("signal", F.coalesce("node_id", "signal").alias("start")).distinct()
    return joined.join(nodes.select(F.col("node_id").alias("start")), "start", "left_semi").select("signal", "start")
