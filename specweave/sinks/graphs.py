"""Graphs as GraphML and JSON. A GraphML file is one document, so it is written on the driver, row by row."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _flat(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """All columns as strings: nested ones as JSON, null as empty."""
    cols = []
    for name, kind in df.dtypes:
        nested = kind.startswith(("array", "map", "struct"))
        text = F.to_json(name) if nested else F.col(name).cast("string")
        cols.append(F.coalesce(text, F.lit("")).alias(name) if name not in skip else F.col(name).cast("string").alias(name))
    return df.select(*cols)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, detail: str = "full") -> None:
    """detail: ``full``, or ``simple`` (type, name, module; relation), or ``minimal`` (ids only). Edge ids are unique."""
    keep = {"full": (None, None), "simple": (["node_id", "type", "name", "module"], ["src", "dst", "relation", "relationship"]), "minimal": (["node_id"], ["src", "dst"])}[detail]
    pick = lambda df, names: df.select(*[c for c in names if c in df.columns]) if names else df
    n, e = _flat(pick(nodes, keep[0]), ("node_id",)), _flat(with_edge_ids(pick(edges, keep[1])), ("src", "dst", "id"))
    node_keys, edge_keys = [c for c in n.columns if c != "node_id"], [c for c in e.columns if c not in ("src", "dst", "id")]
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for what, keys in (("node", node_keys), ("edge", edge_keys)):
            for k in keys:
                f.write(f'  <key id="{what[0]}_{k}" for="{what}" attr.name="{k}" attr.type="string"/>\n')
        f.write('  <graph edgedefault="directed">\n')
        for row in n.orderBy("node_id").toLocalIterator():
            data = "".join(f'<data key="n_{k}">{escape(row[k])}</data>' for k in node_keys)
            f.write(f"    <node id={quoteattr(row['node_id'])}>{data}</node>\n")
        for row in e.orderBy("src", "dst", "id").toLocalIterator():
            data = "".join(f'<data key="e_{k}">{escape(row[k])}</data>' for k in edge_keys)
            f.write(f"    <edge id={quoteattr(row['id'])} source={quoteattr(row['src'])} target={quoteattr(row['dst'])}>{data}</edge>\n")
        f.write("  </graph>\n</graphml>\n")


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Ids e0, e1, ... where the ids are missing or not unique; given unique ids stay."""
    if "id" in edges.columns:
        n, distinct, missing = edges.agg(F.count("*"), F.countDistinct("id"), F.count_if(F.col("id").isNull())).first()
        if n == distinct and not missing:
            return edges
        edges = edges.drop("id")
    order = W.orderBy("src", "dst", *[c for c in edges.columns if c not in ("src", "dst") and not dict(edges.dtypes)[c].startswith("map")])
    return edges.withColumn("id", F.concat(F.lit("e"), F.row_number().over(order) - 1))


def collapsed(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair, the latest."""
    return edges.withColumn("_r", F.row_number().over(W.partitionBy("src", "dst").orderBy(F.desc("edge_seq")))).where("_r = 1").drop("_r")


def graph_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, attributes) and (source, target, attributes) with all attribute values as strings."""
    attrs = lambda df, skip: F.map_filter(F.create_map(*[x for n in df.columns if n not in skip for x in (F.lit(n), F.col(n))]), lambda k, v: v != "")
    n, e = _flat(nodes, ("node_id",)), _flat(edges, ("src", "dst"))
    return n.select(F.col("node_id").alias("id"), attrs(n, ("node_id",)).alias("attributes")), e.select(F.col("src").alias("source"), F.col("dst").alias("target"), attrs(e, ("src", "dst")).alias("attributes"))


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Folders ``nodes`` and ``edges`` of JSON lines."""
    n, e = graph_json(nodes, edges)
    n.write.mode("overwrite").json(f"{path}/nodes")
    e.write.mode("overwrite").json(f"{path}/edges")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """GraphML if ids are plain and it can be written, else JSON folders; returns which."""
    try:
        write_graphml(nodes, edges, path)
        return "graphml"
    except (OSError, ValueError):
        write_json(nodes, edges, f"{path}.json")
        return "json"
