"""GraphML as tables, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_VALUE: string, _key: string>>"


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, attributes map) and edges(id, source, target, attributes map); all values are strings."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = read("key", "_id string, `_attr.name` string").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("n"))
    names = keys.agg(F.map_from_entries(F.collect_set(F.struct("k", "n"))).alias("names"))  # as many rows as attributes

    def attributes(df: DataFrame) -> DataFrame:
        own = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE: string, _key: string>>")), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]), F.coalesce(d["_VALUE"], F.lit("")))))
        return df.crossJoin(F.broadcast(names)).withColumn("attributes", own).drop("data", "names")

    nodes = attributes(read("node", f"_id string, {_DATA}")).withColumnRenamed("_id", "id")
    edges = attributes(read("edge", f"_id string, _source string, _target string, {_DATA}"))
    return nodes, edges.select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_target").alias("target"), "attributes")


def attribute_names(table: DataFrame) -> DataFrame:
    return table.select(F.explode(F.map_keys("attributes")).alias("name")).distinct()


def as_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed columns for the names in use, everything else in attrs."""
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    n = nodes.select(F.col("id").alias("node_id"), F.coalesce(at("name"), at("label"), F.col("id")).alias("name"), F.coalesce(at("type"), at("entity_type")).alias("type"), at("text").alias("text"), at("description").alias("description"), F.col("attributes").alias("attrs"))
    e = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), at("relation").alias("relation"), at("relationship").alias("relationship"), at("weight").try_cast("double").alias("weight"), at("description").alias("description"), F.xxhash64("id", "source", "target").alias("edge_seq"))
    return n, e
