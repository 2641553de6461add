"""Entities and relations from extraction records, their merging, and local and global search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.operators import graph as G
from specweave.operators.inference import asked
from specweave.operators.retrieval import top_chunks
from specweave.scratch import written

RECORD, FIELD = "##", "<|>"


def records(responses: DataFrame, id_col: str = "doc_id", text_col: str = "response", record: str = RECORD, field: str = FIELD) -> DataFrame:
    """(id, pos, fields): the bracketed tuples of each response."""
    parts = responses.select(id_col, F.posexplode(F.split(text_col, "\\Q" + record + "\\E")).alias("pos", "r"))
    inner = F.regexp_extract("r", r"(?s)\((.*)\)", 1)
    fields = F.transform(F.split(inner, "\\Q" + field + "\\E"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^\"|\"$", "")))
    return parts.select(id_col, "pos", fields.alias("fields")).where(F.size("fields") > 1)


def entity_rows(recs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, name, type, description) of four-tuples that say entity."""
    own = recs.where((F.lower(F.col("fields")[0]) == "entity") & (F.size("fields") == 4))
    return own.select(id_col, "pos", F.upper(F.col("fields")[1]).alias("name"), F.lower(F.col("fields")[2]).alias("type"), F.col("fields")[3].alias("description")).where("name <> ''")


def relation_rows(recs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, source, target, description, strength) of five-tuples that say relationship; a bad strength drops the row."""
    own = recs.where((F.lower(F.col("fields")[0]) == "relationship") & (F.size("fields") == 5))
    rows = own.select(id_col, "pos", F.upper(F.col("fields")[1]).alias("source"), F.upper(F.col("fields")[2]).alias("target"), F.col("fields")[3].alias("description"), F.col("fields")[4].try_cast("double").alias("strength"))
    return rows.where("strength is not null and source <> '' and target <> ''")


def merged_entities(rows: DataFrame) -> DataFrame:
    """(name, type, n, descriptions): one row a name and type, distinct descriptions in order."""
    return rows.groupBy("name", "type").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("description")).alias("descriptions"))


def merged_relations(rows: DataFrame) -> DataFrame:
    """(source, target, n, weight, descriptions): strengths summed, direction aside."""
    pair = rows.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "description", "strength")
    return pair.groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("strength").alias("weight"), F.sort_array(F.collect_set("description")).alias("descriptions"))


def extraction_prompts(chunks: DataFrame, types: list[str], text_col: str = "chunk") -> DataFrame:
    """Chunks with a prompt that asks for records."""
    head = f'Entity Types: [{", ".join(types)}]\nList entities as ("entity"{FIELD}name{FIELD}type{FIELD}description) and relations as ("relationship"{FIELD}source{FIELD}target{FIELD}description{FIELD}strength from 1 to 10), separated by {RECORD}.\n\nText:\n'
    return chunks.withColumn("prompt", F.concat(F.lit(head), F.col(text_col)))


def local_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, node_id, text): the nodes nearest to each question by TF-IDF, with their relations.

    nodes(node_id, text), edges(src, dst, description).
    """
    top = top_chunks(nodes.select("node_id", F.col("text").alias("chunk")), queries, k, ("node_id",)).where("sim > 0")
    ways = edges.select(F.col("src").alias("node_id"), F.concat(F.lit("-> "), F.col("dst").cast("string"), F.lit(": "), F.coalesce("description", F.lit(""))).alias("line")).union(edges.select("dst", F.concat(F.lit("<- "), F.col("src").cast("string"), F.lit(": "), F.coalesce("description", F.lit("")))))
    lines = ways.join(top.select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("lines"))
    return top.join(nodes, "node_id").join(lines, "node_id", "left").select("query_id", "rank", "node_id", F.concat_ws("\n", "text", "lines").alias("text"))


def global_search(queries: DataFrame, communities: DataFrame, k: int = 5, spec=None) -> DataFrame:
    """(query_id, response): the community summaries nearest to a question are each answered, and the answers joined by one more call.

    communities(community, block, summary).
    """
    keys = ["community", "block"]
    top = top_chunks(communities.select(*keys, F.col("summary").alias("chunk")), queries, k, tuple(keys)).join(communities, keys).join(queries, "query_id")
    partial = asked(top.select("query_id", "rank", "query", F.concat(F.lit("Question: "), F.col("query"), F.lit("\nFrom this summary alone:\n"), F.col("summary")).alias("prompt")), spec)
    joined = partial.groupBy("query_id").agg(F.first("query").alias("query"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "response"))), lambda x: x["response"]), "\n---\n").alias("answers"))
    return asked(joined.select("query_id", F.concat(F.lit("Question: "), F.col("query"), F.lit("\nJoin these answers:\n"), F.col("answers")).alias("prompt")), spec).select("query_id", "response")


def community_summaries(communities: DataFrame, nodes: DataFrame, block: int = 50) -> DataFrame:
    """(community, block, summary): the texts of all members of a community, about ``block`` of them a row.

    Members are dealt to blocks by a hash, so that no community is one task; a block's texts stand in the order of the ids.
    """
    sizes = communities.groupBy("community").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = communities.join(sizes, "community").select("community", F.pmod(F.xxhash64("node_id"), "blocks").cast("int").alias("block"), "node_id")
    texts = F.array_sort(F.collect_list(F.struct("node_id", "text")))
    return dealt.join(nodes.select("node_id", "text"), "node_id").groupBy("community", "block").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("summary"))


def community_reports(summaries: DataFrame, spec=None, block: int = 50) -> DataFrame:
    """(community, block, summary) with one row a community: a report by the model.

    Each row of ``community_summaries`` is reported on; the reports of ``block`` rows are joined by one more call, until one is left.
    """
    ask = F.concat(F.lit("Write a short report on what the members of this group have in common and how they relate.\n\n"), F.col("summary"))
    level = written(asked(summaries.withColumn("prompt", ask), spec).select("community", "block", F.col("response").alias("summary")), "reports")
    join = F.concat(F.lit("Join these reports on parts of one group into one report.\n\n"), F.col("summary"))
    while not level.groupBy("community").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        merged = level.groupBy("community", F.floor(F.col("block") / block).cast("int").alias("block")).agg(
            F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "summary"))), lambda x: x["summary"]), "\n---\n").alias("summary")
        )
        done = merged.where("n = 1").select("community", "block", "summary")
        more = asked(merged.where("n > 1").withColumn("prompt", join), spec).select("community", "block", F.col("response").alias("summary"))
        level = written(done.unionByName(more), "reports")
    return level


def gleaned(answers: DataFrame, spec=None, rounds: int = 1) -> DataFrame:
    """``answers(prompt, response, ...)`` after further passes, each of which asks for what the records so far leave out."""
    more = F.concat("prompt", F.lit("\n\nRecords so far:\n"), F.coalesce("response", F.lit("")), F.lit(f"\n\nSome entities and relations are still missing. List only those, as before, separated by {RECORD}."))
    names = answers.columns
    for _ in range(rounds):
        asked_again = asked(answers.withColumn("_again", more).withColumnRenamed("response", "_before"), spec, "_again").withColumnRenamed("response", "_more")
        answers = written(asked_again.withColumn("response", F.concat_ws(RECORD, "_before", F.nullif(F.trim("_more"), F.lit("")))).select(names), "gleaned")
    return answers


def summarised_descriptions(merged: DataFrame, names: list[str], spec=None, longest: int = 500) -> DataFrame:
    """``merged`` with one description by the model where the distinct ones are several and longer than ``longest`` characters together."""
    text = F.array_join("descriptions", "\n")
    long_ = (F.size("descriptions") > 1) & (F.length(text) > longest)
    ask = F.concat(F.lit("Write one description that holds everything these say about "), F.concat_ws(" and ", *names), F.lit(":\n"), text)
    short = merged.where(~long_)
    told = asked(merged.where(long_).withColumn("prompt", ask), spec).withColumn("descriptions", F.array("response")).select(merged.columns)
    return short.unionByName(told)


def entity_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of merged entities and relations."""
    nodes = entities.groupBy(F.col("name").alias("node_id")).agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.array_join(F.flatten(F.sort_array(F.collect_list("descriptions"))), " ").alias("description"))
    nodes = nodes.select("node_id", F.col("node_id").alias("name"), "type", "description", F.concat_ws(" ", "node_id", "description").alias("text"))
    edges = relations.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("related").alias("relationship"), "weight", F.array_join("descriptions", " ").alias("description"))
    return nodes, edges.withColumn("edge_seq", F.xxhash64("src", "dst"))


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return G.distances(G.undirected(edges), starts, depth)
