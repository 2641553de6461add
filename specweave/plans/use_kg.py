"""Question to answer over a knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.operators import entities as E
from specweave.operators.inference import asked
from specweave.operators.retrieval import top_chunks


def answer(queries: DataFrame, graph: dict[str, DataFrame], method: str = "local", spec=None, docs: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(query_id, response). method: ``local`` (nearest nodes), ``global`` (community reports, or summaries), ``basic`` (chunks), ``drift`` (global, then local).

    queries(query_id, query); docs(doc_id, chunk_idx, chunk) for basic.
    """
    if method == "global":
        return E.global_search(queries, graph.get("reports", graph["summaries"]), k, spec)
    if method == "basic":
        found = top_chunks(docs, queries, k).join(docs, ["doc_id", "chunk_idx"]).select("query_id", "rank", F.col("chunk").alias("text"))
    elif method in ("local", "drift"):
        found = E.local_search(queries, graph["nodes"], graph["edges"], k).select("query_id", "rank", "text")
    else:
        raise ValueError(method)
    context = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    rows = queries.join(context, "query_id", "left")
    if method == "drift":
        broad = E.global_search(queries, graph.get("reports", graph["summaries"]), k, spec).withColumnRenamed("response", "broad")
        rows = rows.join(broad, "query_id", "left").withColumn("context", F.concat_ws("\n\n", "broad", "context"))
    prompts = rows.select("query_id", F.concat_ws("\n\n", F.concat(F.lit("Question: "), F.col("query")), "context").alias("prompt"))
    return asked(prompts, spec).select("query_id", "response")
