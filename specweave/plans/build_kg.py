"""Documents to a knowledge graph: chunks, extraction records, merged entities and relations, communities and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from specweave.operators import communities as C
from specweave.operators import entities as E
from specweave.operators import graph as G
from specweave.operators.inference import asked
from specweave.operators.retrieval import chunk_words
from specweave.operators.tokenizing import chunk_tokens
from specweave.scratch import written

CHUNK, OVERLAP = 1200, 100


def build(docs: DataFrame, types: list[str], spec=None, size: int = CHUNK, overlap: int = OVERLAP, vocabulary: str | None = None, gleanings: int = 1, with_reports: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, communities, summaries and, if asked for, reports of ``docs(doc_id, text)``. Answers of the model are kept, so it is asked once.

    Chunks are windows of tokens by the rank file ``vocabulary``, or of words without one.
    """
    chunks = chunk_tokens(docs, vocabulary, size, overlap) if vocabulary else chunk_words(docs, size, overlap)
    answers = written(asked(E.extraction_prompts(chunks, types), spec).select("doc_id", "prompt", "response"), "kg-answers")
    recs = E.records(E.gleaned(answers, spec, gleanings))
    entities = E.summarised_descriptions(E.merged_entities(E.entity_rows(recs)), ["name"], spec)
    relations = E.summarised_descriptions(E.merged_relations(E.relation_rows(recs)), ["source", "target"], spec)
    nodes, edges = E.entity_graph(entities, relations)
    nodes, edges = written(nodes, "kg-nodes"), written(edges, "kg-edges")
    groups = C.louvain(nodes, G.undirected(edges))
    summaries = written(E.community_summaries(groups, nodes), "kg-summaries")
    graph = {"nodes": nodes, "edges": edges, "communities": groups, "summaries": summaries}
    return graph | ({"reports": E.community_reports(summaries, spec)} if with_reports else {})
