"""Signals to contexts, prompts, test plans and assertions. All signals go through one plan; there is no loop over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.operators import communities as C
from specweave.operators import context as X
from specweave.operators import graph as G
from specweave.operators import inference as I
from specweave.operators import knowledge_graph as K
from specweave.operators import replies as R
from specweave.operators import retrieval, rtl
from specweave.scratch import written
from specweave.sources.settings import Settings

_META = "map<string,string>"


def _contexts(df: DataFrame, kind: str, **meta) -> DataFrame:
    """In the form of contexts, numbered by score within signal and type."""
    pairs = [x for k, c in meta.items() for x in (F.lit(k), c.cast("string"))]
    rows = df.withColumn("metadata", F.create_map(*pairs) if pairs else F.create_map().cast(_META))
    order = F.row_number().over(W.partitionBy("signal").orderBy(F.desc("score"), "text"))
    return rows.select("signal", F.lit(kind).alias("source_type"), order.alias("ordinal"), "text", F.col("score").cast("double").alias("score"), F.col("metadata").cast(_META).alias("metadata"))


def contexts(docs: DataFrame, signals: DataFrame, nodes: DataFrame, edges: DataFrame, settings: Settings = Settings(), rtl_files: DataFrame | None = None) -> DataFrame:
    """contexts of ``signals(signal)`` by the generators that the settings name, in their order."""
    queries = signals.select(F.col("signal").alias("query_id"), F.col("signal").alias("query"))
    mapping = written(K.signal_nodes(signals, nodes), "signal-nodes")
    starts = written(K.start_nodes(signals, mapping, nodes), "start-nodes")
    only = starts.select("start").distinct()
    pairs = written(G.undirected(edges, "relation", "relationship"), "pairs")
    parts = []
    for kind in settings.generators:
        if kind == "rag":
            code = rtl_files if settings.enable_rtl else None
            if settings.whole_text:
                found = retrieval.whole_text_context(docs, queries, code)
            else:
                found = retrieval.rag_contexts(docs, queries, code, settings.chunk_sizes, settings.overlap_ratios, settings.per_retriever)
            parts.append(_contexts(found.withColumnRenamed("query_id", "signal"), "rag"))
        elif kind == "path":
            ends = written(G.endpoints(nodes, pairs, only), "endpoints")
            paths = written(G.simple_paths(pairs, only, settings.max_path_depth, ends), "paths")
            good = G.path_metrics(paths, nodes, pairs).where("significant")
            told = X.described_paths(good, nodes, pairs, settings.path_style).withColumnRenamed("importance", "score")
            parts.append(_contexts(told.join(starts, "start"), "path", path_length=F.col("length"), start_node=F.col("start")))
        elif kind == "motif":
            cycles = G.cycles(pairs, 5, only).withColumn("motif", F.concat(F.lit("cycle:"), F.array_join("cycle", ","))).withColumn("base", F.lit(0.8))
            hubs = G.hub_motifs(nodes, pairs, only).select(F.concat(F.lit("hub:"), F.col("center")).alias("motif"), "center").distinct()
            star = G.both_ways(pairs).join(hubs, F.col("node") == F.col("center")).select("motif", F.col("other").alias("node")).union(hubs.select("motif", F.col("center")))
            members = cycles.select("motif", F.explode("cycle").alias("node")).withColumn("base", F.lit(0.8)).unionByName(star.withColumn("base", F.lit(0.7))).distinct()
            scored = C.motif_importance(members.select("motif", "node"), nodes, pairs).join(members.groupBy("motif").agg(F.max("base").alias("base")), "motif").select("motif", ((F.col("base") + F.col("importance")) / 2).alias("score"))
            text = X.described_groups(members.select("motif", "node"), nodes, pairs, "Motif", "motif")
            mine = members.join(starts, F.col("node") == F.col("start")).select("signal", "start", "motif").distinct()
            parts.append(_contexts(mine.join(scored, "motif").join(text, "motif"), "motif", type=F.substring_index("motif", ":", 1), start_node=F.col("start")))
        elif kind == "community":
            groups = C.louvain(nodes, pairs)
            scored = C.community_contexts(nodes, pairs, groups, only)
            text = X.described_groups(groups.select("community", F.col("node_id").alias("node")).join(scored.select("community").distinct(), "community", "left_semi"), nodes, pairs, "Community", "community")
            parts.append(_contexts(scored.join(text, "community").join(starts, "start"), "community", size=F.col("size"), start_node=F.col("start")))
        elif kind == "local_expansion":
            near = written(G.expansion(pairs, only, settings.expansion_depth, settings.expansion_size).select("start", "node"), "expansion")
            stats = G.group_metrics(near, pairs, nodes).withColumn("score", G.expansion_score())
            text = X.described_groups(near, nodes, pairs, "Neighbourhood")
            parts.append(_contexts(stats.join(text, "start").join(starts, "start"), "local_expansion", size=F.col("n"), start_node=F.col("start")))
        elif kind == "guided_random_walk":
            targets = [r["signal"] for r in signals.orderBy("signal").collect()]  # the interface of one design
            walks = written(C.guided_walks(nodes, pairs, mapping, only, targets, settings.walks, settings.walk_budget, settings.teleport, settings.alpha, settings.beta, settings.gamma, settings.walk_targets), "walks")
            best = C.ranked_walks(C.walk_quality(walks, nodes, pairs), max(1, len(targets) - 1), settings.walk_contexts)
            told = X.described_paths(best, nodes, pairs, "standard")
            parts.append(_contexts(told.join(starts, "start"), "guided_random_walk", path_length=F.col("length"), start_node=F.col("start")))
        else:
            raise ValueError(f"unknown generator {kind}")
    return X.union_contexts(*parts)


def plan(docs: DataFrame, signals: DataFrame, nodes: DataFrame, edges: DataFrame, settings: Settings = Settings(), rtl_files: DataFrame | None = None, spec=None, ask=None) -> dict[str, DataFrame]:
    """contexts, prompts, plans and svas. The contexts are made once and serve both plans and assertions."""
    if settings.max_signals is not None:
        signals = signals.orderBy("signal").limit(int(settings.max_signals))
    found = written(contexts(docs, signals, nodes, edges, settings, rtl_files), "contexts")
    kept = written(X.pruned(found, ask, settings.max_contexts), "kept-contexts") if settings.prune else found
    base = signals.select("signal", F.concat(F.lit("Signal: "), F.col("signal"), F.lit("\nWrite test plans for this signal, one a line, each beginning with Plan:")).alias("base"))
    asks = written(X.prompts(kept, base, prompts=settings.prompts_per_signal, max_tokens=settings.max_tokens_per_prompt), "prompts")
    answers = written(I.asked(asks.withColumnRenamed("text", "ask"), spec, "ask").select("signal", "prompt", "response"), "plan-answers")
    lines = R.plan_lines(answers, ("signal", "prompt")).withColumn("order", F.struct("prompt", "pos"))
    plans = R.unique_plans(lines, "signal", "order").withColumn("plan_no", F.row_number().over(W.partitionBy("signal").orderBy("order")).cast("long")).select("signal", "plan_no", "plan")
    plans = written(plans, "plans")
    dealt = R.dealt_plans(plans, asks).groupBy("signal", "prompt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plan_no", "plan"))), lambda x: F.concat(F.lit("Plan "), x["plan_no"], F.lit(": "), x["plan"])), "\n").alias("listed"))
    sva_asks = asks.join(dealt, ["signal", "prompt"]).select("signal", "prompt", F.concat_ws("\n\n", "text", F.lit("Write one assertion for each plan, each in a block after SVA:"), "listed").alias("ask"))
    sva_answers = written(I.asked(sva_asks, spec, "ask").select("signal", "response"), "sva-answers")
    svas = R.unique_assertions(R.assertions(sva_answers)).withColumn("sva_id", F.row_number().over(W.orderBy("sva")) - 1)
    return {"contexts": found, "kept": kept, "prompts": asks, "plans": plans, "svas": svas.select("sva_id", "sva")}


def design_graph(files: DataFrame, spec_nodes: DataFrame, spec_edges: DataFrame, include_internal: bool = True) -> tuple[DataFrame, DataFrame]:
    """The connected graph of a specification graph and of RTL files."""
    facts = {k: written(v, f"rtl-{k}") for k, v in rtl.facts(files).items()}
    nodes, edges = K.rtl_graph(facts, include_internal)
    nodes, edges = K.linked(nodes, edges, spec_nodes, spec_edges)
    return K.connected(written(nodes, "design-nodes"), written(edges, "design-edges"))
