"""Contexts: rendering, pruning and packing into prompts under a token budget.

contexts(signal, source_type, ordinal, text, score, metadata map<string,string>).
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.functions.text import cosine, fixed, token_estimate
from specweave.operators.graph import induced

BEFORE_SELECTION = 20
MOST_CONTEXTS = 100
LONG, CUT = 800, 750
USABLE = 0.75


def ranked(contexts: DataFrame, *by: str) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "ordinal"))


def best_per_type(contexts: DataFrame, most: int = BEFORE_SELECTION) -> DataFrame:
    """The ``most`` best of each signal and source type."""
    return contexts.withColumn("_r", ranked(contexts, "signal", "source_type")).where(F.col("_r") <= most).drop("_r")


def balanced(contexts: DataFrame, most: int = MOST_CONTEXTS) -> DataFrame:
    """At most ``most`` a signal: an equal quota for each type (1 at least) by score, the rest by score whatever the type."""
    types = contexts.groupBy("signal").agg(F.countDistinct("source_type").alias("_t"), F.count("*").alias("_n"))
    rows = contexts.join(types, "signal").withColumn("_q", F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_t"))))
    rows = rows.withColumn("_own", ranked(rows, "signal", "source_type"))
    order = W.partitionBy("signal").orderBy(F.when(F.col("_own") <= F.col("_q"), 0).otherwise(1), F.desc("score"), "source_type", "ordinal")
    return rows.withColumn("_k", F.row_number().over(order)).where((F.col("_n") <= most) | (F.col("_k") <= most)).drop("_t", "_n", "_q", "_own", "_k")


def similar_contexts(contexts: DataFrame, queries: DataFrame, least: float = 0.3, per_type: int = 2) -> DataFrame:
    """contexts(…, vec) near the signal's ``queries(signal, query_vec)``: similarity of at least ``least``; the best few of each type by the mean of similarity and score."""
    rows = contexts.join(queries, "signal").withColumn("sim", cosine(F.col("vec"), F.col("query_vec"))).where(F.col("sim") >= least)
    rows = rows.withColumn("combined", (F.col("sim") + F.col("score")) / 2)
    rank = F.row_number().over(W.partitionBy("signal", "source_type").orderBy(F.desc(F.round("combined", 12)), "ordinal"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= per_type).drop("query_vec")


def shortened(text: Column) -> Column:
    return F.when(F.length(text) > LONG, F.concat(F.left(text, F.lit(CUT)), F.lit("... [cut]"))).otherwise(text)


def selection_prompts(contexts: DataFrame) -> DataFrame:
    """(signal, source_type, prompt): asks a model which contexts help; contexts are numbered from 0."""
    row = F.struct((ranked(contexts, "signal", "source_type") - 1).alias("i"), "text")
    listed = contexts.withColumn("_row", row).groupBy("signal", "source_type").agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["i"], F.lit("] "), shortened(r["text"]))), "\n\n")
    head = F.concat(F.lit("Signal: "), F.col("signal"), F.lit("\nBelow are contexts of type "), F.col("source_type"), F.lit(". Keep those that could help to plan tests for the signal; when in doubt, keep.\n\n"))
    return listed.select("signal", "source_type", F.concat(head, lines, F.lit("\n\nAnswer with one line: Selected contexts: [numbers]")).alias("prompt"))


def selected_indices(response: Column) -> Column:
    """Numbers of the answer's list; null if the list is missing or any of its items is no number."""
    inner = F.regexp_extract(response, r"Selected contexts:\s*\[([^\]]*)\]", 1)
    items = F.transform(F.filter(F.split(inner, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))
    return F.when(response.rlike(r"Selected contexts:\s*\[[^\]]*\]") & ~F.exists(items, lambda x: x.isNull()), items)


def selected(contexts: DataFrame, responses: DataFrame, fallback: int = 2) -> DataFrame:
    """Contexts that ``responses(signal, source_type, response)`` name; of types without a usable answer the best ``fallback``."""
    picks = responses.select("signal", "source_type", selected_indices(F.col("response")).alias("_i"))
    rows = contexts.withColumn("_k", ranked(contexts, "signal", "source_type") - 1).join(picks, ["signal", "source_type"], "left")
    sizes = contexts.groupBy("signal", "source_type").agg(F.count("*").alias("_n"))
    rows = rows.join(sizes, ["signal", "source_type"])
    valid = F.filter("_i", lambda i: (i >= 0) & (i < F.col("_n")))
    keep = F.when(F.coalesce(F.size(valid), F.lit(0)) > 0, F.array_contains(valid, F.col("_k"))).otherwise(F.col("_k") < fallback)
    return rows.where(keep).drop("_k", "_i", "_n")


def pruned(contexts: DataFrame, ask=None, most: int = MOST_CONTEXTS) -> DataFrame:
    """Prefilter, selection by the model ``ask(prompts) -> responses`` (if given), then the balanced subset."""
    rows = best_per_type(contexts)
    if ask is not None:
        rows = selected(rows, ask(selection_prompts(rows)))
    return balanced(rows, most)


#: Metadata that is shown with each type of context.
SHOWN = {"path": ("path_length", "start_node"), "motif": ("type", "start_node", "metrics"), "community": ("size", "start_node", "metrics"), "local_expansion": ("size", "start_node", "metrics"), "guided_random_walk": ("path_length", "start_node")}


def formatted(contexts: DataFrame) -> DataFrame:
    """With ``rendered``: the text and, below it, the metadata shown for its type."""
    out = F.lit(None).cast("string")
    for kind, keys in SHOWN.items():
        parts = [F.when(F.try_element_at("metadata", F.lit(k)).isNotNull(), F.concat(F.lit(f"{k}: "), F.try_element_at("metadata", F.lit(k)))) for k in keys]
        out = F.when(F.col("source_type") == kind, F.concat_ws("\n", *parts)).otherwise(out)
    return contexts.withColumn("rendered", F.when(F.coalesce(out, F.lit("")) != "", F.concat_ws("\n", "text", out)).otherwise(F.col("text")))


def distribution(contexts: DataFrame, prompts: int = 3) -> DataFrame:
    """(signal, source_type, n, prompt, share): how many contexts of a type each prompt gets, the first ones one more."""
    n = contexts.groupBy("signal", "source_type").agg(F.count("*").alias("n"))
    each = n.withColumn("prompt", F.explode(F.sequence(F.lit(0), F.lit(prompts - 1))))
    share = F.floor(F.col("n") / prompts) + F.when(F.col("prompt") < F.pmod("n", F.lit(prompts)), 1).otherwise(0)
    return each.withColumn("share", share.cast("long"))


TYPE_ORDER = ("rag", "path", "motif", "community", "local_expansion", "guided_random_walk")


def packed(contexts: DataFrame, prompts: int = 3, max_tokens: int = 8000, overhead: int = 0, mode: str = "disjoint") -> DataFrame:
    """(signal, prompt, position, source_type, ordinal, tokens): contexts put into prompts under the budget.

    The budget of a prompt is ``int(max_tokens * 0.75) - overhead``. Each type's contexts by score fill the shares of ``distribution``: in mode
    ``disjoint`` the prompts get consecutive stretches, in mode ``prefix`` each begins at the first again. What a prompt has no
    room for goes to the first that has, or nowhere. Packing is sequential within a signal, so a signal is one group.
    """
    if mode not in ("disjoint", "prefix"):
        raise ValueError(mode)
    room = int(max_tokens * USABLE) - overhead
    sized = formatted(contexts).select("signal", "source_type", "ordinal", "score", token_estimate(F.col("rendered")).alias("tokens"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        left, out, taken = [room] * prompts, [], set()
        order = {t: i for i, t in enumerate(TYPE_ORDER)}
        for kind in sorted(frame["source_type"].unique(), key=lambda t: (order.get(t, len(order)), t)):
            rows = frame[frame["source_type"] == kind].sort_values(["score", "ordinal"], ascending=[False, True], kind="stable")
            items = list(zip(rows["ordinal"], rows["tokens"], strict=True))
            base, extra, at, spilled = len(items) // prompts, len(items) % prompts, 0, []
            for p in range(prompts):
                share = base + (p < extra)
                own = items[at : at + share] if mode == "disjoint" else items[:share]
                at += share
                for item in own:
                    if item[1] <= left[p]:
                        left[p] -= item[1]
                        out.append((p, kind, *item))
                        taken.add((kind, item[0]))
                    else:
                        spilled.append(item)
            for item in spilled:
                p = next((p for p in range(prompts) if item[1] <= left[p]), None)
                if p is not None and (kind, item[0]) not in taken:
                    left[p] -= item[1]
                    out.append((p, kind, *item))
                    taken.add((kind, item[0]))
        count, rows = [0] * prompts, []
        for p, kind, ordinal, tokens in out:
            count[p] += 1
            rows.append((frame["signal"].iloc[0], p, count[p], kind, ordinal, tokens))
        return pd.DataFrame(rows, columns=["signal", "prompt", "position", "source_type", "ordinal", "tokens"])

    kinds = dict(contexts.dtypes)
    return sized.groupBy("signal").applyInPandas(pack, f"signal {kinds['signal']}, prompt int, position int, source_type string, ordinal {kinds['ordinal']}, tokens long")


def prompts(contexts: DataFrame, base: DataFrame, **packing) -> DataFrame:
    """(signal, prompt, text): ``base(signal, base)`` followed by the packed contexts under headings by type; never empty."""
    rows = packed(contexts, **packing).join(formatted(contexts).select("signal", "source_type", "ordinal", "rendered"), ["signal", "source_type", "ordinal"])
    section = rows.groupBy("signal", "prompt", "source_type").agg(F.min("position").alias("p"), F.array_sort(F.collect_list(F.struct("position", "rendered"))).alias("r"))
    part = F.concat(F.lit("## "), F.col("source_type"), F.lit(" contexts\n"), F.array_join(F.transform("r", lambda x: x["rendered"]), "\n\n"))
    body = section.withColumn("part", part).groupBy("signal", "prompt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    return base.join(body, "signal", "left").select("signal", F.coalesce("prompt", F.lit(0)).alias("prompt"), F.concat_ws("\n\n", "base", "body").alias("text"))


def path_text(style: str = "standard") -> Column:
    """A path as text from columns names, types, relations (arrays along the path), importance and length."""
    arrow = F.array_join(F.col("names"), " -> ")
    if style == "concise":
        return arrow
    chain = F.array_join(F.transform("names", lambda n, i: F.when(i == 0, n).otherwise(F.concat(F.lit("-["), F.coalesce(F.get("relations", i - 1), F.lit("linked")), F.lit("]-> "), n))), " ")
    lines = F.array_join(F.transform("names", lambda n, i: F.concat(F.lit("- "), n, F.lit(" ("), F.coalesce(F.get("types", i), F.lit("unknown")), F.lit(")"))), "\n")
    if style == "detailed":
        return F.concat_ws("\n", F.concat(F.lit("Path: "), chain), lines, F.concat(F.lit("Importance: "), fixed(F.col("importance"))))
    if style == "verification":
        low = F.lower(arrow)
        hints = [(r"clk|clock", "check timing against the clock"), (r"rst|reset", "check reset along the path"), (r"en|sel|ctrl|control", "check that control signals gate the path"), (r"data|bus", "check that data arrives unchanged")]
        notes = F.concat_ws("; ", *[F.when(low.rlike(p), F.lit(t)) for p, t in hints])
        return F.concat_ws("\n", F.concat(F.lit("Path: "), chain), F.when(notes != "", F.concat(F.lit("To verify: "), notes)))
    if style != "standard":
        raise ValueError(style)
    return F.concat_ws("\n", F.concat(F.lit("Path of "), F.col("length"), F.lit(" nodes: "), chain), lines)


def described_paths(paths: DataFrame, nodes: DataFrame, pairs: DataFrame, style: str = "standard") -> DataFrame:
    """``paths`` with ``text``. pairs: with relation and relationship."""
    at = paths.withColumn("_id", F.xxhash64("path")).select("_id", F.posexplode("path").alias("i", "node"))
    named = at.join(nodes.select(F.col("node_id").alias("node"), F.coalesce("name", F.col("node_id").cast("string")).alias("name"), F.coalesce("type", F.lit("unknown")).alias("type")), "node", "left")
    nxt = F.lead("node").over(W.partitionBy("_id").orderBy("i"))
    hop = named.withColumn("nxt", nxt).withColumns({"a": F.least("node", "nxt"), "b": F.greatest("node", "nxt")})
    hop = hop.join(pairs.select("a", "b", F.coalesce("relationship", "relation").alias("rel")), ["a", "b"], "left")
    got = hop.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("i", "name", "type", F.coalesce("rel", F.lit("linked")).alias("rel")))).alias("h"))
    got = got.select("_id", F.transform("h", lambda x: x["name"]).alias("names"), F.transform("h", lambda x: x["type"]).alias("types"), F.transform("h", lambda x: x["rel"]).alias("relations"))
    return paths.withColumn("_id", F.xxhash64("path")).join(got, "_id").withColumn("text", path_text(style)).drop("_id", "names", "types", "relations")


def described_groups(members: DataFrame, nodes: DataFrame, pairs: DataFrame, title: str, key: str = "start") -> DataFrame:
    """(key, text): counts by type and the first names of each, and the nodes with most neighbours."""
    info = members.join(nodes.select(F.col("node_id").alias("node"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("name", F.col("node_id").cast("string")).alias("name")), "node")
    by_type = info.groupBy(key, "type").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("name")), 1, 5).alias("some"))
    lines = by_type.groupBy(key).agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n", "some"))), lambda x: F.concat(F.lit("- "), x["n"], F.lit(" "), x["type"], F.lit(": "), F.array_join(x["some"], ", "))), "\n").alias("lines"))
    inside = both_ways_in(induced(members, pairs, key), key).groupBy(key, "node").agg(F.count("*").alias("d")).join(info.select(key, "node", "name"), [key, "node"])
    hubs = inside.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("d"), "node"))).where("r <= 3").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name", "d"))), lambda x: F.concat(x["name"], F.lit(" ("), x["d"], F.lit(")"))), ", ").alias("hubs"))
    return lines.join(hubs, key, "left").select(key, F.concat_ws("\n", F.concat(F.lit(f"{title} of "), F.col("total"), F.lit(" nodes")), "lines", F.when(F.col("hubs").isNotNull(), F.concat(F.lit("Most connected: "), F.col("hubs")))).alias("text"))


def both_ways_in(inside: DataFrame, key: str) -> DataFrame:
    return inside.select(key, F.col("a").alias("node"), F.col("b").alias("other")).union(inside.select(key, F.col("b"), F.col("a")))


def union_contexts(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
