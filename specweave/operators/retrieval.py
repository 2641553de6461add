"""Chunking, TF-IDF retrieval, retrieval scores and dense retrieval.

Documents stay apart: chunks are cut and numbered within each. The idf is that of the chunk table. Everything is joins
on terms: chunk texts never meet each other, and only per-query ranks are sorted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.functions.text import cosine, tokens, words
from specweave.scratch import written

SIZES = (50, 100, 200, 800, 3200)
RATIOS = (0.2, 0.4)
PER_RETRIEVER = 20
PER_QUERY = 10
BEST_SPEC, BEST_RTL, RTL_BONUS = 100, 50, 1.1


def chunk_words(docs: DataFrame, size: int = 100, overlap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_idx, chunk, n_words): windows of ``size`` words that start every ``size - overlap`` words."""
    step = size - overlap
    if step < 1:
        raise ValueError("overlap must be smaller than size")
    split = docs.select(F.col(id_col), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    cut = split.select(id_col, "_w", F.posexplode(starts).alias("chunk_idx", "_at"))
    part = F.slice("_w", F.col("_at") + 1, F.lit(size))
    return cut.select(id_col, "chunk_idx", F.array_join(part, " ").alias("chunk"), F.size(part).alias("n_words"))


def chunk_many(docs: DataFrame, sizes=SIZES, ratios=RATIOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of every size and overlap ratio, with columns chunk_size and overlap."""
    parts = [chunk_words(docs, s, int(s * r), id_col, text_col).withColumn("chunk_size", F.lit(s)).withColumn("overlap", F.lit(int(s * r))) for s in sizes for r in ratios]
    return functools.reduce(DataFrame.unionByName, parts)


#: Words that open and close blocks of code.
OPENERS = ("module ", "function ", "task ", "always ", "initial ")
CLOSERS = ("endmodule", "endfunction", "endtask")


def chunk_code(files: DataFrame, size: int = 100, overlap: int = 20, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, chunk_idx, chunk, n_words): whole lines, up to ``size`` words where a line may start a chunk; ``overlap`` in lines.

    A line that opens or closes a block starts no chunk. One fold over the lines of a file, each with its number of words and whether
    it may start a chunk, finds the spans of lines; the texts are cut by span afterwards.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    cut = files.select(id_col, lines.alias("_lines"))
    free = " or ".join(f"contains(x, '{w}')" for w in OPENERS + CLOSERS)
    marks = F.expr(f"transform(_lines, (x, i) -> struct(i as i, size(filter(split(x, '\\\\s+'), w -> w <> '')) as n, not ({free}) as free))")
    back = f"greatest(s.a, x.i - {int(overlap)})"
    full = f"x.free and s.held + x.n > {int(size)}"
    spans = F.expr(f"""
      aggregate(_marks, named_struct('a', 0, 'held', 0, 'spans', cast(array() as array<struct<a:int,b:int>>)),
        (s, x) -> if({full},
          named_struct('a', {back}, 'held', aggregate(slice(_marks, {back} + 1, x.i - {back}), x.n, (t, y) -> t + y.n),
            'spans', if(x.i > s.a, concat(s.spans, array(named_struct('a', s.a, 'b', x.i))), s.spans)),
          named_struct('a', s.a, 'held', s.held + x.n, 'spans', s.spans)),
        s -> concat(s.spans, array(named_struct('a', s.a, 'b', size(_marks)))))""")
    cut = cut.withColumn("_marks", marks).select(id_col, "_lines", F.posexplode(spans).alias("chunk_idx", "_span"))
    text = F.array_join(F.slice("_lines", F.col("_span.a") + 1, F.col("_span.b") - F.col("_span.a")), "\n")
    return cut.select(id_col, "chunk_idx", text.alias("chunk")).withColumn("n_words", F.size(words(F.col("chunk"))))


def term_counts(chunks: DataFrame, keys: list[str], text_col: str = "chunk") -> DataFrame:
    """(keys, term, tf): terms are words of two characters or more."""
    return chunks.select(*keys, F.explode(tokens(F.col(text_col), 2)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def inverse_frequencies(counts: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + N) / (1 + df)) + 1; ``n_chunks``: one row with N as n."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_chunks)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, w): tf * idf, each vector of length one."""
    raw = counts.join(idf, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, keys).select(*keys, "term", (F.col("x") / F.col("norm")).alias("w"))


def _ranked(hit: DataFrame, last: DataFrame, queries: DataFrame, keys: list[str], by: list[str], k: int) -> DataFrame:
    """The ``k`` best of ``hit(by, query_id, keys, sim)`` for each ``by`` and query, filled up from ``last(by, keys)``."""
    latest = [F.desc(c) for c in keys]
    place = F.row_number().over(W.partitionBy(*by, "query_id").orderBy(F.desc(F.round("sim", 12)), *latest))
    best = written(hit.select(*by, "query_id", *keys, "sim").withColumn("_r", place).where(F.col("_r") <= k).drop("_r"), "best", True)  # read twice
    fill = queries.select("query_id").crossJoin(F.broadcast(last)).select(*by, "query_id", *keys).join(best, [*by, "query_id", *keys], "left_anti").withColumn("sim", F.lit(0.0))
    return best.unionByName(fill).withColumn("rank", place).where(F.col("rank") <= k)


def top_chunks(chunks: DataFrame, queries: DataFrame, k: int = PER_RETRIEVER, keys: tuple[str, ...] = ("doc_id", "chunk_idx"), text_col: str = "chunk", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query_id, keys, sim, rank): the ``k`` chunks nearest to each of ``queries(query_id, query)`` by TF-IDF cosine.

    Ties go to the later chunk. Chunks without a shared term fill up, latest first. ``by``: columns that tell separate tables of
    chunks apart, each with its own idf. Of the weights of all chunks only lengths and query terms are needed.
    """
    keys, by = list(keys), list(by)
    chunks = written(chunks.select(*by, *keys, text_col), "chunks")
    counts = written(term_counts(chunks, [*by, *keys], text_col), "terms")  # read for frequencies, lengths and matches
    n = chunks.groupBy(*by).agg(F.count("*").alias("n"))
    df = counts.groupBy(*by, "term").agg(F.count("*").alias("df"))
    idf = (df.join(F.broadcast(n), by) if by else df.crossJoin(F.broadcast(n))).select(*by, "term", _idf(F.col("n"), F.col("df")).alias("idf"))
    idf = written(idf, "idf")
    norm = counts.join(idf, [*by, "term"]).groupBy(*by, *keys).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    query_w = _query_weights(queries, idf, by)
    hit = counts.join(query_w, [*by, "term"]).groupBy(*by, "query_id", *keys).agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot")).join(norm, [*by, *keys])
    hit = hit.withColumn("sim", F.col("dot") / F.col("norm"))
    late = F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in keys]))
    last = chunks.select(*by, *keys).withColumn("_r", late).where(F.col("_r") <= 2 * k).drop("_r") if by else chunks.select(*keys).orderBy(*[F.desc(c) for c in keys]).limit(2 * k)
    return _ranked(hit, last, queries, keys, by, k)  # at least k of the last are not among the best


def _idf(n, df):
    return F.log((1 + n) / (1 + df)) + 1


def _query_weights(queries: DataFrame, idf: DataFrame, by: list[str]) -> DataFrame:
    """(by, query_id, term, q, idf): weights of the queries' terms, each query's vector of length one."""
    raw = term_counts(queries, ["query_id"], "query").join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(*by, "query_id")))
    return raw.select(*by, "query_id", "term", (F.col("x") / norm).alias("q"), "idf")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all rows, and the row of each."""
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _windows(p: np.ndarray, row: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, chunk, how many of the row's places it holds); ``p`` ascends within a row, chunk i holds places i * step to i * step + size - 1.

    Places between two starts of chunks follow each other, and every chunk is some of these stretches and the front of one more.
    """
    if not len(p):
        return p, p, p
    most = int(p.max()) // step + 1

    def runs(q, r):
        key = r * most + q // step
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        return key[at], np.diff(np.append(at, len(key)))

    key, n = runs(p, row)
    parts = [(key[key % most >= j] - j, n[key % most >= j]) for j in range(size // step)]
    if size % step:
        j = size // step
        front = (p % step < size % step) & (p >= j * step)
        key, n = runs(p[front], row[front])
        parts.append((key - j, n))
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, n = key[at], np.add.reduceat(n, at)
    return key // most, key % most, n


def top_windows(docs: DataFrame, queries: DataFrame, configs: list[tuple[int, int]], k: int = PER_RETRIEVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(config, query_id, doc_id, chunk_idx, sim, rank): ``top_chunks`` over the chunks of ``chunk_words`` for each (size, overlap), without cutting them.

    Texts are split into terms once. A document's term is one row with the places it stands at, and every chunk is a range of
    places: document frequencies are sums of how many chunks of each configuration a row's places touch. Terms meet their
    frequencies in one join, and are counted by chunk where their document is, as arrays, so that only lengths of chunks are left to shuffle.
    """
    sizes = [(c, size, size - overlap) for c, (size, overlap) in enumerate(configs)]
    # one pattern a text, not a word: what belongs to no term becomes one mark, at which words are split
    marked = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]+", "\u0001")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spread = texts.repartition("id").select("id", words(marked).alias("w"))
    terms = spread.select("id", F.posexplode("w").alias("at", "word")).select("id", "at", F.explode(F.split("word", "\u0001")).alias("term")).where("char_length(term) >= 2")
    rows = written(terms.groupBy("id", "term").agg(F.array_sort(F.collect_list("at")).alias("at")).withColumn("row", F.monotonically_increasing_id()), "places")

    steps = [(size, d) for _, size, d in sizes]
    names = [f"df{c}" for c, _, _ in sizes]

    def touched(batches):
        """How many chunks of each configuration a row's places touch."""
        for batch in batches:
            p, row = _flat(batch.column(1))
            found = [np.bincount(_windows(p, row, size, d)[0], minlength=batch.num_rows) for size, d in steps]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found)], ["term", *names])

    df = rows.select("term", "at").mapInArrow(touched, "term string, " + ", ".join(f"{x} long" for x in names)).groupBy("term").agg(*[F.sum(x).alias(x) for x in names])
    df = written(df, "frequencies", True)
    lengths = texts.select("id", F.size(words(F.col("text"))).alias("n")).where("n > 0")
    total = lengths.agg(*[F.coalesce(F.sum(F.expr(f"(n - 1) div {d} + 1")), F.lit(0)).alias(f"n{c}") for c, _, d in sizes]).first()  # one row
    wide = df.select("term", F.array(*[_idf(F.lit(total[f"n{c}"]), F.col(f"df{c}")) for c, _, _ in sizes]).alias("idfs"))
    idf = wide.select("term", F.posexplode("idfs").alias("config", "idf"))
    query_w = written(_query_weights(queries, idf, ["config"]), "query-weights", True)

    ranges = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(size).alias("size"), F.lit(d).alias("step")) for c, size, d in sizes])

    # chunks of step d that hold place p: from first(p) to p div d
    first = lambda p, size, d: f"if({p} < {size}, 0, ({p} - {size}) div {d} + 1)"

    def by_chunk(found: DataFrame, weight) -> DataFrame:
        """(id, config, chunk_idx, row, x) of rows (id, row, at): the summed weights of a row's places; a document's are in one task."""
        every = found.select("*", F.explode("at").alias("p")).drop("at").select("*", F.explode(ranges).alias("c")).withColumn("w", weight)
        every = every.select("id", "c.config", "row", "w", F.explode(F.expr(f"sequence({first('p', 'c.size', 'c.step')}, p div c.step)")).alias("chunk_idx"))
        return every.groupBy("id", "config", "chunk_idx", "row").agg(F.sum("w").alias("x"))

    n_chunks = [total[f"n{c}"] for c, _, _ in sizes]

    def squares(batches):
        """Squared weights by chunk, summed over a batch; the rows of a document follow each other."""
        for batch in batches:
            p, row = _flat(batch.column(1))
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            doc = ids.indices.to_numpy()
            dfs = batch.column(2).flatten().to_numpy().reshape(-1, len(steps))
            for c, (size, d) in enumerate(steps):
                r, chunk, tf = _windows(p, row, size, d)
                if not len(r):
                    continue
                x = tf * (np.log((1 + n_chunks[c]) / (1.0 + dfs[:, c])) + 1)[r]
                most = int(chunk.max()) + 1
                key = doc[r].astype(np.int64) * most + chunk
                if len(ids.dictionary) * most <= 4 * len(key) + (1 << 20):
                    held = np.flatnonzero(np.bincount(key))
                    sums = np.bincount(key, x * x)[held]
                else:
                    held, at = np.unique(key, return_inverse=True)
                    sums = np.bincount(at, x * x)
                yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(held // most)), pa.array(np.full(len(held), c, np.int32)), pa.array(held % most), pa.array(sums)], ["id", "config", "chunk_idx", "x"])

    kind = dict(rows.dtypes)["id"]
    few = F.array(*names).cast("array<int>") if max(n_chunks) < 1 << 31 else F.array(*names)  # no frequency is larger
    weighted = rows.join(df.select("term", few.alias("dfs")), "term").select("id", "at", "dfs").repartition("id").sortWithinPartitions("id")
    norm = weighted.mapInArrow(squares, f"id {kind}, config int, chunk_idx long, x double").groupBy("id", "config", "chunk_idx").agg(F.sqrt(F.sum("x")).alias("norm"))
    asked = queries.select(F.explode(tokens(F.col("query"), 2)).alias("term")).distinct()
    match = rows.join(F.broadcast(asked), "term")
    tf = by_chunk(match.drop("term").repartition("id"), F.lit(1.0)).join(match.select("row", "term"), "row")
    dot = tf.join(query_w, ["config", "term"]).groupBy("id", "config", "chunk_idx", "query_id").agg(F.sum(F.col("x") * F.col("idf") * F.col("q")).alias("dot"))
    hit = dot.join(norm, ["id", "config", "chunk_idx"]).withColumn("sim", F.col("dot") / F.col("norm"))

    late = lengths.orderBy(F.desc("id")).limit(2 * k).select("id", "n", F.explode(ranges).alias("c")).select("id", "c.config", F.explode(F.expr("sequence(0, (n - 1) div c.step)")).alias("chunk_idx"))
    last = late.withColumn("_r", F.row_number().over(W.partitionBy("config").orderBy(F.desc("id"), F.desc("chunk_idx")))).where(F.col("_r") <= 2 * k).drop("_r")
    top = _ranked(hit.withColumn("chunk_idx", F.col("chunk_idx").cast("int")), last.withColumn("chunk_idx", F.col("chunk_idx").cast("int")), queries, ["id", "chunk_idx"], ["config"], k)
    return top.withColumnRenamed("id", id_col)


def retrieval_score(rank: str = "rank", n_words: str = "n_words", best: int = BEST_SPEC, bonus: float = 1.0):
    """Mean of 1/rank and of closeness to the best length in words."""
    return (F.lit(1.0) / F.col(rank) + F.lit(1.0) / (F.abs(F.col(n_words) - best) + 1)) / 2 * bonus


def rag_contexts(docs: DataFrame, queries: DataFrame, rtl: DataFrame | None = None, sizes=SIZES, ratios=RATIOS, k: int = PER_RETRIEVER, keep: int = PER_QUERY) -> DataFrame:
    """(query_id, ordinal, text, score, chunk_size, overlap, rank, content_type): the best ``keep`` over all retrievers.

    ``rtl``: (file, text), chunked by lines.
    """
    configs = [(s, int(s * r)) for s in sizes for r in ratios]
    named = F.array(*[F.struct(F.lit(s).alias("chunk_size"), F.lit(o).alias("overlap")) for s, o in configs])
    found = []
    # of the best chunks, a bounded number a query, texts are cut where their documents are
    top = written(top_windows(docs, queries, configs, k, docs.columns[0]), "top-windows", True).withColumn("c", F.get(named, F.col("config")))
    text = words(F.col("text"))
    step = F.col("c.chunk_size") - F.col("c.overlap")
    chunk = F.slice(text, F.col("chunk_idx") * step + 1, F.col("c.chunk_size"))
    spec = top.join(docs.select(docs.columns[0], "text"), docs.columns[0]).withColumn("_c", chunk).withColumn("text", F.array_join("_c", " ")).withColumn("n_words", F.size("_c"))
    found.append(spec.withColumns({"score": retrieval_score(), "content_type": F.lit("spec"), "_o": F.col("config")}))
    if rtl is not None:
        key = rtl.columns[0]
        chunks = [chunk_code(rtl, s, o, key).withColumn("config", F.lit(i)) for i, (s, o) in enumerate(configs)]
        chunks = written(functools.reduce(DataFrame.unionByName, chunks), "code-chunks")
        code = top_chunks(chunks, queries, k, (key, "chunk_idx"), by=("config",)).join(chunks, ["config", key, "chunk_idx"])
        code = code.withColumns({"c": F.get(named, F.col("config")), "text": F.col("chunk"), "score": retrieval_score(best=BEST_RTL, bonus=RTL_BONUS), "content_type": F.lit("rtl"), "_o": F.col("config") + len(configs)})
        found.append(code)
    found = [x.select("query_id", "_o", "rank", "text", "score", "c.chunk_size", "c.overlap", "content_type") for x in found]
    every = functools.reduce(DataFrame.unionByName, found)
    ordinal = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "_o", "rank"))
    return every.withColumn("ordinal", ordinal).where(F.col("ordinal") <= keep).drop("_o")


def whole_text_context(docs: DataFrame, queries: DataFrame, rtl: DataFrame | None = None) -> DataFrame:
    """One context of score 1 a query: the documents and then the code, in order of their ids."""
    def joined(df: DataFrame, key: str) -> DataFrame:
        return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), "\n\n").alias("t"))

    text = joined(docs, docs.columns[0])
    if rtl is not None:
        text = text.crossJoin(joined(rtl, rtl.columns[0]).withColumnRenamed("t", "u")).select(F.concat_ws("\n\n", "t", "u").alias("t"))
    return queries.select("query_id").crossJoin(text).select("query_id", F.lit(1).alias("ordinal"), F.col("t").alias("text"), F.lit(1.0).alias("score"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, sim, rank): the nearest vectors to each of ``queries(query_id, query_vec)``, a small broadcast table."""
    pairs = vectors.crossJoin(F.broadcast(queries)).select("query_id", F.col(id_col), cosine(F.col(vec_col), F.col("query_vec")).alias("sim"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("sim", 12)), F.desc(id_col)))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def node_texts(nodes: DataFrame) -> DataFrame:
    """(node_id, text): what the dense retriever embeds, the id and all attribute values."""
    return nodes.select("node_id", F.concat_ws(" ", F.col("node_id"), F.array_join(F.map_values("attributes"), " ")).alias("text"))


def hashed_vectors(texts: DataFrame, id_col: str, text_col: str = "text", dims: int = 64) -> DataFrame:
    """(id, embedding): signed feature hashing of words, an offline stand-in for a sentence encoder."""
    hits = texts.select(id_col, F.explode(tokens(F.col(text_col))).alias("t")).select(id_col, F.pmod(F.xxhash64("t"), F.lit(dims)).alias("d"), F.when(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    sums = hits.groupBy(id_col, "d").agg(F.sum("s").alias("s")).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("d", "s"))).alias("m"))
    return sums.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0))).alias("embedding"))
