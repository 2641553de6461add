"""Chunks, retrieval, pruning and packing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from specweave.functions import text as T
from specweave.operators import context as X
from specweave.operators import retrieval as V


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_chunks(spark):
    got = [(r["chunk_idx"], r["chunk"]) for r in V.chunk_words(docs(spark, "a b c d e f g h i j"), 4, 1).orderBy("chunk_idx").collect()]
    assert got == [(0, "a b c d"), (1, "d e f g"), (2, "g h i j"), (3, "j")]
    assert V.chunk_words(docs(spark, "", None, "  ")).count() == 0
    with pytest.raises(ValueError):
        V.chunk_words(docs(spark, "a"), 5, 5)


def test_every_word_is_in_a_chunk(spark):
    words = [f"w{i}" for i in range(997)]
    got = V.chunk_many(docs(spark, " ".join(words)), (50, 100), (0.2, 0.4)).collect()
    for size in (50, 100):
        for overlap in (int(size * 0.2), int(size * 0.4)):
            own = [r["chunk"].split() for r in got if (r["chunk_size"], r["overlap"]) == (size, overlap)]
            assert set().union(*own) == set(words) and max(map(len, own)) == size


def test_code_chunks_keep_blocks(spark):
    text = "module m;\n" + "\n".join(f"wire w{i} ;" for i in range(9)) + "\nendmodule"
    files = spark.createDataFrame([("m.v", text)], "file string, text string")
    parts = [r["chunk"] for r in V.chunk_code(files, 9, 1).orderBy("chunk_idx").collect()]
    assert parts[0].startswith("module m;") and parts[-1].endswith("endmodule")
    assert all(not p.startswith("endmodule") for p in parts)


def test_tfidf(spark):
    rows = ["red red blue", "blue green", "green green yellow"]
    chunks = V.chunk_words(docs(spark, *rows), 100, 0)
    q = spark.createDataFrame([("q", "red blue"), ("none", "zzz")], "query_id string, query string")
    got = {(r["query_id"], r["doc_id"]): (r["sim"], r["rank"]) for r in V.top_chunks(chunks, q, 3).collect()}
    idf = lambda t: math.log(4 / (1 + sum(t in r.split() for r in rows))) + 1
    vec = lambda r: {t: r.split().count(t) * idf(t) for t in set(r.split())}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    qv = vec("red blue")
    want = [sum(v.get(t, 0) * qv[t] for t in qv) / norm(v) / norm(qv) for v in map(vec, rows)]
    assert [got[("q", i)][0] for i in range(3)] == pytest.approx(want)
    assert [got[("q", i)][1] for i in range(3)] == [1, 2, 3]
    assert [got[("none", i)] for i in (2, 1, 0)] == [(0.0, 1), (0.0, 2), (0.0, 3)]


def test_scores_and_whole_text(spark):
    q = spark.createDataFrame([("q", "red")], "query_id string, query string")
    got = V.rag_contexts(docs(spark, "red " * 80, "blue"), q, sizes=(100,), ratios=(0.2,)).orderBy("ordinal").collect()
    assert got[0]["score"] == pytest.approx((1 + 1 / 21) / 2) and got[0]["rank"] == 1
    rtl = spark.createDataFrame([("a.v", "module m; red endmodule")], "file string, text string")
    assert {r["content_type"] for r in V.rag_contexts(docs(spark, "red"), q, rtl, (100,), (0.2,)).collect()} == {"spec", "rtl"}
    assert V.whole_text_context(docs(spark, "x", "y"), q, rtl).first()["text"] == "x\n\ny\n\nmodule m; red endmodule"


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.0, 0.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vec array<double>")
    assert [(r["vec_id"], round(r["sim"], 6)) for r in V.nearest_vectors(v, q, 2).orderBy("rank").collect()] == [(0, 1.0), (1, 0.8)]


def test_formats(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.fixed(F.lit(0.125))) == "0.12" and one(T.fixed(F.lit(1234567.0))) == "1234567.00"
    assert one(T.file_size(F.lit(512))) == "512.00 B" and one(T.file_size(F.lit(1536))) == "1.50 KB" and one(T.file_size(F.lit(3 << 30))) == "3.00 GB"
    assert one(T.duration(F.lit(90.0))) == "1.50 mins" and one(T.duration(F.lit(7200.0))) == "2.00 hours"
    assert one(T.token_estimate(F.lit(""))) == 0 and one(T.token_estimate(F.lit("ab"))) == 1 and one(T.token_estimate(F.lit("a " * 10))) == 10
    assert one(T.number_in(F.lit("x/property_goldmine_12.sva"))) == 12 and one(T.number_in(F.lit("none.txt"))) is None
    assert one(T.natural_order(F.lit("a2"))) < one(T.natural_order(F.lit("a10")))
    assert one(F.array_join(T.tokens(F.lit("Été_1, l'eau")), "|")) == "été_1|l|eau"


def contexts(spark, rows):
    return spark.createDataFrame([("s", t, i, x, s, {}) for i, (t, s, x) in enumerate(rows)], "signal string, source_type string, ordinal int, text string, score double, metadata map<string,string>")


def test_balanced(spark):
    c = contexts(spark, [("a", s / 10, "x") for s in (9, 8, 7, 6, 5)] + [("b", 0.1, "x"), ("c", 0.2, "x")])
    got = {(r["source_type"], r["ordinal"]) for r in X.balanced(c, 5).collect()}
    assert got == {("a", 0), ("a", 1), ("a", 2), ("b", 5), ("c", 6)}
    assert X.balanced(c, 100).count() == 7
    assert X.best_per_type(c, 2).count() == 4


def test_selection(spark):
    c = contexts(spark, [("a", 0.9, "x"), ("a", 0.8, "y"), ("a", 0.7, "z"), ("b", 0.5, "w" * 900)])
    assert "[0] x" in X.selection_prompts(c).where("source_type = 'a'").first()["prompt"]
    assert "[cut]" in X.selection_prompts(c).where("source_type = 'b'").first()["prompt"]
    answer = lambda a: spark.createDataFrame([("s", "a", a)], "signal string, source_type string, response string")
    pick = lambda a: {r["ordinal"] for r in X.selected(c, answer(a)).collect()}
    assert pick("ok\nSelected contexts: [2, 0, 7]") == {0, 2, 3}
    assert pick("Selected contexts: [1, two]") == {0, 1, 3} == pick("nonsense") == pick("Selected contexts: []")
    kept = X.pruned(c, lambda p: p.select("signal", "source_type", F.lit("Selected contexts: [0]").alias("response")))
    assert {r["ordinal"] for r in kept.collect()} == {0, 3}


def test_similarity(spark):
    c = contexts(spark, [("a", 0.2, "x"), ("a", 0.9, "y"), ("a", 0.5, "z")]).withColumn("vec", F.when(F.col("ordinal") == 0, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("ordinal") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0))))
    q = spark.createDataFrame([("s", [1.0, 0.0])], "signal string, query_vec array<double>")
    assert [(r["ordinal"], r["rank"]) for r in X.similar_contexts(c, q).orderBy("rank").collect()] == [(2, 1), (0, 2)]


def test_distribution_and_packing(spark):
    c = contexts(spark, [("rag", 1 - i / 10, "word " * 4) for i in range(7)])
    assert [r["share"] for r in X.distribution(c, 3).orderBy("prompt").collect()] == [3, 2, 2]
    got = X.packed(c, 3, 8000).collect()
    assert sorted(r["ordinal"] for r in got) == list(range(7))
    assert {(r["prompt"], r["ordinal"]) for r in got} == {(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)}
    prefix = X.packed(c, 3, 8000, mode="prefix").collect()
    assert {r["ordinal"] for r in prefix} == {0, 1, 2}
    with pytest.raises(ValueError):
        X.packed(c, mode="other")


def test_budget_is_kept(spark):
    rng = random.Random(1)
    c = contexts(spark, [(rng.choice(["rag", "path", "motif"]), rng.random(), "w " * rng.randint(1, 60)) for _ in range(60)])
    used = {}
    for r in X.packed(c, 3, 200, overhead=10).collect():
        used[r["prompt"]] = used.get(r["prompt"], 0) + r["tokens"]
    assert used and max(used.values()) <= 140


def test_prompts(spark):
    c = contexts(spark, [("rag", 0.9, "alpha"), ("path", 0.8, "beta")]).withColumn("metadata", F.create_map(F.lit("path_length"), F.lit("3")))
    base = spark.createDataFrame([("s", "BASE"), ("other", "ONLY")], "signal string, base string")
    got = {(r["signal"], r["prompt"]): r["text"] for r in X.prompts(c, base, prompts=2).collect()}
    assert got[("s", 0)].startswith("BASE\n\n## rag contexts\nalpha") and "path_length: 3" in got[("s", 0)]
    assert got[("other", 0)] == "ONLY"
