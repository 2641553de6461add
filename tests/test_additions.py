"""Token windows, Louvain communities, gleaning and reports, PDF text, and guards."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave import scratch
from specweave.operators import communities as C
from specweave.operators import entities as E
from specweave.operators import graph as G
from specweave.operators import retrieval as V
from specweave.operators import tokenizing as T
from specweave.plans import build_kg, use_kg
from specweave.sources import documents as D
from specweave.sources import results as SR
from specweave.sources.pdf import pdf_pages
from test_graph import metrics


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def test_token_windows(spark, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    with open(vocabulary, "rb") as f:
        coder = T._coder(f.read(), T.PATTERN)
    assert isinstance(coder, tiktoken.Encoding)
    texts = ["the quick brown fox " * 60, "", None, "naïve ✓ 日本語", "x" * 50 + " y" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [coder.encode_ordinary(t or "") for t in texts]
    assert [r["tokens"] for r in T.token_counts(df, vocabulary).orderBy("doc_id").collect()] == [len(x) for x in want]
    got = T.chunk_tokens(df, vocabulary, 100, 20).orderBy("doc_id", "chunk_idx").collect()
    for i, ids in enumerate(want):
        own = [r for r in got if r["doc_id"] == i]
        assert [r["chunk"] for r in own] == [coder.decode_bytes(ids[a : a + 100]).decode("utf-8", "replace") for a in range(0, len(ids), 80)]
    with pytest.raises(ValueError):
        T.chunk_tokens(df, vocabulary, 10, 10)


def test_windows_rank_like_chunks(spark):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 40 + i))) for i in range(12)] + [(50, None), (51, " - ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([("a", "w3 w5"), ("b", "w0 zz"), ("c", "nothing")], "query_id string, query string")
    key = lambda r: (r["query_id"], r["doc_id"], r["chunk_idx"], round(r["sim"], 9), r["rank"])
    got = V.top_windows(df, q, [(10, 4), (7, 0)], 5).collect()
    for i, (size, overlap) in enumerate([(10, 4), (7, 0)]):
        want = sorted(map(key, V.top_chunks(V.chunk_words(df, size, overlap), q, 5).collect()))
        assert sorted(key(r) for r in got if r["config"] == i) == want


def test_windows_make_no_row_for_each_place(spark):
    words = [f"w{i % 40}" for i in range(3000)]
    df = spark.createDataFrame([(i, " ".join(words[i:])) for i in range(4)], "doc_id long, text string")
    q = spark.createDataFrame([("a", "w3 w5")], "query_id string, query string")
    configs = [(s, int(s * r)) for s in V.SIZES for r in V.RATIOS]
    # 12,000 places; a chunk of each configuration holds most of its places' terms once
    assert max(metrics(spark, lambda: V.top_windows(df, q, configs, 5).collect())) <= 12_000
    got = {r["chunk_idx"]: r["n"] for r in V.top_windows(df, q, [(10, 4), (7, 0), (9, 6)], 3).groupBy("chunk_idx").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 9


@pytest.mark.parametrize(("size", "step"), [(10, 6), (7, 7), (9, 3), (10, 3), (50, 40)])
def test_places_by_window(size, step):
    draw = random.Random(size)
    rows = [sorted(draw.sample(range(200), draw.randrange(1, 60))) for _ in range(20)]
    want = {(r, c): n for r, ps in enumerate(rows) for c in range(max(ps) // step + 1) if (n := sum(c * step <= p < c * step + size for p in ps))}
    p, row = np.array([p for ps in rows for p in ps]), np.array([r for r, ps in enumerate(rows) for _ in ps])
    got = V._windows(p, row, size, step)
    assert {(r, c): n for r, c, n in zip(*(x.tolist() for x in got), strict=True)} == want and len(got[0]) == len(want)


def test_louvain(spark):
    groups = [list(range(a, a + 6)) for a in (0, 10, 20)]
    edges = [p for g in groups for p in itertools.combinations(g, 2)] + [(5, 10), (15, 20)]
    pairs = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(i,) for g in groups for i in g] + [(99,)], "node_id long")
    got = {r["node_id"]: r["community"] for r in C.louvain(nodes, pairs).collect()}
    assert got == {**{i: g[0] for g in groups for i in g}, 99: 99}
    assert C.modularity(pairs, C.louvain(nodes, pairs)) > 0.55
    assert C.louvain(nodes, pairs.where("false")).where("node_id = community").count() == 19


def rings(n, seed):
    """Rings of 20 with random chords, some of them between rings."""
    draw = random.Random(seed)
    edges = {(i, i + 1 if i % 20 < 19 else i - 19) for i in range(n)} | {(i, i // 20 * 20 + draw.randrange(20)) for i in range(n) for _ in range(3)}
    return sorted({(min(e), max(e)) for e in edges | {(draw.randrange(n), draw.randrange(n)) for _ in range(n // 4)}})


def test_louvain_same_moves_by_arrays_and_joins(spark):
    pairs = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in rings(200, 5)], "a string, b string")
    nodes = spark.createDataFrame([(f"v{i}",) for i in range(199)] + [("alone",)], "node_id string")  # v199 is an end only
    sent, joined = ({r["node_id"]: r["community"] for r in C.louvain(nodes, pairs, most_sent=m).collect()} for m in (1000, 0))
    assert sent == joined and len(sent) == 200 and "v199" not in sent and sent["alone"] == "alone"
    assert all(c == min(v for v in sent if sent[v] == c) for c in sent.values())
    whole = nodes.union(spark.createDataFrame([("v199",)], "node_id string"))
    assert C.modularity(pairs, C.louvain(whole, pairs)) > 0.6


def test_louvain_rounds_move_no_links(spark):
    edges = rings(1000, 7)
    pairs, nodes = spark.createDataFrame(edges, "a long, b long"), spark.range(1000).withColumnRenamed("id", "node_id")
    links = 2 * len([e for e in edges if e[0] != e[1]])
    assert sum(metrics(spark, lambda: C.louvain(nodes, pairs), "shuffle records written")) < 8 * links


def test_guided_walks_stay_on_edges(spark):
    edges = [(i, (i + 1) % 12) for i in range(12)] + [(0, 6)]
    nodes = spark.createDataFrame([(i, "port" if i % 4 == 0 else "module") for i in range(12)] + [(50, "module")], "node_id long, type string")
    pairs = G.undirected(spark.createDataFrame([(a, b, 0) for a, b in edges], "src long, dst long, edge_seq int"))
    signals = nodes.where("type = 'port'").select(F.concat(F.lit("s"), "node_id").alias("signal"), "node_id")
    starts = spark.createDataFrame([(0,), (50,)], "start long")
    got = C.guided_walks(nodes, pairs, signals, starts, ["s4", "s8"], walks=6, budget=12, teleport=0.3).collect()
    assert len(got) == 12 and all(r["path"] == [50] for r in got if r["start"] == 50)
    near = {(a, b) for e in edges for a, b in (e, e[::-1])}
    doors = {n for r in G.shortest_paths(pairs, starts).collect() for n in r["path"]}
    for r in got:
        steps = list(zip(r["path"], r["path"][1:], strict=False))
        assert all(s in near or s[1] in doors for s in steps)
        assert r["discovered"] == [f"s{n}" for n in dict.fromkeys(r["path"]) if n in (4, 8)]


def test_gleaning_summaries_and_reports(spark):
    def model(prompt, system=""):
        if "still missing" in prompt:
            return '("entity"<|>clk<|>signal<|>ticks)'
        if prompt.startswith("Write one description"):
            return "one text"
        return "report of " + str(prompt.count("\n"))

    first = spark.createDataFrame([(1, "p", '("entity"<|>ack<|>signal<|>answers)'), (2, "p", "")], "doc_id int, prompt string, response string")
    rows = E.entity_rows(E.records(E.gleaned(first, model)))
    assert sorted((r["doc_id"], r["name"]) for r in rows.collect()) == [(1, "ACK"), (1, "CLK"), (2, "CLK")]
    merged = spark.createDataFrame([("A", "t", 2, ["x" * 300, "y" * 300]), ("B", "t", 2, ["x", "y"])], "name string, type string, n long, descriptions array<string>")
    told = {r["name"]: r["descriptions"] for r in E.summarised_descriptions(merged, ["name"], model).collect()}
    assert told == {"A": ["one text"], "B": ["x", "y"]}
    nodes = spark.createDataFrame([(i, f"node {i}") for i in range(130)], "node_id long, text string")
    groups = nodes.select("node_id", (F.col("node_id") >= 120).cast("int").alias("community"))
    parts = E.community_summaries(groups, nodes)
    assert sorted(x for r in parts.collect() for x in r["summary"].split("\n")) == sorted(f"node {i}" for i in range(130))
    reports = E.community_reports(parts, model).collect()
    assert sorted(r["community"] for r in reports) == [0, 1] and all(r["summary"].startswith("report of") for r in reports)


def test_graph_from_documents(spark, vocabulary):
    def model(prompt, system=""):
        return '("entity"<|>FIFO<|>block<|>a queue)##("entity"<|>ack<|>signal<|>an answer)##("relationship"<|>FIFO<|>ack<|>raises<|>7)'

    docs = spark.createDataFrame([(1, "The FIFO raises ack."), (2, "ack answers")], "doc_id int, text string")
    graph = build_kg.build(docs, ["block", "signal"], model, vocabulary=vocabulary, with_reports=True)
    assert {r["node_id"] for r in graph["nodes"].collect()} == {"FIFO", "ACK"} and graph["communities"].select("community").distinct().count() == 1
    q = spark.createDataFrame([("q", "what raises ack")], "query_id string, query string")
    for method in ("local", "global", "drift"):
        assert use_kg.answer(q, graph, method, model).count() == 1


def test_plans_of_two_files_stay_apart(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Signal x:\nPlan 1: first\nmore\nSignal y:\nPlan 2: second\n")
    (tmp_path / "b.txt").write_text("Plan 9: nobody's\nSignal x:\nPlan 1: third\n")
    got = sorted(tuple(r) for r in SR.plans_from_text(spark, str(tmp_path)).collect())
    assert got == [("x", 1, "first more"), ("x", 2, "third"), ("y", 1, "second")]


def pdf(pages, packed=True):
    """A small PDF; packed: compressed contents, and the page objects in an object stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages))) + b"] >>"}
    streams = {}
    for i, content in enumerate(pages):
        objects[10 + i] = b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (100 + i)
        body = zlib.compress(content) if packed else content
        streams[100 + i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), b" /Filter /FlateDecode" if packed else b"", body)
    if packed:
        parts, head = b"", b""
        for n, b in objects.items():
            head += b"%d %d " % (n, len(parts))
            parts += b + b"\n"
        body = zlib.compress(head + parts)
        streams[500] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(objects), len(head), body)
        objects = {}
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % kv for kv in {**objects, **streams}.items()) + b"\n%%EOF"


def test_pdf_text(spark, tmp_path):
    pages = [b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(clk) -300 (and) -20 (then) 10 <72737421>] TJ ET", b"BT (p\\101ge) Tj T* (two) ' ET"]
    for packed in (False, True):
        assert pdf_pages(pdf(pages, packed)) == ["Hello (world)\nclk andthenrst!", "pAge\ntwo"]
    (tmp_path / "spec.pdf").write_bytes(pdf(pages))
    got = D.read_documents(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r["doc_id"], r["page"], r["text"].split("\n")[0]) for r in got] == [("spec", 1, "Hello (world)"), ("spec", 2, "pAge")]
    with pytest.raises(ValueError):
        pdf_pages(b"%PDF /Encrypt 5 0 R")


def test_guards(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node_id long")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    for measure in (G.closeness, G.betweenness):
        with pytest.raises(ValueError):
            measure(nodes, pairs, most_nodes=3)


def test_scratch_scopes(spark):
    import os

    local = lambda df: df._scratch_path.removeprefix("file://")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with scratch.scope():
        gone = scratch.written(spark.range(3), "gone")
        stays = scratch.kept(scratch.written(gone.selectExpr("id + 1 AS id"), "stays"))
        assert gone.count() == 3
    assert not os.path.exists(local(gone)) and stays.count() == 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    scratch.discard(stays)
    assert not os.path.exists(local(stays))
