"""Parsers, sources, sinks, results and whole flows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from specweave.operators import analysis as A
from specweave.operators import entities as E
from specweave.operators import inference as I
from specweave.operators import knowledge_graph as K
from specweave.operators import replies as R
from specweave.operators import rtl
from specweave.plans import build_kg, planning, samples, use_kg
from specweave.plans.results import summarise
from specweave.session import Stages
from specweave.sinks import graphs as SG
from specweave.sinks import results as SR
from specweave.sources import documents as D
from specweave.sources import graphml, rtl_files, settings
from specweave.sources import results as SO
from specweave.streaming.documents import arriving_chunks


def test_documents(spark, tmp_path):
    (tmp_path / "b.txt").write_text("one two\fthree")
    (tmp_path / "a.jsonl").write_text(json.dumps({"page": 1, "out": "hello"}) + "\n" + json.dumps({"out": "", "raw_out": "<b>x</b> \\cmd{y}z"}) + "\n")
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>para</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "c.docx").write_bytes(word.getvalue())
    pages = D.read_documents(spark, str(tmp_path))
    got = {(r["doc_id"], r["page"]): r["text"] for r in pages.collect()}
    assert got == {("a", 1): "hello", ("a", 2): "x z", ("b", 1): "one two", ("b", 2): "three", ("c", 1): "para\ntwo"}
    assert {r["doc_id"]: r["text"] for r in D.whole_documents(pages).collect()}["b"] == "one two\n\nthree"
    stats = D.page_statistics(pages).first()
    assert (stats["num_pages"], stats["num_files"]) == (5, 3)
    assert {r["doc_id"]: r["words"] for r in D.document_statistics(pages).collect()} == {"a": 3, "b": 3, "c": 2}
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.rtf").write_bytes(b"")
    with pytest.raises(ValueError):
        D.read_documents(spark, str(tmp_path / "d.rtf"))
    assert D.read_documents(spark, str(tmp_path / "d.pdf")).count() == 0
    assert D.read_documents(spark, str(tmp_path / "d.pdf"), {".pdf": lambda b: ["page"]}).count() == 1
    (tmp_path / "x.bin").write_bytes(b"")
    for wrong in ("missing.txt", "x.bin"):
        with pytest.raises((ValueError, FileNotFoundError)):
            D.resolve_inputs(spark, str(tmp_path / wrong))


def test_jsonl_tables(spark):
    raw = "Table 1: Pinout description \\begin{array}{l} \\text{A} & b \\\\ c^2 \\end{array}"
    rows = spark.createDataFrame([("text", None), ("", raw), ("", "<p>hi</p>"), ("  ", None)], "out string, raw_out string")
    assert [r["text"] for r in D.jsonl_text(rows).collect()] == ["text", "Table 1: Pinout description\n\n{l} A | b c²", "hi", ""]


def test_rtl_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.v").write_text("module a(x); endmodule")
    (tmp_path / "h.vh").write_text("// h")
    (tmp_path / "sub" / "b.sv").write_text("module b(y); endmodule")
    names = lambda df: sorted(r["file"].rsplit("/", 1)[1] for r in df.collect())
    assert names(rtl_files.read_rtl(spark, str(tmp_path))) == ["a.v", "b.sv"]
    assert names(rtl_files.read_rtl(spark, str(tmp_path), recursive=False)) == ["a.v", "h.vh"]


def test_graphml_round_trip(spark, tmp_path):
    nodes, edges = planning.design_graph(samples.table(spark, "rtl"), samples.table(spark, "spec_nodes"), samples.table(spark, "spec_edges"))
    path = str(tmp_path / "g.graphml")
    SG.write_graphml(nodes, edges, path)
    n, e = graphml.as_graph(*graphml.read_graphml(spark, path))
    assert {r[0] for r in n.select("node_id").collect()} == {r[0] for r in nodes.select("node_id").collect()}
    key = lambda df: sorted((r["src"], r["dst"], r["relation"] or "", r["relationship"] or "") for r in df.collect())
    assert key(e) == key(edges)
    assert "name" in {r["name"] for r in graphml.attribute_names(graphml.read_graphml(spark, path)[0]).collect()}
    SG.write_graphml(nodes, edges, path, "minimal")
    assert graphml.read_graphml(spark, path)[0].count() == nodes.count()
    SG.write_json(nodes, edges, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/nodes")).count() == nodes.count()
    ids = SG.with_edge_ids(edges).agg(F.count("*"), F.countDistinct("id")).first()
    assert ids[0] == ids[1]


def test_design_graph_is_linked_and_connected(spark):
    nodes, edges = planning.design_graph(samples.table(spark, "rtl"), samples.table(spark, "spec_nodes"), samples.table(spark, "spec_edges"))
    got = {(r["src"], r["dst"], r["relationship"]) for r in edges.where("relationship is not null").collect()}
    assert ("b1", "rtl_bus_ctl", "describes") in got and ("s1", "rtl_bus_top.clk", "references") in got
    assert ("design_root", "b1", "contains_spec") in got and ("design_root", "rtl_bus_mem", "contains_implementation") in got
    report = K.connectivity_report(nodes, edges)
    assert report["components"].count() == 1 and report["bridges"].count() > 0 and report["hubs"].count() == 5


def test_plan_parsers(spark, tmp_path):
    r = spark.createDataFrame([("r", "intro\na: one\nmore\nb: two: three\n")], "response_id string, response string")
    assert [(x["signal"], x["plan"]) for x in R.colon_plans(r).orderBy("plan_no").collect()] == [("a", "one more"), ("b", "two: three")]
    plans = R.plan_lines(samples.table(spark, "replies").withColumnRenamed("reply_id", "signal"))
    assert [x["plan"] for x in R.unique_plans(plans).collect()] == ["Check reset of ack"]
    (tmp_path / "p.json").write_text(json.dumps({"s": ["x", "y"]}))
    assert sorted(tuple(x) for x in SO.plans_from_json(spark, str(tmp_path / "p.json")).collect()) == [("s", 1, "x"), ("s", 2, "y")]
    df = spark.createDataFrame([("b", 1, "p1"), ("a", 1, "p0"), ("a", 2, "p2")], "signal string, plan_no long, plan string")
    (tmp_path / "plans.txt").write_text("\n".join(x["line"] for x in SR.plan_lines(df).orderBy("line_no").collect()))
    back = sorted((x["signal"], x["plan"]) for x in SO.plans_from_text(spark, str(tmp_path / "plans.txt")).collect())
    assert back == [("a", "p0"), ("a", "p2"), ("b", "p1")]


def test_assertions_and_checker(spark, tmp_path):
    found = R.assertions(samples.table(spark, "replies"), ("reply_id",))
    texts = {x["sva"] for x in found.collect()}
    assert "@(posedge clk) disable iff (!rst_n) req |-> ##1 ack;" in texts and "@( posedge clk ) go |=> !go;" in texts
    same = spark.createDataFrame([("A  b;",), ("a b;",), ("// c\na b;",)], "sva string")
    assert R.unique_assertions(same).count() == 1
    svas = spark.createDataFrame([(0, "@(posedge clk) go == 8'hFF |-> $past(inner);")], "sva_id int, sva string")
    known = spark.createDataFrame([("clk",), ("go",)], "signal string")
    assert [x[0] for x in SR.unknown_identifiers(svas, known).collect()] == ["inner"]
    SR.write_checker(svas, known, "top", str(tmp_path / "c.sva"))
    text = (tmp_path / "c.sva").read_text()
    assert "module top_checker (" in text and "bind top top_checker checker_inst" in text and ".inner(inner)" in text
    (tmp_path / "property_goldmine_10.sva").write_text("property p; ten endproperty")
    (tmp_path / "property_goldmine_2.sva").write_text("bare two")
    assert [x["sva"] for x in SO.read_svas(spark, str(tmp_path)).orderBy("sva_id").collect()] == ["bare two", "ten"]


def test_results(spark, tmp_path):
    reports = samples.table(spark, "reports")
    out = summarise(reports.select("sva_id"), reports, samples.table(spark, "coverage").where("report_id = 0"))
    assert [x["status"] for x in out["proofs"].orderBy("sva_id").collect()] == ["proven", "cex", "inconclusive", "error", "inconclusive", "- marked_proven"]
    final = out["final"].first()
    assert (final["assertions"], final["syntax_correct"], final["proven"]) == (6, 5, 1) and len(final) == 15
    SR.write_proof_report(out["proofs"], str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["SVA ID", "Proof Status", "Error Message"]
    assert A.proven_only(reports, out["proofs"]).count() == 1
    assert A.original_script(samples.table(spark, "scripts")).first()["path"] == "FPV_b.tcl"


def test_entities_and_search(spark):
    recs = E.records(samples.table(spark, "records"))
    merged = {x["name"]: (x["n"], x["descriptions"]) for x in E.merged_entities(E.entity_rows(recs)).collect()}
    assert merged == {"FIFO": (2, ["a buffer", "a queue"]), "ACK": (1, ["an answer"])}
    assert [(x["source"], x["target"], x["weight"]) for x in E.merged_relations(E.relation_rows(recs)).collect()] == [("ACK", "FIFO", 9.0)]


def test_models(spark):
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert I.retried(flaky, sleep=slept.append) == "ok" and slept == [1.0, 1.5]
    assert I.text_of({"choices": [{"message": {"content": "hi"}}]}) == "hi" and I.text_of([{"text": "a"}, {"text": "b"}]) == "ab"
    p = spark.createDataFrame([("x",), (None,)], "prompt string")
    assert {r["response"] for r in I.asked(p, lambda prompt, system: prompt.upper()).collect()} == {"X", None}
    signals = spark.createDataFrame([("ack",)], "signal string")
    told = I.asked(I.summary_prompts("spec", "", signals), None)
    out = I.with_summaries(signals.withColumns({"prompt": F.lit(0), "text": F.lit("body")}), told).first()["text"]
    assert out.endswith("body") and "### this signal" in out


def test_build_and_use_graph(spark):
    docs = spark.createDataFrame([(0, "the fifo raises ack"), (1, "the fifo is a queue")], "doc_id int, text string")

    def extract(prompt, system):
        return samples.RECORDS[0][1] if "queue" not in prompt.split("Text:")[1] else samples.RECORDS[1][1]

    graph = build_kg.build(docs, ["block", "signal"], extract)
    assert {x["node_id"] for x in graph["nodes"].collect()} == {"FIFO", "ACK"} and graph["edges"].count() == 1
    q = spark.createDataFrame([("q", "fifo queue")], "query_id string, query string")
    echo = lambda prompt, system: prompt
    assert "FIFO" in use_kg.answer(q, graph, "local", echo).first()["response"]
    assert "Question" in use_kg.answer(q, graph, "global", echo).first()["response"]
    with pytest.raises(ValueError):
        use_kg.answer(q, graph, "other")


@pytest.mark.parametrize("generators", [("rag", "path"), ("motif", "community", "local_expansion", "guided_random_walk")])
def test_whole_plan(spark, generators):
    files = samples.table(spark, "rtl")
    nodes, edges = planning.design_graph(files, samples.table(spark, "spec_nodes"), samples.table(spark, "spec_edges"))
    docs = samples.table(spark, "spec_nodes").select(F.col("node_id").alias("doc_id"), "text")
    signals = spark.createDataFrame([("req",), ("ack",)], "signal string")
    use = settings.Settings(generators=generators, chunk_sizes=(50,), overlap_ratios=(0.2,), max_path_depth=3, walks=5, walk_budget=15)
    out = planning.plan(docs, signals, nodes, edges, use, files)
    assert {r["source_type"] for r in out["contexts"].collect()} == set(generators)
    assert {r["signal"] for r in out["plans"].collect()} == {"req", "ack"}
    assert out["svas"].count() == 2
    assert out["prompts"].where("text like '%contexts%'").count() > 0


def test_signals(spark):
    files = samples.table(spark, "rtl")
    ports = {r["signal"] for r in rtl.design_signals(files).collect()}
    assert ports == {"clk", "rst_n", "req", "ack", "wdata", "rdata"}
    assert {"go", "mid", "state"} <= {r["signal"] for r in rtl.design_signals(files, internal=True).collect()}
    assert spark.createDataFrame([("input logic [3:0] x; output y",)], "t string").select(rtl.declared_names(F.col("t"))).first()[0] == ["x", "y"]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("per_retriever: 5\nchunk_sizes: [10]\n")
    s = settings.load(str(tmp_path / "c.yaml"), {"prune": False}, {"SPECWEAVE_USE_KG": "false"})
    assert (s.per_retriever, s.chunk_sizes, s.prune, s.use_kg) == (5, (10,), False, False)
    with pytest.raises(ValueError):
        settings.load(None, {"nope": 1}, {})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" ".join(f"w{i}" for i in range(25)))
    q = arriving_chunks(spark, str(tmp_path / "in"), 10, 0).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("x y")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select doc_id, count(*) n from chunks group by doc_id order by doc_id").collect() == [("a", 3), ("b", 1)]


def test_stage_times_and_texts(spark, tmp_path):
    t = Stages()
    with t.stage("a"):
        pass
    with pytest.raises(ValueError), t.stage("a"):
        pass
    assert t.seconds["a"] >= 0
    SR.write_texts(spark.createDataFrame([("x", "body")], "doc_id string, text string"), str(tmp_path / "t"))
    assert next((tmp_path / "t" / "doc_id=x").glob("*.txt")).read_text() == "body\n"
    n, e = spark.createDataFrame([("a",)], "node_id string"), spark.createDataFrame([("a", "a")], "src string, dst string")
    assert SG.write_graph(n, e, str(tmp_path / "g.xml")) == "graphml"
    assert SG.write_graph(n, e, str(tmp_path / "no" / "g.xml")) == "json"
