"""Extraction from Verilog against rows derived by hand."""

import pytest
from pyspark.sql import functions as F

from specweave.operators import knowledge_graph as K
from specweave.operators import rtl
from specweave.plans import samples


@pytest.fixture(scope="module")
def mods(spark):
    return rtl.modules(rtl.cleaned(rtl.inline_includes(samples.table(spark, "rtl")))).cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ports(mods):
    got = {(r["module"], r["port"]): (r["direction"], r["width"]) for r in rtl.ports(mods).collect()}
    assert got[("bus_top", "wdata")] == ("input", "7:0")
    assert got[("bus_top", "ack")] == ("output", None)
    assert got[("bus_ctl", "ack")] == ("output", None) and got[("bus_ctl", "clk")] == ("input", None)
    assert got[("bus_mem", "q")] == ("output", "7:0")
    assert len(got) == 15


def test_ansi_list_takes_the_last_direction(spark):
    df = spark.createDataFrame([("a.v", "module m (input [3:0] a, b, output c, inout d);\nendmodule")], "file string, text string")
    assert rows(rtl.ports(rtl.modules(df)), "port", "direction", "width") == sorted([("a", "input", "3:0"), ("b", "input", "3:0"), ("c", "output", None), ("d", "inout", None)], key=str)


def test_instances_and_connections(mods):
    inst = rtl.instances(mods)
    assert rows(inst, "parent", "instance", "module") == [("bus_top", "u_ctl", "bus_ctl"), ("bus_top", "u_mem", "bus_mem")]
    assert ("u_mem", "en", "go") in rows(rtl.connections(inst), "instance", "port", "signal")
    df = mods.sparkSession.createDataFrame([("p", "u", "m", "a, b")], "parent string, instance string, module string, args string")
    assert rows(rtl.connections(df), "port", "signal") == [("port_0", "a"), ("port_1", "b")]


def test_comments_and_attributes(spark):
    text = "(* keep *) wire a; // wire b;\n/* wire c;\n wire d; */ wire e;"
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(rtl.strip_comments(F.col("text"))).first()[0] == "(* keep *) wire a; \n wire e;"


def test_includes(spark):
    files = spark.createDataFrame([("d/a.v", 'x `include "b.vh" y `include "none.vh" z'), ("d/b.vh", "B")], "file string, text string")
    assert rows(rtl.inline_includes(files), "file", "text") == [("d/a.v", "x B y  z"), ("d/b.vh", "B")]


def test_always_and_assignments(mods):
    blocks = rtl.always_blocks(mods).where("module = 'bus_ctl' and block = 0").first()["senslist"]
    assert [(s["signal"], s["type"]) for s in blocks] == [("clk", "posedge"), ("rst_n", "negedge")]
    got = rows(rtl.assignments(mods).where("module = 'bus_top'"), "type", "lhs", "rhs")
    assert got == [("continuous", "mid", "wdata ^ rdata")]
    kinds = {(r["lhs"], r["type"], r["in_clocked_block"]) for r in rtl.assignments(mods).where("module = 'bus_ctl'").collect()}
    assert ("state", "non_blocking", True) in kinds and ("ack", "blocking", False) in kinds and ("go", "continuous", None) in kinds


def test_control_flow(mods):
    flow = rtl.control_flow(mods)
    assert rows(flow.where("module = 'bus_ctl'"), "kind", "expr") == [("case", "state"), ("if", "!rst_n"), ("if", "req")]
    assert rows(flow.where("module = 'bus_mem'"), "kind", "expr") == sorted([("for", None), ("if", "en")], key=str)


def test_signal_attributes(mods):
    got = {(r["module"], r["name"]): r for r in rtl.signal_attributes(mods, rtl.ports(mods)).collect()}
    assert got[("bus_ctl", "state")]["type"] == "reg" and got[("bus_ctl", "state")]["width"] == "1:0"
    assert got[("bus_ctl", "ST_BUSY")]["value"] == "1" and got[("bus_ctl", "ST_BUSY")]["type"] == "parameter"
    assert got[("bus_mem", "i")]["type"] == "integer"


def test_state_machines(mods):
    got = {r["fsm_id"]: r for r in rtl.state_machines(mods, rtl.always_blocks(mods)).collect()}
    assert got["bus_ctl_fsm_state"]["detection_method"] == "case_statement"
    assert got["bus_ctl_fsm_params"]["state_encodings"] == ["ST_IDLE", "ST_BUSY"]
    assert (got["bus_ctl_fsm_0"]["clock_signal"], got["bus_ctl_fsm_0"]["reset_signal"]) == ("clk", "rst_n")
    assert "bus_mem_fsm_0" in got and not got["bus_mem_fsm_0"]["reset_sensitive"]


def test_loose_state_machines_only_if_none(spark):
    df = rtl.modules(spark.createDataFrame([("a.v", "module m (a); input a; reg curr_state_q, x; endmodule")], "file string, text string"))
    got = rtl.state_machines(df, rtl.always_blocks(df)).collect()
    assert got and all(r["detection_method"] == "direct_pattern" for r in got)


def test_protocol_first_match(spark):
    got = {r["port"]: r["c"] for r in samples.table(spark, "ports").select("port", rtl.protocol_class(F.col("port")).alias("c")).collect()}
    assert got["req_clk"] == "clock_signals" and got["q_d"] == "data_signals" and got["valid"] == "handshaking_signals" and got["addr"] is None


def test_names(spark):
    got = {r[0] for r in rtl.wanted_signals(samples.table(spark, "names")).collect()}
    assert got == {"ok_sig", "y", "data", "Mixed"}


def test_order_of_files(spark):
    files = samples.table(spark, "rtl")
    place = {r["file"]: r["place"] for r in rtl.files_in_order(files, rtl.file_dependencies(files)).collect()}
    assert place["top.v"] == 4
    cyc = spark.createDataFrame([("b", "a"), ("a", "b")], "file string, needs string")
    two = spark.createDataFrame([("b", ""), ("a", "")], "file string, text string")
    assert rows(rtl.files_in_order(two, cyc), "file", "place") == [("a", 1), ("b", 2)]


def test_top_and_hierarchy(mods):
    inst = rtl.instances(mods)
    assert rtl.top_modules(mods, inst).first()["module"] == "bus_top"
    deep = rows(rtl.hierarchical_signals(inst, rtl.internal_signals(mods), rtl.top_modules(mods, inst), 1), "signal", "depth")
    assert ("bus_top.u_ctl.state", 1) in deep and ("bus_top.go", 0) in deep
    assert all(d == 0 for _, d in rows(rtl.hierarchical_signals(inst, rtl.internal_signals(mods), rtl.top_modules(mods, inst), 0), "signal", "depth"))


def test_graph(spark):
    facts = rtl.facts(samples.table(spark, "rtl"))
    nodes, edges = K.rtl_graph(facts)
    got = {(r["src"], r["dst"], r["relation"]) for r in edges.collect()}
    assert ("bus_top.clk", "bus_top", "input_to") in got and ("bus_top", "bus_top.ack", "outputs") in got
    assert ("bus_top", "bus_ctl", "instantiates") in got
    assert ("bus_top.req", "bus_ctl.req", "drives") in got and ("bus_ctl.ack", "bus_top.ack", "drives") in got
    kinds = {r["type"] for r in nodes.collect()}
    assert {"module", "port", "fsm", "protocol_pattern", "verification_point", "assignment", "control_flow", "signal"} <= kinds
    assert not {"control_flow", "signal"} & {r["type"] for r in K.rtl_graph(facts, include_internal=False)[0].collect()}


def test_links(spark):
    names = spark.createDataFrame([("1", "clk"), ("2", "a.b"), ("3", "c+"), ("4", "ab")], "name_id string, name string")
    texts = spark.createDataFrame([("x", "The CLK and (a.b) but not c++."), ("y", "aclk axb")], "text_id string, text string")
    assert rows(K.name_hits(names, texts), "name_id", "text_id") == [("1", "x"), ("2", "x"), ("3", "x")]


def test_summaries_and_relationships(spark):
    facts = rtl.facts(samples.table(spark, "rtl"))
    got = rtl.design_summary({k: facts[k] for k in ("modules", "ports", "instances")}).first()
    assert (got["n_modules"], got["n_ports"], got["n_instances"]) == (3, 15, 2)
    near = {(r["source"], r["target"]) for r in rtl.signal_relationships(facts["dataflow"], rtl.primary_signals(facts["ports"])).collect()}
    assert ("bus_ctl.req", "bus_ctl.go") in near and ("bus_top.clk", "bus_top.ack") not in near
    assert rtl.module_port_names(facts["modules"], facts["ports"]).count() == 3 * 10
