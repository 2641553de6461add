"""Small built-in inputs for queries on formats that no test table has: Verilog, reports, replies, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RTL = [
    ("top.v", """`include "defs.vh"
// top level
module bus_top (clk, rst_n, req, ack, wdata, rdata);
  input clk, rst_n;
  input req;
  output ack;
  input [7:0] wdata;
  output [7:0] rdata;
  wire go; wire [7:0] mid;
  bus_ctl u_ctl (.clk(clk), .rst_n(rst_n), .req(req), .ack(ack), .go(go));
  bus_mem u_mem (.clk(clk), .en(go), .d(wdata), .q(rdata));
  assign mid = wdata ^ rdata;
endmodule
"""),
    ("ctl.v", """module bus_ctl (input clk, input rst_n, input req, output reg ack, output go);
  parameter ST_IDLE = 0; parameter ST_BUSY = 1;
  reg [1:0] state; /* the state
     of the machine */
  always @(posedge clk or negedge rst_n) begin
    if (!rst_n) state <= ST_IDLE;
    else case (state)
      ST_IDLE: if (req) state <= ST_BUSY;
      ST_BUSY: state <= ST_IDLE;
    endcase
  end
  always @(state) ack = state[0];
  assign go = req && ack;
endmodule
"""),
    ("mem.v", """module bus_mem (clk, en, d, q);
  input clk; input en; input [7:0] d; output reg [7:0] q;
  (* keep *) reg [7:0] store;
  integer i;
  always @(posedge clk) begin
    for (i = 0; i < 8; i = i + 1) store[0] <= d[0];
    if (en) q <= store;
  end
endmodule
"""),
    ("defs.vh", "`define WIDTH 8\n"),
]

SPEC_NODES = [("b1", "block", "controller", "The bus_ctl block answers each req with an ack."), ("b2", "block", "memory", "The bus_mem block stores wdata while en is high."), ("s1", "signal", "clock", "All registers use clk.")]
SPEC_EDGES = [("b1", "b2", "controls"), ("s1", "b1", "times")]

_FRAME = "=" * 62
REPORTS = [
    (0, f"run\n{_FRAME}\nSUMMARY\n{_FRAME}\n  assertions : 2\n   - proven : 1 (50%)\n   - cex : 1 (50%)\n  covers : 1\n   - covered : 1\n\nend"),
    (1, f"{_FRAME}\nSUMMARY\n{_FRAME}\n  assertions : 1\n   - cex : 1 (100%)\n   - proven : 0\n\n"),
    (2, f"{_FRAME}\nSUMMARY\n{_FRAME}\n  assertions : 1\n   - undetermined : 1\n\n"),
    (3, "ok\nERROR (VERI-1137): top.sva: syntax error near end\nmore"),
    (4, "nothing to see"),
    (5, f"{_FRAME}\nSUMMARY\n{_FRAME}\n  assertions : 1\n   - marked_proven : 1\n  covers : 2\n   - proven : 2\n\n"),
]
COVERAGE = [
    (0, "stimuli|statement|81.5\nstimuli|statement|90.25\ncoi|toggle|7\ncoi|branch|12.0\nother|branch|3.0\nproofs: proven cex"),
    (1, "ERROR (VERI-1): bad\nproofs: proven\nproofs: cex"),
    (2, "coi|expression|55.5"),
]
REPLIES = [
    (0, "Plan: Check reset of ack\nnotes\n  Plan: check  RESET of ack\nSVA for Plan 1:\n```\n@(posedge clk) disable iff (!rst_n)\n  req |-> ##1 ack; // handshake\n```\n"),
    (1, "SVA: ```\n@(posedge clk) req |-> ack;\n```\nassert property (@(posedge clk) go |-> req; )\n@( posedge clk ) go |=> !go;"),
    (2, "no plan here"),
]
RECORDS = [
    (0, '("entity"<|>FIFO<|>block<|>a queue)##("entity"<|>ack<|>signal<|>an answer)##("relationship"<|>FIFO<|>ack<|>raises<|>7)##("entity"<|>broken)'),
    (1, '("entity"<|>fifo<|>block<|>a buffer)##("relationship"<|>ACK<|>FIFO<|>belongs to<|>2)##("relationship"<|>ACK<|>X<|>bad<|>much)'),
]
SCRIPTS = [
    ("a.tcl", "clear -all\nanalyze -v2k \\\n  ${RTL_PATH}/core.v\nelaborate -top core\nclock clk\nreset rst\nclock clk2\n"),
    ("FPV_b.tcl", "analyze -v2k other.v\nelaborate -top other -x\nstopat -env foo\nreset -expression {!rst_n}\n"),
    ("c.tcl", "puts hello\n"),
]
PORTS = ["clk", "rst_n", "wdata", "q_d", "en", "valid", "req_clk", "ready", "addr", "PCLK", "soft_reset", "sel_in", "ack", "irq"]
NAMES = ["_tmp", "n12", "tmp3", "genblk1", "genblk[0].x", "genblk1.y", "unnamed1", "12", "PCLK", "D_x", "ok_sig", "top.u1.data", "top.u1.ADDR", "", "Mixed"]
DEPENDENCIES = [("top.v", "ctl.v"), ("top.v", "mem.v"), ("ctl.v", "defs.vh"), ("mem.v", "cell.v"), ("cell.v", "defs.vh"), ("loop_a.v", "loop_b.v"), ("loop_b.v", "loop_a.v"), ("user.v", "loop_a.v")]
TABLES = [(0, r"\text{Pin} & \text{Use} \\ A^{2} & x^2 \hline"), (1, r"a & b"), (2, r"\begin")]


def table(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = {
        "rtl": (RTL, "file string, text string"), "spec_nodes": (SPEC_NODES, "node_id string, type string, name string, text string"),
        "spec_edges": (SPEC_EDGES, "src string, dst string, relationship string"), "reports": (REPORTS, "sva_id int, content string"),
        "coverage": (COVERAGE, "report_id int, content string"), "replies": (REPLIES, "reply_id int, response string"), "records": (RECORDS, "doc_id int, response string"),
        "scripts": (SCRIPTS, "path string, content string"), "ports": ([("m", p, i) for i, p in enumerate(PORTS)], "module string, port string, ordinal int"),
        "names": ([(n,) for n in NAMES], "signal string"), "dependencies": (DEPENDENCIES, "file string, needs string"), "tables": (TABLES, "row_id int, latex string"),
    }[name]
    return spark.createDataFrame(rows, schema)


def values(name: str, rows: list[tuple], columns: str) -> str:
    """The same rows as an SQL table expression."""
    def literal(x: object) -> str:
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows) + ")"
