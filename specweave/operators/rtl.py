"""Fact extraction from Verilog: tables of modules, ports, instances, assignments and more.

Input is ``files(file, text)``. All scans are SQL regular expressions over whole files, one row a match. Comments are removed
first; a file that is included is put in place of its include line, one level deep.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.functions.text import found
from specweave.operators.graph import directed_distances
from specweave.scratch import written

#: Patterns, word lists and classes that decide which facts are found.
MODULE = r"(?s)\bmodule\s+(\w+)\s*(?:#\s*\((?:[^()]|\([^()]*\))*\)\s*)?\((.*?)\)\s*;(.*?)\bendmodule"
DECLARED = r"\b(input|output|inout)\s+(?:(?:wire|reg|logic)\s+)?(?:signed\s+)?(?:\[\s*(\w+)\s*:\s*(\w+)\s*\]\s*)?(\w+)"
INSTANCE = r"(?s)\b(\w+)\s+(?:#\s*\((?:[^()]|\([^()]*\))*\)\s*)?(\w+)\s*\(((?:[^()]|\([^()]*\))*)\)\s*;"
ALWAYS = r"\balways(?:_ff|_comb|_latch)?\s*@\s*\((.*?)\)"
ALWAYS_BODY = r"(?s)always(?:_ff|_comb|_latch)?\s*@\s*\((.*?)\)(.*?)(?=always|module|endmodule|$)"
CONTINUOUS = r"assign\s+(\w+(?:\s*\[\s*\d+(?::\d+)?\s*\])?)\s*=\s*(.*?);"
PROCEDURAL = r"(\w+(?:\s*\[\s*\d+(?::\d+)?\s*\])?)\s*(<=|=)\s*(.*?);"
INCLUDE = r'`include\s+"([^"]+)"'
NOT_SIGNALS = ["and", "or", "not", "xor", "if", "else"]
SV_TYPES = ["logic", "bit", "byte", "shortint", "int", "longint", "integer", "time"]
WIDTH = r"(?:signed\s+)?(?:\[\s*(\d+)\s*:\s*(\d+)\s*\])?\s*(\w+)\s*;"
FSM_PATTERNS = [
    (r"reg\s+\[\s*\d+\s*:\s*\d+\s*\]\s*(\w+).*?(?:state|current|next|present|fsm|st)", "register of several bits beside a state word"),
    (r"reg\s+(\w*state\w*)", "register named after a state"),
    (r"parameter\s+(\w+STATE\w*)\s*=", "parameter named after a state"),
    (r"localparam\s+(\w+STATE\w*)\s*=", "local parameter named after a state"),
    (r"case\s*\(\s*(\w*state\w*)\s*\)", "case over a state"),
    (r"case\s*\(\s*(\w*current\w*)\s*\)", "case over what is current"),
    (r"case\s*\(\s*(\w*next\w*)\s*\)", "case over what is next"),
    (r"case\s*\(\s*(\w*present\w*)\s*\)", "case over what is present"),
    (r"case\s*\(\s*(\w+)\s*\).*?IDLE.*?BUSY", "case with IDLE and BUSY branches"),
    (r"(always\s*@\s*\(\s*posedge.*?\).*?case)", "clocked block with a case"),
]


def strip_comments(text: Column) -> Column:
    """Without block and line comments; attributes ``(* *)`` stay."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)//.*?$", "")


def strip_includes(text: Column) -> Column:
    return F.regexp_replace(text, INCLUDE, "")


def cleaned(files: DataFrame) -> DataFrame:
    return files.withColumn("text", strip_comments("text"))


def inline_includes(files: DataFrame) -> DataFrame:
    """Each include line replaced by the text of the file of that name; by nothing if there is none. One level deep."""
    name = F.element_at(F.split("file", "/"), -1)
    library = files.groupBy(name.alias("included")).agg(F.min("text").alias("body"))
    parts = files.select("file", F.split("text", INCLUDE).alias("parts"), F.regexp_extract_all("text", F.lit(INCLUDE), F.lit(1)).alias("names"))
    wanted = parts.select("file", F.posexplode("names").alias("i", "n")).withColumn("included", F.element_at(F.split("n", "/"), -1)).join(library, "included", "left")
    got = wanted.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("i", F.coalesce("body", F.lit("")).alias("b")))).alias("bodies"))
    text = F.array_join(F.transform("parts", lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.try_element_at("bodies", (i - 1).cast("int")), F.lit("")), p))), "")
    return files.drop("text").join(parts, "file").join(got, "file", "left").withColumn("text", text).drop("parts", "names", "bodies")


def modules(files: DataFrame) -> DataFrame:
    """(file, module, idx, header, body)."""
    return found(files.select("file", "text"), "text", MODULE, {"module": 1, "header": 2, "body": 3}, "idx").drop("text")


def ports(mods: DataFrame) -> DataFrame:
    """(module, port, direction, width, ordinal): from ANSI headers and from declarations in the body.

    A header item without direction takes that of the body, else that of the ANSI item before it, else ``unknown``.
    """
    items = mods.select("module", "header", "body", F.posexplode(F.split("header", ",")).alias("ordinal", "item")).withColumn("item", F.trim(F.regexp_replace("item", r"\s+", " "))).where("item <> ''")
    ansi = items.withColumns({"d": F.regexp_extract("item", DECLARED, 1), "msb": F.regexp_extract("item", DECLARED, 2), "lsb": F.regexp_extract("item", DECLARED, 3), "port": F.regexp_extract("item", r"(\w+)\s*(?:\[[^\]]*\]\s*)*(?:=.*)?$", 1)})
    kept = W.partitionBy("module").orderBy("ordinal")
    own = F.struct(F.col("d").alias("d"), F.col("msb").alias("msb"), F.col("lsb").alias("lsb"))
    ansi = ansi.withColumn("from", F.last(F.when(F.col("d") != "", own), True).over(kept)).withColumn("is_ansi", F.col("d") != "")
    lines = found(mods.select("module", F.explode(F.regexp_extract_all("body", F.lit(r"\b(?:input|output|inout)\b[^;]*;"), F.lit(0))).alias("line")), "line", r"\b(input|output|inout)\b", {"bd": 1}, "k").where("k = 0")
    lines = lines.select("module", "bd", F.regexp_extract("line", r"\[\s*(\w+)\s*:\s*(\w+)\s*\]", 1).alias("bm"), F.regexp_extract("line", r"\[\s*(\w+)\s*:\s*(\w+)\s*\]", 2).alias("bl"), F.explode(F.split(F.regexp_replace(F.regexp_replace("line", r"\b(input|output|inout|wire|reg|logic|signed)\b|;", " "), r"\[[^\]]*\]", " "), ",")).alias("n"))
    body = lines.select("module", F.trim(F.regexp_replace("n", r"\s+", " ")).alias("port"), "bd", "bm", "bl").where("port <> ''").dropDuplicates(["module", "port"])
    both = ansi.join(body, ["module", "port"], "left")
    direction = F.when(F.col("is_ansi"), F.col("d")).when(F.col("bd").isNotNull(), F.col("bd")).otherwise(F.coalesce(F.col("from.d"), F.lit("unknown")))
    msb = F.when(F.col("is_ansi"), F.col("msb")).when(F.col("bd").isNotNull(), F.col("bm")).otherwise(F.coalesce(F.col("from.msb"), F.lit("")))
    lsb = F.when(F.col("is_ansi"), F.col("lsb")).when(F.col("bd").isNotNull(), F.col("bl")).otherwise(F.coalesce(F.col("from.lsb"), F.lit("")))
    return both.select("module", "port", direction.alias("direction"), width_text(msb, lsb).alias("width"), "ordinal").where("port <> ''").dropDuplicates(["module", "port"])


def width_text(msb: Column, lsb: Column) -> Column:
    """``msb:lsb`` for numbers, a marker for other expressions, null without a range."""
    number = msb.rlike(r"^\d+$") & lsb.rlike(r"^\d+$")
    return F.when(F.coalesce(msb, F.lit("")) == "", F.lit(None).cast("string")).when(number, F.concat(msb, F.lit(":"), lsb)).otherwise("width_expression")


def width_bits(width: Column) -> Column:
    """Number of bits of ``msb:lsb``; 1 without a width."""
    ends = F.transform(F.split(width, ":"), lambda x: x.try_cast("int"))
    return F.when(width.isNull(), 1).when(F.size(ends) == 2, F.abs(F.get(ends, F.lit(0)) - F.get(ends, F.lit(1))) + 1)


def instances(mods: DataFrame) -> DataFrame:
    """(parent, instance, module, args): a known module's name, an instance name and connections, inside another module."""
    hits = found(mods.select(F.col("module").alias("parent"), "body"), "body", INSTANCE, {"module": 1, "instance": 2, "args": 3}, "idx").drop("body")
    known = mods.select("module").distinct()
    return hits.join(F.broadcast(known), "module", "left_semi").where("module <> parent").dropDuplicates(["parent", "instance"]).select("parent", "instance", "module", "args", "idx")


def connections(inst: DataFrame) -> DataFrame:
    """(parent, instance, module, port, signal): named ``.port(signal)`` with a plain name, else ``port_<n>`` by position."""
    items = inst.select("parent", "instance", "module", F.posexplode(F.split("args", ",")).alias("k", "item")).withColumn("item", F.trim("item"))
    named = F.contains(F.col("item"), F.lit("."))
    port = F.when(named, F.regexp_extract("item", r"^\.(\w+)\s*\(\s*(\w+)\s*\)", 1)).otherwise(F.concat(F.lit("port_"), F.col("k")))
    signal = F.when(named, F.regexp_extract("item", r"^\.(\w+)\s*\(\s*(\w+)\s*\)", 2)).otherwise(F.regexp_extract("item", r"^(\w+)", 1))
    return items.select("parent", "instance", "module", port.alias("port"), signal.alias("signal")).where("port <> '' and signal <> ''")


def sensitivity(senslist: Column) -> Column:
    """array<struct<signal, type>>: posedge, negedge or level; items are separated by `` or ``."""
    def item(x: Column) -> Column:
        t = F.trim(x)
        kind = F.when(F.startswith(t, F.lit("posedge")), "posedge").when(F.startswith(t, F.lit("negedge")), "negedge").otherwise("level")
        return F.struct(F.trim(F.regexp_replace(t, r"^(posedge|negedge)", "")).alias("signal"), kind.alias("type"))

    return F.transform(F.split(senslist, " or "), item)


def always_blocks(mods: DataFrame) -> DataFrame:
    """(module, block, senslist)."""
    return found(mods.select("module", "body"), "body", ALWAYS, {"s": 1}, "block").select("module", "block", sensitivity(F.col("s")).alias("senslist"))


def rhs_signals(rhs: Column) -> Column:
    return F.filter(F.regexp_extract_all(rhs, F.lit(r"\w+"), F.lit(0)), lambda s: ~s.rlike(r"^\d+$") & ~s.isin(NOT_SIGNALS))


def assignments(mods: DataFrame) -> DataFrame:
    """(module, type, lhs, rhs, rhs_signals, in_clocked_block, always_block, idx)."""
    own = mods.select("module", "body")
    cont = found(own, "body", CONTINUOUS, {"lhs": 1, "rhs": 2}, "idx").select("module", F.lit("continuous").alias("type"), "lhs", "rhs", F.lit(None).cast("boolean").alias("in_clocked_block"), F.lit(None).cast("int").alias("always_block"), "idx")
    blocks = found(own, "body", ALWAYS_BODY, {"sens": 1, "inner": 2}, "always_block").drop("body")
    proc = found(blocks, "inner", PROCEDURAL, {"lhs": 1, "op": 2, "rhs": 3}, "idx")
    proc = proc.select("module", F.when(F.col("op") == "<=", "non_blocking").otherwise("blocking").alias("type"), "lhs", "rhs", F.col("sens").rlike("posedge|negedge").alias("in_clocked_block"), "always_block", "idx")
    both = cont.unionByName(proc).withColumns({"lhs": F.trim("lhs"), "rhs": F.trim("rhs")})
    return both.withColumn("rhs_signals", rhs_signals(F.col("rhs")))


def control_flow(mods: DataFrame) -> DataFrame:
    """(module, kind, idx, expr): if, case, for, while. Conditions end at the first closing parenthesis."""
    own = mods.select("module", "body")
    parts = []
    for kind, pattern, group in (("if", r"\bif\s*\((.*?)\)", 1), ("case", r"\bcase\s*\(\s*(.+?)\s*\)", 1), ("for", r"\bfor\s*\(", 0), ("while", r"\bwhile\s*\(", 0)):
        hit = found(own, "body", pattern, {"expr": group}, "idx")
        parts.append(hit.select("module", F.lit(kind).alias("kind"), "idx", F.trim("expr").alias("expr") if group else F.lit(None).cast("string").alias("expr")))
    return functools.reduce(DataFrame.unionByName, parts)


def signal_attributes(mods: DataFrame, port_table: DataFrame) -> DataFrame:
    """(module, name, type, width, signed, value, initial_value, is_port); of several declarations the last pattern's wins."""
    own = mods.select("module", "body")
    parts = []
    for order, kind in enumerate(["wire", "reg", "parameter", "localparam", *SV_TYPES]):
        if kind in ("parameter", "localparam"):
            hit = found(own, "body", rf"\b{kind}\s+(?:\[[^\]]*\]\s*)?(\w+)\s*=\s*(.*?);", {"name": 1, "value": 2}, "idx").withColumns({"width": F.lit(None).cast("string"), "signed": F.lit(None).cast("boolean"), "value": F.trim("value")})
        else:
            hit = found(own, "body", rf"\b{kind}\s+{WIDTH}", {"msb": 1, "lsb": 2, "name": 3}, "idx").withColumn("decl", F.regexp_extract("body", rf"\b{kind}\s+signed\b", 0))
            hit = hit.withColumns({"width": F.when((F.col("msb") != "") & (F.col("lsb") != ""), F.concat("msb", F.lit(":"), "lsb")).otherwise("1"), "value": F.lit(None).cast("string")})
            hit = hit.withColumn("signed", F.expr(rf"regexp_like(body, concat('\\b{kind}\\s+signed\\s+(\\[[^\\]]*\\]\\s*)?', name, '\\s*;'))"))
        first = F.expr(r"regexp_extract(body, concat('initial\\s+', name, '\\s*=\\s*(.*?);'), 1)")
        parts.append(hit.withColumn("initial_value", F.nullif(F.trim(first), F.lit(""))).select("module", "name", F.lit(kind).alias("type"), "width", "signed", "value", "initial_value", F.lit(order).alias("o"), "idx"))
    every = functools.reduce(DataFrame.unionByName, parts)
    last = every.withColumn("r", F.row_number().over(W.partitionBy("module", "name").orderBy(F.desc("o"), F.desc("idx")))).where("r = 1").drop("r", "o", "idx")
    is_port = port_table.select("module", F.col("port").alias("name"), F.lit(True).alias("is_port"))
    return last.join(is_port, ["module", "name"], "left").withColumn("is_port", F.coalesce("is_port", F.lit(False)))


def state_like(name: Column, *more: str) -> Column:
    low = F.lower(name)
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in ("state", "st_", *more)])


def state_machines(mods: DataFrame, blocks: DataFrame) -> DataFrame:
    """(fsm_id, module, detection_method, state_variable, state_encodings, clock_signal, reset_signal, ...).

    Four detectors; of equal ids the later one wins, except that state registers never replace. Only if none finds anything
    are loose patterns tried.
    """
    own = mods.select("module", "body")
    none, yes = F.lit(None).cast("string"), F.lit(True)

    def rows(df: DataFrame, order: int, method: str, ident: Column, **cols: Column) -> DataFrame:
        fields = {"state_variable": none, "state_encodings": F.lit(None).cast("array<string>"), "clock_signal": none, "reset_signal": none, "pattern_match": none, "matched_text": none, "clock_sensitive": yes, "reset_sensitive": yes} | cols
        return df.select(ident.alias("fsm_id"), "module", F.lit(method).alias("detection_method"), *[c.alias(n) for n, c in fields.items()], F.lit(order).alias("o"))

    case = found(own, "body", r"case\s*\(\s*(\w+)\s*\)", {"v": 1}).where(state_like(F.col("v"), "fsm") | (F.lower("v") == "st")).dropDuplicates(["module", "v"])
    regs = found(own, "body", r"\breg\s+(?:\[\s*\d+\s*:\s*\d+\s*\])?\s*(\w+)\s*;", {"v": 1}).where(state_like(F.col("v"), "fsm")).dropDuplicates(["module", "v"])
    params = found(own, "body", r"parameter\s+(\w+)\s*=\s*\d+", {"v": 1}).where(state_like(F.col("v"), "idle", "busy", "wait", "done"))
    params = params.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vs")).where(F.size("vs") >= 2)
    edge = lambda kinds: F.filter("senslist", lambda s: s["type"].isin("posedge", "negedge") & F.lower(s["signal"]).rlike(kinds))
    clocked = blocks.withColumns({"c": F.try_element_at(F.transform(edge("clk|clock"), lambda s: s["signal"]), F.lit(-1)), "r": F.try_element_at(F.transform(edge("rst|reset"), lambda s: s["signal"]), F.lit(-1))}).where("c is not null")
    name = F.concat_ws("_fsm_", "module", "v")
    every = (
        rows(regs, 0, "reg_declaration", name, state_variable=F.col("v"))
        .unionByName(rows(case, 1, "case_statement", name, state_variable=F.col("v")))
        .unionByName(rows(params, 2, "parameter_definitions", F.concat("module", F.lit("_fsm_params")), state_encodings=F.col("vs")))
        .unionByName(rows(clocked, 3, "always_block", F.concat_ws("_fsm_", "module", "block"), clock_signal=F.col("c"), reset_signal=F.col("r"), reset_sensitive=F.col("r").isNotNull()))
    )
    loose = [rows(found(own, "body", f"(?si){p}", {"v": 1}).where("v <> ''").dropDuplicates(["module", "v"]), i, "direct_pattern", F.concat_ws("_direct_fsm_", "module", "v"), pattern_match=F.lit(d), matched_text=F.col("v"), clock_sensitive=F.lit(None).cast("boolean"), reset_sensitive=F.lit(None).cast("boolean")) for i, (p, d) in enumerate(FSM_PATTERNS)]
    any_ = every.limit(1).select(F.lit(1).alias("_any"))
    loose = functools.reduce(DataFrame.unionByName, loose).join(any_, F.lit(True), "left_anti")
    last = W.partitionBy("fsm_id").orderBy(F.desc("o"))
    return every.unionByName(loose).withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "o")


def protocol_class(port: Column) -> Column:
    """Class of a port by its name; the first that fits."""
    low = F.lower(port)
    return (
        F.when(low.rlike("clk|clock"), "clock_signals").when(low.rlike("rst|reset"), "reset_signals").when(low.rlike("data|_d$"), "data_signals")
        .when(low.rlike("en|sel|ctrl|control"), "control_signals").when(low.rlike("valid|ready|ack|req"), "handshaking_signals")
    )


def protocol_patterns(port_table: DataFrame) -> DataFrame:
    """(module, pattern_type, signals) with the signals in port order."""
    rows = port_table.withColumn("pattern_type", protocol_class(F.col("port"))).where("pattern_type is not null")
    return rows.groupBy("module", "pattern_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "port"))), lambda x: x["port"]).alias("signals"))


#: Kinds of suggestions. The wording is our own.
SUGGESTIONS = {
    "reset_behavior": ("Reset behaviour", "All outputs take a defined value while reset is active"),
    "clock_domain_crossing": ("Clock domain crossing", "Signals between clock domains pass a synchroniser"),
    "data_stability": ("Data stability", "Data does not change while it is sampled"),
    "handshaking_protocol": ("Handshake", "Each request is followed by its acknowledgement in order"),
}


def verification_points(patterns: DataFrame) -> DataFrame:
    """(module, type, description, signals, suggestion) by four rules on a module's protocol patterns."""
    classes = ["clock_signals", "reset_signals", "data_signals", "control_signals", "handshaking_signals"]
    wide = patterns.groupBy("module").pivot("pattern_type", classes).agg(F.first("signals"))
    none = F.array().cast("array<string>")
    wide = wide.withColumns({c: F.coalesce(c, none) for c in classes})
    control = F.when(F.size("control_signals") > 0, F.col("control_signals")).otherwise(F.col("clock_signals"))
    asks = F.filter("handshaking_signals", lambda s: F.lower(s).rlike("req|valid"))
    acks = F.filter("handshaking_signals", lambda s: F.lower(s).rlike("ack|ready"))
    rules = {
        "reset_behavior": (F.size("reset_signals") > 0, F.col("reset_signals")),
        "clock_domain_crossing": (F.size("clock_signals") > 1, F.col("clock_signals")),
        "data_stability": ((F.size("data_signals") > 0) & (F.size(control) > 0), F.concat("data_signals", F.slice(control, 1, 1))),
        "handshaking_protocol": ((F.size(asks) > 0) & (F.size(acks) > 0), F.concat(asks, acks)),
    }
    parts = [wide.where(c).select("module", F.lit(k).alias("type"), F.lit(SUGGESTIONS[k][0]).alias("description"), s.alias("signals"), F.lit(SUGGESTIONS[k][1]).alias("suggestion")) for k, (c, s) in rules.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def fallback_points(port_table: DataFrame) -> DataFrame:
    """Points for modules without any suggestion: clock, reset and data ports taken alone."""
    parts = []
    for kind, pattern, text in (("clock_check", "clk|clock", "Clock toggles as specified"), ("reset_check", "rst|reset", "Reset brings a defined state"), ("data_check", "data", "Data is transferred unchanged")):
        hit = port_table.where(F.lower("port").rlike(pattern)).groupBy("module").agg(F.sort_array(F.collect_list("port")).alias("signals"))
        parts.append(hit.select("module", F.lit(kind).alias("type"), F.lit(kind.replace("_", " ")).alias("description"), "signals", F.lit(text).alias("suggestion")))
    return functools.reduce(DataFrame.unionByName, parts)


def dataflow_edges(assigned: DataFrame, conns: DataFrame, port_table: DataFrame) -> DataFrame:
    """(src, dst) between ``module.signal`` names: from each right side to its left, and through instance ports."""
    inner = assigned.select(F.explode("rhs_signals").alias("s"), "module", F.regexp_extract("lhs", r"^\w+", 0).alias("l")).select(F.concat_ws(".", "module", "s").alias("src"), F.concat_ws(".", "module", "l").alias("dst"))
    cross = conns.join(port_table.select("module", "port", "direction"), ["module", "port"])
    out, in_ = F.concat_ws(".", "parent", "signal"), F.concat_ws(".", "parent", "instance", "port")
    is_in = F.col("direction") == "input"
    return inner.union(cross.select(F.when(is_in, out).otherwise(in_).alias("src"), F.when(is_in, in_).otherwise(out).alias("dst"))).distinct()


def primary_signals(port_table: DataFrame) -> DataFrame:
    return port_table.select(F.concat_ws(".", "module", "port").alias("signal")).distinct()


def signal_relationships(dataflow: DataFrame, primary: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, target, dist): primary signals that reach another one along the data flow, and over how many steps."""
    near = directed_distances(dataflow, primary.select(F.col("signal").alias("start")), depth).where("dist > 0")
    return near.join(primary.select(F.col("signal").alias("node")), "node", "left_semi").select(F.col("start").alias("source"), F.col("node").alias("target"), "dist")


def module_port_names(mods: DataFrame, port_table: DataFrame) -> DataFrame:
    """(signal): every port name under every module, for designs whose ports could not be assigned; bounded by the design."""
    return mods.select("module").distinct().crossJoin(port_table.select("port").distinct()).select(F.concat_ws(".", "module", "port").alias("signal"))


def design_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table of ``facts``."""
    counts = [t.agg(F.count("*").alias(f"n_{n}")) for n, t in tables.items()]
    return functools.reduce(DataFrame.crossJoin, counts)


def module_summary(mods: DataFrame, port_table: DataFrame, assigned: DataFrame, flow: DataFrame) -> DataFrame:
    """(module, n_ports, n_assigns, n_ifs, n_cases, complexity) with complexity = ports + assignments + 2 ifs + 2 cases."""
    out = mods.select("module").distinct()
    for name, df, cond in (("n_ports", port_table, None), ("n_assigns", assigned, None), ("n_ifs", flow, "kind = 'if'"), ("n_cases", flow, "kind = 'case'")):
        n = (df.where(cond) if cond else df).groupBy("module").agg(F.count("*").alias(name))
        out = out.join(n, "module", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out.withColumn("complexity", F.col("n_ports") + F.col("n_assigns") + 2 * F.col("n_ifs") + 2 * F.col("n_cases"))


def file_dependencies(files: DataFrame) -> DataFrame:
    """(file, needs): includes, and uses of modules that another file defines."""
    clean = cleaned(files)
    base = files.select(F.element_at(F.split("file", "/"), -1).alias("name"), F.col("file").alias("needs"))
    inc = clean.select("file", F.explode(F.regexp_extract_all("text", F.lit(INCLUDE), F.lit(1))).alias("n")).select("file", F.element_at(F.split("n", "/"), -1).alias("name")).join(base, "name")
    defined = clean.select(F.col("file").alias("needs"), F.explode(F.regexp_extract_all("text", F.lit(r"\bmodule\s+(\w+)"), F.lit(1))).alias("m"))
    used = clean.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s+(?:#\s*\(.*?\)\s*)?\w+\s*\("), F.lit(1)))).alias("m")).join(defined, "m")
    return inc.select("file", "needs").union(used.select("file", "needs")).where("file <> needs").distinct()


def dependency_levels(files: DataFrame, needs: DataFrame, ordinal: str | None = None) -> DataFrame:
    """(file, level): 0 without dependencies, else one more than the highest dependency; null on or behind a cycle."""
    todo = written(files.select("file").distinct(), "levels")
    edges = written(needs.select("file", "needs").distinct(), "levels")
    done, level = None, 0
    while True:
        blocked = edges if done is None else edges.join(done.select(F.col("file").alias("needs")), "needs", "left_anti")
        ready = todo.join(blocked.select("file").distinct(), "file", "left_anti")
        if done is not None:
            ready = ready.join(done, "file", "left_anti")
        ready = written(ready.select("file", F.lit(level).alias("level")), "levels")
        if ready.isEmpty():
            break
        done = ready if done is None else written(done.unionByName(ready), "levels")
        level += 1
    if done is None:
        return files.select("file", F.lit(None).cast("int").alias("level")).distinct()
    return files.select("file").distinct().join(done, "file", "left")


def files_in_order(files: DataFrame, needs: DataFrame) -> DataFrame:
    """Files with their place: dependencies first; with a cycle anywhere, in the order of names."""
    levels = dependency_levels(files, needs)
    cyclic = levels.agg((F.count_if(F.col("level").isNull()) > 0).alias("cyclic"))
    keyed = levels.crossJoin(F.broadcast(cyclic)).withColumn("k", F.when(F.col("cyclic"), 0).otherwise(F.col("level")))
    return files.join(keyed.select("file", "k"), "file").withColumn("place", F.row_number().over(W.orderBy("k", "file"))).drop("k")


def combined_text(files: DataFrame, needs: DataFrame) -> DataFrame:
    """One row (text): all files without comments and includes, each under a banner, dependencies first."""
    placed = files_in_order(files, needs).withColumn("text", F.concat(F.lit("// File: "), F.col("file"), F.lit("\n"), strip_includes(strip_comments("text"))))
    return placed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def top_modules(mods: DataFrame, inst: DataFrame) -> DataFrame:
    """One row (module): the first by name of those never instantiated; if there is none, the first of all."""
    free = mods.select("module").distinct().join(inst.select("module"), "module", "left_anti").agg(F.min("module").alias("free"))
    return free.crossJoin(mods.agg(F.min("module").alias("any"))).select(F.coalesce("free", "any").alias("module"))


def preferred_top(mods: DataFrame, inst: DataFrame, folder: str) -> DataFrame:
    """One row (module): a top whose name is part of the folder's name goes before the others."""
    free = mods.select("module").distinct().join(inst.select("module"), "module", "left_anti")
    return free.orderBy(F.when(F.contains(F.lower(F.lit(folder)), F.lower("module")), 0).otherwise(1), "module").limit(1)


def top_ports(mods: DataFrame, inst: DataFrame, port_table: DataFrame) -> DataFrame:
    return port_table.join(top_modules(mods, inst), "module", "left_semi")


def internal_signals(mods: DataFrame) -> DataFrame:
    """(module, signal): declared wires, registers and variables, lists included."""
    decl = r"\b(?:wire|reg|logic|integer|bit|byte|int)\b\s*(?:signed\s*)?(?:\[[^\]]*\]\s*)*([^;=()]*)[;=]"
    lines = found(mods.select("module", "body"), "body", decl, {"names": 1})
    return lines.select("module", F.explode(F.split("names", ",")).alias("n")).select("module", F.regexp_extract("n", r"^\s*(\w+)", 1).alias("signal")).where("signal <> ''").distinct()


def hierarchical_signals(inst: DataFrame, signals: DataFrame, top: DataFrame, depth: int = 3) -> DataFrame:
    """(path, depth, signal): signals of every module instance within ``depth`` levels below the top (depth + 1 in all)."""
    level = top.select("module", F.col("module").alias("path"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(inst.select(F.col("parent").alias("module"), "instance", F.col("module").alias("child")), "module").select(F.col("child").alias("module"), F.concat_ws(".", "path", "instance").alias("path"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out.join(signals, "module").select("path", "depth", F.concat_ws(".", "path", "signal").alias("signal"))


def base_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def wanted_signal(name: Column) -> Column:
    """False for generated and constant-like names, by the last part of a path."""
    base = base_name(name)
    drop = base.rlike(r"^_+|^n\d+$|^tmp\d+$|^genblk\d+|^unnamed|^\d+$|^D_") | (base.rlike(r"[A-Z]") & (base == F.upper(base)) & base.rlike(r"^[A-Z0-9_]+$"))
    return (F.coalesce(name, F.lit("")) != "") & ~drop & ~(F.contains(name, F.lit("genblk")) & name.rlike(r"\[.*\]"))


def wanted_signals(signals: DataFrame) -> DataFrame:
    return signals.where(wanted_signal(F.col("signal"))).select(base_name(F.col("signal")).alias("signal")).distinct()


def without_top_ports(signals: DataFrame, ports_of_top: DataFrame) -> DataFrame:
    """Without names of top ports, clocks and resets."""
    base = base_name(F.col("signal"))
    return signals.withColumn("_b", base).join(ports_of_top.select(F.col("port").alias("_b")), "_b", "left_anti").where(~F.col("_b").isin("clock", "clk", "reset", "rst", "rst_n")).drop("_b")


def without_shadows(signals: DataFrame, internals: DataFrame) -> DataFrame:
    return signals.withColumn("_b", base_name(F.col("signal"))).join(internals.select(F.col("signal").alias("_b")), "_b", "left_anti").drop("_b")


def design_signals(files: DataFrame, internal: bool = False, depth: int = 3) -> DataFrame:
    """(signal): ports of the top and, if asked for, filtered internal and hierarchical signals. Ports are never filtered."""
    mods = modules(cleaned(inline_includes(files)))
    inst, port_table = instances(mods), ports(mods)
    own = top_ports(mods, inst, port_table)
    out = own.select(F.col("port").alias("signal"))
    if internal:
        inside = internal_signals(mods)
        deep = hierarchical_signals(inst, inside, top_modules(mods, inst), depth)
        out = out.union(wanted_signals(inside.select("signal"))).union(wanted_signals(without_top_ports(deep.select("signal"), own)))
    return out.distinct()


def declared_names(text: Column) -> Column:
    """Distinct names of input, output and inout declarations."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:input|output|inout)\s+(?:(?:reg|wire|logic)\s+)?(?:\[[^\]]*\]\s*)?(\w+)"), F.lit(1)))


def facts(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of a design."""
    mods = modules(cleaned(inline_includes(files)))
    port_table, inst, blocks, assigned = ports(mods), instances(mods), always_blocks(mods), assignments(mods)
    conns, flow = connections(inst), control_flow(mods)
    patterns = protocol_patterns(port_table)
    points = verification_points(patterns)
    spare = fallback_points(port_table)
    any_ = points.limit(1).select(F.lit(1).alias("_any"))
    return {
        "modules": mods, "ports": port_table, "instances": inst, "connections": conns, "always_blocks": blocks, "assignments": assigned,
        "control_flow": flow, "signal_attributes": signal_attributes(mods, port_table), "fsms": state_machines(mods, blocks), "protocol_patterns": patterns,
        "verification_points": points.unionByName(spare.join(any_, F.lit(True), "left_anti")), "dataflow": dataflow_edges(assigned, conns, port_table),
    }
