"""Plans, checkers and reports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words of assertions that are no signals.
KEYWORDS = ["posedge", "negedge", "disable", "iff", "property", "assert", "endproperty", "logic", "begin", "end", "if", "else", "inside", "not", "or", "and"]


def plan_lines(plans: DataFrame) -> DataFrame:
    """(line_no, line): ``Signal s:`` and its plans, numbered through all signals.

    Plans are ranked within their signals; only the table of signals is summed up in one task.
    """
    by_signal = W.orderBy("signal")
    heads = plans.groupBy("signal").agg(F.count("*").alias("n"))
    heads = heads.select("signal", (F.sum("n").over(by_signal) - F.col("n")).alias("before"), F.row_number().over(by_signal).alias("k"))
    own = plans.withColumn("r", F.row_number().over(W.partitionBy("signal").orderBy("plan_no"))).join(heads, "signal")
    number = F.col("before") + F.col("r")
    lines = own.select((number + F.col("k")).cast("int").alias("line_no"), F.concat(F.lit("Plan "), number, F.lit(": "), F.col("plan")).alias("line"))
    return lines.unionByName(heads.select((F.col("before") + F.col("k")).cast("int").alias("line_no"), F.concat(F.lit("Signal "), F.col("signal"), F.lit(":")).alias("line")))


def identifiers(text: Column) -> Column:
    """Distinct identifiers that are no keywords; the letters of sized numbers such as 8'hFF are none."""
    plain = F.regexp_replace(text, r"\d*'[sS]?[bodhBODH][0-9a-fA-FxXzZ_]+", " ")
    return F.array_except(F.regexp_extract_all(plain, F.lit(r"\b[a-zA-Z_]\w*\b"), F.lit(0)), F.array(*[F.lit(k) for k in KEYWORDS]))


def unknown_identifiers(svas: DataFrame, signals: DataFrame) -> DataFrame:
    """(signal): identifiers of assertions that are no known signals; system functions are none."""
    plain = F.regexp_replace("sva", r"\$\w+", " ")
    return svas.select(F.explode(identifiers(plain)).alias("signal")).distinct().join(signals, "signal", "left_anti")


def checker(svas: DataFrame, signals: DataFrame, top: str) -> DataFrame:
    """One row (text): a module ``<top>_checker`` with all assertions and its bind to ``top``.

    svas(sva_id, sva); signals(signal): known ports. Unknown identifiers become ports too, to be bound inside.
    """
    missing = unknown_identifiers(svas, signals)
    listed = signals.select("signal", F.lit(0).alias("k")).union(missing.select("signal", F.lit(1))).agg(F.array_sort(F.collect_list(F.struct("k", "signal"))).alias("p"))
    props = svas.agg(F.array_sort(F.collect_list(F.struct("sva_id", "sva"))).alias("s"))
    port = F.transform("p", lambda x: F.concat(F.lit("  input logic "), x["signal"], F.when(x["k"] == 1, F.lit(" /* internal */")).otherwise(F.lit(""))))
    body = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("  property a"), i, F.lit(";\n    "), x["sva"], F.lit("\n  endproperty\n  assert_a"), i, F.lit(": assert property (a"), i, F.lit(");\n"))), "\n")
    bind = F.array_join(F.transform("p", lambda x: F.concat(F.lit("  ."), x["signal"], F.lit("("), x["signal"], F.lit(")"))), ",\n")
    text = F.concat(F.lit(f"module {top}_checker (\n"), F.array_join(port, ",\n"), F.lit("\n);\n"), body, F.lit(f"endmodule\n\nbind {top} {top}_checker checker_inst (\n"), bind, F.lit("\n);\n"))
    return listed.crossJoin(props).select(text.alias("text"))


def write_checker(svas: DataFrame, signals: DataFrame, top: str, path: str) -> None:
    """The checker as one file; it holds every assertion of a design, and so fits the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(checker(svas, signals, top).first()["text"])


def write_proof_report(proofs: DataFrame, path: str) -> None:
    """CSV with SVA ID, Proof Status and Error Message."""
    proofs.select(F.col("sva_id").alias("SVA ID"), F.col("status").alias("Proof Status"), F.col("error").alias("Error Message")).orderBy("SVA ID").write.mode("overwrite").csv(path, header=True)


def script_with_assertions(content: Column, checker_file: str) -> Column:
    """A prover script whose analyze line also reads the checker; ``-v2k`` becomes ``-sv12``."""
    return F.regexp_replace(content, r"analyze -v2k ([^\n]*)", f"analyze -v2k $1\nanalyze -sv12 {checker_file}")


def write_texts(documents: DataFrame, path: str) -> None:
    """A folder of text for each document, by its id."""
    documents.select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(path)
