"""Proof reports, coverage, prover scripts and result summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.functions.text import words

#: The frame of a report's summary, and the measures of coverage.
SUMMARY = r"(?s)=+\nSUMMARY\n=+\n(.*?)\n\n"
MODELS = ("statement", "branch", "functional", "toggle", "expression")
KINDS = ("stimuli", "coi")
MEASURES = tuple(f"{k}_{m}" for k in KINDS for m in MODELS)


def proof_status(content: Column) -> Column:
    """error, proven, cex, inconclusive, or the first other status with a count.

    A report with ``ERROR`` is an error. Of the summary's assertions (up to the covers), one proven outranks a counterexample,
    and that an undetermined one. Without a summary or counts: inconclusive.
    """
    lines = F.split(F.trim(F.regexp_extract(content, SUMMARY, 1)), "\n")
    trimmed = F.transform(lines, lambda x: F.trim(x))
    start = F.array_position(F.transform(trimmed, lambda x: F.startswith(x, F.lit("assertions"))), True)
    after = F.slice(trimmed, (start + 1).cast("int"), F.size(trimmed))
    stop = F.array_position(F.transform(after, lambda x: F.startswith(x, F.lit("covers"))), True)
    inside = F.when(stop > 0, F.slice(after, 1, (stop - 1).cast("int"))).otherwise(after)
    counted = F.filter(inside, lambda x: (F.size(F.split(x, ":")) == 2) & (F.coalesce(F.regexp_extract(x, r":\s*(\d+)", 1).try_cast("int"), F.lit(0)) > 0))
    status = F.transform(counted, lambda x: F.lower(F.trim(F.get(F.split(x, ":"), F.lit(0)))))
    has = lambda *names: F.arrays_overlap(status, F.array(*[F.lit(n) for n in names]))
    known = F.when(has("- proven"), "proven").when(has("- cex", "- ar_cex"), "cex").when(has("- undetermined", "- unknown") | (F.size(status) == 0), "inconclusive").otherwise(F.get(status, F.lit(0)))
    return F.when(F.contains(content, F.lit("ERROR")), "error").when(~content.rlike(SUMMARY) | (start == 0), "inconclusive").otherwise(known)


def error_line(content: Column) -> Column:
    """The first line with ERROR; null without one."""
    return F.nullif(F.trim(F.regexp_extract(content, r"(?m)^.*ERROR.*$", 0)), F.lit(""))


def short_error(content: Column) -> Column:
    """What follows the last colon of the error line."""
    return F.trim(F.element_at(F.split(error_line(content), ":"), -1))


def proof_table(svas: DataFrame, reports: DataFrame) -> DataFrame:
    """(sva_id, status, error) of assertions that have a report."""
    return svas.join(reports, "sva_id").select("sva_id", proof_status(F.col("content")).alias("status"), short_error(F.col("content")).alias("error"))


def coverage_rows(reports: DataFrame, id_col: str = "report_id", text_col: str = "content") -> DataFrame:
    """(id, pos, kind, model, value): ``kind|model|d.d`` triples; numbers without a decimal point are no triples."""
    hits = reports.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(r"\w+\|\w+\|\d+\.\d+"), F.lit(0))).alias("pos", "m"))
    part = F.split("m", r"\|")
    return hits.select(id_col, "pos", F.get(part, F.lit(0)).alias("kind"), F.get(part, F.lit(1)).alias("model"), F.get(part, F.lit(2)).cast("double").alias("value"))


def coverage(reports: DataFrame, id_col: str = "report_id", text_col: str = "content") -> DataFrame:
    """(id, syntax, functionality, ten coverages): the last triple of a measure counts; missing ones are 0.

    syntax is 0 with an analysis error or a syntax error; functionality is 1 if the last ``proofs:`` line lists proven.
    """
    last = coverage_rows(reports, id_col, text_col).withColumn("measure", F.concat_ws("_", "kind", "model"))
    last = last.withColumn("r", F.row_number().over(W.partitionBy(id_col, "measure").orderBy(F.desc("pos")))).where("r = 1")
    wide = last.groupBy(id_col).pivot("measure", list(MEASURES)).agg(F.first("value"))
    text = F.col(text_col)
    proofs = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\bproofs:[^\n]*"), F.lit(0)), F.lit(-1))
    proven = F.array_contains(F.split(F.trim(F.element_at(F.split(proofs, ":"), -1)), r"\s+"), "proven")
    syntax = F.when(text.rlike(r"(?i)ERROR \(VERI-|syntax error"), 0.0).otherwise(1.0)
    flags = reports.select(id_col, syntax.alias("syntax"), F.when(F.coalesce(proven, F.lit(False)), 1.0).otherwise(0.0).alias("functionality"))
    return flags.join(wide, id_col, "left").select(id_col, "syntax", "functionality", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MEASURES])


def summary(proofs: DataFrame, n_svas: DataFrame, cover: DataFrame) -> DataFrame:
    """The final row of fifteen figures. n_svas: one row (n); cover: one row of ``coverage``."""
    counts = proofs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("proven", "error")])
    rate = lambda c: F.when(F.col("assertions") > 0, F.col(c) / F.col("assertions")).otherwise(0.0)
    rows = n_svas.select(F.col("n").alias("assertions")).crossJoin(counts).crossJoin(cover.select(*MEASURES))
    rows = rows.withColumns({"syntax_correct": F.col("assertions") - F.col("error"), "proven": F.col("proven")})
    return rows.select("assertions", "syntax_correct", "proven", rate("syntax_correct").alias("syntax_rate"), rate("proven").alias("proven_rate"), *MEASURES)


def plan_statistics(plans: DataFrame) -> DataFrame:
    """One row: plans, signals, plans a signal, words a plan."""
    out = plans.agg(F.count("*").alias("n_plans"), F.countDistinct("signal").alias("n_signals"), F.coalesce(F.avg(F.size(words(F.col("plan")))), F.lit(0.0)).alias("words_per_plan"))
    return out.withColumn("plans_per_signal", F.when(F.col("n_signals") > 0, F.col("n_plans") / F.col("n_signals")).otherwise(0.0))


def assertion_statistics(svas: DataFrame) -> DataFrame:
    return svas.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(words(F.col("sva")))), F.lit(0.0)).alias("words_per_sva"))


def statistics(df: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, population deviation, min, max, median, sum, least mode and nine quantiles of a column."""
    c = F.col(col)
    out = df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.median(c).alias("median"), F.sum(c).alias("sum"), F.mode(c, True).alias("mode"),
        F.percentile(c, [i / 10 for i in range(1, 10)]).alias("q"),
    )
    return out.withColumns({f"q{i}0": F.col("q")[i - 1] for i in range(1, 10)}).drop("q")


def script_facts(scripts: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, top_module, design_file, stopat, clock, reset) of prover scripts.

    The first ``elaborate -top``; the first Verilog file of an ``analyze -v2k`` line, continued lines joined, one below
    ${RTL_PATH} before others; of the other commands the last line.
    """
    text = F.col(text_col)
    joined = F.regexp_replace(text, r"\\[ \t]*\r?\n", " ")
    analyze = F.array_join(F.filter(F.split(joined, "\n"), lambda x: F.contains(x, F.lit("analyze -v2k"))), "\n")
    below, other = F.regexp_extract(analyze, r"\$\{RTL_PATH\}/(\S+\.v)", 1), F.regexp_extract(analyze, r"(\S+\.v)", 1)
    line = lambda start: F.try_element_at(F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.startswith(x, F.lit(start))), F.lit(-1))
    top = F.nullif(F.regexp_extract(text, r"(?m)^[ \t]*elaborate -top\s+(\S+)", 1), F.lit(""))
    return scripts.select(id_col, top.alias("top_module"), F.coalesce(F.nullif(below, F.lit("")), F.nullif(other, F.lit(""))).alias("design_file"), line("stopat -env").alias("stopat"), line("clock").alias("clock"), line("reset").alias("reset"))


def original_script(scripts: DataFrame, prefix: str | None = None) -> DataFrame:
    """The first script by path that analyses Verilog; prefix: of those whose name starts so."""
    rows = scripts.where(F.contains("content", F.lit("analyze -v2k")))
    if prefix:
        rows = rows.where(F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(prefix)))
    return rows.orderBy("path").limit(1)


def proven_only(svas: DataFrame, proofs: DataFrame) -> DataFrame:
    return svas.join(proofs.where("status = 'proven'"), "sva_id", "left_semi")


def entity_types(prompts: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity_type): the items of the first bracketed list after ``Entity Types:``."""
    inner = F.regexp_extract(text_col, r"(?si)Entity Types:\s*\[([^\]]*)\]", 1)
    return prompts.select(F.explode(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", "")))).alias("entity_type")).where("entity_type <> ''")
