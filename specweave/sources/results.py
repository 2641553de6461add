"""Plans, assertions and proof reports of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.functions.text import number_in


def plans_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(signal, plan_no, plan) of ``{signal: [plan, ...]}``."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return rows.select(F.explode("m").alias("signal", "plans")).select("signal", F.posexplode("plans").alias("plan_no", "plan")).withColumn("plan_no", (F.col("plan_no") + 1).cast("long"))


def plans_from_lines(lines: DataFrame) -> DataFrame:
    """(signal, plan_no, plan) of lines(line_no, line): ``Signal s:``, ``Plan n: text``, and lines that continue a plan.

    With a column ``path`` each file is read by itself, and the plans of a signal are numbered through the files by path.
    """
    named = "path" in lines.columns
    rows = (lines if named else lines.withColumn("path", F.lit(""))).withColumn("line", F.trim("line")).where("line <> ''")
    own = W.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("signal", F.last(F.nullif(F.regexp_extract("line", r"^Signal\s+(.+?):\s*$", 1), F.lit("")), True).over(own)).where("signal is not null")
    rows = rows.where(~F.col("line").rlike(r"^Signal\s+.+?:\s*$")).withColumn("head", F.col("line").rlike(r"^Plan\s+\d+\s*:\s*.+$"))
    rows = rows.withColumn("plan_no", F.sum(F.col("head").cast("long")).over(W.partitionBy("signal").orderBy("path", "line_no"))).where("plan_no > 0")
    text = F.when(F.col("head"), F.trim(F.regexp_extract("line", r"^Plan\s+\d+\s*:\s*(.+)$", 1))).otherwise(F.col("line"))
    parts = rows.withColumn("t", text).groupBy("signal", "plan_no").agg(F.array_sort(F.collect_list(F.struct("path", "line_no", "t"))).alias("p"))
    return parts.select("signal", "plan_no", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("plan"))


def plans_from_text(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return plans_from_lines(whole)


def read_svas(spark: SparkSession, folder: str, pattern: str = "property_goldmine_*.sva") -> DataFrame:
    """(sva_id, path, sva) in numeric order of the names: the first property's body, or else the whole file."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    body = F.regexp_extract("text", r"(?is)property\s+\w+\s*;\s*(.*?)\s*endproperty", 1)
    return by_number(files.select("path", F.coalesce(F.nullif(body, F.lit("")), F.trim("text")).alias("sva")), "sva_id")


def read_reports(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(sva_id, path, content) in numeric order of the names."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return by_number(files, "sva_id")


def by_number(files: DataFrame, id_col: str) -> DataFrame:
    """Files numbered from 0 by the last number of their names, those without one last, by name."""
    order = W.orderBy(F.asc_nulls_last(number_in(F.col("path"))), "path")
    return files.withColumn(id_col, F.row_number().over(order) - 1)


def document_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row of the recorded statistics; what is missing is 0."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "num_pages long, num_tokens long, file_size long, num_files long").alias("s"))
    return rows.select(*[F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in ("num_pages", "num_tokens", "file_size", "num_files")])


def existing_interface(text):
    """From a file with a module: its header line and the declared names, as a struct."""
    from specweave.operators.rtl import declared_names

    return F.struct(F.regexp_extract(text, r"(?s)\bmodule\s+\w+\s*\(.*?\)\s*;", 0).alias("interface"), declared_names(text).alias("signals"))
