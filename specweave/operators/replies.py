"""Parsing of answers: plans and assertions, and their duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.functions.text import squeezed

#: The patterns by which assertions are found.
CLOCKED = r"(?s)@\(\s*posedge\s+\w+.*?;"
FENCED = r"(?s)SVA:?\s*```\s*(.*?)\s*```"
HEADED = r"(?s)SVA for Plan \d+:.*?```(.*?)```"
HEADER = r"SVA for Plan \d+:"
ASSERTED = r"(?s)assert\s+property\s*\(\s*@\(posedge\s+\w+\)\s+.*?;\s*\)"
SV_BLOCK = r"(?s)```systemverilog\s(.*?)```"
BLOCK = r"(?s)```(.*?)```"
PROPERTY = r"(?s)property\s+\w+\s*;.*?endproperty\s*;?\s*assert\s+property\(.+?\);"
COMMENTED = r"//\s*assert\s+property\s*\((.*?)\);"
BODY = r"(?s)assert\s+property\s*\((.*?)\);"
PAIRED = r"(?s)property\s+(\w+);\s*@\s*\(posedge\s+\w+\)\s*(.*?);\s*endproperty\s*assert\s+property\s*\(\1\);"


def _every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _within(text: Column, outer: str, inner: str) -> Column:
    return F.flatten(F.transform(_every(text, outer, 1), lambda b: _every(b, inner)))


def assertion_strategies(text: Column) -> dict[str, Column]:
    """Arrays of assertions by way of finding them."""
    sections = F.slice(F.split(text, HEADER), F.lit(2), F.greatest(F.size(F.split(text, HEADER)) - 1, F.lit(0)))
    first = F.transform(sections, lambda b: F.trim(F.regexp_extract(b, BLOCK, 1)))
    commented = F.flatten(F.transform(_every(text, BLOCK, 1), lambda b: F.transform(_every(b, COMMENTED, 1), lambda x: F.regexp_extract(x, r"@\(posedge\s+\w+\)\s*(.*)", 0))))
    return {
        "fenced": _within(text, FENCED, CLOCKED),
        "raw": _every(text, CLOCKED),
        "plan_blocks": _within(text, HEADED, CLOCKED),
        "plan_sections": F.filter(first, lambda s: F.startswith(s, F.lit("@(posedge"))),
        "asserted": F.transform(_every(text, ASSERTED), F.trim),
        "sv_properties": _within(text, SV_BLOCK, PROPERTY),
        "commented": F.filter(commented, lambda s: s != ""),
        "bodies": F.flatten(F.transform(_every(text, BLOCK, 1), lambda b: _every(b, BODY, 1))),
        "paired": F.transform(_every(text, PAIRED, 2), lambda b: F.concat(F.lit("@(posedge clk) "), b)),
    }


USED = ("fenced", "raw", "plan_blocks", "plan_sections", "asserted")


def clean_assertion(text: Column) -> Column:
    """Without comments, white space as single blanks."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", ""))


def assertions(responses: DataFrame, keys: tuple[str, ...] = ("signal",), strategies: tuple[str, ...] = USED, text_col: str = "response") -> DataFrame:
    """(keys, sva): distinct before cleaning and again after it."""
    ways = assertion_strategies(F.col(text_col))
    found = responses.select(*keys, F.explode(F.array_distinct(functools.reduce(F.concat, [ways[s] for s in strategies]))).alias("sva"))
    return found.where(F.trim("sva") != "").select(*keys, clean_assertion(F.col("sva")).alias("sva")).where("sva <> ''").distinct()


def unique_assertions(rows: DataFrame) -> DataFrame:
    """(sva): the first spelling of each assertion, case aside; comment lines do not count."""
    norm = F.lower(squeezed(F.array_join(F.filter(F.split("sva", "\n"), lambda x: ~F.startswith(F.trim(x), F.lit("//"))), " ")))
    return rows.withColumn("_n", norm).where("_n <> ''").groupBy("_n").agg(F.min("sva").alias("sva")).select("sva")


def plan_lines(responses: DataFrame, keys: tuple[str, ...] = ("signal",), text_col: str = "response") -> DataFrame:
    """(keys, pos, plan): lines that start with ``Plan:``."""
    lines = responses.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    return lines.where(F.startswith("line", F.lit("Plan:"))).select(*keys, "pos", F.trim(F.regexp_replace("line", "^Plan:", "")).alias("plan"))


def colon_plans(responses: DataFrame, id_col: str = "response_id", text_col: str = "response") -> DataFrame:
    """(id, signal, plan_no, plan): ``signal: plan`` lines, split at the first colon; lines without one continue the plan before."""
    lines = responses.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    own = W.partitionBy(id_col).orderBy("pos")
    starts = lines.withColumn("head", F.contains("line", F.lit(":"))).withColumn("plan_no", F.sum(F.col("head").cast("int")).over(own)).where("plan_no > 0")
    part = F.when(F.col("head"), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))).otherwise(F.col("line"))
    signal = F.max(F.when(F.col("head"), F.trim(F.substring_index("line", ":", 1))))
    rows = starts.withColumn("part", part).groupBy(id_col, "plan_no").agg(signal.alias("signal"), F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return rows.select(id_col, "signal", F.col("plan_no").cast("long").alias("plan_no"), F.array_join(F.transform("parts", lambda x: x["part"]), " ").alias("plan"))


def unique_plans(plans: DataFrame, by: str = "signal", order: str = "pos") -> DataFrame:
    """The first of the plans of a signal that agree but for case and white space."""
    norm = F.lower(squeezed(F.col("plan")))
    return plans.withColumn("_r", F.row_number().over(W.partitionBy(by, norm).orderBy(order))).where("_r = 1").drop("_r")


def dealt_plans(plans: DataFrame, prompts: DataFrame) -> DataFrame:
    """(signal, prompt, plan_no, plan): with more than ten plans and several prompts plan j goes to prompt j mod P, else all to each."""
    n_prompts = prompts.groupBy("signal").agg(F.countDistinct("prompt").alias("p"))
    n_plans = plans.groupBy("signal").agg(F.count("*").alias("n"))
    rows = plans.withColumn("j", F.row_number().over(W.partitionBy("signal").orderBy("plan_no")) - 1).join(n_prompts, "signal").join(n_plans, "signal").join(prompts.select("signal", "prompt").distinct(), "signal")
    share = (F.col("n") > 10) & (F.col("p") > 1)
    return rows.where(~share | (F.pmod("j", "p") == F.col("prompt"))).select("signal", "prompt", "plan_no", "plan")
