"""Verilog files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECURSIVE, FLAT = "*.{v,sv}", "*.{v,sv,vh,svh}"


def read_rtl(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(file, text): all .v and .sv below a folder, or with headers those in it."""
    reader = spark.read.option("pathGlobFilter", RECURSIVE if recursive else FLAT).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
