"""Shared pieces: word patterns, tables, names and hashes of whole rows, and the library's scratch tables and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from specweave.operators.components import components
from specweave.scratch import discard, kept, scope, written

__all__ = ["SPACE", "WORD", "columns_of", "components", "discard", "free_prefix", "kept", "row_hashes", "scope", "table", "written"]

#: White space and words as the contracts define them (Java and Python regex syntax alike).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """``prefix``, lengthened until no column of ``docs`` begins with it: for helper columns beside columns of any name."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def row_hashes(docs: DataFrame, *seeds: int) -> list[Column]:
    """A hash of the whole row for each seed. Maps and variants, which Spark does not hash, count by their JSON."""
    parts = [c if _hashable(f.dataType) else F.to_json(F.struct(c.alias("v"))) for c, f in zip(columns_of(docs), docs.schema.fields, strict=True)]
    return [F.xxhash64(F.lit(s), *parts) for s in seeds]
