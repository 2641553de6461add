"""New documents as they arrive, chunked with the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specweave.operators.retrieval import chunk_words


def arriving_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (doc_id, text): each text file that appears in a folder, once."""
    rows = spark.readStream.option("wholetext", "true").text(folder)
    return rows.selectExpr("regexp_extract(input_file_name(), '([^/]+)[.][^./]*$', 1) AS doc_id", "value AS text")


def arriving_chunks(spark: SparkSession, folder: str, size: int = 100, overlap: int = 20) -> DataFrame:
    return chunk_words(arriving_documents(spark, folder), size, overlap)
