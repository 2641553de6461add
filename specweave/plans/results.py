"""Artefacts of a run to its final row of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.operators import analysis as A


def summarise(svas: DataFrame, reports: DataFrame, coverage_text: DataFrame) -> dict[str, DataFrame]:
    """proofs, coverage and the final row. coverage_text(report_id, content) has one row."""
    proofs, cover = A.proof_table(svas, reports), A.coverage(coverage_text)
    return {"proofs": proofs, "coverage": cover, "final": A.summary(proofs, svas.agg(F.count("*").alias("n")), cover)}
