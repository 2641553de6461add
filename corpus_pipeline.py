"""Pipeline over ``documents``: quality filter, exact dedup, SimHash near-dedup, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null text counts as empty text in every stage, and an empty table stays empty. A row with a null id is judged, deduplicated by its
text (of equal texts it comes last) and mixed like others, but is no near copy of any; the docstrings of the operators define the other cases.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from specweave.llm import bpe, exact, mixing, quality, simhash
from specweave.llm.common import discard, kept, scope, table, written


#: Documents that a Python worker gets at a time. With Spark's default of 10,000 a batch of texts takes tens of MB, several
#: times over in the JVM and in Python.
BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    """For plans that the caller runs, hence not taken back here; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    _small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact.drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts the document with the smallest doc_id stays. Texts are linked by the vantage-point tree over their
    fingerprints, as in op1, and beside it by similar five-word shingles (0.8 or more)."""
    return simhash.drop_near_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded bytes, one row a document of the mix."""
    _small_batches(spark)
    return bpe.encoded(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [
    ("quality filter", quality_filter),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]

#: A classifier is trained on the way, so SQL cannot express the rows; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote on the way goes when its result is written, and that result when the next stage has read it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scope():
            docs = kept(written(stage(spark, docs, sf_dir), f"pipeline-{i}"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
