"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes each normalised text to ``HASHES`` slots of a filter that has about 16 slots a row, counts the rows of each
slot and sets the bits of the slots that two or more rows hit. Only slot numbers are shuffled for that, combined within
each task. The filter stands in chunks of 4 KB, one row each. Pass 2 tests each row against it: a row of which some slot is its own
alone cannot repeat and passes straight through, where it was read; the others, which are the repeats and about one row in a hundred
by chance, are shuffled by their hash. A chance hit costs a shuffled row, never a wrong result.

The filter is broadcast. It has ``MOST_SLOTS`` slots at most, which is 256 MB, whatever the input. Up to 134 million
rows it grows with them; beyond, chance hits grow (a third of the rows at a billion, nearly all at ten billion), until the dedup
is an ordinary one by shuffled hashes.

Defined cases: null text counts as empty; a null id comes last among equal texts; of rows that share text and id one
stays; an empty table gives an empty result; other columns, of any name and type, are carried along untouched by ``drop_repeats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import SPACE, columns_of, free_prefix, row_hashes, table, written

HASHES = 2
SLOTS_A_ROW = 16
MOST_SLOTS = 1 << 31
CHUNK_BITS = 15  # the bits of one of Spark's bitmaps


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_slots(n: int) -> int:
    """A power of two, so that slots are bits of a hash."""
    return min(MOST_SLOTS, max(1 << CHUNK_BITS, 1 << (SLOTS_A_ROW * max(1, n) - 1).bit_length()))


def _slots(sha: Column, slots: int, hashes: int = HASHES) -> list[Column]:
    return [F.xxhash64(sha, F.lit(i)).bitwiseAND(F.lit(slots - 1)) for i in range(hashes)]


def repeated_slots(shas: DataFrame, slots: int) -> DataFrame:
    """The filter after pass 1 from (sha): (chunk, bits) with a bit for each slot hit at least twice.

    A row whose own slots coincide hits its slot once. Repeated slots are dealt by chunk, 32,768 rows a chunk at most.
    """
    hit = shas.select(F.explode(F.array_distinct(F.array(*_slots(F.col("sha"), slots)))).alias("slot"))
    twice = hit.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    chunks = twice.select(F.shiftright("slot", CHUNK_BITS).alias("chunk"), F.col("slot").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).alias("at"))
    return chunks.repartition("chunk").groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits"))


def marked(rows: DataFrame, sha: str, filter_chunks: DataFrame, slots: int, maybe: str) -> DataFrame:
    """``rows`` with the column ``maybe``: whether all slots of a row are in the filter."""
    names, out = columns_of(rows), rows
    for i, slot in enumerate(_slots(F.col(sha), slots)):
        own = filter_chunks.select(F.col("chunk").alias(f"{maybe}_c"), F.col("bits").alias(f"{maybe}_b"))
        before = [] if i == 0 else [F.col(maybe)]
        out = out.withColumn(f"{maybe}_s", slot)
        out = out.join(F.broadcast(own), F.shiftright(f"{maybe}_s", CHUNK_BITS) == F.col(f"{maybe}_c"), "left")
        # bit b of a bitmap is bit b mod 8 of its byte b div 8
        byte = F.conv(F.hex(F.substring(F.col(f"{maybe}_b"), (F.shiftright(F.col(f"{maybe}_s").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)), 3) + 1).cast("int"), F.lit(1))), 16, 10)
        is_set = F.coalesce(F.getbit(byte.cast("int"), F.col(f"{maybe}_s").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
        for x in before:
            is_set = x & is_set
        out = out.select(*names, is_set.alias(maybe))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256."""
    hashed = written(docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact")
    slots = slots or filter_slots(hashed.count())
    rows = marked(hashed, "sha", written(repeated_slots(hashed, slots), "exact-filter", True), slots, "maybe")
    maybe = rows.where("maybe")
    groups = maybe.groupBy("sha").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r"))).alias("first"), F.count("*").alias("n")
    )
    groups = written(groups, "exact-groups", True)  # so that the join is one of its own, which splits a hot group
    shuffled = maybe.join(groups, "sha").select(
        F.col("id").alias(id_col), F.col("first.i").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first.r") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    straight = rows.where("not maybe").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return straight.unionByName(shuffled)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest id."""
    p = free_prefix(docs, "_x_")
    sha = text_hash(F.col(text_col))
    slots = slots or filter_slots(docs.count())
    chunks = written(repeated_slots(docs.select(sha.alias("sha")), slots), "exact-filter", True)
    rows = marked(docs.withColumn(p + "sha", sha), p + "sha", chunks, slots, p + "maybe")
    row = F.struct(*columns_of(docs))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), *row_hashes(docs, 0))
    firsts = rows.where(F.col(p + "maybe")).groupBy(p + "sha").agg(F.min_by(row, order).alias(p + "row")).select(p + "row.*")
    return rows.where(~F.col(p + "maybe")).select(*columns_of(docs)).union(firsts)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
