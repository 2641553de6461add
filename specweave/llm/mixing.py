"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same number of expected copies: the source's target over its size, 2 at most. Along
a fixed order of the source's documents the expected copies are summed up, one random offset in [0, 1) is added, and a
document is emitted once for each integer that the sum crosses at it. The order goes by size (nine leading bits), so
that documents of each size get their share and the words taken come near the target.

The prefix sum never gathers a source in one task: a document's rank is the offset of its cell (source, three levels of
size and hash) plus its rank inside the cell. Each of the sums over cells sees at most 256 rows of a parent cell, and
only the last cells are sorted; documents of one size, such as many copies, are dealt to 4,096 of them by hash.

Defined cases: null text has no words; the null source is a source, and comes last; a source without words gets target
0 and no copies; without any words all targets are 0; documents with the same id and text are separate rows, ranked
arbitrarily among each other; an empty table gives an empty result; other columns, of any name and type, are carried along by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.llm.common import WORD, columns_of, free_prefix, row_hashes, table, written

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST_COPIES = 2.0
SEED = "mix-1"
#: Sources are keys ``s:<source>``, the null source this one: without nulls, joins and windows share a partitioning.
NO_SOURCE = "none"


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """(_m_source, source_size, target, copies) from (_m_source, source_size), one row a source.

    Sources in code point order, null last, take the weights in turn. Shares are filled like vessels: sources in the
    order of cap over weight, each as far as its cap, the rest at one common level. That is where resharing the excess
    by weight ends. The table has a row a source and so the windows over all of it are small.
    """
    order = W.orderBy(F.col("_m_source") == NO_SOURCE, F.col("_m_source").cast("binary"))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("w", share).withColumn("cap", most * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("_m_source") == NO_SOURCE, F.col("_m_source").cast("binary"))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, W.unboundedFollowing)
    level = caps.select(
        "*",
        ((F.lit(total) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)).alias("level"),
    )
    # the first source that its level does not fill sets the level of all after it
    open_level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.col("level").alias("l")))).over(W.partitionBy())["l"]
    target = F.least(F.col("cap"), F.coalesce(open_level, F.lit(float("inf"))) * F.col("w"))
    return level.select(
        "_m_source", "source_size", target.alias("target"),
    ).withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _bits(text: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(text, start, n), 2, 10).cast("int")


#: Cells below a source: leading bits of the size as a binary numeral (its length, then two, two and four bits), and a hash.
LEVELS = (("_m_class", "_m_one"), ("_m_two",), ("_m_three",))
CELL = ("_m_source", *(c for level in LEVELS for c in level))


def _celled(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    size = docs.select(
        F.col(id_col).alias("_m_id"), F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit(NO_SOURCE)).alias("_m_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_m_size"), *more,
    )
    size = size.withColumns({"_m_hash": F.md5(F.concat_ws("|", F.lit(seed), F.col("_m_id").cast("string"))), "_m_bits": F.concat(F.bin("_m_size"), F.lit("000000000"))})
    bits, hex_ = F.col("_m_bits"), lambda start, n: F.conv(F.substring("_m_hash", start, n), 16, 10).cast("int")
    return (
        size.withColumn("_m_class", F.when(F.col("_m_size") == 0, 0).otherwise((F.length(bits) - 9) * 4 - 4 + _bits(bits, 2, 2)).cast("int"))
        .withColumn("_m_one", _bits(bits, 4, 2))
        .withColumn("_m_two", _bits(bits, 6, 4) * 16 + hex_(1, 1))
        .withColumn("_m_three", hex_(2, 2))
        .drop("_m_hash", "_m_bits")
    )


def _counted(rows: DataFrame, cells_of: DataFrame, weights, total: float, most: float, seed: str) -> DataFrame:
    """``rows`` with source_size, target and n_copies; ``cells_of``: the same rows, for the counts."""
    goal = targets(cells_of.groupBy("_m_source").agg(F.sum("_m_size").alias("source_size")), weights, total, most)
    start, keys = goal.withColumn("_m_start", F.lit(0).cast("long")), ["_m_source"]
    counts = cells_of.groupBy(*CELL).agg(F.count("*").alias("n"))
    for level in LEVELS:
        parent, keys = keys, [*keys, *level]
        own = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
        own = own.select(*keys, (F.sum("n").over(W.partitionBy(*parent).orderBy(*level)) - F.col("n")).alias("_m_before"))
        start = own.join(start, parent).select(*keys, (F.col("_m_before") + F.col("_m_start")).alias("_m_start"), "source_size", "target", "copies")
    ranked = rows.withColumn("_m_rank", F.row_number().over(W.partitionBy(*CELL).orderBy("_m_id", "_m_tie")))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.lit("offset"), F.col("_m_source")))
    offset = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    upto = F.col("_m_start") + F.col("_m_rank")
    crossed = F.floor(offset + F.col("copies") * upto) - F.floor(offset + F.col("copies") * (upto - 1))
    n_copies = F.least(crossed, F.ceil(F.lit(most))).cast("int").alias("n_copies")
    return ranked.join(start, list(CELL)).select(*ranked.columns, "source_size", "target", n_copies)


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, total=TOTAL, most=MOST_COPIES, seed: str = SEED) -> DataFrame:
    """One row a document: id, size, source_size, target, n_copies (0 to ``most``), taken."""
    rows = written(_celled(docs, id_col, text_col, source_col, seed, F.monotonically_increasing_id().alias("_m_tie")), "mix", True)
    return _counted(rows, rows, weights, total, most, seed).select(
        F.col("_m_id").alias(id_col), F.col("_m_size").alias("size"), "source_size", "target",
        (F.col("n_copies") * F.col("_m_size")).cast("long").alias("taken"), "n_copies",
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, total=TOTAL, most=MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as it is taken.

    Copies are counted on narrow rows and handed back by two hashes of the whole row. The join hashes the narrow side, so
    that texts are shuffled once and never sorted; only rows that are equal in all columns are numbered, to share out their copies.
    """
    p = free_prefix(docs, "_m_")
    mark = [h.alias(c) for h, c in zip(row_hashes(docs, 0, 1), ("_m_tie", "_m_tie2"), strict=True)]
    rows = written(_celled(docs, id_col, text_col, source_col, seed, *mark), "mix-rows", True)
    per_row = _counted(rows, rows, weights, total, most, seed).groupBy("_m_tie", "_m_tie2").agg(F.sum("n_copies").alias("_m_copies"), F.count("*").alias("_m_equal"))
    per_row = written(per_row, "mix-copies", True)
    tie, tie2, n, equal = p + "tie", p + "tie2", p + "copies", p + "equal"
    repeated = not per_row.where("_m_equal > 1").isEmpty()
    per_row = per_row.where("_m_copies > 0").select(*[F.col(c).alias(p + c[3:]) for c in per_row.columns])
    taken = docs.select("*", *[h.alias(c) for h, c in zip(mark, (tie, tie2), strict=True)]).join(per_row.hint("shuffle_hash"), [tie, tie2])
    copies = F.col(n)
    if repeated:
        place = F.row_number().over(W.partitionBy(tie, tie2).orderBy(F.lit(0)))
        copies = F.floor(copies / F.col(equal)) + F.when(place <= F.pmod(copies, F.col(equal)), 1).otherwise(0)
    taken = taken.withColumn(n, copies.cast("int")).where(F.col(n) > 0)
    return taken.withColumn(p + "copy", F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns_of(docs))


def op7_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1|' || doc_id) AS h FROM documents
), b AS (
  SELECT *, CASE WHEN size = 0 THEN '0' ELSE bin(size) END || '000000000' AS x FROM d
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (length(x) - 9) * 4 - 4 + 2 * substr(x, 2, 1)::INT + substr(x, 3, 1)::INT END AS cls,
    2 * substr(x, 4, 1)::INT + substr(x, 5, 1)::INT AS one,
    16 * (8 * substr(x, 6, 1)::INT + 4 * substr(x, 7, 1)::INT + 2 * substr(x, 8, 1)::INT + substr(x, 9, 1)::INT) + ('0x' || substr(h, 1, 1))::INT AS two,
    ('0x' || substr(h, 2, 2))::INT AS three FROM b
), s AS (
  SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM c GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT *, least(cap, coalesce(arg_min(level, cap / w) FILTER (level * w <= cap) OVER (), 'infinity'::DOUBLE) * w) AS target FROM l
), r AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS f,
    row_number() OVER (PARTITION BY c.source ORDER BY cls, one, two, three, doc_id) AS upto,
    ('0x' || substr(md5('mix-1|offset|' || coalesce('s:' || c.source, 'none')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, (size * (floor(u + f * upto) - floor(u + f * (upto - 1))))::BIGINT AS taken FROM r
"""
