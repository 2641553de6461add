"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are the items. Their sizes are rounded up to ten significant bits, so there are at most 512
sizes an octave whatever the input; the histogram (size, number of groups), which is all that reaches the driver, has
a proven bound of about 20,000 rows. Groups of one size are interchangeable, so best fit over the histogram places runs of
equal items at once and gives what placing them one by one would give: the tightest bin that takes an item stays the
tightest until it can take no more. Bins stand in a balanced tree by remaining room.

``packed`` opens as few bins of a fixed capacity as best fit needs. ``sharded`` has a fixed number of shards and uses the
least capacity with which that many bins suffice, so that the shards come out near equal in bytes. A group larger than
an equal share fits in no shard; it alone is dealt by a hash of the id into pieces of about an eighth of a share. So the law of near
equal sizes holds whatever the groups, and indivisible are the groups that fit. Rows of a split group that share an id, or have none,
stay in one piece; only if they alone exceed a share does their shard come out larger.

Ranks (of groups among those of their size, of rows in their shard) are sums of cell counts plus ranks within cells,
so no task sorts a whole size or shard.

Defined cases: null text has size 8 and is grouped with empty text; a null id is an id like any other; rows that share id and text
are separate rows of one group; groups of equal size class are ranked by hash, so ties are settled alike in every run; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from specweave.llm.common import table, written

HEADER = 8
DIGITS = 10


class Tree:
    """A treap of distinct keys with the least key not below a bound."""

    def __init__(self):
        self.root, self.draw = None, random.Random(7).random

    def _split(self, t, key):
        """Keys below ``key`` and the rest."""
        if t is None:
            return None, None
        if t[0] < key:
            t[2], right = self._split(t[2], key)
            return t, right
        left, t[1] = self._split(t[1], key)
        return left, t

    def _joined(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] < b[3]:
            a[2] = self._joined(a[2], b)
            return a
        b[1] = self._joined(a, b[1])
        return b

    def add(self, key):
        a, b = self._split(self.root, key)
        self.root = self._joined(self._joined(a, [key, None, None, self.draw()]), b)

    def take_at_least(self, bound):
        """Remove and return the least key >= ``bound``; None if there is none."""
        a, b = self._split(self.root, bound)
        if b is None:
            self.root = a
            return None
        t = b
        while t[1] is not None:
            t = t[1]
        key = t[0]
        _, b = self._split(b, (key[0], key[1] + 1))
        self.root = self._joined(a, b)
        return key


def best_fit(histogram: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Runs (size, bin, number of items) in order of placing, and the number of bins; None if ``most_bins`` do not do."""
    free, bins, runs = Tree(), 0, []
    for size, n in sorted(histogram, reverse=True):
        if size > capacity:
            return None
        while n:
            found = free.take_at_least((size, -1))
            if found is None:
                if most_bins is not None and bins == most_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            k = min(n, found[0] // size)
            runs.append((size, found[1], k))
            free.add((found[0] - k * size, found[1]))
            n -= k
    return runs, bins


def least_capacity(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best fit with about the least capacity (to one part in 10,000) with which ``shards`` bins suffice."""
    total, largest = sum(s * n for s, n in histogram), max(s for s, _ in histogram)
    low = max(largest, -(-total // shards))
    if done := best_fit(histogram, low, shards):
        return done[0]
    high = low + largest  # an item that no bin takes means that all are filled above high - largest
    best = best_fit(histogram, high, shards)
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        if done := best_fit(histogram, middle, shards):
            high, best = middle, done
        else:
            low = middle
    return best[0]


def _rounded(size: str) -> str:
    shift = f"greatest(length(bin({size})) - {DIGITS}, 0)"
    return f"shiftleft(shiftright({size} + shiftleft(1L, {shift}) - 1, {shift}), {shift})"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return written(
        docs.select(
            F.col(id_col).alias("_b_id"), (F.octet_length(text) + HEADER).cast("long").alias("_b_size"), F.crc32(text.cast("binary")).alias("_b_crc"),
            F.xxhash64(text).alias("_b_key"), F.monotonically_increasing_id().alias("_b_row"),
        ),
        "pack", True
    )


def _placed(rows: DataFrame, share: int, place) -> DataFrame:
    """``rows`` with ``shard``. share: groups above it are split. place: from the histogram to runs."""
    spark = rows.sparkSession
    groups = rows.groupBy("_b_key").agg(F.sum("_b_size").alias("bytes"))
    # groups above an equal share: fewer than there are shards
    large = {r["_b_key"]: -(-r["bytes"] * 8 // share) for r in groups.where(F.col("bytes") > share).collect()}
    piece = F.lit(0)
    for key, n in large.items():
        piece = F.when(F.col("_b_key") == key, F.pmod(F.xxhash64(F.col("_b_id"), F.lit(5)), F.lit(n)).cast("int")).otherwise(piece)
    rows = rows.withColumn("_b_piece", piece)
    units = rows.groupBy("_b_key", "_b_piece").agg(F.sum("_b_size").alias("bytes")).withColumn("_b_class", F.expr(_rounded("bytes"))).withColumn("_b_cell", F.pmod(F.col("_b_key") + F.col("_b_piece"), F.lit(64)).cast("int"))
    units = written(units, "pack-units", True)
    cells = units.groupBy("_b_class", "_b_cell").agg(F.count("*").alias("n"))
    runs = place([(r["_b_class"], r["n"]) for r in cells.groupBy("_b_class").agg(F.sum("n").alias("n")).collect()])
    upto: dict[int, int] = {}
    spans = []
    for size, shard, k in runs:
        spans.append((size, upto.get(size, 0), upto.get(size, 0) + k, shard))
        upto[size] = upto.get(size, 0) + k
    spans = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("_b_class", "_b_from", "_b_to", "shard"), zip(*spans, strict=True) if spans else ([],) * 4, strict=True)}))
    cells = cells.withColumn("_b_before", F.sum("n").over(W.partitionBy("_b_class").orderBy("_b_cell")) - F.col("n")).drop("n")
    ranked = units.withColumn("_b_rank", F.row_number().over(W.partitionBy("_b_class", "_b_cell").orderBy("_b_key", "_b_piece")) - 1).join(cells, ["_b_class", "_b_cell"])
    ranked = ranked.withColumn("_b_rank", F.col("_b_rank") + F.col("_b_before")).alias("u")
    spans = F.broadcast(spans.alias("s"))  # a row for each size and shard it meets: bounded by sizes plus shards
    where = (F.col("u._b_class") == F.col("s._b_class")) & (F.col("_b_rank") >= F.col("_b_from")) & (F.col("_b_rank") < F.col("_b_to"))
    homes = ranked.join(spans, where).select("_b_key", "_b_piece", F.col("shard").cast("int").alias("shard"))
    return rows.join(homes, ["_b_key", "_b_piece"])


def _slotted(placed: DataFrame) -> DataFrame:
    placed = written(placed.withColumn("_b_cell", F.pmod(F.xxhash64("_b_id", F.lit(3)), F.lit(128)).cast("int")), "pack-placed", True)
    cells = placed.groupBy("shard", "_b_cell").agg(F.count("*").alias("n"))
    cells = cells.withColumn("_b_before", F.sum("n").over(W.partitionBy("shard").orderBy("_b_cell")) - F.col("n")).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", "_b_cell").orderBy("_b_id", "_b_row")) - 1
    return placed.withColumn("_b_in", inside).join(cells, ["shard", "_b_cell"]).withColumn("slot", (F.col("_b_in") + F.col("_b_before")).cast("long"))


def sharded(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row in one of ``shards`` shards near equal in bytes: id, size, text_crc32, shard, slot."""
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum("_b_size"), F.lit(0))).first()[0]
    placed = _placed(rows, max(1, -(-total // shards)), lambda h: least_capacity(h, shards) if h else [])
    return _slotted(placed).select(F.col("_b_id").alias(id_col), F.col("_b_size").alias("size"), F.col("_b_crc").alias("text_crc32"), "shard", "slot")


def packed(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row in a shard of at most ``capacity`` bytes, in as few as best fit needs; larger groups are split.

    A rounded-up size that exceeds the capacity though the size itself does not gets a shard as if it just fitted.
    """
    def place(h: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        fits = best_fit([(min(s, capacity), n) for s, n in h], capacity)
        return [(next((c for c, _ in h if c > capacity), s) if s == capacity and s not in dict(h) else s, b, k) for s, b, k in fits[0]]

    rows = _rows(docs, id_col, text_col)
    return _slotted(_placed(rows, capacity, place)).select(F.col("_b_id").alias(id_col), F.col("_b_size").alias("size"), F.col("_b_crc").alias("text_crc32"), "shard", "slot")


def op5_shards(spark, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
