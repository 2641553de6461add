"""Embedding near-dedup over a pivot-permutation index.

Equal vectors collapse to one class each. Pivots are drawn from a bounded sample of classes, less those at a cosine of
``SEPARATE`` or more to another pivot, so a dense group has few pivots and shares their lists. Every class enters the inverted
lists of its nearest pivots (``nearest``, or the binary logarithm of the pivot count if that is more, so that recall does not
fall as pivots are added) and of those within the angle of ``TIGHT`` and of ``least`` together. A class within ``TIGHT`` of a
pivot needs the latter only: by the angle bound, whatever links with it is in that pivot's list, so these links are exact.
Two classes are candidates if they share at least ``shared`` pivots; candidates are verified by cosine in double precision. A pair is
counted in the list of its first shared pivot only. Lists longer than a tile are cut into chunks, each pair of chunks
being a task of bounded size, so a hot list is no hot task; no pair is dropped. A tile returns sums of link counts and a spanning
forest of its links instead of the links, so a dense group costs rows in proportion to its members.

Vectors are compared with those of their length, so each length has pivots of its own, and a length with few classes
(fewer than ``FEW``, or than a thousandth of all) has one list instead, which is searched exactly. Pivots take ``PIVOT_BYTES`` at
most, all lengths together, when they are broadcast.

There are no false links. Recall is that of the index; the tests hold it to 0.99 against brute force, on loose pairs, in dense
groups and with several lengths. The test tables themselves hold no pair at a cosine of 0.9, and say nothing about it.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
lengths never link; a null id never serves as a component; rows that share an id are separate
rows, an exact copy included; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import components, discard, table, written
from specweave.llm.simhash import forest

LEAST = 0.9
NEAREST = 8
SHARED = 1
MOST_PIVOTS, PIVOT_BYTES = 1 << 16, 64 << 20
FEW = 64
SEPARATE = 0.6
TIGHT = math.radians(30)
TILE = 2048
WHOLE = 1 << 24  # the list of all vectors of a length has this number plus the length


def _classed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with v the float64 bytes of a valid vector, else null."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                a = None if x is None or not x or None in x else np.array(x, "<f8")
                out.append(None if a is None or not np.isfinite(a).all() or not a.any() else (a + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, v binary")


def _units(values: list[bytes]) -> np.ndarray:
    a = np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
    a = a / np.abs(a).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def separated(points: np.ndarray, most: float = SEPARATE) -> np.ndarray:
    """The unit vectors, in order, that have a cosine below ``most`` to all kept before them."""
    kept = points[:0]
    for at in range(0, len(points), 512):
        part = points[at : at + 512]
        part = part[(part @ kept.T < most).all(1)]
        close, ok = part @ part.T >= most, np.zeros(len(part), bool)
        for i in range(len(part)):
            ok[i] = not (close[i] & ok).any()
        kept = np.concatenate([kept, part[ok]])
    return kept


def described(x: np.ndarray, points: np.ndarray, nearest: int, least: float = LEAST) -> np.ndarray:
    """For each unit vector of ``x``, which pivots' lists it enters."""
    s = x @ points.T
    k = min(len(points), max(nearest, math.ceil(math.log2(max(1, len(points))))))
    enters = s >= math.cos(min(math.pi, TIGHT + math.acos(max(-1.0, min(1.0, least))))) - 1e-12
    loose = np.flatnonzero(s.max(1) < math.cos(TIGHT))
    enters[loose[:, None], np.argpartition(-s[loose], k - 1, axis=1)[:, :k]] = True
    return enters


def tile_links(values: list[bytes], rep: np.ndarray, size: np.ndarray, near: np.ndarray, side: np.ndarray, pivot: int, least: float, shared: int):
    """Link counts and forest of one tile; side 0 and 1: two chunks, all 0: one chunk with itself. near: padded with -1."""
    x = _units(values)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(right)
    right = left if one else right
    none = np.empty(0, np.int64)
    count, a_all, b_all = np.zeros(len(rep), np.int64), none, none
    step = max(1, (1 << 22) // near.shape[1] ** 2)
    for at in range(0, len(left), 512):
        part = left[at : at + 512]
        s = x[part] @ x[right].T
        i, j = np.nonzero(s >= least - 1e-12)
        sure = s[i, j] >= least + 1e-12
        a, b = part[i], right[j]
        if one:
            a, b, sure = a[a < b], b[a < b], sure[a < b]
        for cut in range(0, len(a), step):
            p, q, exact = a[cut : cut + step], b[cut : cut + step], sure[cut : cut + step]
            both = ((near[p][:, :, None] == near[q][:, None, :]) & (near[p] >= 0)[:, :, None]).any(2)
            first = np.where(both, near[p], np.iinfo(near.dtype).max).min(1)
            edge = np.flatnonzero(~exact)
            exact[edge] = (x[p[edge]] * x[q[edge]]).sum(1) >= least
            ok = (both.sum(1) >= shared) & (first == pivot) & exact
            p, q = p[ok], q[ok]
            np.add.at(count, p, size[q])
            np.add.at(count, q, size[p])
            a_all, b_all = np.concatenate([a_all, p]), np.concatenate([b_all, q])
            if len(a_all) > 1 << 20:
                a_all, b_all = forest(a_all, b_all, len(rep))
    return count, *forest(a_all, b_all, len(rep))


def pivot_sets(classes: DataFrame, pivots: int | None = None, few: int = FEW) -> dict[int, tuple[int, np.ndarray]]:
    """For each length with many classes, the number of its first pivot and its pivots, unit vectors drawn by hash.

    They number about 2 n^0.55 for n classes of a length (or ``pivots``), less those too near to another, within the limits.
    """
    sizes = classes.groupBy((F.length("v") / 8).cast("long").alias("l")).agg(F.count("*").alias("n"))
    total = classes.count()
    rows = sizes.where(F.col("n") >= max(few, total // 1000)).collect()  # a thousand lengths at most
    wanted = {r["l"]: pivots or math.ceil(2 * r["n"] ** 0.55) for r in rows}
    scale = min(1.0, MOST_PIVOTS / max(1, sum(wanted.values())), PIVOT_BYTES / max(1, sum(8 * length * k for length, k in wanted.items())))
    rates = [F.lit(x) for r in rows for x in (r["l"], min(1.0, scale * wanted[r["l"]] / r["n"]))]
    if not rates:
        return {}
    rate = F.coalesce(F.create_map(*rates)[(F.length("v") / 8).cast("long")], F.lit(0.0))
    draw = F.pmod(F.xxhash64("v", F.lit(29)), F.lit(1 << 40)) / float(1 << 40)
    sample = sorted(classes.where(draw < rate).select("v").toArrow().column(0).to_pylist(), key=lambda v: (len(v), v))
    out, first = {}, 0
    for length, own in itertools.groupby(sample, lambda v: len(v) // 8):
        points = separated(_units(list(own)))
        out[length] = first, points
        first += len(points)
    return out


def near_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST, nearest: int = NEAREST, shared: int = SHARED, pivots: int | None = None, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a vector."""
    rows = written(_classed(vectors, id_col, vec_col), "vectors")
    classes = written(rows.where("v is not null").groupBy("v").agg(F.count("*").alias("size"), F.min("vec_id").alias("rep")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    sent = rows.sparkSession.sparkContext.broadcast(pivot_sets(classes, pivots))

    def entered(batches):
        sets = sent.value
        for batch in batches:
            length = pc.divide(pc.binary_length(batch.column(1)), 8).to_numpy()
            for own in np.unique(length).tolist():
                same = batch.filter(pa.array(length == own))
                first, points = sets.get(own, (WHOLE + own, None))
                step = 4096 if points is None else max(1, (1 << 23) // max(len(points), own))
                for part in [same.slice(i, step) for i in range(0, same.num_rows, step)]:
                    if points is None:
                        at, pivot = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                    else:
                        at, pivot = np.nonzero(described(_units(part.column(1).to_pylist()), points, nearest, least))
                    ends = np.searchsorted(at, np.arange(part.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(ends, (pivot + first).astype(np.int32))], ["class", "v", "size", "near"])

    index = written(classes.select("class", "v", "size").mapInArrow(entered, "class long, v binary, size long, near array<int>"), "pivot-index")
    entries = index.withColumn("pivot", F.explode("near"))
    lists = entries.groupBy("pivot").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))  # a row a pivot
    entries = entries.join(F.broadcast(lists), "pivot").withColumn("c", F.pmod(F.xxhash64("class", F.lit(31)), F.col("n")).cast("int"))
    dealt = entries.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "pivot", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), (F.col("c") > F.col("d")).cast("int").alias("side"), "class", "v", "size", "near"
    )

    def linked(key, part):
        values = part.column("v").to_pylist()
        rep, size, side = (part.column(c).to_numpy() for c in ("class", "size", "side"))
        lists = part.column("near").to_pylist()
        near = np.full((len(values), max(map(len, lists))), -1, np.int32)
        for row, own in zip(near, lists, strict=True):
            row[: len(own)] = own
        i, j = key[1].as_py(), key[2].as_py()
        if i != j and len(np.unique(side)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.int64())})
        count, a, b = tile_links(values, rep, size, near, side, key[0].as_py(), least, 1 if key[0].as_py() >= WHOLE else shared)
        own = np.flatnonzero(count)
        return pa.table({"a": np.concatenate([rep[own], rep[a]]), "b": pa.array([None] * len(own) + rep[b].tolist(), pa.int64()), "w": np.concatenate([count[own], np.zeros(len(a), np.int64)])})

    found = written(dealt.groupBy("pivot", "i", "j").applyInArrow(linked, "a long, b long, w long"), "vector-links")
    counts = found.groupBy("a").agg(F.sum("w").alias("w")).withColumnRenamed("a", "class")
    joined = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("class"), F.col("component").alias("c"))
    known = classes.join(counts, "class", "left").join(joined, "class", "left").withColumn("c", F.coalesce("c", "class"))
    least_id = known.groupBy("c").agg(F.min("rep").alias("component_id"))
    known = written(known.join(least_id, "c").select("v", (F.col("size") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id"), "vector-homes")
    with_class = rows.where("v is not null").join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    without = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    discard(classes, index, found)
    return with_class.union(without).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding(spark, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))
