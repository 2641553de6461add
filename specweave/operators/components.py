"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.scratch import discard, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of ``edges(a, b)``: one row ``(node, component)`` for each node that has an edge to another.

    ``component`` is the smallest node reachable. Alternates large-star and small-star steps over a distributed edge
    table until it is a star forest; each round is written to the scratch folder. Minima are combined before the
    shuffle, so that a hub with very many neighbours costs one partial row a task, and the join that hands the minimum
    back is an ordinary shuffled join that adaptive execution can split. Self-loops, repeats and nulls are ignored.
    """
    cur = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(mins, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        nxt = written(small, "cc")
        discard(cur)
        cur = nxt
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
