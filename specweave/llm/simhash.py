"""SimHash near-dedup over a vantage-point tree.

Fingerprints are made in Arrow batches from whole texts. Equal fingerprints collapse to one class each (combined before the
shuffle). A vantage-point tree, fitted on a bounded sample of classes, routes every class to its home leaf and, as a query,
to every leaf that its ball of the linking radius reaches: with d the distance to the vantage point and m the node's
median, the near side is pruned when d - r > m and the far side when d + r <= m (triangle bounds). Each leaf is searched
exactly; leaves larger than a tile are cut into tiles of bounded size, each pair of chunks in one, so no leaf is one task. A tile
returns a spanning forest of its links, not the links, so a dense group costs rows in proportion to its members.

``near_texts`` is the pipeline's: the links of the tree, as above, and those of a wider search beside it, for documents whose sets of
five-word shingles have a Jaccard similarity of 0.8. Such fingerprints differ in some 10 of 64 bits (16 at times), and balls of that radius reach nearly every leaf of any vantage-point tree
over random bits, so a tree of that radius would compare everything with everything. In the wider search a document's candidates are those that share one of
its least shingles, a fifth of them (the prefix bound: sets of that similarity must), in an order that puts common shingles last.
Candidates are compared by SimHash alone, the fingerprint and 256 bits more, against the angle that the similarity means for sets of
their sizes; so the similarity is an estimate with a standard error of about 0.03. Groups are searched in tiles, as leaves are.

Defined cases: null and wordless text has fingerprint zero and links like any other; null ids get the smallest id
reachable but never serve as one, and a class of null ids only links to nothing; rows that share an id are separate rows; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import components, discard, free_prefix, table, written

WIDTH = 3
RADIUS = 2
SEED = 42
LEAF = 2048
TILE = 4096
MOST_LEVELS = 14
SAMPLE = 1 << 16
MOST_SENT = 1_000_000  # ids that are broadcast, 8 MB

NEAR_WIDTH, SIMILARITY = 5, 0.8
NEAR_WORDS = 5  # fingerprints of 64 bits
SLACK = 6.4  # bits: the standard error of a difference of 49 in 320
SAMPLE_DOCS, COMMON, MOST_COMMON = 5_000, 4, 1_000_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles of ``width`` lower-cased (A-Z) words, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.fromiter((digest(b" ".join(x), SEED) for x in zip(*[words[i:] for i in range(width)], strict=False)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32768):
        counts += np.unpackbits(hashes[at : at + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of the shingles of a text; zero without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """Complete binary tree in heap order: vantage points and median distances of the inner nodes."""

    def __init__(self, sample: np.ndarray, levels: int, radius: int = RADIUS, seed: int = 1):
        draw = np.random.default_rng(seed)
        inner = (1 << levels) - 1
        self.levels, self.radius = levels, radius
        self.points, self.medians = np.zeros(inner, np.uint64), np.zeros(inner, np.int16)
        parts = {0: sample}
        for node in range(inner):
            own = parts.pop(node)
            choices = draw.choice(own, min(8, len(own)), replace=False) if len(own) else draw.integers(0, 2**63, 1, np.uint64)
            best = None
            for point in choices:
                d = np.bitwise_count(own ^ point)
                m = int(np.median(d)) if len(d) else 32
                m = min((m - 1, m), key=lambda x: abs(np.count_nonzero(d <= x) * 2 - len(d)))
                # what reaches both sides, and how uneven the sides are
                cost = np.count_nonzero(np.abs(d.astype(np.int16) * 2 - 2 * m - 1) < 2 * radius) + abs(np.count_nonzero(d <= m) * 2 - len(d))
                if best is None or cost < best[0]:
                    best = cost, point, m, d
            _, self.points[node], self.medians[node], d = best
            if 2 * node + 2 < inner:
                parts[2 * node + 1], parts[2 * node + 2] = own[d <= best[2]], own[d > best[2]]

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each leaf that a value's ball reaches: its index in ``values``, the leaf, whether it is the home leaf."""
        at, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.levels):
            d, m = np.bitwise_count(values[at] ^ self.points[node]).astype(np.int16), self.medians[node]
            near, far = d - self.radius <= m, d + self.radius > m
            at, node, home = (
                np.concatenate([at[near], at[far]]),
                np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]),
                np.concatenate([home[near] & (d <= m)[near], home[far] & (d > m)[far]]),
            )
        return at, node - ((1 << self.levels) - 1), home


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, smallest member) that connect what the edges a-b over 0..n-1 connect."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def tile_links(query_fp: np.ndarray, home_fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest over positions (queries first, then homes) of the pairs query < home at ``radius`` or nearer."""
    q, n = len(query_fp), len(query_fp) + len(home_fp)
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, q, 256):
        near = np.flatnonzero(np.bitwise_count(query_fp[at : at + 256, None] ^ home_fp[None, :]) <= radius)
        x, y = near // max(1, len(home_fp)) + at, near % max(1, len(home_fp))
        differ = query_fp[x] != home_fp[y]
        a, b = np.concatenate([a, x[differ]]), np.concatenate([b, y[differ] + q])
        if len(a) > 1 << 20:
            a, b = forest(a, b, n)
    return forest(a, b, n)


def class_links(classes: DataFrame, radius: int = RADIUS, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between the ids of ``classes(fp, rep)`` that span all links of at most ``radius`` differing bits."""
    n = classes.count()
    levels = max(0, min(MOST_LEVELS, math.ceil(math.log2(max(1, n) / leaf))))
    sample = classes.where(F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(max(1, n // SAMPLE))) == 0).select("fp").limit(2 * SAMPLE).toPandas()
    tree = VantageTree(np.sort(sample["fp"].to_numpy("<i8").view("<u8")), levels, radius)

    def routed(batches):
        for batch in batches:
            for part in [batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)]:
                fp, rep = part.column(0).to_numpy(), part.column(1).to_numpy()
                at, where, home = tree.route(fp.view("<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(fp[at]), pa.array(rep[at]), pa.array(home)], ["leaf", "fp", "rep", "home"])

    rows = written(classes.where("rep is not null").select("fp", "rep").mapInArrow(routed, "leaf long, fp long, rep long, home boolean"), "vp-routed")
    # one row a leaf, 2 ** MOST_LEVELS at most
    counts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / tile).cast("int").alias("nq"), F.greatest(F.lit(1), F.ceil(F.count_if("home") / tile)).cast("int").alias("nh"))
    dealt = rows.join(F.broadcast(counts), "leaf").withColumn("k", F.xxhash64("fp", F.lit(11)))
    as_query = dealt.select("leaf", F.pmod("k", "nq").cast("int").alias("qc"), F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("hc"), "fp", "rep", F.lit(False).alias("home"))
    as_home = dealt.where("home").select("leaf", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qc"), F.pmod("k", "nh").cast("int").alias("hc"), "fp", "rep", F.lit(True).alias("home"))

    def linked(rows: pa.Table) -> pa.Table:
        fp, rep, home = (rows.column(c).to_numpy() for c in ("fp", "rep", "home"))
        order = np.argsort(home, kind="stable")
        fp, rep, q = fp[order].view("<u8"), rep[order], int(np.count_nonzero(~home))
        i, j = tile_links(fp[:q], fp[q:], radius)
        return pa.table({"a": rep[i], "b": rep[j]})

    return as_query.union(as_home).groupBy("leaf", "qc", "hc").applyInArrow(linked, "a long, b long").where("a <> b").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row a document."""
    rows = written(fingerprints(docs, id_col, text_col, width), "simhash", True)
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes", True)
    found = components(class_links(classes, radius)).withColumnRenamed("node", "rep")
    homes = written(classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-homes", True)
    discard(classes)
    return rows.join(homes, "fp").select("doc_id", "fp", "component_id")


def _without(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` but those of ``groups(doc_id, component_id)`` whose component has a smaller id; rows with a null id stay."""
    key = free_prefix(docs, "_s_") + "gone"
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "simhash-gone", True)
    # few ids are broadcast, so that texts stay where they are; else hashing the narrow side spares sorting the texts
    few = gone.limit(MOST_SENT + 1).count() <= MOST_SENT
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(key), "left_anti")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id; rows with a null id stay."""
    return _without(docs, near_groups(docs, id_col, text_col, width, radius), id_col)


def _remixed(x: np.ndarray, turn: int) -> np.ndarray:
    x = (x ^ np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def signature(text: str | None, common: np.ndarray, width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> tuple[list[int], int, np.ndarray]:
    """Of the set of shingles ``NEAR_WORDS`` fingerprints by different bits, the size, and the least members, which sets so similar share.

    common: sorted hashes of shingles that come last in the order.
    """
    own = np.unique(shingle_hashes(text, width))
    n = len(own)
    prints = [majority(own if i == 0 else _remixed(own, i)) for i in range(NEAR_WORDS)]
    if not n:
        return prints, 0, own
    k = n - math.ceil(similarity * n - 1e-9) + 1
    rank = _remixed(own, NEAR_WORDS) >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank |= (common[at] == own).astype(np.uint64) << np.uint64(63)
    return prints, n, own[np.argpartition(rank, k - 1)[:k]] if k < n else own


def most_bits(a, b, similarity: float, acos=np.arccos, sqrt=np.sqrt, least=np.minimum):
    """How many of all bits fingerprints of sets of sizes a and b may differ in at this similarity, and one standard error more."""
    cosine = least(similarity / (1 + similarity) * (a + b) / sqrt(a * 1.0 * b), a * 0.0 + 1.0)
    return 64 * NEAR_WORDS * acos(cosine) / math.pi + SLACK


def text_links(prints: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Forest over the rows of the pairs of ``left`` and ``right`` that are similar; ``prints`` has a row a fingerprint word."""
    n = len(size)
    a_all, b_all = np.empty(0, np.int64), np.empty(0, np.int64)
    most = most_bits(1.0, 1.0, similarity)  # sizes that differ allow less
    step = max(1, (1 << 21) // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        d = np.bitwise_count(prints[0][part][:, None] ^ prints[0][right][None, :]) + np.bitwise_count(prints[1][part][:, None] ^ prints[1][right][None, :])
        i, j = np.nonzero(d <= most)
        a, b = part[i], right[j]
        d = d[i, j].astype(np.int64)
        for word in prints[2:]:
            d += np.bitwise_count(word[a] ^ word[b])
            a, b, d = a[d <= most], b[d <= most], d[d <= most]
        ok = (a != b) & (d <= most_bits(size[a], size[b], similarity)) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
        a_all, b_all = np.concatenate([a_all, a[ok]]), np.concatenate([b_all, b[ok]])
        if len(a_all) > 1 << 20:
            a_all, b_all = forest(a_all, b_all, n)
    return forest(a_all, b_all, n)


def common_shingles(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Shingles that stand in many documents of a hash sample, ``MOST_COMMON`` at most, sorted. They decide the order of candidates
    only, and so how much work the search is, never what it finds."""
    n = docs.count()
    text = F.col(text_col).cast("string")
    some = docs.where(F.pmod(F.xxhash64(text, F.lit(13)), F.lit(1 << 30)) < (1 << 30) * min(1.0, max(SAMPLE_DOCS, n / 1000) / max(1, n))).select(text.alias("text"))

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x.as_py(), width)).view("<i8"))], ["s"])

    top = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(f"n >= {COMMON}").orderBy(F.desc("n"), "s").limit(MOST_COMMON)
    return np.sort(top.select("s").toArrow().column(0).to_numpy().view("<u8"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id), one row a document: components of documents with near fingerprints, found by the vantage-point tree, or
    with similar sets of shingles."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(common_shingles(docs, text_col, width))
    words = [f"f{i}" for i in range(NEAR_WORDS)]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [signature(x, sent.value, width, similarity) for x in texts]
            own = np.fromiter((fingerprint(x) for x in texts), "<u8", len(texts)).view("<i8")
            prints = np.array([p for p, _, _ in found], "<u8").reshape(-1, NEAR_WORDS).view("<i8")
            ends = np.cumsum([0, *(len(x) for _, _, x in found)]).astype(np.int32)
            least = pa.ListArray.from_arrays(ends, np.concatenate([x for _, _, x in found]).view("<i8") if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), *(pa.array(np.ascontiguousarray(c)) for c in prints.T), pa.array([n for _, n, _ in found], pa.int32()), least], ["doc_id", "fp", *words, "size", "least"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(run, f"doc_id long, fp long, {', '.join(w + ' long' for w in words)}, size int, least array<long>"), "near")
    # the tree links classes of equal fingerprints; each is named by its least document
    tree = written(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes", True)
    branches = written(class_links(tree, radius), "tree-links", True)

    # the wider search: equal fingerprints of all words and equal sizes are one class, and any member's shingles do for it
    kinds = rows.groupBy(*words, "size").agg(F.min("doc_id").alias("rep"), F.min("least").alias("least"))
    classes = written(kinds.where("rep is not null"), "near-classes")
    narrow = classes.select("rep", *words, "size")
    entries = classes.select("rep", F.explode("least").alias("s"))
    groups = entries.groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("n > 1")
    # shingles with the same members are one group
    groups = written(groups.groupBy("n", "lo", "hi", "x").agg(F.min("s").alias("s")), "near-groups", True)

    # groups of two: the pair is known, and compared by columns
    side = lambda e: narrow.select(*[F.col(c).alias(f"{e}_{c}") for c in narrow.columns])
    pairs = groups.where("n = 2").join(side("a"), F.col("lo") == F.col("a_rep")).join(side("b"), F.col("hi") == F.col("b_rep"))
    bits = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words])
    a, b = F.col("a_size"), F.col("b_size")
    limit = most_bits(a, b, similarity, F.acos, F.sqrt, F.least)
    two = pairs.where((bits <= limit) & (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9)).select(F.col("lo").alias("a"), F.col("hi").alias("b"))

    # larger ones: tiles of bounded size, small groups many to a task
    more = groups.where("n > 2").select("s", "n")
    total = more.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = entries.join(more, "s").join(narrow, "rep").withColumn("k", F.ceil(F.col("n") / tile).cast("int")).withColumn("c", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("k")).cast("int"))
    dealt = members.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("g", F.when(F.col("k") == 1, F.pmod(F.xxhash64("s"), F.lit(max(1, total // (8 * tile))))).otherwise(F.col("s")))
    dealt = dealt.select("g", (F.col("k") > 1).alias("large"), F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), (F.col("c") > F.col("d")).alias("side"), "s", "rep", *words, "size")

    def linked(part: pa.Table) -> pa.Table:
        part = part.sort_by("s")
        s, rep, size, other = (part.column(c).to_numpy() for c in ("s", "rep", "size", "side"))
        prints = np.stack([part.column(w).to_numpy() for w in words]).view("<u8")
        cuts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
        one = part.column("i")[0].as_py() == part.column("j")[0].as_py()
        out = [(np.empty(0, np.int64),) * 2]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            left, right = (np.arange(y - x),) * 2 if one else (np.flatnonzero(~other[x:y]), np.flatnonzero(other[x:y]))
            i, j = text_links(prints[:, x:y], size[x:y], left, right, similarity)
            out.append((rep[x:y][i], rep[x:y][j]))
        return pa.table({"a": np.concatenate([p for p, _ in out]), "b": np.concatenate([q for _, q in out])})

    many = dealt.groupBy("g", "large", "i", "j").applyInArrow(linked, "a long, b long")
    # a document joins its class of the tree with that of the wider search
    ties = rows.where("doc_id is not null").select("fp", *words, "size").distinct().join(tree.withColumnRenamed("rep", "a"), "fp").join(narrow.withColumnRenamed("rep", "b"), [*words, "size"]).where("a <> b").select("a", "b")
    links = written(two.union(many).union(branches).union(ties).distinct(), "near-links", True)
    found = components(links).withColumnRenamed("node", "rep")
    homes = written(narrow.join(found, "rep", "left").select(*words, "size", F.coalesce("component", "rep").alias("component_id")), "near-homes", True)
    discard(classes, groups, links, tree, branches)
    return rows.join(homes, [*words, "size"], "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of ``near_texts`` the one with the smallest id; rows with a null id stay."""
    return _without(docs, near_texts(docs, id_col, text_col, width, similarity), id_col)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
