"""Language identification as a mixture of languages.

Each language has smoothed probabilities of hashed character trigrams, counted on labelled documents: all of them, or, above
``MOST_ROWS``, a hash sample of that size on average (a documented bound of the fit), in which a language has up to an equal
share, and all of its documents if they are fewer. A document is taken as draws from a mixture of
languages: expectation-maximisation estimates the proportions over its whole text; then the languages are added in the
order of their proportions while the likelihood, less a penalty of ``PENALTY * ln(n)`` a language, rises. The language
with the largest proportion within the chosen set is predicted; the score is its proportion in the full mixture.

Training and prediction run in Arrow batches; a task of training sends one vector of counts a language.

Defined cases: null text and text without a letter is ``und`` with score 0; ties go to the first language by code point; without
any labelled document everything is ``und``; labels of training rows that are null are ignored; rows that share an id
are separate rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import table

BITS = 16
MOST_ROWS = 20_000
ROUNDS = 12
PENALTY = 3.0
SMOOTH = 0.5


@functools.cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, and whether it is a letter."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for i in [*range(0xD800), *range(0xE000, 0x40000)]:
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return lower, letter


def trigrams(text: str | None) -> np.ndarray:
    """Hashes of the trigrams of lower-cased letters, other characters as single spaces; empty without a letter."""
    lower, letter = _folding()
    a = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letter[a]
    if not is_letter.any():
        return np.empty(0, np.int64)
    a = np.where(is_letter, lower[a], np.uint32(32))
    a = a[is_letter | np.concatenate([[True], is_letter[:-1]])]
    a = np.concatenate([[32], a, [32]]).astype(np.uint64)
    h = a[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ a[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def mixture(p: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` (likelihoods of each n-gram) by expectation-maximisation, and the log likelihood."""
    share, total = np.full(p.shape[1], 1 / p.shape[1]), weight.sum()
    for _ in range(rounds if p.shape[1] > 1 else 0):
        share = share * ((weight / (p @ share)) @ p) / total
    return share, float(weight @ np.log(p @ share))


def predict(text: str | None, probabilities: np.ndarray, penalty: float = PENALTY) -> tuple[int, float, list[int]]:
    """Index of the predicted language (-1: none), score, and the set of languages."""
    grams = trigrams(text)
    if not len(grams) or not probabilities.shape[1]:
        return -1, 0.0, []
    weight = np.ones(len(grams))
    if len(grams) > 1 << 13:
        counts = np.bincount(grams, minlength=1 << BITS)
        grams = np.flatnonzero(counts)
        weight = counts[grams].astype(float)
    p = probabilities[grams]
    share, _ = mixture(p, weight)
    order = np.argsort(-share, kind="stable")
    cost = penalty * np.log(weight.sum() + 1)
    chosen, own = [int(order[0])], np.ones(1)
    best = float(weight @ np.log(p[:, order[0]])) - cost
    for k in range(2, len(order) + 1):
        trial, value = mixture(p[:, order[:k]], weight)
        if value - k * cost <= best:
            break
        best, chosen, own = value - k * cost, [int(i) for i in order[:k]], trial
    top = max(own)
    winner = min(i for i, s in zip(chosen, own, strict=True) if s == top)
    return winner, float(np.clip(share[winner], 0, 1)), chosen


def sampled(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """About ``most_rows`` of ``rows(id, lang, text)``: languages with fewer than an equal share whole, the others by a hash."""
    sizes = sorted((r["n"], r["lang"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row a language
    if sum(n for n, _ in sizes) <= most_rows:
        return rows
    left, rates = most_rows, []
    for i, (n, lang) in enumerate(sizes):
        quota = left / (len(sizes) - i)
        left -= min(n, quota)
        if n > quota:
            rates += [F.lit(lang), F.lit(quota / n)]
    # id and text pick a row, so reruns agree and copies of a text are drawn one by one
    rate = F.coalesce(F.create_map(*rates)[F.col("lang")], F.lit(1.0))
    return rows.where(F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1_000_000)) < 1_000_000 * rate)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in code point order and probabilities (n-gram hash x language)."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = sampled(rows, most_rows).select("lang", "text")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = trigrams(text.as_py())
                counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                np.add.at(counts[lang], grams, 1)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "gram", "n"])

    # at most languages x 65,536 rows reach the driver
    got = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(got.column("lang").unique().to_pylist())
    counts = np.full((1 << BITS, len(langs)), SMOOTH)
    if len(langs):
        index = pc.index_in(got.column("lang"), pa.array(langs))
        np.add.at(counts, (got.column("gram").to_numpy(), index.to_numpy()), got.column("n").to_numpy())
    return langs, counts / counts.sum(0)


def languages(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(id, lang_pred, score, langs): one row a document; langs is the chosen set, in the order of the proportions."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, probabilities = sent.value
        for batch in batches:
            found = [predict(x.as_py(), probabilities) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([langs[i] if i >= 0 else "und" for i, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([[langs[i] for i in c] for _, _, c in found], pa.list_(pa.string()))],
                ["id", "lang_pred", "score", "langs"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, langs array<string>").withColumnRenamed("id", id_col)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return languages(docs, train(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
