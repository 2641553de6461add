"""Quality classifier by co-training of two views.

View one is the text itself (shares of letters, capitals, digits, marks; lengths of words and lines; repeats); view two is the page's
metadata (source, language, declared size). Each view has a logistic classifier. In each round a classifier labels the
unlabelled documents it is surest of, in the proportions of the classes, and hands them to the other view's training set. Afterwards
each view's margin is calibrated on labelled documents kept out of training (Platt scaling), and the two are combined
by adding their evidence, that is calibrated log-odds less those of the prior.

The labelled part of the fit is a bounded sample: at most about ``MOST_LABELLED`` labelled documents, picked by a hash of the id. The
unlabelled pool is every other document. A round goes over all of it: executors score its two views with the classifiers so far and
keep a histogram of what each view is how sure of, which sets the cuts for the surest share; the documents beyond the cuts then
teach the other view through sums over all of them, the gradient and curvature of its next Newton steps, so no pool reaches the
driver and none is capped. Then every document is scored in one Arrow pass over whole texts, without a shuffle; ``keep_good``
filters in that pass.

Defined cases: null text counts as empty; null metadata is a value of its own; labels that are null or whose document is
missing are ignored, of several labels of a document the lowest counts; a document with a null id is scored but takes no part in the fit; without
labels of both classes every score is 0.5 and everything is accepted; rows that share an id are separate rows; an
empty table gives an empty result; other columns, of any name and type, are carried along untouched by ``keep_good``.
"""

from __future__ import annotations

import copy
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from specweave.llm.common import columns_of, discard, free_prefix, table, written

MOST_LABELLED = 20_000
ROUNDS = 4
GROWTH = 0.1  # of the pool, each round and view; with ties at the cut, a little more
THRESHOLD = 0.5
META_SLOTS = 64

TEXT_FEATURES, META_FEATURES = 16, 4


@functools.cache
def _kinds() -> np.ndarray:
    """Code point classes: 0 other mark, 1 lower letter, 2 upper letter, 3 digit, 4 space, 5 line end, 6 plain punctuation."""
    out = np.zeros(0x110000, np.uint8)
    for i in [*range(0xD800), *range(0xE000, 0x40000)]:
        c = chr(i)
        if c.isalpha():
            out[i] = 2 if c.isupper() else 1
        elif c.isdigit():
            out[i] = 3
        elif c.isspace():
            out[i] = 4
    out[10] = 5
    for c in ".,;:'\"?-":
        out[ord(c)] = 6
    return out


def text_features(text: str | None) -> np.ndarray:
    text = text or ""
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    n = np.bincount(kind, minlength=7)
    all_, words = max(1, len(kind)), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    solid = max(1, all_ - n[4] - n[5])
    letters = max(1, n[1] + n[2])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    starts = np.count_nonzero((kind[1:] == 0) & (kind[:-1] != 0)) + (len(kind) > 0 and kind[0] == 0)
    ends_well = sum(x.rstrip()[-1] in ".?!:;\"'" for x in lines)
    return np.array([
        n[2] / letters, n[3] / solid, n[0] / solid, n[6] / solid, letters / solid, starts / max(1, len(words)),
        lengths.mean(), lengths.std(), np.log1p(len(words)), np.log1p(len(lines)), len(words) / max(1, len(lines)) / 50.0,
        len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), ends_well / max(1, len(lines)),
        np.count_nonzero(lengths == 1) / max(1, len(words)), np.log1p(lengths.max()),
    ], np.float32)


def meta_features(source: str | None, lang: str | None, size: int | None) -> list[float]:
    """Slots of source and language, the logarithm of the size, and whether it is missing; ``_spread`` makes the view of it."""
    slots = [zlib.crc32(f"{name}:{value}".encode()) % META_SLOTS for name, value in (("s", source), ("l", lang))]
    return [*slots, np.log1p(max(0, size or 0)), size is None]


def _spread(meta: np.ndarray) -> np.ndarray:
    out = np.zeros((len(meta), META_SLOTS + 2), np.float32)
    for column in (0, 1):
        out[np.arange(len(meta)), meta[:, column].astype(int)] = 1
    out[:, -2:] = meta[:, 2:]
    return out


COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def _raw_views(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Features of both views of a batch whose last four columns are COLUMNS 1 to 4."""
    text, source, lang, size = batch.columns[-4:]
    rows = [text_features(x.as_py()) for x in text], [meta_features(*x) for x in zip(source.to_pylist(), lang.to_pylist(), size.to_pylist(), strict=True)]
    return [np.array(r, np.float32).reshape(-1, w) for r, w in zip(rows, (TEXT_FEATURES, META_FEATURES), strict=True)]


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    text, meta = _raw_views(batch)
    return [text, _spread(meta)]


def _inputs(docs: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    kinds, p = ("string", "string", "string", "long"), free_prefix(docs, "_q_")
    return [F.col(c).cast(k).alias(f"{p}{i + 1}") for i, (c, k) in enumerate(zip(columns[1:], kinds, strict=True))]


def features(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(id, text_view, meta_view) with the features as arrays of floats."""

    def run(batches):
        for batch in batches:
            lists = [pa.ListArray.from_arrays(np.arange(0, batch.num_rows + 1, dtype=np.int32) * v.shape[1], v.ravel()) for v in _raw_views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", "text_view", "meta_view"])

    rows = docs.select(F.col(columns[0]).alias("id"), *_inputs(docs, columns))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text_view array<float>, meta_view array<float>")


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features, with their squares if asked for."""

    def __init__(self, x: np.ndarray, squares: bool, ridge: float = 1.0):
        self.squares, self.mean, self.scale = squares, x.mean(0), x.std(0) + 1e-6
        self.width = x.shape[1] * (1 + squares) + 1
        self.w, self.penalty = np.zeros(self.width), np.full(self.width, ridge)
        self.penalty[-1] = 1e-6

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z * z, np.ones((len(z), 1))] if self.squares else [z, np.ones((len(z), 1))], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._wide(x.astype(float)) @ self.w

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Curvature (width x width) and gradient of the log likelihood, as one array; sums over the rows.

        Curvature is kept above a floor: steps are then short enough without a search along them, which would take more passes.
        """
        a = self._wide(x.astype(float))
        p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
        return np.concatenate([((a * np.maximum(p * (1 - p), FLOOR)[:, None]).T @ a).ravel(), a.T @ (y - p)])

    def step(self, sums: np.ndarray) -> float:
        h, g = sums[: -self.width].reshape(self.width, -1), sums[-self.width :]
        move = np.linalg.solve(h + np.diag(self.penalty), g - self.penalty * self.w)
        self.w = self.w + np.clip(move, -5, 5)
        return float(np.abs(move).max())


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of calibrated log-odds, with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.stack([margin, np.ones_like(margin)], 1)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - goal * z).sum())

    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag([1e-3, 1e-6]), a.T @ (goal - p))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-7:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    # a view that ranks the wrong way round knows nothing: it gets the prior
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((pos + 1) / (neg + 1))))


#: Margins of the surest documents are counted in bins from that of a probability of 0.95 on: a view that is sure of nothing teaches nothing.
SURE, BIN, BINS = float(np.log(19)), 0.05, 512
PSEUDO_WEIGHT, LAST_STEPS, FLOOR = 0.3, 2, 0.05


def _taught(views: list[np.ndarray], lessons: list) -> list[np.ndarray]:
    """The labels that each view has been given by the other in the lessons so far: 1, 0 or -1 for none; the first one stays."""
    given = [np.full(len(views[0]), -1) for _ in views]
    for teachers, cuts in lessons:
        for i, (model, (low, high)) in enumerate(zip(teachers, cuts, strict=True)):
            m, free = model.margin(views[i]), given[1 - i] < 0
            given[1 - i][free & (m >= high)] = 1
            given[1 - i][free & (m <= low)] = 0
    return given


def _sureness(models: list[Logistic], given: list[np.ndarray], views: list[np.ndarray]) -> np.ndarray:
    """Number of rows, then for each view, label 1 and 0, how many rows that the other view has no label for are in each bin."""
    out = [np.array([len(views[0])])]
    for i, model in enumerate(models):
        m = model.margin(views[i])[given[1 - i] < 0]
        for side in (m, -m):
            out.append(np.bincount(np.minimum((side[side >= SURE] - SURE) / BIN, BINS - 1).astype(int), minlength=BINS))
    return np.concatenate(out).astype(float)


def _pass(models: list[Logistic], lessons: list, views: list[np.ndarray]) -> np.ndarray:
    """``_sureness``, then the sums of what the views were taught, and how many rows that are."""
    given = _taught(views, lessons)
    sums = [m.sums(v[g >= 0], g[g >= 0]) for m, v, g in zip(models, views, given, strict=True)]
    return np.concatenate([_sureness(models, given, views), *sums, [np.count_nonzero(g >= 0) for g in given]])


class LocalPool:
    """Unlabelled documents in memory."""

    def __init__(self, views: list[np.ndarray]):
        self.views = views

    def total(self, work) -> np.ndarray:
        return work(self.views)


class SparkPool:
    """Unlabelled documents as a table of features, of which every pass sums something over all rows.

    Sums are added up as whole numbers of 2 ** -16, so that they do not depend on the order in which tasks end.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def total(self, work) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                own = work(_stacked(batch))
                total = own if total is None else total + own
            if total is not None:
                at = np.append(np.flatnonzero(total[:-1]), len(total) - 1)  # the last one tells the length
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.rint(total[at] * 65536).astype(np.int64))], ["at", "n"])

        got = self.rows.select("text_view", "meta_view").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        if not got.num_rows:
            return work([np.empty((0, TEXT_FEATURES), np.float32), np.empty((0, META_SLOTS + 2), np.float32)])
        at = got.column("at").to_numpy()
        out = np.zeros(at.max() + 1)
        out[at] = got.column("n").to_numpy() / 65536
        return out


class CoTrained:
    """Two views that teach each other. Labels: 1 good, 0 bad, -1 unknown; unknown rows join the pool if none is given."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, growth: float = GROWTH, seed: int = 3, pool=None):
        draw = np.random.default_rng(seed)
        known = np.flatnonzero(y >= 0)
        self.ready = len(np.unique(y[known])) == 2
        if not self.ready:
            return
        held = known[draw.random(len(known)) < 0.25]
        if len(np.unique(y[held])) < 2 or len(np.unique(y[np.setdiff1d(known, held)])) < 2:
            held = known  # too few to keep any out
        train = known if len(held) == len(known) else np.setdiff1d(known, held)
        self.models = [Logistic(x[train].astype(float), squares=i == 0) for i, x in enumerate(views)]
        for model, x in zip(self.models, views, strict=True):
            for _ in range(100):
                if model.step(model.sums(x[train], y[train])) < 1e-6:
                    break
        self.taught = [0] * len(views)
        self._learn(pool or LocalPool([x[y < 0] for x in views]), [x[train] for x in views], y[train], rounds, growth)
        truth = y[held].astype(float)
        self.prior = float(np.log((truth.sum() + 1) / (len(truth) - truth.sum() + 1)))
        self.scales = [_platt(m.margin(x[held]), truth) for m, x in zip(self.models, views, strict=True)]

    def _learn(self, pool, views: list[np.ndarray], y: np.ndarray, rounds: int, growth: float) -> None:
        """A pass over the pool a round: it sums up what both views were taught so far, for a Newton step of each, and what they are
        now surest of, a share of the pool, which is the next lesson. Some more steps follow the last lesson."""
        lessons: list = []
        base = float(y.mean())
        for turn in range(rounds + LAST_STEPS):
            found = pool.total(functools.partial(_pass, self.models, lessons))
            n, bins, sums = found[0], found[1 : 1 + len(views) * 2 * BINS].reshape(len(views), 2, BINS), found[1 + len(views) * 2 * BINS :]
            teachers = copy.deepcopy(self.models)
            if lessons:
                at = 0
                for model, x in zip(self.models, views, strict=True):
                    size = model.width * (model.width + 1)
                    model.step(model.sums(x, y) + PSEUDO_WEIGHT * sums[at : at + size])
                    at += size
                self.taught = [int(x) for x in sums[-len(views) :]]
            if turn < rounds and bins.any():
                cuts = []
                for own in bins:
                    ends = []
                    for side, share in zip(own, (base, 1 - base), strict=True):
                        enough = np.flatnonzero(np.cumsum(side[::-1]) >= n * growth * share)  # from the surest bin on
                        ends.append(SURE + BIN * (BINS - 1 - enough[0] if len(enough) else 0))
                    cuts.append((-ends[1], ends[0]))
                lessons.append((teachers, cuts))
            if not lessons:
                break

    def scores(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated probability of each view, then the combined one."""
        if not self.ready:
            return [np.full(len(views[0]), 0.5)] * 3
        odds = [a * m.margin(x) + b for m, x, (a, b) in zip(self.models, views, self.scales, strict=True)]
        odds.append(sum(odds) - (len(odds) - 1) * self.prior)
        return [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds]


def _stacked(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """Both views of rows of ``features``."""
    out = []
    for name, width in (("text_view", TEXT_FEATURES), ("meta_view", META_FEATURES)):
        column = rows.column(name)
        out.append((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    return [out[0], _spread(out[1])]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labelled: int = MOST_LABELLED, columns: tuple[str, ...] = COLUMNS) -> tuple[CoTrained, DataFrame]:
    """The classifier from ``docs`` and ``labels(doc_id, quality)``, and the table of features of all documents.

    Only ids and labels are joined at full size. The sample of labelled ids, about ``most_labelled``, is broadcast.
    """
    labels = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    labels = written(docs.select(F.col(columns[0]).alias("id")).where("id is not null").distinct().join(labels, "id"), "quality-labels", True)
    rate = 1_000_000 * min(1.0, most_labelled / max(1, labels.count()))
    sample = labels.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_000)) < rate)
    rows = written(features(docs, columns).join(F.broadcast(sample), "id", "left"), "quality-features", True)
    own = rows.where("y is not null").groupBy("id", "y").agg(F.min(F.struct("text_view", "meta_view")).alias("v"))  # of rows that share an id one
    table = own.select("id", "y", "v.*").toArrow().sort_by("id")
    model = CoTrained(_stacked(table), table.column("y").to_numpy(), pool=SparkPool(rows.where("y is null and id is not null")))
    discard(labels)
    return model, rows


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(doc_id, p_text, p_meta, score, accepted), one row a document."""
    model, rows = fit(docs, labels, columns=columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p_text, p_meta, both = sent.value.scores(_stacked(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p_text), pa.array(p_meta), pa.array(both), pa.array(both >= threshold)], ["doc_id", "p_text", "p_meta", "score", "accepted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['id']}, p_text double, p_meta double, score double, accepted boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns."""
    model, rows = fit(docs, labels, columns=columns)
    discard(rows)
    sent, n = docs.sparkSession.sparkContext.broadcast(model), len(docs.columns)

    def run(batches):
        for batch in batches:
            good = sent.value.scores(_views(batch))[2] >= threshold
            yield batch.select(range(n)).filter(pa.array(good))

    # mapInArrow takes no names with dots, so columns go by their places
    places = [f"c{i}" for i in range(n)]
    schema = StructType([StructField(p, f.dataType, f.nullable) for p, f in zip(places, docs.schema.fields, strict=True)])
    rows = docs.select(*[c.alias(p) for c, p in zip(columns_of(docs), places, strict=True)], *_inputs(docs, columns))
    return rows.mapInArrow(run, schema).toDF(*docs.columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
