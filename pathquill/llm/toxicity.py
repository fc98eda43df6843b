"""Toxic passages by maximum-scoring segments over token log-odds.

Fitting: document counts of hashed tokens in toxic, other and all documents give log-odds under a
Dirichlet prior whose shape is the whole corpus' token distribution. A weight is pulled towards 0
by its standard error; tokens without evidence cost a small drift, so random text scores below zero on average.

Scoring: a linear scan (each positive run is pushed once and merged at most once) yields every
maximal scoring segment. With lambda, the root of E[exp(lambda s)] = 1 over corpus tokens, the best
segment of n tokens follows an extreme-value law with location ln(K n); K comes from the clean
training documents. Segments with expectation below ``significance`` are the toxic passages. Two
aggregates, the calibrated best segment and the sum of significant ones, go through a logistic
curve fitted on the training documents, each read with weights that others gave.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Cache
from .common import crc_mod, map_texts, settle, table

#: Token slots: the model's size, whatever the corpus' vocabulary.
SLOTS = 1 << 18
#: Training rows at most: the labels that are broadcast and the features that the driver fits the curve on.
MAX_LABELS = 200_000
#: Documents' worth of prior for each class.
PRIOR = 200.0
DRIFT = 0.15
#: Parts of the labels; each is read with the weights of the others when the curve is fitted.
FOLDS = 8
SIGNIFICANCE = 1.0
MARKS = ".,;:!?\"'()[]{}<>|*#$%&_-"


def slot(piece: str) -> int:
    return zlib.crc32(piece.lower().strip(MARKS).encode()) % SLOTS


def slots_of() -> Cache:
    return Cache(slot)


@dataclass
class Model:
    weights: np.ndarray  # float32 for each slot
    lam: float
    log_k: float
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0)


def token_weights(pos: np.ndarray, neg: np.ndarray, every: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds with a Dirichlet prior shaped like ``every``, shrunk by one and a half standard errors, less the drift."""
    alpha = prior * (every + 0.01) / (every + 0.01).sum() * max(every.sum() / max(pos.sum() + neg.sum(), 1), 1)
    a0 = alpha.sum()
    p, q = pos + alpha, neg + alpha
    delta = np.log(p / (pos.sum() + a0 - p)) - np.log(q / (neg.sum() + a0 - q))
    error = np.sqrt(1 / p + 1 / q)
    return (np.sign(delta) * np.maximum(np.abs(delta) - 1.5 * error, 0) - DRIFT).astype(np.float32)


def karlin(weights: np.ndarray, every: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; a fallback of 1 where no token scores above 0."""
    p = every / max(every.sum(), 1)
    if not (weights[p > 0] > 0).any() or p @ weights >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while p @ np.exp(high * weights.astype(float)) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * weights.astype(float)) < 1 else (low, mid)
    return max((low + high) / 2, 1e-3)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in text order, in linear time.

    Only runs of positive scores are visited; each is kept with the sums before and after it.
    """
    up = scores > 0
    if not up.any():
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, nearest entry with a smaller left sum
    for s, e, left, right in zip(edge[::2].tolist(), edge[1::2].tolist(), total[edge[::2]].tolist(), total[edge[1::2]].tolist(), strict=True):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((s, e, left, right, j))
                break
            s, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, right - left) for s, e, left, right, _ in stack]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.slots = model, slots_of()

    def levels(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, lambda x - ln n) of every segment of n words, and n."""
        pieces = text.split()
        n = len(pieces)
        if not n:
            return [], 0
        found = segments(self.model.weights[np.fromiter(map(self.slots.__getitem__, pieces), np.int64, n)])
        return [(s, e, self.model.lam * x - math.log(n)) for s, e, x in found], n

    def read(self, text: str) -> tuple[float, float, list[tuple[int, int, float]], int]:
        """(calibrated best segment, calibrated sum of significant ones, those segments, words)."""
        found, n = self.levels(text)
        if not n:
            return 0.0, 0.0, [], 0
        log_k = self.model.log_k
        rated = [(s, e, x - log_k) for s, e, x in found]
        significant = [r for r in rated if r[2] > -math.log(SIGNIFICANCE)]
        return max((r[2] for r in rated), default=-math.log(n) - log_k), sum(r[2] + math.log(SIGNIFICANCE) for r in significant), significant, n

    def features(self, text: str) -> tuple[float, float]:
        best, total, _, n = self.read(text)
        return (max(best, -20.0), math.log1p(total)) if n else (-20.0, 0.0)

    def score(self, text: str) -> float:
        return self.probability(self.features(text))

    def probability(self, x: tuple[float, float]) -> float:
        c, s = self.model.curve, self.model.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * x[0] / s[0] + c[2] * x[1] / s[1]))))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (constant first) by Newton steps with a weak ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T * (p * (1 - p)) @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the rows of ``labels`` (id and 0/1 label), of which at most ``MAX_LABELS``, by hash, are used.

    The prior counts every document, lambda every token. Null labels are left out; an id with several labels takes the
    largest, and repeated rows count each. Null and empty texts hold no token. Without labels of both kinds, or documents,
    every score is the base rate.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).dropna().groupBy("_id").agg((F.max("_label") > 0).cast("int").alias("_label"))
    known = bounded(known).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    # at most MAX_LABELS rows, so that they may be broadcast
    marked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold each slot, by kind (clean and toxic of each fold, all), and tokens of each slot."""
        slots, sums = slots_of(), np.zeros((2 * FOLDS + 2, SLOTS), np.int64)
        for batch in batches:
            for t, y, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                pieces = (t or "").split()
                mine, times = np.unique(np.fromiter(map(slots.__getitem__, pieces), np.int64, len(pieces)), return_counts=True)
                sums[-1][mine] += times
                sums[-2][mine] += 1
                if y is not None:
                    sums[2 * fold + y][mine] += 1
        at = np.flatnonzero(sums[-1])
        for k in range(0, len(at), 10_000):
            part = at[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(s[part]) for s in sums)], names=["slot", *kinds])

    kinds = [*(f"{kind}{fold}" for fold in range(FOLDS) for kind in ("neg", "pos")), "every", "tokens"]
    counts = marked.select("_text", "_label", "_fold").mapInArrow(count, "slot long, " + ", ".join(f"{k} long" for k in kinds)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in kinds))
    dense = dict(zip(kinds, dense_counts(counts, kinds), strict=True))

    def model_of(folds: list[int]) -> Model:
        pos, neg = (sum((dense[f"{kind}{f}"] for f in folds), np.zeros(SLOTS)) for kind in ("pos", "neg"))
        weights = token_weights(pos, neg, dense["every"].astype(float))
        return Model(weights, karlin(weights, dense["tokens"].astype(float)), 0.0)

    # each fold is read with the weights of the others, so that the curve learns from documents its features haven't seen
    model, others = model_of(list(range(FOLDS))), [model_of([f for f in range(FOLDS) if f != fold]) for fold in range(FOLDS)]
    train = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    del dense
    levels = settled_levels(train, others)
    # ln K: the median best segment of clean documents is the law's median
    clean = levels.where("label = 0 and size(levels) > 0").groupBy("fold").agg(F.percentile(F.array_max("levels"), 0.5).alias("median")).collect()  # a row a fold
    log_k = {r.fold: r.median + math.log(math.log(2)) for r in clean}
    model.log_k = sum(log_k.values()) / len(log_k) if log_k else 0.0
    ln_k = F.lit(model.log_k)
    for fold, value in log_k.items():
        ln_k = F.when(F.col("fold") == fold, F.lit(value)).otherwise(ln_k)
    rated = levels.withColumn("log_k", ln_k)
    best = F.when(F.col("words") == 0, F.lit(-20.0)).otherwise(F.greatest(F.coalesce(F.array_max("levels"), -F.log("words")) - F.col("log_k"), F.lit(-20.0)))
    total = F.aggregate("levels", F.lit(0.0), lambda s, x: s + F.greatest(x - F.col("log_k") + math.log(SIGNIFICANCE), F.lit(0.0)))
    got = rated.select("label", best.alias("best"), F.log1p(total).alias("total")).toArrow()  # MAX_LABELS rows at most
    x = np.column_stack([got.column("best").to_numpy(), got.column("total").to_numpy()]) if got.num_rows else np.zeros((0, 2))
    y = got.column("label").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.001
        model.curve = (math.log(rate / (1 - rate)), 0.0, 0.0)
        return model
    model.scale = tuple(np.maximum(x.std(0), 1e-6))
    model.curve = tuple(logistic(x / np.array(model.scale), y))
    return model


def dense_counts(counts: DataFrame, kinds: list[str], slots: int = SLOTS) -> list[np.ndarray]:
    """A column of ``slots`` counts for each of ``kinds``, from a table with a row a ``slot``, in as few bytes as they fit.

    Most counts are 0 or small, so each task sends its rows compressed, and the driver unpacks one task's rows at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            if batch.num_rows:
                columns = [x.to_numpy().astype("<i8") for x in batch.columns]
                # the low bytes of all counts first, then the next ones: the high ones are zeros
                planes = np.ascontiguousarray(np.concatenate(columns).view(np.uint8).reshape(-1, 8).T)
                yield pa.RecordBatch.from_arrays([pa.array([squeeze(planes.tobytes())], pa.binary())], names=["packed"])

    out = [np.zeros(slots, np.uint16) for _ in kinds]
    unpack = zstandard.ZstdDecompressor().decompress
    rows = counts.select("slot", *kinds).mapInArrow(pack, "packed binary").toArrow().column("packed")
    for x in rows:
        planes = np.frombuffer(unpack(x.as_py()), np.uint8).reshape(8, -1)
        at, *columns = np.ascontiguousarray(planes.T).view("<i8").reshape(1 + len(kinds), -1)
        for k, column in enumerate(columns):
            if column.max() > np.iinfo(out[k].dtype).max:
                out[k] = out[k].astype(np.uint32 if column.max() < 1 << 32 else np.int64)
            out[k][at] = column
    return out


def bounded(known: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of their ids: a threshold, so that no task gathers them.

    The threshold aims at 2 % less, some nine deviations below ``most`` at its default.
    """
    n = known.count()
    if n <= most:
        return known
    return known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(0.98 * most / n * (1 << 40)))


def settled_levels(train: DataFrame, models: list[Model]) -> DataFrame:
    """``label, fold, words, levels`` of each training document, written down: lambda x - ln n of its segments under its fold's model."""
    shared = train.sparkSession.sparkContext.broadcast(models)

    def make():
        scorers = [Scorer(m) for m in shared.value]

        def run(texts: list[str], y: list[int], folds: list[int]):
            read = [scorers[f].levels(t) for t, f in zip(texts, folds, strict=True)]
            return y, folds, [n for _, n in read], pa.array([[x for _, _, x in found] for found, _ in read], pa.list_(pa.float64()))

        return run

    levels = settle(map_texts(train, "_id", "_text", "label int, fold int, words long, levels array<double>", make, ["_label", "_fold"]))
    shared.destroy()  # the rows are written down; nothing reads the models again
    return levels


def toxic_passages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, passages`` for every row of ``docs``.

    ``passages`` are the significant segments as (start, end) word positions and their calibrated
    score. Null and empty texts have no passages and a low score; rows repeat as they come.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("level", pa.float64())]))

    def make():
        scorer = Scorer(shared.value)

        def run(texts: list[str]):
            score, passages = [], []
            for t in texts:
                best, total, found, n = scorer.read(t)
                score.append(scorer.probability((max(best, -20.0), math.log1p(total)) if n else (-20.0, 0.0)))
                passages.append([{"start": s, "end": e, "level": x} for s, e, x in found])
            return score, [int(s >= threshold) for s in score], pa.array(passages, kind)

        return run

    return map_texts(docs, doc_id, text, "score double, predicted int, passages array<struct<start:bigint,end:bigint,level:double>>", make)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below ``threshold``; null and empty texts have the lowest score there is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, 4) == 2


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from labels of which none is held out; a null id is not held out. Cases as in :func:`toxic_passages`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxic_passages(docs, fit(docs, training_labels(spark, sf_dir)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
