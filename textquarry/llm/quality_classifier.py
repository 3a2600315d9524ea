"""Quality classifier by positive-unlabelled learning.

Positives are documents that labels mark as good; the unlabelled side is a sample of all training documents.
The class prior is the share of good ones among labelled training rows.  A logistic model on the shape of
texts minimises the non-negative unbiased risk: the loss of positives times the prior, plus the loss of
unlabelled as negatives less what positives contribute to it; where that difference would fall below zero,
the step goes against it instead.

Samples are drawn by hashes and bounded by max_positive and max_unlabelled.  Whole texts are read throughout; memory goes
by the longest of them.

Edge cases: null text is empty and gets a score too.  Labels that are null, or whose document is absent, are
left out.  Without positives or unlabelled rows every score is the prior.  Repeated rows count each.  How the tables lie
on disk has no part in the model: samples are ordered by hashes and shapes.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, crc_mod, hashes, short_batches, spans, unit_hash, windows, words

SHAPES = 256
MEASURES = 16
#: Classes of bytes: 1 lower-case letters and all beyond ASCII, 2 capitals, 3 digits, 4 line feeds, 5 blanks, 6 and above each other byte.
_CLASS = np.arange(6, 262, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[10] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_FEED = np.arange(256) == 10


def distinct(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n rows has, told apart by 44 of their bits; batches are shorter than 2**20 rows."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) + (values >> np.uint64(20)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def shapes(text: pa.Array) -> np.ndarray:
    """Of each text its measures and the shares of its hashed trigrams of runs of byte classes; null is empty."""
    data_all, at_all = buffers(text)
    out = np.zeros((len(text), MEASURES + SHAPES), dtype=np.float32)
    for lo, hi in chunks(at_all):
        data, at, n = data_all[at_all[lo] : at_all[hi]], at_all[lo : hi + 1] - at_all[lo], hi - lo
        c, row = _CLASS[data], np.repeat(np.arange(n), np.diff(at))
        of_class = np.bincount(row * 7 + np.minimum(c, np.uint64(6)).astype(np.int64), minlength=n * 7).reshape(n, 7)
        starts, ends, first = words(data, at)
        n_words, word_row = np.diff(first), np.repeat(np.arange(n), np.diff(first))
        h = hashes(data, starts, ends)
        three, three_row = windows(h, first, 3)
        begin, end, line_first = spans(data, at, _FEED)
        full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        line_row = np.repeat(np.arange(n), np.diff(line_first))[full]
        n_lines = np.bincount(line_row, minlength=n)
        letters = np.concatenate([[0], np.cumsum((c == 1) | (c == 2))])
        size, w, some_lines = np.maximum(1, np.diff(at)), np.maximum(1, n_words), np.maximum(1, n_lines)
        out[lo:hi, :MEASURES] = np.stack([
            np.log1p(n_words), np.log1p(np.diff(at)) / 4, np.diff(at) / w / 10, distinct(h, word_row, n) / w,
            distinct(three, three_row, n) / np.maximum(1, n_words - 2), distinct(hashes(data, begin, end)[full], line_row, n) / some_lines, n_words / some_lines / 50,
            *(of_class[:, k] / size for k in range(1, 7)),
            np.bincount(word_row[c[starts] == 2], minlength=n) / w, np.bincount(word_row[letters[ends] == letters[starts]], minlength=n) / w, np.ones(n),
        ], axis=1)
        # Runs of one class count as one character.
        edge = np.ones(len(c), dtype=bool)
        edge[1:] = (c[1:] != c[:-1]) | (row[1:] != row[:-1])
        run, of = c[edge], row[edge]
        same = np.flatnonzero(of[:-2] == of[2:]) if len(of) > 2 else np.zeros(0, np.int64)
        t = (run[same] * np.uint64(0x9E3779B97F4A7C15) + run[same + 1] * np.uint64(0xBF58476D1CE4E5B9) + run[same + 2] * np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
        count = np.bincount(of[same] * SHAPES + (t >> np.uint64(56)).astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
        out[lo:hi, MEASURES:] = np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True)))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 1e-3, batch: int = 512) -> Model:
    width = MEASURES + SHAPES
    flat = Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    if not len(positive) or not len(unlabelled):
        return flat
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    draw = np.random.default_rng(3)
    w, b = np.zeros(width), flat.bias
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        xp, xu = p[draw.integers(len(p), size=batch)], u[draw.integers(len(u), size=batch)]
        gp, gu = xp @ w + b, xu @ w + b
        # Logistic losses: log(1 + e^-g) as a positive, log(1 + e^g) as a negative.
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_pos = prior * (sig(gp) - 1) / batch
        d_neg_p, d_neg_u = -prior * sig(gp) / batch, sig(gu) / batch
        if negative_risk >= 0:
            grad_w, grad_b = xp.T @ (d_pos + d_neg_p) + xu.T @ d_neg_u, (d_pos + d_neg_p).sum() + d_neg_u.sum()
        else:
            grad_w, grad_b = -(xp.T @ d_neg_p + xu.T @ d_neg_u), -(d_neg_p.sum() + d_neg_u.sum())
        g = np.append(grad_w + decay * w, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, float(b), prior)


def shapes_of(texts: DataFrame, limit: int) -> np.ndarray:
    """The shapes of texts (at, text), at most limit of them, in an order that depends on the rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shapes(batch.column(1))], pa.binary())], ["at", "shape"])

    rows = texts.select("at", "text").mapInArrow(run, "at double, shape binary").orderBy("at", "shape").limit(limit)
    with short_batches(texts.sparkSession):
        rows = rows.toArrow()
    return np.frombuffer(b"".join(x.as_buffer() for x in rows["shape"]), dtype=np.float32).reshape(-1, MEASURES + SHAPES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", max_positive: int = 3000, max_unlabelled: int = 4000) -> Model:
    """Fit on all rows given, of which the samples are drawn; the caller keeps held-out rows away."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(quality_col).cast("int").alias("y"))
    good, total = known.agg(F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = docs.count()
    prior = min(max((good + 1) / (total + 2), 0.02), 0.98)
    few = known.where((F.col("y") == 1) & (unit_hash("label_id", seed=11) < min(1.0, max_positive / max(1, good)))).select("label_id").distinct()
    few = few.withColumn("at", unit_hash("label_id", seed=11)).orderBy("at", "label_id").limit(2 * max_positive)
    both = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    positive = both.join(F.broadcast(few), "label_id")  # at most 2 * max_positive ids
    unlabelled = both.withColumn("at", unit_hash(F.col("label_id").cast("string"), "text", seed=13)).where(F.col("at") < min(1.0, max_unlabelled / max(1, n_docs)))
    return fit(shapes_of(positive, 2 * max_positive), shapes_of(unlabelled, 2 * max_unlabelled), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vars(model))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**sent.value)
        for texts in batches:
            x = shapes(texts)
            x = model.mean + np.clip((x - model.mean) / model.scale, -8, 8) * model.scale
            yield pa.array(model.scores(x))

    out = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))


def split(df: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """Rows that may train: those whose crc32 of the id, modulo folds, isn't 0."""
    return df.where(crc_mod(id_col, folds) != 0)
