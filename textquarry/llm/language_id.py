"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows.  The model is fitted on a sample of them,
at most about max_sample rows, drawn evenly over the languages by a hash: follow-the-regularised-leader
with an elastic-net penalty, whose soft threshold leaves most weights zero.  A fifth of the sample is held out of
the fit to find the temperature that calibrates its probabilities.  Whole texts are read, in training
and in scoring.

Edge cases: text that is null or has no letters is ``und`` with score 0; so is every text if there is no
training row.  Rows with null language or id don't train.  Of equally probable languages the first by name is told.  Repeated rows train as often as they occur.
A language with one row can be learned.  Extra columns are kept by ``identify``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, short_batches, trimmed, unit_hash, unused

BITS, BLOCK = 15, 1 << 20
UNKNOWN = "und"


def gram_buckets(text: str) -> np.ndarray:
    """The buckets of all character n-grams of 1 to 3."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    h = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    out = [h]
    for n in (1, 2):
        if len(x) > n:
            h = (out[-1][:-1] ^ (out[-1][:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[n:] * np.uint64(0x94D049BB133111EB) + np.uint64(n)
            out.append(h)
    return np.concatenate([(h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS) for h in out]).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of 1 to 3, and how often each occurs.  Long texts are counted in blocks."""
    text = text.lower()
    if len(text) <= 1024:
        return np.unique(gram_buckets(text), return_counts=True)
    count = np.zeros(1 << BITS, dtype=np.int64)
    for lo in range(0, len(text), BLOCK):
        count += np.bincount(gram_buckets(text[lo : lo + BLOCK + 2]), minlength=1 << BITS)
        if lo + BLOCK < len(text):  # n-grams that begin in the next block are counted there
            count -= np.bincount(gram_buckets(text[lo + BLOCK : lo + BLOCK + 2]), minlength=1 << BITS)
    there = np.flatnonzero(count)
    return there, count[there]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = grams(text)
    value = (1 + np.log(count)) * idf[at]
    return at, value / max(np.sqrt((value**2).sum()), 1e-12)


@dataclass(frozen=True)
class Model:
    classes: list[str]
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        at, value = features(text, self.idf)
        return softmax((value @ self.weights[at] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, alpha: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates; the last feature is the bias."""
    z = np.zeros(((1 << BITS) + 1, n_classes))
    n = np.zeros_like(z)
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = np.append(rows[i][0], 1 << BITS), np.append(rows[i][1], 1.0)
            w = weights(z[at], n[at])
            error = softmax(value @ w)
            error[y[i]] -= 1
            g = value[:, None] * error
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search; 1 if there is nothing to go by."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(rows: DataFrame, text_col: str, lang_col: str, key_col: str, max_sample: int = 2000, max_languages: int = 200, alpha: float = 2.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 3) -> Model | None:
    """Fit on the rows given; key_col decides which of them are sampled.  More languages than max_languages are refused.

    The fit's two tables hold a double for each feature and language, 52 MB each at 200 languages, and the model that is
    sent to tasks half as much.
    """
    rows = rows.where(F.col(key_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), unit_hash(F.col(key_col).cast("string"), seed=5).alias("at")).where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, langs = np.zeros(1 << BITS, dtype=np.int64), Counter()
        for batch in batches:
            for text in batch.column(0):
                df[grams(text.as_py())[0]] += 1
            langs.update(batch.column(1).to_pylist())
        there = np.flatnonzero(df)
        buckets, names = pa.array([*there, *[None] * len(langs)], pa.int64()), pa.array([*[None] * len(there), *langs], pa.string())
        yield pa.RecordBatch.from_arrays([buckets, names, pa.array([*df[there], *langs.values()], pa.int64())], ["bucket", "lang", "n"])

    counted = rows.select("text", "lang").mapInArrow(trimmed(frequencies), "bucket long, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    with short_batches(rows.sparkSession):
        counted = counted.limit((1 << BITS) + max_languages + 1).toArrow()  # so many rows tell of too many languages
    bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    is_gram = ~np.isnan(bucket.astype(float))
    langs = {lang: int(k) for lang, k in zip(counted["lang"].to_pylist(), n) if lang is not None}
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    total = sum(langs.values())
    if not total:
        return None
    df = np.zeros(1 << BITS)
    df[bucket[is_gram].astype(int)] = n[is_gram]
    idf = np.log((1 + total) / (1 + df)) + 1
    each = max_sample / len(langs)
    chance = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / count))) for k, count in sorted(langs.items())], F.lit(0.0))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [grams(text.as_py()) for text in batch.column(0)]
            packed = [pa.array([b[j].astype(np.int32).tobytes() for b in both], pa.binary()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *packed], ["lang", "at", "bucket", "n"])

    some = rows.where(F.col("at") < chance).mapInArrow(trimmed(sampled), "lang string, at double, bucket binary, n binary").orderBy("at", "lang", "bucket", "n").limit(2 * max_sample)
    with short_batches(rows.sparkSession):
        some = some.toArrow()
    classes = sorted(langs)
    y = np.array([classes.index(x) for x in some["lang"].to_pylist()], dtype=int)
    x = []
    for at, count in zip(some["bucket"], some["n"]):
        at = np.frombuffer(at.as_buffer(), dtype=np.int32)
        value = (1 + np.log(np.frombuffer(count.as_buffer(), dtype=np.int32))) * idf[at]
        x.append((at, value / max(np.sqrt((value**2).sum()), 1e-12)))
    held = np.arange(len(x)) % 5 == 4
    w, bias = follow_the_leader([x[i] for i in np.flatnonzero(~held)], y[~held], len(classes), alpha, l1, l2, epochs)
    logits = np.array([value @ w[at] + bias for (at, value), h in zip(x, held) if h]).reshape(-1, len(classes))
    return Model(classes, w.astype(np.float32), bias, idf.astype(np.float32), temperature_of(logits, y[held]))


def predict(spark, model: Model | None, text: Column) -> Column:
    """struct<lang, score> of a text column."""
    sent = spark.sparkContext.broadcast(vars(model) if model else None)

    @F.arrow_udf("lang string, score double")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**sent.value) if sent.value else None
        for texts in batches:
            langs, scores = [], []
            for text in (x.as_py() for x in texts):  # one text at a time is a Python string
                known = model is not None and has_letter(text)
                p = model.probabilities(text) if known else np.zeros(1)
                langs.append(model.classes[int(p.argmax())] if known else UNKNOWN)
                scores.append(min(1.0, float(p.max())))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
        give_back()

    return apply(text)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its calibrated probability; columns of these names are replaced."""
    got = unused(docs, "language_prediction")
    return docs.withColumn(got, predict(docs.sparkSession, model, F.col(text_col))).withColumn(lang_name, F.col(f"{got}.lang")).withColumn(score_name, F.col(f"{got}.score")).drop(got)
