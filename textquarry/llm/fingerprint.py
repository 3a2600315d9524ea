"""Document fingerprints: quartile bucket digests, compared with a bounded difference.

Every three neighbouring bytes of a text (UTF-8) are hashed into one of 256 buckets.  A digest states for each bucket
into which quartile of the 256 counts its count falls, as two bits, and the length of the text on a logarithmic scale:
128 + 2 hexadecimal digits.  Equal texts have equal digests; a text that changes a little changes few buckets.

The difference of two digests is the sum of the bucket differences, and some for the length.  It is bounded by
the sum of the larger buckets; likeness is 1 less the share of that bound that it takes: 1 for equal digests (also of two
empty texts), 0 where no bucket of one is in use in the other.

Texts are compared with their neighbours in the order of ids (``with_next``): rows are range-partitioned and sorted once,
each task goes through its rows in order and looks one row ahead.  The first and last row of each task, no more rows than
there are tasks, are joined up in a second step.

Edge cases: null text is empty; a text under three bytes has no triplets, but its length.  Ids may be of any type that has
an order; null ids come last; rows of one id come in the order of their texts' hashes, so repeated rows may stand in any
order without changing a result.  A single row is next to itself.  Texts are counted whole, by blocks.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, short_batches

BUCKETS = 256
#: Multiplicative hashing: the upper eight of 32 bits.
FACTOR = 2654435761
#: A step of length is a factor of 2 ** (1 / STEPS); so much counts for each step, and so many steps at most.
STEPS, LENGTH_WEIGHT, LENGTH_MOST = 4, 4, 16
BLOCK = 1 << 20


def counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)
    for lo in range(0, max(len(flat) - 2, 0), BLOCK):
        x = flat[lo : lo + BLOCK + 2].astype(np.uint32)
        total += np.bincount(((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(FACTOR)) >> np.uint32(24), minlength=BUCKETS)
    return total


def length_code(n: int) -> int:
    """The number of steps up to n: the least c with n**STEPS < 2**c, without rounding."""
    return min((n**STEPS).bit_length(), 255)


def quartiles(count: np.ndarray) -> np.ndarray:
    """Of each bucket, how many of the three quartiles of all buckets its count is above."""
    edges = np.sort(count)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    return (count[:, None] > edges).sum(axis=1)


def digest(data: bytes) -> str:
    q = quartiles(counts(data)).reshape(-1, 4)
    return bytes((q << [6, 4, 2, 0]).sum(axis=1).astype(np.uint8).tolist()).hex() + f"{length_code(len(data)):02x}"


def opened(fingerprint: str) -> tuple[np.ndarray, int]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    return (raw[:-1, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3).ravel().astype(np.int64), int(raw[-1])


def difference(a: str, b: str) -> tuple[int, int]:
    """The difference of two digests and its bound."""
    (x, m), (y, n) = opened(a), opened(b)
    steps = LENGTH_WEIGHT * min(abs(m - n), LENGTH_MOST)
    return int(abs(x - y).sum()) + steps, int(np.maximum(x, y).sum()) + steps


def likeness(a: str, b: str) -> float:
    far, bound = difference(a, b)
    return 1.0 if a == b else 1 - far / bound


def likeness_of(a: str | Column, b: str | Column) -> Column:
    """The likeness of two columns of digests; null where either is."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else likeness(i, j) for i, j in zip(x, y)], dtype="float64")

    return of(a, b)


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the digest of a text column."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest((x.as_py() or "").encode()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    with short_batches(docs.sparkSession):
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def edited(text: str, after: str) -> str:
    """The last quarter of a text's characters, rounded down, replaced by the first as many (or all) of another."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


FOUND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def compared(text: str, own: str, after: str, its: str) -> tuple:
    new = edited(text, after).encode()
    other = digest(new)
    return len(text), hashlib.sha256(new).hexdigest(), own, other, likeness(own, other), likeness(own, its)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each row with the next by id.

    The edited text ends in the beginning of the next row's text; the last row's next is the first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("tie"), text.alias("text"))
    by: list[Column] = [F.col("id").asc_nulls_last(), F.col("tie").asc()]
    # a task's last row can't be finished there, so it comes with its text, and with it the task's first row
    edge = f"last string, first_id {kind}, first_tie string, first string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, None
        for batch in batches:
            ids, ties, texts = batch.columns
            done = []
            for i in range(len(batch)):
                here = (ids[i : i + 1], texts[i].as_py())
                here = (*here, digest(here[1].encode()))
                if held is None:
                    first = (ids[i : i + 1], ties[i].as_py(), here[1])
                else:
                    done.append((held[0], compared(held[1], held[2], *here[1:])))
                held = here
            if done:
                n = len(done)
                cols = [pa.concat_arrays([x for x, _ in done]), *(pa.array(list(c)) for c in zip(*(x for _, x in done)))]
                none = [pa.nulls(n, pa.string()), pa.nulls(n, ids.type), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *none], ["id", *NAMES, "last", "first_id", "first_tie", "first"])
        if held is not None:
            found = [pa.array([len(held[1])]), pa.nulls(1, pa.string()), pa.array([held[2]]), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
            yield pa.RecordBatch.from_arrays([held[0], *found, pa.array([held[1]]), first[0], pa.array([first[1]]), pa.array([first[2]])], ["id", *NAMES, "last", "first_id", "first_tie", "first"])

    with short_batches(docs.sparkSession):
        told = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, f"id {kind}, {FOUND}, {edge}"))
    order = Window.orderBy(F.col("first_id").asc_nulls_last(), "first_tie")
    edges = told.where("last is not null")
    edges = edges.select("id", "last", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(x.as_py(), y.as_py()) for x, y in zip(*batch.columns[1:])]
            found = [compared(x, digest(x.encode()), y, digest(y.encode())) for x, y in pairs]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) for c in zip(*found))], ["id", *NAMES])

    with short_batches(docs.sparkSession):
        ends = edges.mapInArrow(finish, f"id {kind}, {FOUND}")
    return told.where("last is null").select("id", *NAMES).unionByName(ends).withColumnRenamed("id", id_col)
