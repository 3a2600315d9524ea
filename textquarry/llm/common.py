"""What several operators of this subpackage share.

Text is split into words as ``[^\\x20\\x09-\\x0D]+`` throughout.  The numpy helpers work on the raw
UTF-8 buffers of Arrow batches, so a task holds one batch and never a Python object for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy helpers handle at once (a longer text is handled alone).
CHUNK_BYTES = 1 << 18
#: Removes a query's shuffle files at its end; else they stay until the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Narrow rows of a partition of a small table.
PART_ROWS = 50_000


# ---------------------------------------------------------------- Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings for a while, and those of before afterwards; a plan takes them when it is made.

    They are the session's, so other threads see them meanwhile: work at the same time wants a session for each thread.
    """
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def short_batches(spark: SparkSession):
    """Arrow batches of few rows meanwhile, as texts may be long."""
    return settings(spark, {BATCH_ROWS: "500"})


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Write the rows to the shared folder and go on from there: lost executors cost nothing done before.

    The shuffles that made the rows are of no more use then, and their files go at once.  With keep_layout, Spark
    still knows by what the rows are partitioned, so that joins on it don't move them again; it forgets that of
    plans that adapt while they run.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with settings(spark, {FREE_SHUFFLES: "true", BATCH_ROWS: "500"} | ({"spark.sql.adaptive.enabled": "false"} if keep_layout else {})):
        return df.select("*").checkpoint()  # select: the plan is made here


def parts_for(n: int, rows: int = PART_ROWS) -> int:
    """How many partitions n narrow rows need."""
    return max(1, -(-n // rows))


def packed(df: DataFrame) -> tuple[DataFrame, int]:
    """Narrow rows, written, counted and put in as few partitions as they need.

    A small table in as many partitions as the session's shuffles have costs its tasks' overhead in each later step.
    """
    out = cut(df)
    n = out.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    return out.coalesce(parts_for(n)), n


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def skew_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows whose keys may be very uneven to a table with one row for each key.

    Both sides also join on a hash of the keys.  A dim that was grouped by the keys thus gets an
    exchange of its own for the join, and adaptive execution may then split the hot partitions of
    facts (or broadcast dim, if its measured size is below the session's threshold).
    """
    guard = unused(facts, "join_guard")
    with_guard = lambda df: df.withColumn(guard, F.xxhash64(*keys, F.lit(17)))
    return with_guard(facts).join(with_guard(dim), [*keys, guard], how).drop(guard)


def dim_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", n: int | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """skew_join, but a dim of at most so many (narrow) rows, counted, is broadcast and facts stay where they are.

    n: the number of rows of a dim that is written already.
    """
    if n is None:
        dim, n = packed(dim)
    if n <= broadcast_rows:
        return facts.join(F.broadcast(dim), keys, how)
    return skew_join(facts, dim, keys, how)


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text, either of which may be null; rows of equal key say the same."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.md5(F.concat(F.length(part(id_col)), F.lit(":"), part(id_col), part(text_col)))


def crc_mod(doc_id: str | Column, n: int) -> Column:
    return F.pmod(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")), F.lit(n))


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b), label being the smallest node that is reachable.

    Large-star and small-star rounds: the edges always stay as few as they were and shrink to stars.
    Each half round groups by a node with partial minima and joins back with splittable skew, so a hub
    is never gathered in one task.  A large star over edges that are stars already tells so.
    """
    e, n = packed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    few = lambda df: df.coalesce(parts_for(2 * n))

    def met(rows: DataFrame) -> DataFrame:
        """Rows (a, b) with the least m of a and all its b."""
        return few(skew_join(rows, few(rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))), ["a"]))

    while True:
        large = cut(met(few(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))))
        if not large.where("m <> least(a, b)").count():
            break
        small = met(few(large.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()))
        ends = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = cut(few(ends.where("a <> b").distinct()))
    leaves = large.where("b < a").select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(few(leaves.select("label").distinct()).select(F.col("label").alias("node"), "label"))


# ---------------------------------------------------------------- numpy side


def give_back() -> None:
    """Return freed memory to the system, as workers wait between tasks with what their largest task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and where each row begins, one more for the end."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    _, where, data = text.buffers()
    at = np.frombuffer(where, dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes that aren't stop bytes, and each row's first run."""
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    keep = ~stop[data]
    before = np.empty(n, dtype=bool)
    before[1:] = ~keep[:-1]
    before[:1] = True
    starts = np.flatnonzero(keep & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[:-1] = ~keep[1:]
    after[-1:] = True
    ends = np.flatnonzero(keep & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(data, at, _SPACE)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n; those of very long texts aren't kept."""
    if len(_powers.get("up", ())) < n:
        up = np.full(n, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        both = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > 16 * CHUNK_BYTES:
            return both
        _powers["up"], _powers["down"] = both
    return _powers["up"], _powers["down"]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of bytes: a polynomial in them, by one running sum over all."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words and the row of each; a row of fewer words has one window of all."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    left = first[row + 1] - np.arange(len(h))
    i = np.flatnonzero(left >= k)
    full = np.full(len(i), k, dtype=np.uint64)
    for j in range(k):
        full = mix(full + h[i + j] * np.uint64(2 * j + 3))
    out, rows = [full], [row[i]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            some = np.full(len(short), n, dtype=np.uint64)
            for j in range(n):
                some = mix(some + h[first[short] + j] * np.uint64(2 * j + 3))
            out.append(some)
            rows.append(short)
    return np.concatenate(out), np.concatenate(rows)
