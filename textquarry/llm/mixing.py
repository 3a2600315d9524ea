"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative weights of the sources: slot i belongs to the
source whose interval holds frac(i * golden ratio).  Slots are ranked within their source.  Each
source's documents are shuffled by a hash, laid end to end and cut into blocks of nearly equally many words,
and the slot of rank r takes block r modulo the number of blocks.  So the points alone decide how many blocks a source
gives, and when: a source's words differ from its target by the discrepancy of the points, a few blocks.  A block is
at most a LEAST_SLOTS-th of any target, if the limit on slots allows it.  Slots that would take a block more often than the limit take nothing.

Running sums (over shuffled documents, over slots) go in two levels, totals of hash ranges first, so a
source with a third of all rows is spread over many tasks.  Only one row for each source reaches the
driver, and their number is checked against max_sources.

Edge cases: null or blank text has size 0 and nothing is taken of it.  A null source is a source of its
own, the last in order.  Null ids are allowed; repeated rows are documents of their own, and stand in any order, as they
are equal.  A text longer than a block stands in several.  Extra columns are ignored.  An empty table gives an empty
result; sources without words have a target of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, row_key

GOLDEN = 2654435769  # 2**32 over the golden ratio
SLOTS, LEAST_SLOTS, MOST_SLOTS = 4096, 512, 1 << 31  # a source, on average; of the source of the least target; in all
RANGE_ROWS = 20_000


def fill(sizes: Sequence[float], weights: Sequence[float], share: float, limit: float) -> np.ndarray:
    """Targets by weight that sum up to share * sum(sizes), none above limit times its size."""
    size, w = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    target, full = np.zeros(len(size)), np.zeros(len(size), dtype=bool)
    while not full.all():
        target[~full] = (share * size.sum() - limit * size[full].sum()) * w[~full] / w[~full].sum()
        above = ~full & (target > limit * size)
        if not above.any():
            break
        full |= above
        target[full] = limit * size[full]
    return target


def running(df: DataFrame, group: str, part: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of value over the rows of the group before this one; part numbers ranges in order."""
    totals = df.groupBy(group, part).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(totals, [group, part]).withColumn(name, F.col(name) + F.col("_before")).drop("_before", part)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def block_words_for(target: np.ndarray, most: int) -> int:
    """Words of a block: few enough that each source gets many, and no more than most, but not more slots than MOST_SLOTS."""
    some = target[target > 0]
    if not len(some):
        return 1
    fine = min(some.sum() / (SLOTS * len(target)), max(some.min() / LEAST_SLOTS, some.sum() / (1 << 24)), most)
    return max(1, int(fine), int(np.ceil(some.sum() / MOST_SLOTS)))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    block_words: int = 1 << 20,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot): how many words the mix takes of each document, and when first.

    Weights go to the sources by code point, null last, and repeat.  block_words is the most that a block has.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row_key(id_col, text_col).alias("at"))
    rows = cut(rows)
    known = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    known = known.orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(known) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    size = np.array([r["size"] for r in known], dtype=np.int64)
    target = fill(size, np.resize(np.asarray(weights, dtype=float), len(known)), share, limit) if len(known) else np.zeros(0)
    block = block_words_for(target, block_words)
    blocks = np.maximum(1, -(-size // block))
    names = pa.array([r["source"] for r in known], pa.string())
    sources = spark.createDataFrame(pa.table({"n": np.arange(len(known)), "source": names, "source_size": size, "target": np.round(target, 6), "blocks": blocks}))

    # Slots: points through the cumulative targets.
    upto = np.cumsum(target)
    total = float(upto[-1]) if len(upto) else 0.0
    edges = np.floor(upto / max(1e-9, total) * 2**32 + 0.5).astype(np.int64)

    @F.arrow_udf("long")
    def owner(point: pa.Array) -> pa.Array:
        return pa.array(np.minimum(np.searchsorted(edges, point.to_numpy(), side="right"), len(edges) - 1))

    point = (F.col("slot") * F.lit(GOLDEN)) % F.lit(1 << 32)
    slots = spark.range(round(total / block)).withColumnRenamed("id", "slot").select("slot", owner(point).alias("n"), F.floor(F.col("slot") / 4096).alias("part"), F.lit(1).alias("one"))
    ranked = running(slots, "n", "part", ["slot"], "one", "rank")
    plan = F.broadcast(sources.select("n", "blocks"))  # at most max_sources rows, checked above
    schedule = ranked.join(plan, "n").where(F.expr(f"rank < {limit} * blocks"))
    schedule = schedule.groupBy("n", F.expr("rank % blocks").alias("block")).agg(F.count(F.lit(1)).alias("turns"), F.min("slot").alias("slot"))

    # Documents laid end to end in hashed order; each meets the blocks that it overlaps.  The first `over` blocks of a source have a word more.
    split = sources.select("n", F.col("source").alias("name"), "source_size", "target", F.expr("source_size div blocks").alias("least"), F.expr("source_size % blocks").alias("over"))
    marked = rows.join(F.broadcast(split), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    parts = max(256, sum(r["docs"] for r in known) // RANGE_ROWS)
    part = (F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * F.lit(parts) / F.lit(float(1 << 32))).cast("long")
    worded = marked.where("size > 0").withColumn("part", part)
    placed = running(worded, "n", "part", ["at", "doc_id", "size"], "size", "start")
    block_of = lambda word: f"if({word} < over * (least + 1), ({word}) div (least + 1), over + ({word} - over * (least + 1)) div least)"
    touched = placed.withColumn("block", F.explode(F.expr(f"sequence({block_of('start')}, {block_of('start + size - 1')})")))
    begin = F.expr("block * least + least(block, over)")
    end = F.expr("(block + 1) * least + least(block + 1, over)")
    overlap = F.least(F.expr("start + size"), end) - F.greatest("start", begin)
    met = touched.join(schedule, ["n", "block"], "left")
    keys = ["n", "start", "doc_id", "source", "size", "source_size", "target"]
    taken = met.groupBy(*keys).agg(F.sum(overlap * F.coalesce("turns", F.lit(0))).cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot"]
    none = marked.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    return taken.select(*cols).unionByName(none.select(*cols))
