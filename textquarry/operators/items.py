"""A growing set of items that is searched while it grows, by any number of writers and readers.

Items are numbered from 0 in the order in which they were committed.  Each ``add`` writes its items, numbered within it, as
a part of its own and then commits a version that says where the part begins; if another writer was first, only the commit
is tried again.  A search reads the parts of the version that it finds, so it sees one consistent set whatever comes later.
``compact`` puts parts together, ``vacuum`` removes what no version that is kept needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.log import VersionLog
from ..plans.shared import shared_dir, written
from .fuzzy import fuzzy_rank

SCHEMA = "index long, item string"
#: What monotonically_increasing_id numbers within a partition.
WITHIN = (1 << 33) - 1
#: More parts than this are put together by the next add.
MOST_PARTS = 64
EMPTY = {"parts": [], "size": 0}


class ItemIndex:
    """The items in a folder that driver and executors share; an existing one is opened as it is."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.base = spark, path or f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
        self.log = VersionLog(spark, f"{self.base}/versions")

    def state(self, version: int | None = None) -> dict:
        """parts (name, begin, n) and size of a version, the last one by default."""
        version = self.log.latest() if version is None else version
        return self.log.read(version) if version else EMPTY

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Make the next version from the last one, again if another writer made one meanwhile."""
        while True:
            version = self.log.latest()
            new = change(self.state(version))
            if self.log.commit(version + 1, new):
                return new

    def clear(self) -> None:
        """Begin anew; searches that run go on with the set they have."""
        self.commit(lambda old: EMPTY)

    def written_part(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.base}/data/part={name}")
        return name

    def add(self, items: DataFrame, item_col: str = "item") -> int:
        """Append items, nulls as empty ones, in the order of their partitions; the new size.  Searches see all of them or none."""
        rows = written(items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.monotonically_increasing_id().alias("id")))
        part = F.shiftright("id", 33).alias("from")
        offsets, n = [], 0
        for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("from").collect():  # a row for each partition
            offsets.append((r["from"], n))
            n += r["n"]
        if not n:
            return self.size
        begin = self.spark.createDataFrame(offsets, "from long, begin long")
        numbered = rows.withColumn("from", part).join(F.broadcast(begin), "from")
        name = self.written_part(numbered.select((F.col("begin") + F.col("id").bitwiseAND(F.lit(WITHIN))).alias("at"), "item"))
        state = self.commit(lambda old: {"parts": [*old["parts"], [name, old["size"], n]], "size": old["size"] + n})
        if len(state["parts"]) > MOST_PARTS:
            self.compact()
        return state["size"]

    def compact(self) -> None:
        """Put the parts together as one; items that come meanwhile stay parts of their own."""
        old = self.state()
        if len(old["parts"]) < 2:
            return
        name = self.written_part(self.items(old).select(F.col("index").alias("at"), "item"))

        def change(now: dict) -> dict:
            same = now["parts"][: len(old["parts"])] == old["parts"]  # not if they were cleared or put together meanwhile
            return {"parts": [[name, 0, old["size"]], *now["parts"][len(old["parts"]) :]], "size": now["size"]} if same else now

        self.commit(change)

    def vacuum(self, keep: int = 1) -> None:
        """Remove the versions before the last ``keep`` and the parts that only they have; searches of those end in an error."""
        last = self.log.latest()
        kept = range(max(1, last - keep + 1), last + 1)
        needed = {p[0] for v in kept for p in self.state(v)["parts"]}
        listed = self.log.names(f"{self.base}/data")
        if self.log.latest() != last:  # a part may be listed that the newest version has
            return self.vacuum(keep)
        older = {p[0] for v in range(1, kept.start) if f"{v:020d}" in self.log.names(self.log.folder) for p in self.state(v)["parts"]}
        for name in listed:  # parts that no version has yet belong to writers at work
            if name.removeprefix("part=") in older - needed:
                self.log.remove(f"{self.base}/data/{name}")
        for name in self.log.names(self.log.folder):
            if name.isdigit() and int(name) < kept.start:
                self.log.remove(f"{self.log.folder}/{name}")

    @property
    def size(self) -> int:
        return self.state()["size"]

    def read(self, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema("at long, item string, part string").option("basePath", f"{self.base}/data").parquet(*(f"{self.base}/data/part={p[0]}" for p in parts))
        begins = self.spark.createDataFrame([(p[0], p[1]) for p in parts], "part string, begin long")
        return rows.join(F.broadcast(begins), "part").select((F.col("begin") + F.col("at")).alias("index"), "item")

    def items(self, state: dict | None = None, begin: int = 0, end: int | None = None) -> DataFrame:
        """(index, item) of the items that are there now, or of those from begin up to end; only their parts are read."""
        state = self.state() if state is None else state
        end = state["size"] if end is None else min(end, state["size"])
        return self.read([p for p in state["parts"] if p[1] < end and p[1] + p[2] > begin]).where((F.col("index") >= begin) & (F.col("index") < end))

    def item(self, index: int) -> str:
        row = self.items(begin=index, end=index + 1).first() if index >= 0 else None
        if row is None:
            raise IndexError(index)
        return row["item"]

    def search(self, query: str, limit: int | None = None, item: Column | None = None, **options) -> DataFrame:
        """fuzzy_rank over the items that are there now."""
        return fuzzy_rank(self.items(), "item" if item is None else item, query, "index", limit, **options)
