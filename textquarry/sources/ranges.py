"""Search over files that are larger than a task should hold: byte ranges that end with lines, dealt over tasks.

A range has the lines that begin in it.  A first pass reads the ranges and tells how many lines, bytes and matching lines each
has; running sums over a file's ranges, no rows but theirs, number the lines of the second pass.  That one reads a range with
as many lines around it as context reaches, so context, limits and numbers are those of a search over the whole file.
A task holds one range, and a line that is longer than one.  Files under a UTF-16 mark are read as one range.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pattern import compile_pattern
from ..operators import grep
from ..plans.shared import written
from .files import MARKS, as_text, decoded
from .walk import tasks_for

RANGES = "path string, k long, begin long, end long, error string"
PART = "skipped long, skipped_bytes long, own long, own_bytes long, text string, binary_offset long"
STEP = 1 << 16
#: Ranges of so many bytes go to a task, where there are more of them than cores.
TASK_BYTES = 64 << 20


def ranges_of(paths: DataFrame, path_col: str, root: str, range_bytes: int) -> DataFrame:
    """(path, k, begin, end, error) of the ranges of each file, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        size, head = os.fstat(file.fileno()).st_size, file.read(3)
                    whole = any(head.startswith(m) for m, encoding in MARKS if encoding != "utf-8")
                    step = max(1, size if whole else range_bytes)
                    rows = [(path, k, b, min(b + step, size), None) for k, b in enumerate(range(0, size, step))]
                except OSError:
                    rows = [(path, 0, 0, 0, "cannot open file")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], [x.split()[0] for x in RANGES.split(", ")])

    some = written(paths.select(F.col(path_col).cast("string").alias("path")).where("path is not null"))
    return written(some.repartition(tasks_for(some.sparkSession, some.count())).mapInArrow(run, RANGES))


def line_start(file, at: int) -> int:
    """Where the first line begins that doesn't begin before a place."""
    if at == 0:
        return 0
    file.seek(at - 1)
    file.readline()
    return file.tell()


def lines_back(file, at: int, n: int) -> int:
    """Where the n-th line before a line's beginning begins, or the file."""
    tail = b""
    while n and at > len(tail) and tail.count(b"\n") <= n:
        low = max(0, at - len(tail) - STEP)
        file.seek(low)
        tail = file.read(at - len(tail) - low) + tail
    parts = tail.split(b"\n")[:-1]
    return at - sum(len(x) + 1 for x in parts[max(0, len(parts) - n) :]) if n else at


def read_part(full: str, begin: int, end: int, before: int, behind: int) -> tuple[int, int, int, int, str, int | None]:
    """A range's lines with some lines before and behind them: how much of the text is not its own, what is, and its first NUL."""
    with open(full, "rb") as file:
        start, stop = line_start(file, begin), line_start(file, end)
        first = lines_back(file, start, before)
        file.seek(first)
        data = file.read(stop - first)
        own = data[start - first :]
        for _ in range(behind):
            data += file.readline()
    if first == 0 and data:
        mark = next((m for m, _ in MARKS if data.startswith(m)), b"")
        text = decoded(data)[0]
        if start == 0:  # a file's beginning, or all of it under a UTF-16 mark
            own = own if mark and mark != MARKS[0][0] else own[len(mark) :]
            own_text = decoded(own)[0]
            skipped = ""
        else:
            skipped, own_text = decoded(data[: start - first])[0], own.decode("utf-8", "replace")
    else:
        text, own_text, skipped = data.decode("utf-8", "replace"), own.decode("utf-8", "replace"), data[: start - first].decode("utf-8", "replace")
    lines = own_text.count("\n") + bool(own_text and not own_text.endswith("\n"))
    nul = text.find("\0")
    return skipped.count("\n"), len(skipped.encode()), lines, len(own_text.encode()), text, nul if nul >= 0 else None


def parts_of(ranges: DataFrame, root: str, before: int, behind: int) -> DataFrame:
    """ranges, whose first columns are path, k, begin and end, with the columns of PART."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, _, begin, end) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                part = read_part(os.path.join(root, path), begin, end, before, behind)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([v], t) for v, t in zip(part, kinds))], [*batch.schema.names, *(x.split()[0] for x in PART.split(", "))])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema)
    return ranges.mapInArrow(run, f"{schema}, {PART}")


def search_ranges(paths: DataFrame, pattern: str | tuple[str, ...], path_col: str = "path", root: str = "", range_bytes: int = 64 << 20, binary: str = "quit", invert: bool = False, before: int = 0, after: int = 0, max_count: int | None = None, byte_offset: bool = False, column: bool = False, spans: bool = False, **options) -> DataFrame:
    """The lines of search_files, (path, kind, line_number, ..., text), a range of a file at a time; matches don't span lines."""
    p = compile_pattern(pattern, **options)
    ranges = ranges_of(paths, path_col, root, range_bytes).where("error is null").select("path", "k", "begin", "end")
    n, held = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    tasks = max(1, min(n, max(4 * ranges.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES))))
    ranges = ranges.repartition(tasks)
    first = as_text(parts_of(ranges, root, 0, 0).withColumn("nul", F.col("binary_offset").isNotNull()), binary)
    hits = F.size(F.filter(p.flags(grep.lines_of(F.col("text"))), lambda x: x != F.lit(invert))) if max_count else F.lit(0)
    counted = written(first.select("path", "k", "begin", "end", "own", "own_bytes", "nul", hits.cast("long").alias("hits")))
    earlier = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias
    numbered = counted.select("path", "k", "begin", "end", so_far("own")("lines_before"), so_far("own_bytes")("bytes_before"), so_far("hits")("hits_before"), F.coalesce(F.max("nul").over(earlier), F.lit(False)).alias("ended"))
    if binary == "quit":
        numbered = numbered.where(~F.col("ended"))
    if max_count:  # behind the limit only what context reaches is looked at
        numbered = numbered.where((F.col("hits_before") < max_count) | F.lit(bool(after)))
    numbered = written(numbered.drop("ended"))
    rows = as_text(parts_of(numbered.repartition(tasks), root, after, before), binary)
    limit = None
    if max_count:
        held = F.size(F.filter(p.flags(F.slice(grep.lines_of(F.col("text")), 1, F.col("skipped").cast("int"))), lambda x: x != F.lit(invert)))
        rows = rows.withColumn("_limit", F.greatest(F.lit(max_count) - F.col("hits_before") + held, F.lit(0)).cast("int"))
        limit = F.col("_limit")
    ids = ["path", "skipped", "skipped_bytes", "own", "lines_before", "bytes_before"]
    found = grep.grep(rows, "text", pattern, ids, invert=invert, before=before, after=after, max_count=limit, byte_offset=byte_offset, column=column, spans=spans, **options)
    found = found.where((F.col("line_number") > F.col("skipped")) & (F.col("line_number") <= F.col("skipped") + F.col("own")))
    found = found.withColumn("line_number", F.col("line_number") - F.col("skipped") + F.col("lines_before"))
    if byte_offset:
        found = found.withColumn("byte_offset", F.col("byte_offset") - F.col("skipped_bytes") + F.col("bytes_before"))
    return found.drop(*ids[1:])
