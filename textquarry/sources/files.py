"""Files as rows of text, for the same search as any other text.

Paths are a DataFrame, so files are dealt over tasks like rows; a file is read whole, in the task that has its path.  Byte
order marks are taken off, and UTF-16 under one is read as text.  Other bytes are read as UTF-8, what isn't valid in it as U+FFFD.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fuzzy, grep
from ..plans.shared import written
from .walk import tasks_for, walk

SCHEMA = "path string, size long, text string, binary_offset long, error string"
#: Characters of text in an Arrow batch, unless a single file has more.
BATCH = 1 << 20
# Byte order marks and what they say.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decoded(data: bytes) -> tuple[str, bool]:
    """The text of a file, and whether a mark said how to read it."""
    for mark, encoding in MARKS:
        if data.startswith(mark):
            body = data[len(mark) :]
            text = body.decode(encoding, "replace")
            if encoding != "utf-8" and len(body) % 2:
                # A high surrogate before an odd byte: each is a character that can't be read.
                unit = int.from_bytes(body[-3:-1], "little" if encoding.endswith("le") else "big")
                text += "\ufffd" if 0xD800 <= unit < 0xDC00 else ""
            return text, True
    return data.decode("utf-8", "replace"), False


def read_whole(full: str, max_filesize: int | None) -> tuple[int | None, bytes | None, str | None]:
    """Size, content and error of a file; a file that is too large has neither content nor error."""
    if os.path.isdir(full):
        return None, None, "is a directory"
    try:
        size = os.path.getsize(full)
        if max_filesize is not None and size > max_filesize:
            return size, None, None
        file = open(full, "rb")
    except OSError:
        return None, None, "cannot open file"
    with file:
        try:
            return size, file.read(), None
        except OSError:
            return size, None, "read error"


def read_files(paths: DataFrame, path_col: str = "path", root: str = "", max_filesize: int | None = None, partitions: int | None = None) -> DataFrame:
    """(path, size, text, binary_offset, error) of each path under root.

    Small files share an Arrow batch.  Without partitions given, the paths are written and counted, and there is a task for
    so many.  Text is null for files that are too large or can't be read.  binary_offset is where the text's first NUL is, in characters, if it has one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            size, data, error = read_whole(os.path.join(root, path), max_filesize)
            text = decoded(data)[0] if data is not None else None
            nul = text.find("\0") if text is not None else -1
            rows.append([path, size, text, nul if nul >= 0 else None, error])
            held += len(text or "")
            if held > BATCH or len(rows) >= 1000:
                yield as_batch(rows)
                rows, held = [], 0
        if rows:
            yield as_batch(rows)

    some = paths.select(F.col(path_col).cast("string").alias("path")).where("path is not null")
    if partitions is None:
        some = written(some)
        partitions = tasks_for(some.sparkSession, some.count())
    return some.repartition(partitions).mapInArrow(run, SCHEMA)


def as_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))], [c.split()[0] for c in SCHEMA.split(", ")])


def as_text(files: DataFrame, binary: str = "quit") -> DataFrame:
    """files with the text that is searched: quit stops before the line of the first NUL; text takes NULs as characters."""
    if binary == "text":
        return files
    cut = F.expr("substring(text, 1, binary_offset)")
    whole_lines = F.substring(cut, F.lit(1), F.length(cut) - F.length(F.substring_index(cut, "\n", -1)))
    return files.withColumn("text", F.when(F.col("binary_offset").isNull(), F.col("text")).otherwise(whole_lines))


def search_files(paths: DataFrame, pattern: str | tuple[str, ...], path_col: str = "path", root: str = "", max_filesize: int | None = None, binary: str = "quit", **options) -> DataFrame:
    """grep over files: (path, kind, line_number, ..., text)."""
    return grep.grep(as_text(read_files(paths, path_col, root, max_filesize), binary), "text", pattern, ["path"], **options)


def binary_matches(paths: DataFrame, pattern: str | tuple[str, ...], path_col: str = "path", root: str = "", max_filesize: int | None = None, **options) -> DataFrame:
    """(path, binary_offset) of files with a NUL that match behind the lines before it; each NUL ends a line there."""
    files = read_files(paths, path_col, root, max_filesize).where("binary_offset is not null")
    files = files.withColumn("_whole", F.col("text"))
    files = as_text(files).withColumn("_at", F.length("text"))
    rest = F.replace(F.expr("substring(_whole, _at + 1)"), F.lit("\0"), F.lit("\n"))
    return grep.grep_documents(files.withColumn("text", rest), "text", pattern, ["path", "binary_offset"], **options)


def search_tree(spark: SparkSession, root: str, pattern: str | tuple[str, ...], max_filesize: int | None = None, binary: str = "quit", walk_options: dict | None = None, **options) -> DataFrame:
    """Walk, read and search in one plan."""
    files = walk(spark, root, **(walk_options or {})).where("type = 'file'")
    full = files.where("depth > 0") if os.path.isdir(root) else files
    return search_files(full, pattern, root=root if os.path.isdir(root) else os.path.dirname(root), max_filesize=max_filesize, binary=binary, **options)


def find_files(spark: SparkSession, root: str, query: str, limit: int | None = None, **walk_options) -> DataFrame:
    """Paths under the root, best match of the query first: a walk, then path ranking in the order of the walk's bytes."""
    files = walk(spark, root, **walk_options)
    files = files.where("type = 'file'" + (" or type = 'directory'" if walk_options.get("yield_directories") else "")).select("path")
    return fuzzy.fuzzy_rank(files, "path", query, "path", limit, ranking=fuzzy.Ranking("path"))


def read_items(spark: SparkSession, path: str, null_separated: bool = False) -> DataFrame:
    """(item) of a file of items, a line each or between NULs."""
    return spark.read.text(path, lineSep="\0" if null_separated else "\n").select(F.col("value").alias("item"))
