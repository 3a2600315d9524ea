"""Queries of walks and of searches over files: the pages, written as a tree of files, with ignore files among them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grep
from ..sources import files, ranges, walk
from .shared import shared_dir, written

#: Ignore files by folder.  The folders are a page's number modulo 7.
RULES = {".ignore": "3/\n*5.txt\n", "2/.ignore": "!*5.txt\n", "4/.rgignore": "*[02].txt\n", "5/.ignore": "*7.TXT\n", "6/.gitignore": "*\n", ".extra": "*9.txt\n"}
WALK = {"parents": False, "git_global": False}
PATH = "concat(page_id % 7, '/', page_id, '.txt')"


def tree(spark: SparkSession, sf_dir: str, text: str = "html") -> str:
    """Write the pages, or a text made of each, as files below a new folder, every third as UTF-16, and return it."""
    root = urlparse(f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}")
    if root.scheme not in ("", "file"):
        raise ValueError("a tree of files needs a shared folder that is mounted")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, wide in zip(*(c.to_pylist() for c in batch.columns)):
                full = os.path.join(root.path, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as file:
                    file.write(b"\xff\xfe" + text.encode("utf-16-le") if wide else text.encode())
            yield batch.slice(0, 0)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.expr(PATH).alias("path"), F.coalesce(F.expr(text), F.lit("")).alias("text"), F.expr("page_id % 3 = 0").alias("wide"))
    rules = spark.createDataFrame([(p, t, False) for p, t in RULES.items()], pages.schema)
    written(pages.unionByName(rules).mapInArrow(write, pages.schema))
    return root.path


# The last folder's rules don't hold, as there is no repository.
KEPT = f"""kept AS (SELECT page_id, {PATH.replace('page_id % 7', "CAST(page_id % 7 AS VARCHAR)").replace("page_id, '.txt'", "CAST(page_id AS VARCHAR), '.txt'")} AS path, coalesce(html, '') AS html FROM pages
  WHERE page_id % 7 <> 3 AND (page_id % 10 <> 5 OR page_id % 7 = 2) AND NOT (page_id % 7 = 4 AND page_id % 10 IN (0, 2)))"""
LINES = """lines AS (SELECT path, CAST(i AS BIGINT) AS line_number, l[i] AS text FROM (
  SELECT path, l, unnest(generate_series(1, len(l))) AS i FROM (
    SELECT path, string_split(CASE WHEN html LIKE '%' || chr(10) THEN left(html, length(html) - 1) ELSE html END, chr(10)) AS l FROM kept WHERE html <> '')))"""


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.list_files(spark, tree(spark, sf_dir), **WALK)


def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.search_tree(spark, tree(spark, sf_dir), "<p>[^<]*ing", walk_options=WALK, byte_offset=False).select("path", "line_number", "text")


def tree_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.search_tree(spark, tree(spark, sf_dir), "<title>", walk_options=WALK, after=1).select("path", "kind", "line_number", "text")


def tree_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.find_files(spark, tree(spark, sf_dir), "^2/ 5.txt$", **WALK).select("path")


def tree_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.list_files(spark, tree(spark, sf_dir), hidden=True, ignore_files=False, **WALK)


def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(spark, tree(spark, sf_dir), max_depth=1, **WALK).select("path", "type", "depth")


def tree_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.list_files(spark, tree(spark, sf_dir), globs=["*1.TXT", "!/5/"], glob_case_insensitive=True, **WALK)


def tree_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tree(spark, sf_dir)
    return walk.list_files(spark, root, extra_ignore_files=[f"{root}/.extra"], dialect="rg", **WALK)


def tree_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.list_files(spark, tree(spark, sf_dir), ignore_case="insensitive", **WALK)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of all pages' files, as a list that wasn't walked."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.expr(PATH).alias("path"))


def tree_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.search_files(listed(spark, sf_dir), "<title>", root=tree(spark, sf_dir)).select("path", "line_number", "text")


def tree_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ranges of bytes, so that a file is dealt over tasks."""
    return ranges.search_ranges(listed(spark, sf_dir), "<p", root=tree(spark, sf_dir), range_bytes=1000, after=1).select("path", "kind", "line_number", "text")


def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = files.read_files(listed(spark, sf_dir), root=tree(spark, sf_dir, "substring(html, 1, page_id * 7 % 300)"), max_filesize=200)
    return read.select("path", "size", F.octet_length("text").cast("long").alias("bytes"))


NUL = "concat(substring_index(html, '\\n', 2), '\\n', 'nul ', char(0), substring(html, length(substring_index(html, '\\n', 2)) + 1))"


def tree_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the line of a file's first NUL is searched."""
    return files.search_files(listed(spark, sf_dir), "<", root=tree(spark, sf_dir, NUL)).select("path", "line_number", "text")


def tree_binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.search_files(listed(spark, sf_dir), "<p", root=tree(spark, sf_dir, NUL), binary="text").select("path", "line_number", "text")


def tree_binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.binary_matches(listed(spark, sf_dir), "<p", root=tree(spark, sf_dir, NUL))


def tree_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.search_tree(spark, tree(spark, sf_dir), "<title>", walk_options=WALK, column=True)
    return grep.printed(found, "path", column=True)


def items_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written between NULs and read as items."""
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").write.option("lineSep", "\0").text(path)
    return files.read_items(spark, path, null_separated=True)


QUERIES = {f.__name__: f for f in (tree_files, tree_search, tree_context, tree_find, tree_hidden, tree_depth, tree_globs, tree_extra, tree_ignore_case, tree_listed, tree_ranges, tree_sizes, tree_binary, tree_binary_text, tree_binary_report, tree_printed, items_read)}
ALL = KEPT.split("WHERE")[0].replace("kept AS", "every AS").rstrip() + ")"
SPLIT = "string_split(CASE WHEN {t} LIKE '%' || chr(10) THEN left({t}, length({t}) - 1) ELSE {t} END, chr(10))"
# The text with a line of its own, with a NUL, behind the second line; and its lines.
WITH_NUL = f"""{ALL}, two AS (SELECT path, html, array_to_string(string_split(html, chr(10))[1:2], chr(10)) AS head FROM every),
t AS (SELECT path, CASE WHEN html = '' THEN chr(10) || 'nul #' ELSE head || chr(10) || 'nul #' || substr(html, length(head) + 1) END AS text, head FROM two),
l AS (SELECT path, CAST(i AS BIGINT) AS line_number, replace(x[i], 'nul #', 'nul ' || chr(0)) AS text, CAST(length(head) + 5 AS BIGINT) AS nul, n FROM (SELECT path, head, x, len(string_split(head, chr(10))) + 1 AS n, unnest(generate_series(1, len(x))) AS i FROM (SELECT path, head, {SPLIT.format(t='text')} AS x FROM t)))"""
ORACLE = {
    "tree_files": f"WITH {KEPT} SELECT path FROM kept",
    "tree_search": f"WITH {KEPT}, {LINES} SELECT path, line_number, text FROM lines WHERE regexp_matches(text, '<p>[^<]*ing')",
    "tree_context": f"WITH {KEPT}, {LINES} SELECT path, CASE WHEN contains(text, '<title>') THEN 'match' ELSE 'context' END AS kind, line_number, text FROM (SELECT *, lag(text) OVER (PARTITION BY path ORDER BY line_number) AS before FROM lines) WHERE contains(text, '<title>') OR contains(before, '<title>')",
    "tree_find": f"WITH {KEPT} SELECT path FROM kept WHERE starts_with(path, '2/') AND ends_with(path, '5.txt')",
    "tree_hidden": f"WITH {ALL} SELECT path FROM every UNION ALL SELECT unnest({[*RULES]}) AS path",
    "tree_depth": f"WITH {ALL} SELECT DISTINCT string_split(path, '/')[1] AS path, 'directory' AS type, CAST(1 AS INT) AS depth FROM every WHERE path NOT LIKE '3/%'",
    "tree_globs": f"WITH {ALL} SELECT path FROM every WHERE path LIKE '%1.txt' AND path NOT LIKE '3/%' AND path NOT LIKE '5/%'",
    "tree_extra": f"WITH {KEPT} SELECT path FROM kept WHERE path NOT LIKE '%9.txt'",
    "tree_ignore_case": f"WITH {KEPT} SELECT path FROM kept WHERE path NOT LIKE '5/%7.txt'",
    "tree_listed": f"WITH {ALL}, l AS (SELECT path, unnest(generate_series(1, len(x))) AS i, x FROM (SELECT path, {SPLIT.format(t='html')} AS x FROM every WHERE html <> '')) SELECT path, CAST(i AS BIGINT) AS line_number, x[i] AS text FROM l WHERE contains(x[i], '<title>')",
    "tree_ranges": f"WITH {ALL}, {LINES.replace('FROM kept', 'FROM every')} SELECT path, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, line_number, text FROM (SELECT *, contains(text, '<p') AS hit, coalesce(contains(lag(text) OVER (PARTITION BY path ORDER BY line_number), '<p'), false) AS before FROM lines) WHERE hit OR before",
    "tree_sizes": f"WITH {ALL.replace('coalesce(html', 'coalesce(left(html, page_id * 7 % 300)')}, b AS (SELECT path, strlen(html) AS n, CASE WHEN page_id % 3 = 0 THEN 2 + 2 * length(html) + 2 * length(regexp_replace(html, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) ELSE strlen(html) END AS size FROM every) SELECT path, CAST(size AS BIGINT) AS size, CASE WHEN size <= 200 THEN CAST(n AS BIGINT) END AS bytes FROM b",
    "tree_binary": f"WITH {WITH_NUL} SELECT path, line_number, text FROM l WHERE line_number < n AND contains(text, '<')",
    "tree_binary_text": f"WITH {WITH_NUL} SELECT path, line_number, text FROM l WHERE contains(text, '<p')",
    "tree_binary_report": f"WITH {WITH_NUL} SELECT DISTINCT path, nul AS binary_offset FROM l WHERE line_number >= n AND contains(text, '<p')",
    "tree_printed": f"WITH {KEPT}, {LINES} SELECT path || ':' || line_number || ':' || (strlen(split_part(text, '<title>', 1)) + 1) || ':' || text AS value FROM lines WHERE contains(text, '<title>')",
    "items_read": "SELECT url AS item FROM pages",
}
