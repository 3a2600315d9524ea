"""Search over append-only streams: the same operators, run on each new batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators.grep import free, grep
from .plans.log import VersionLog


def grep_stream(stream: DataFrame, text_col: str, pattern: str, id_cols: list[str], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append what grep finds in new rows to Parquet, with all of its options, as a document is a row."""
    out = grep(stream, text_col, pattern, id_cols, **options)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def visit_stream(stream: DataFrame, text_col: str, pattern: str, id_cols: list[str], path: str, checkpoint: str, visit: Callable[[DataFrame, int], None] | None = None, max_lines: int | None = None, **options) -> StreamingQuery:
    """Hand the lines found in each batch to ``visit(lines, batch)`` and keep them at ``path``, a folder for each batch.

    A batch that is run again, after a failure between its output and its commit, writes its folder again instead of adding
    to it, and is handed on under the same number, so that visitors can tell.  With max_lines, no more lines than that are
    kept of one document (one value of id_cols) over all batches, however its rows are spread over them: each batch also
    writes how many lines each document has had, and the next one goes on from there.
    """
    spark, number = stream.sparkSession, free("line_number", id_cols)

    def each(batch: DataFrame, n: int) -> None:
        found = grep(batch, text_col, pattern, id_cols, **options)
        if max_lines is not None:
            log = VersionLog(spark, path)
            before = [int(x.removeprefix("batch=")) for x in log.names(f"{path}/counts") if x.startswith("batch=")]
            last = max((b for b in before if b < n), default=None)
            seen = spark.read.parquet(f"{path}/counts/batch={last}") if last is not None else spark.createDataFrame([], f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.select(*id_cols).schema)}, _seen long")
            same = [found[c].eqNullSafe(seen[c]) for c in id_cols]
            order = Window.partitionBy(*id_cols).orderBy(number, F.xxhash64(*found.columns))
            found = found.join(seen, same, "left").select(*(found[c] for c in found.columns), F.coalesce("_seen", F.lit(0)).alias("_seen")).withColumn("_nth", F.row_number().over(order))
            found = found.where(F.col("_seen") + F.col("_nth") <= max_lines).drop("_seen", "_nth")
        found.write.mode("overwrite").parquet(f"{path}/lines/batch={n}")
        kept = spark.read.schema(found.schema).parquet(f"{path}/lines/batch={n}")
        if max_lines is not None:
            now = kept.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("_seen")).unionByName(seen)
            now.groupBy(*id_cols).agg(F.sum("_seen").alias("_seen")).write.mode("overwrite").parquet(f"{path}/counts/batch={n}")
        if visit is not None:
            visit(kept, n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
