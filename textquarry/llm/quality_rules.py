"""Quality rules with verdicts on hosts.

Every document gets counts and the base rules.  Softer rules (many symbols, many repeated lines, odd word
lengths) are too noisy to judge one document, so their failures, with those of the base rules, are
summed up by host.  A host's failure rate is shrunk towards a beta prior that is fitted to all hosts by
moments, so a host of two documents isn't condemned for one.  Documents of a rejected host stay only if
they break no rule themselves; elsewhere soft failures are forgiven.

Edge cases: null text has no words and fails the base rules.  A null host is a host of its own.
Repeated rows count each.  Extra columns are ignored; an empty table gives an empty result.  With one
host, or hosts that all agree, the prior has its weakest strength.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, cut, hashes, mix, skew_join, spans, windows, words

SYMBOLS = b"#*$%&|<>"
STRENGTH = (1.0, 1000.0)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def text_counts(text: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """For ranges of rows, the counts of COUNTS."""
    symbol, newline, space = (np.zeros(256, dtype=bool) for _ in range(3))
    symbol[list(SYMBOLS)] = True
    newline[10] = True
    space[[9, 10, 11, 12, 13, 32]] = True
    data_all, at_all = buffers(text)
    for lo, hi in chunks(at_all):
        data, at = data_all[at_all[lo] : at_all[hi]], at_all[lo : hi + 1] - at_all[lo]
        n = hi - lo
        starts, ends, first = words(data, at)
        counted = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
        out = {"n_words": np.diff(first), "word_chars": counted(~space[data] & ((data & 0xC0) != 0x80)), "n_symbols": counted(symbol[data])}

        begin, end, line_first = spans(data, at, newline)
        worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        row = np.repeat(np.arange(n), np.diff(line_first))[worded]
        key = mix(hashes(data, begin, end)[worded] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        new = np.zeros(len(key), dtype=bool)
        new[np.unique(key, return_index=True)[1]] = True
        out["n_lines"] = np.bincount(row, minlength=n)
        out["n_dup_lines"] = np.bincount(row[~new], minlength=n)

        count = np.diff(first)
        row = np.repeat(np.arange(n), count)
        sh, sh_row = windows(hashes(data, starts, ends), first, 3)
        where = np.flatnonzero(first[row + 1] - np.arange(len(starts)) >= 3)  # the full windows come first in sh
        key = mix(sh[: len(where)] + sh_row[: len(where)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        again = where[times[back] > 1]
        mark = np.zeros(len(starts) + 3, dtype=bool)
        for j in range(3):
            mark[again + j] = True
        out["n_repeat_words"] = np.bincount(row[mark[: len(starts)]], minlength=n)
        yield lo, hi, out


def document_counts(docs: DataFrame, id_col: str, text_col: str, host: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, out in text_counts(batch.column(2)):
                keep = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(out[c].astype(np.int64)) for c in COUNTS)], ["doc_id", "host", *COUNTS])

    few = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), host), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The counts of each document, base_failed, n_soft (soft rules broken), host_rejected and kept."""
    rows = document_counts(docs, id_col, text_col, F.col(host_col))
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    soft = F.expr("int(10 * n_symbols > n_words) + int(10 * n_dup_lines > 3 * n_lines) + int(word_chars < 3 * n_words or word_chars > 12 * n_words)")
    rows = cut(rows.withColumn("base_failed", base).withColumn("n_soft", soft.cast("long")))
    failed = F.when(F.col("base_failed") | (F.col("n_soft") > 0), 1).otherwise(0)
    hosts = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(failed).alias("failures")))
    rate = F.col("failures") / F.col("docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    strength = min(max(m * (1 - m) / v - 1, STRENGTH[0]), STRENGTH[1]) if v > 1e-12 else STRENGTH[0]
    shrunk = (F.col("failures") + F.lit(m * strength)) / (F.col("docs") + F.lit(strength))
    hosts = hosts.select("host", (shrunk > max_rate).alias("host_rejected"))
    out = skew_join(rows, hosts, ["host"])
    kept = ~F.col("base_failed") & (~F.col("host_rejected") | (F.col("n_soft") == 0))
    return out.select("doc_id", *COUNTS, "base_failed", "n_soft", "host_rejected", kept.alias("kept"))
