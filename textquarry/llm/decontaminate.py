"""Benchmark decontamination: a BM25 index of the test items, searched by every training passage.

Documents are read as overlapping passages of twice the longest item, half a passage apart, so any copy of
an item lies whole in some passage.  Each passage is a query of its distinct words against the items.  A
score is divided by the item's score against itself, so 1 means that all its words are there.  The search is
block-max WAND in vectors: items stand in blocks, each term has its greatest share in each block, and a block is
scored exactly only where the sum of these bounds reaches the threshold.  All items at or above the
threshold are retrieved, none is capped, and then verified: the 5-word shingles of the item's question and
answer are looked up in the passage, and 80 of 100 of each must be there.

Words are runs of letters and digits (ASCII, or any byte above), in lower case for ASCII and Latin-1 letters.
The answer of an item is its last line, or its last sentence if it has one line; the rest is the question.

The index is broadcast.  It is built from about ITEMS items at a time; a larger benchmark is searched in several
passes, one for each part of it, under statistics of all its items.  Equal items are searched once.

Edge cases: null texts are empty; documents or items without words match nothing; a question or answer of fewer than five
words is one shingle, and one without words is no bar.  Very long texts are read in passages like all others.  Rows that
repeat a (doc_id, item_id) are folded; of passages with equally many shingles that of the greatest score is told.  Null ids are
kept as a value, and ids may be of any type.  Extra columns are ignored.  An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import buffers, chunks, cut, dim_join, hashes, lower, row_key, spans, trimmed, unused, windows

K1, B = 1.2, 0.75
ITEMS = 50_000
SHINGLE = 5


def normal(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 letters, whose second byte follows C3."""
    data = lower(data)
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return data


def not_word() -> np.ndarray:
    stop = np.ones(256, dtype=bool)
    stop[128:] = False
    stop[48:58] = stop[97:123] = stop[65:91] = False
    return stop


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of k words of one run of words."""
    return np.unique(windows(h, np.array([0, len(h)]), k)[0]) if len(h) >= k > 0 else np.zeros(0, np.uint64)


def part_of(h: np.ndarray) -> tuple[int, np.ndarray]:
    """The length of a question's or answer's shingles, and these; fewer words than SHINGLE are one shingle."""
    k = min(SHINGLE, len(h))
    return k, shingles(h, k)


@dataclass
class Index:
    """Postings by term and block: those of term t in block b are items[cell[t * blocks + b] : cell[t * blocks + b + 1]]."""

    terms: np.ndarray  # sorted word hashes
    maybe: np.ndarray  # whether a term has these first 20 bits
    items: np.ndarray
    share: np.ndarray
    cell: np.ndarray
    bound: np.ndarray  # (terms, blocks): the greatest share
    parts: list[tuple]  # of each item, part_of its question and of its answer
    ids: list
    lengths: np.ndarray
    stride: int


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, and where each text's begin."""
    data, at = buffers(texts)
    data = normal(data)
    starts, ends, first = spans(data, at, not_word())
    return hashes(data, starts, ends), first


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: how many, their words, the longest's words, and in how many a term (sorted) is."""

    items: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


#: Words of the longest items of the first class of lengths; each next class has eight times as long ones.
CLASS_WORDS = 256


def statistics(h: np.ndarray, first: np.ndarray) -> Statistics:
    length = np.diff(first)
    row = np.repeat(np.arange(len(length)), length)
    seen = np.unique(np.stack([h, row.astype(np.uint64)]), axis=1)[0] if len(h) else h
    terms, df = np.unique(seen, return_counts=True)
    return Statistics(int((length > 0).sum()), len(h), int(length.max(initial=0)), terms, df)


def statistics_of(items: DataFrame) -> tuple[Statistics, DataFrame]:
    """The statistics of all items (text) but for the terms, and a table (term, df) of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = hashed(batch.column(0))
            sets = [np.unique(h[a:b]) for a, b in zip(first, first[1:])]
            edge = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
            terms = np.concatenate(sets) if sets else h
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(first)), pa.ListArray.from_arrays(edge, pa.array(terms.view(np.int64)))], ["words", "terms"])

    each = cut(items.select("text").mapInArrow(trimmed(run), "words long, terms array<long>").where("words > 0"))
    n, words, longest = each.agg(F.count(F.lit(1)), F.sum("words"), F.max("words")).first()
    none = np.zeros(0, np.uint64)
    return Statistics(n, words or 0, longest or 0, none, none), cut(each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def build_index(rows: list[tuple], over: Statistics | None = None, block: int | None = None) -> Index | None:
    """rows: (id, text, question, answer); over: the statistics of a benchmark of which these rows are a part."""
    h, first = hashed(pa.array([r[1] for r in rows], pa.string()))
    over = over or statistics(h, first)
    keep = np.flatnonzero(np.diff(first) > 0)
    if not len(keep):
        return None
    length = np.diff(first)[keep]
    row = np.repeat(np.arange(len(keep)), length)
    terms, term = np.unique(h, return_inverse=True)  # texts without words have none in h
    pair, tf = np.unique(term * len(keep) + row, return_counts=True)
    t, item = pair // len(keep), pair % len(keep)
    df = over.df[np.searchsorted(over.terms, terms)]
    idf = np.log1p((over.items - df + 0.5) / (df + 0.5))
    share = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] * over.items / over.words))
    share /= np.bincount(item, weights=share)[item]
    size = block or max(8, -(-len(keep) // 48))
    blocks = -(-len(keep) // size)
    cell_of = t * blocks + item // size
    bound = np.zeros(len(terms) * blocks, dtype=np.float32)
    np.maximum.at(bound, cell_of, share.astype(np.float32) * np.float32(1.00001))
    cell = np.searchsorted(cell_of, np.arange(len(terms) * blocks + 1))
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[(terms >> np.uint64(44)).astype(np.int64)] = True
    parts = [hashed(pa.array([rows[i][j] for i in keep], pa.string())) for j in (2, 3)]
    parts = list(zip(*([part_of(x[f[i] : f[i + 1]]) for i in range(len(keep))] for x, f in parts)))
    return Index(terms, maybe, item.astype(np.int32), share.astype(np.float32), cell, bound.reshape(len(terms), blocks), parts, [rows[i][0] for i in keep], length, max(32, over.longest))


def by_length(rows: list[tuple], over: Statistics) -> Iterator[tuple[list[tuple], Statistics]]:
    """The items by classes of length, each with the statistics of all and its own longest: passages are no wider than its items need.

    In passages as wide as a very long item asks for, nearly every short one would reach the threshold.
    """
    words = np.diff(hashed(pa.array([r[1] for r in rows], pa.string()))[1])
    low, high = 0, CLASS_WORDS
    while low < over.longest:
        if own := [r for r, n in zip(rows, words) if low < n <= high]:
            yield own, replace(over, longest=min(high, over.longest))
        low, high = high, 8 * high


def search(index: Index, h: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, item, score) of every passage and item at or above the threshold."""
    count = np.diff(first)
    halves = -(-count // index.stride)
    base = np.concatenate([[0], np.cumsum(halves)])  # passages are numbered by the half with which they begin
    word = np.flatnonzero(index.maybe[(h >> np.uint64(44)).astype(np.int64)])
    t = np.minimum(np.searchsorted(index.terms, h[word]), len(index.terms) - 1)
    known = index.terms[t] == h[word]
    word, t = word[known], t[known]
    row = np.searchsorted(first, word, side="right") - 1
    half = base[row] + (word - first[row]) // index.stride
    later = half > base[row]
    n = len(index.terms)
    key = np.unique(np.concatenate([half * n + t, (half[later] - 1) * n + t[later]]))
    passage, t = key // n, key % n
    if not len(key):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    edge = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    upper = np.add.reduceat(index.bound[t], edge, axis=0)
    at, block = np.nonzero(upper >= threshold - 1e-4)
    # Exact scores: the postings of the passage's terms in the blocks left over.
    stop = np.concatenate([edge[1:], [len(key)]])
    n_terms = stop[at] - edge[at]
    pair = np.repeat(np.arange(len(at)), n_terms)
    which = np.arange(len(pair)) - np.repeat(np.cumsum(n_terms) - n_terms, n_terms) + edge[at][pair]
    cell = t[which] * index.bound.shape[1] + block[pair]
    lo, n_post = index.cell[cell], index.cell[cell + 1] - index.cell[cell]
    post = np.arange(n_post.sum()) - np.repeat(np.cumsum(n_post) - n_post, n_post) + np.repeat(lo, n_post)
    group = np.repeat(at[pair], n_post) * len(index.ids) + index.items[post]
    hit, back = np.unique(group, return_inverse=True)
    score = np.bincount(back, weights=index.share[post], minlength=len(hit))
    good = score >= threshold - 1e-6
    hit, score = hit[good], score[good]
    begin = passage[edge[hit // len(index.ids)]]
    row = np.searchsorted(base, begin, side="right") - 1
    return row, first[row] + (begin - base[row]) * index.stride, hit % len(index.ids), score


def last_part(text: Column) -> Column:
    """Where an item's answer begins: after its last line break, or else its last sentence end."""
    body = F.rtrim(F.coalesce(text, F.lit("")))
    answer = F.regexp_extract(body, r"(?s)\A.*\n([^\n]+)\z", 1)
    sentence = F.regexp_extract(body, r"(?s)\A.*[.!?]\s+(\S.*)\z", 1)
    return F.when(answer != "", answer).otherwise(sentence)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    threshold: float = 0.6,
    percent: int = 80,
    max_items: int = ITEMS,
    max_chars: int = 1 << 26,
) -> DataFrame:
    """(doc_id, item_id, score, n_shingles, n_found, question_found, answer_found), the best passage of each pair.

    Of the question's and of the answer's shingles, each, percent are in the passage; a part without words is no bar.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(item_text_col), F.lit(""))
    answer = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else last_part(F.col(item_text_col))
    body = F.rtrim(whole)
    question = whole if answer_col else F.substring(body, F.lit(1), F.length(body) - F.length(answer))
    texts = F.concat_ws("\n", whole, answer) if answer_col else whole
    named = cut(items.select(F.col(item_id_col).alias("item_id"), texts.alias("text"), question.alias("question"), answer.alias("answer")).distinct())
    # Equal items are searched once; the numbers are fixed, as they are written.
    once = cut(named.select("text", "question", "answer").distinct().withColumn("no", F.monotonically_increasing_id()))
    count, chars = once.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(-(-count // max_items), -(-(chars or 0) // max_chars))
    over, dfs = statistics_of(once) if parts > 1 else (None, None)
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = {"no": LongType(), "score": DoubleType(), "n_shingles": LongType(), "n_found": LongType(), "question_found": LongType(), "answer_found": LongType()}
    schema = StructType([few.schema["doc_id"], *(StructField(k, v) for k, v in names.items())])
    found = spark.createDataFrame([], schema)
    for part in range(parts):
        own = once.where(F.pmod(F.xxhash64("no"), F.lit(parts)) == part).select("no", "text", "question", "answer")
        rows = [tuple(r) for r in own.collect()]  # about max_items rows of about max_chars
        if over:
            terms = spark.createDataFrame(pa.table({"term": np.unique(hashed(pa.array([r[1] for r in rows], pa.string()))[0]).view(np.int64)}))
            known = dfs.join(terms, "term").toArrow()
            term = known["term"].to_numpy().view(np.uint64)
            order = np.argsort(term)
            over = replace(over, terms=term[order], df=known["df"].to_numpy()[order])
        for few_rows, known in by_length(rows, over or statistics(*hashed(pa.array([r[1] for r in rows], pa.string())))):
            index = build_index(few_rows, known)
            sent = spark.sparkContext.broadcast(vars(index))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                index, stop = Index(**sent.value), not_word()
                for batch in batches:
                    data_all, at_all = buffers(batch.column(1))
                    for lo, hi in chunks(at_all):
                        data, at = normal(data_all[at_all[lo] : at_all[hi]]), at_all[lo : hi + 1] - at_all[lo]
                        starts, ends, first = spans(data, at, stop)
                        h = hashes(data, starts, ends)
                        out = []
                        for row, begin, item, score in zip(*search(index, h, first, threshold)):
                            end = min(first[row + 1], begin + 2 * index.stride)
                            both = index.parts[item]
                            hits = [int(np.isin(x, shingles(h[begin:end], k)).sum()) for k, x in both]
                            if all(100 * n >= percent * len(x) for n, (_, x) in zip(hits, both)):
                                out.append((lo + row, index.ids[item], score, sum(len(x) for _, x in both), sum(hits), *hits))
                        if out:
                            cols = list(zip(*out))
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), *(pa.array([int(x) for x in c], pa.int64()) for c in cols[3:])], ["doc_id", *names])

            found = found.unionByName(cut(few.mapInArrow(trimmed(run), schema)))
            sent.destroy()
    best = F.max(F.struct("n_found", "score", "n_shingles", "question_found", "answer_found")).alias("best")
    every = dim_join(found.groupBy("doc_id", "no").agg(best), named.join(once, ["text", "question", "answer"]).select("no", "item_id"), ["no"])
    return every.select("doc_id", "item_id", F.round("best.score", 4).alias("score"), "best.n_shingles", "best.n_found", "best.question_found", "best.answer_found")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that hold an item of the benchmark, whatever their ids."""
    key, text = unused(docs, "row_key"), F.col(text_col).alias("text")
    leaks = find_leaks(docs.select(row_key(id_col, text_col).alias("doc_id"), text), items, **how).select(F.col("doc_id").alias(key)).distinct()
    return dim_join(docs.withColumn(key, row_key(id_col, text_col)), leaks, [key], "left_anti").select(*docs.columns)
