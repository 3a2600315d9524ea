"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, counted over a corpus.

A text is encoded by a byte-level tokenizer (A, with a space before the text) and by a piece tokenizer (B, which adds
that space).  Byte offsets at which a token of both ends cut the tokens into groups, and each A token of a group is
linked with each of its B tokens.  The count of an id pair is the number of documents that hold it linked.

1. Each task encodes its documents once, writes their ids (two bytes each), packs each document's distinct pairs into
   int64 keys ``a << 32 | b`` and sums them by ``np.unique``; what a task holds of sums is bounded.
2. Partial counts are range-partitioned and sorted by key.  Each task sums runs of equal keys and writes a shard, two flat
   files of keys and counts, into the shared folder; its name becomes known only once it is whole.
3. Documents go through their written ids again and look their pairs up by ``searchsorted`` in the memory-mapped shards
   (where the shared folder isn't mounted, a shard at a time is read).  No row of a document is shuffled.

Only the list of shards and the highest count of each A id, at most as many as A has ids, pass through the driver.

Edge cases: texts that are null or empty, or whose joined token bytes aren't the space and the text (a piece tokenizer
writes U+2581 as a space), have no tokens: all numbers are 0 and ``groups`` is empty.  Strings of special tokens are plain
text.  Repeated rows and repeated or null ids are documents of their own.  Within a group of many tokens, equal tokens are
counted before they are paired, and pairs are formed by blocks; no link is left out.  A very long text is encoded whole and
alone, at some 100 bytes of memory a token.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, cut, shared_dir, short_batches
from .warc import publish, store, temporary

TOKENIZERS = "/opt/tokenizers"
#: Distinct pairs of which a task holds partial counts, and links that are formed at once.
MOST_PARTIAL, BLOCK = 1 << 21, 1 << 20
#: A key is an id of A, shifted by so many bits, and an id of B.
SHIFT = 32
#: From so many links on, a group's equal tokens are counted first.
WIDE = 1 << 12
#: How the byte-level vocabulary splits texts, and the bytes that it writes as they are.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


@dataclass(frozen=True)
class Pair:
    """The files of tokenizer A (byte-level, json) and of tokenizer B (pieces, model)."""

    a: str = f"{TOKENIZERS}/byte_bpe_50k.json"
    b: str = f"{TOKENIZERS}/piece_bpe_32k.model"


class Tokenizers:
    """Both tokenizers in a task, with the bytes of each of their tokens."""

    def __init__(self, files: Pair):
        import sentencepiece

        with open(files.a, encoding="utf-8") as file:
            self.spec = json.load(file)
        other = [b for b in range(256) if b not in PRINTED]
        byte = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"] for t in self.spec["added_tokens"]}
        vocab = {bytes(byte[c] for c in k): i for k, i in self.spec["model"]["vocab"].items() if k not in special}
        self.file = files.a
        self.size_a = max(self.spec["model"]["vocab"].values()) + 1
        self.fast = self.by_rank(vocab)
        self.slow = None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.size_b = self.pieces.get_piece_size()
        bytes_a = [b""] * self.size_a
        for k, i in vocab.items():
            bytes_a[i] = k
        bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.size_b) for p in [self.pieces.id_to_piece(i)]]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.len_a, self.len_b = np.array([*map(len, bytes_a)]), np.array([*map(len, bytes_b)])
        ends = [(range(self.size_a), b","), (range(self.size_a), b"|"), (range(self.size_b), b","), (range(self.size_b), b";"), (range(self.size_b), b"")]
        self.written = pa.array([b"%d%s" % (i, end) for ids, end in ends for i in ids], pa.large_binary())
        self.width = np.dtype("<u2" if max(self.size_a, self.size_b) <= 1 << 16 else "<u4")
        del self.spec

    def by_rank(self, vocab: dict[bytes, int]):
        """The same vocabulary as ranks, which encode several times faster; only where ids stand in the order of the merges."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in self.spec["model"]["merges"]]
        ids = self.spec["model"]["vocab"]
        if sorted(vocab.values()) != [*range(len(vocab))] or any(ids[x + y] != 256 + i for i, (x, y) in enumerate(merges)) or self.spec.get("normalizer") or self.spec["pre_tokenizer"].get("add_prefix_space"):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})

    def encode_a(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except ValueError:  # its pattern gives up on some very long texts
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=1)
def tokenizers(files: Pair) -> Tokenizers:
    return Tokenizers(files)


@dataclass
class Tokens:
    """The tokens of some documents, and the groups that they share; numbers of groups run over all documents."""

    docs: int
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    group_a: np.ndarray = field(init=False)
    group_b: np.ndarray = field(init=False)
    in_a: np.ndarray = field(init=False)
    in_b: np.ndarray = field(init=False)
    doc: np.ndarray = field(init=False)

    def cut_into_groups(self, t: Tokenizers) -> Tokens:
        """Documents' ends are ends of both tokenizers' tokens, so groups never span two documents."""
        ends_a, ends_b = np.cumsum(t.len_a[self.a]), np.cumsum(t.len_b[self.b])
        at = np.searchsorted(ends_b, ends_a)
        shared = ends_b[at] == ends_a if len(ends_a) else np.zeros(0, bool)
        also = np.zeros(len(self.b), dtype=bool)
        also[at[shared]] = True
        self.group_a, self.group_b = np.cumsum(shared) - shared, np.cumsum(also) - also
        n = int(shared.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.doc = np.repeat(np.arange(self.docs), self.n_a)[shared]
        return self

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number of each group; exact, as they stay far below 2**53."""
        return np.bincount(self.doc, values, self.docs).astype(np.int64)

    def texts(self, t: Tokenizers) -> pa.Array:
        """For each document ``a1,a2|b1;a3|b2,b3``: ids of A, ids of B, group by group."""
        n = len(self.a) + len(self.b)
        code = np.empty(n, dtype=np.int64)
        before_b, behind_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        last_a, last_b = np.ones(len(self.a), bool), np.ones(len(self.b), bool)
        last_a[:-1], last_b[:-1] = self.group_a[1:] != self.group_a[:-1], self.group_b[1:] != self.group_b[:-1]
        end = last_b.astype(np.int64)
        end[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 2
        code[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + t.size_a * last_a
        code[np.arange(len(self.b)) + behind_a[self.group_b]] = 2 * t.size_a + self.b + t.size_b * end
        pieces = t.written.take(pa.array(code))
        _, where, data = pieces.buffers()
        offsets = np.frombuffer(where, np.int64)[pieces.offset : pieces.offset + n + 1] if n else np.zeros(1, np.int64)
        docs = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return pa.LargeStringArray.from_buffers(self.docs, pa.py_buffer(offsets[docs].astype(np.int64).tobytes()), data if data is not None else pa.py_buffer(b""))

    def pairs(self, t: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document its distinct pairs, as (document, key, links), sorted by document and key."""
        group_a, a, times_a = self.group_a, self.a, None
        group_b, b, times_b, in_b = self.group_b, self.b, None, self.in_b
        if len(self.in_a) and int((self.in_a * self.in_b).max()) > WIDE:
            one, times_a = np.unique(group_a * t.size_a + a, return_counts=True)
            two, times_b = np.unique(group_b * t.size_b + b, return_counts=True)
            group_a, a, group_b, b = one // t.size_a, one % t.size_a, two // t.size_b, two % t.size_b
            in_b = np.bincount(group_b, minlength=len(in_b))
        each = in_b[group_a]  # the pairs of each A token
        total, first_b = np.cumsum(each), np.cumsum(in_b) - in_b
        keys, links, lo = [], [], 0
        while lo < len(a):
            done = int(total[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + BLOCK, side="right")))
            n = each[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            right = np.arange(len(left)) + np.repeat(first_b[group_a[lo:hi]] - (total[lo:hi] - n - done), n)
            key = (self.doc[group_a[left]] * t.size_a + a[left]) * t.size_b + b[right]
            key, n = summed(key, None if times_a is None else times_a[left] * times_b[right])
            keys.append(key)
            links.append(n)
            lo = hi
        key, n = (keys[0], links[0]) if len(keys) == 1 else summed(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *links]))
        both = key // t.size_b
        return both // t.size_a, (both % t.size_a << SHIFT) | key % t.size_b, n


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of n (1 each, if there is none)."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else np.zeros(0, np.int64)


def encode(t: Tokenizers, text: pa.Array) -> Tokens:
    """The tokens of some texts (no nulls); none of a text that is empty or that its tokens don't spell."""
    texts = text.to_pylist()
    a = [t.encode_a(f" {x}") if x else np.zeros(0, np.uint32) for x in texts]
    b = t.pieces.encode(texts, num_threads=1)
    data, at = buffers(text)
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x):
            want = b" " + data[at[i] : at[i + 1]].tobytes()
            if spelled(t.bytes_a, x) != want or spelled(t.bytes_b, y) != want:
                a[i], b[i] = np.zeros(0, np.uint32), []
        else:
            b[i] = []
    n_a, n_b = np.array([*map(len, a)], dtype=np.int64), np.array([*map(len, b)], dtype=np.int64)
    flat_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
    return Tokens(len(texts), np.concatenate([np.zeros(0, np.int64), *a]).astype(np.int64), flat_b, n_a, n_b)


def spelled(table: pa.Array, ids) -> bytes:
    _, _, data = table.take(pa.array(ids)).buffers()
    return data.to_pybytes() if data is not None else b""


@dataclass
class Partial:
    """Counts by key, of bounded size: what is full goes on to the next step."""

    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, counts = summed(keys)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > MOST_PARTIAL:
            keys, counts = self.merged()
            if len(keys) > MOST_PARTIAL // 2:
                yield keys, counts
            else:
                self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        out = summed(np.concatenate([none, *self.keys]), np.concatenate([none, *self.counts]))
        self.keys, self.counts, self.held = [], [], 0
        return out


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def encoded(docs: DataFrame, files: Pair) -> DataFrame:
    """(id, a, b, n_a, n_b, n_groups, n_links) of documents, and (key, n) of partial counts, the rest null."""
    kind = docs.schema[0].dataType
    schema = f"id {kind.simpleString()}, a binary, b binary, {', '.join(f'{c} long' for c in NUMBERS)}, key long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, partial, ids = tokenizers(files), Partial(), None

        def counts(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 1 << 17):
                k = pa.array(keys[lo : lo + (1 << 17)])
                none = [pa.nulls(len(k), x) for x in (ids, pa.binary(), pa.binary(), *[pa.int64()] * 4)]
                yield pa.RecordBatch.from_arrays([*none, k, pa.array(n[lo : lo + (1 << 17)])], ["id", "a", "b", *NUMBERS, "key", "n"])

        for batch in batches:
            ids = batch.column(0).type
            text = batch.column(1).cast(pa.large_string()).fill_null("")
            for lo, hi in chunks(buffers(text)[1]):
                tokens = encode(t, text.slice(lo, hi - lo)).cut_into_groups(t)
                for full in partial.add(tokens.pairs(t)[1]):
                    yield from counts(*full)
                wide = lambda ids, n: pa.array([x.tobytes() for x in np.split(ids.astype(t.width), np.cumsum(n)[:-1])], pa.binary())
                numbers = [tokens.n_a, tokens.n_b, tokens.by_doc(np.ones(len(tokens.doc))), tokens.by_doc(tokens.in_a * tokens.in_b)]
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), wide(tokens.a, tokens.n_a), wide(tokens.b, tokens.n_b), *map(pa.array, numbers), none, none], ["id", "a", "b", *NUMBERS, "key", "n"])
        if ids is not None:
            yield from counts(*partial.merged())

    with short_batches(docs.sparkSession):
        return docs.mapInArrow(run, schema)


def shards(counts: DataFrame, folder: str) -> DataFrame:
    """Sum sorted (key, n) by runs and write them; return (shard, first, last, n) and, for A ids, (a, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        path = f"{root}/shard-{TaskContext.get().partitionId():06d}"
        names = {c: temporary(f"{path}.{c}") for c in ("keys", "counts")}
        best: dict[int, int] = {}
        first, last, written = None, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
        with fs.open_output_stream(names["keys"]) as k, fs.open_output_stream(names["counts"]) as c:
            for batch in chain(batches, [None]):
                if batch is not None:  # the last run goes on in the next batch
                    keys, n = summed(*(np.concatenate([x, y.to_numpy()]) for x, y in zip(last, batch.columns)))
                    last, keys, n = (keys[-1:], n[-1:]), keys[:-1], n[:-1]
                else:
                    keys, n = last
                if len(keys):
                    first = int(keys[0]) if first is None else first
                    written, end = written + len(keys), int(keys[-1])
                    k.write(keys.tobytes())
                    c.write(n.tobytes())
                    a = keys >> SHIFT
                    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                    for i, m in zip(a[at].tolist(), np.maximum.reduceat(n, at).tolist()):
                        best[i] = max(m, best.get(i, 0))
        attempt = f"{path}-{TaskContext.get().taskAttemptId()}"
        for c, name in names.items():
            publish(fs, name, f"{attempt}.{c}") if written else fs.delete_file(name)
        none = pa.nulls(len(best), pa.string()), *(pa.nulls(len(best), pa.int64()) for _ in range(3))
        cols = ["shard", "first", "last", "n", "a", "best"]
        if written:
            yield pa.RecordBatch.from_arrays([*map(pa.array, ([attempt], [first], [end], [written])), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], cols)
            yield pa.RecordBatch.from_arrays([*none, pa.array([*best]), pa.array([*best.values()])], cols)

    return counts.mapInArrow(run, "shard string, first long, last long, n long, a long, best long")


@dataclass(frozen=True)
class Counts:
    """Sorted shards of keys and counts; best: the highest count of each A id."""

    folder: str
    names: tuple[str, ...]
    lasts: np.ndarray
    best: np.ndarray

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which are there."""
        fs, _ = store(self.folder)
        out = np.zeros(len(keys), dtype=np.int64)
        of = np.searchsorted(self.lasts, keys)
        for s in np.unique(of):
            lo, hi = np.searchsorted(of, [s, s + 1])
            known, n = (opened(fs, f"{self.names[s]}.{c}") for c in ("keys", "counts"))
            out[lo:hi] = n[np.searchsorted(known, keys[lo:hi])]
        return out


def opened(fs: pafs.FileSystem, path: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=np.int64, mode="r")
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=np.int64)


def looked_up(tokens: DataFrame, counts: Counts, files: Pair) -> DataFrame:
    """(id, the numbers, n_best, count_sum, groups)."""
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(files)
        for batch in batches:
            raw = [batch.column(i).cast(pa.large_binary()) for i in (1, 2)]
            for lo, hi in chunks(buffers_of(raw[0])):
                flat, n = zip(*(ids_of(x.slice(lo, hi - lo), t.width) for x in raw))
                some = Tokens(hi - lo, *flat, *n).cut_into_groups(t)
                doc, key, links = some.pairs(t)
                keys, back = np.unique(key, return_inverse=True)
                found = counts.lookup(keys)
                best = (found == counts.best[keys >> SHIFT])[back]
                sums = [np.zeros(hi - lo, np.int64) for _ in range(2)]
                np.add.at(sums[0], doc, links * best)
                np.add.at(sums[1], doc, links * found[back])
                rest = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rest.column(0), *(rest.column(i) for i in range(3, 7)), *map(pa.array, sums), some.texts(t)], ["id", *NUMBERS, "n_best", "count_sum", "groups"])

    with short_batches(tokens.sparkSession):
        return tokens.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in (*NUMBERS, 'n_best', 'count_sum'))}, groups string")


def buffers_of(x: pa.Array) -> np.ndarray:
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    return at - at[0]


def ids_of(x: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    at = buffers_of(x)
    start = int(np.frombuffer(x.buffers()[1], np.int64)[x.offset]) if len(x) else 0
    flat = np.frombuffer(x.buffers()[2] or b"", np.uint8)[start : start + int(at[-1])]
    return np.frombuffer(flat.tobytes(), width).astype(np.int64), np.diff(at) // width.itemsize


@dataclass
class Alignment:
    """documents: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups); pairs: (a, b, n), how many documents hold a pair.

    Both read what was written; close() removes it.
    """

    documents: DataFrame
    pairs: DataFrame
    folder: str

    def close(self) -> None:
        fs, root = store(self.folder)
        fs.delete_dir(root)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: Pair = Pair()) -> Alignment:
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_dir(spark)}/align-{uuid.uuid4().hex}"
    encoded(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), files).write.option("compression", "zstd").parquet(f"{folder}/tokens")
    both = spark.read.parquet(f"{folder}/tokens")
    fs, root = store(folder)
    fs.create_dir(f"{root}/shards")
    partial = both.where("key is not null").select("key", "n")
    told = cut(shards(partial.repartitionByRange("key").sortWithinPartitions("key"), f"{folder}/shards"))
    found = told.where("shard is not null").orderBy("first").toArrow()
    highest = told.where("a is not null").groupBy("a").agg(F.max("best").alias("best")).toArrow()
    best = np.zeros(max(highest["a"].to_pylist(), default=-1) + 1, dtype=np.int64)
    best[highest["a"].to_numpy()] = highest["best"].to_numpy()
    counts = Counts(f"{folder}/shards", tuple(found["shard"].to_pylist()), found["last"].to_numpy(), best)
    pairs = partial.groupBy("key").agg(F.sum("n").alias("n")).select(F.shiftright("key", SHIFT).alias("a"), F.col("key").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b"), "n")
    return Alignment(looked_up(both.where("key is null").select("id", "a", "b", *NUMBERS), counts, files), pairs, folder)
