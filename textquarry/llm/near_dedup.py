"""MinHash near-duplicate grouping with SuperMinHash signatures.

Every document becomes the set of its word shingles.  Equal sets are folded into one class first, so
exact copies never meet again.  The classes get SuperMinHash signatures: each element walks a
permutation of the registers of its own and offers rank + uniform at each step, and a document stops
as soon as no later rank can lower any register.  Signatures are banded; documents that share a band
are candidates, candidates are confirmed on their full sets, and confirmed links are grouped by
distributed star contraction.

No bucket is ever expanded into all its pairs.  Each document first meets one pivot, the most central
document of its buckets.  Later rounds look only at buckets whose documents are still in different
components, and compare a few pivots outside the bucket's largest component with the rest.  A bucket is
settled when it has one component left or no document outside the largest one can have a link there that
isn't checked.  So every candidate link between two components is checked, however large the bucket.

Two exact bounds keep this short where thousands of copies differ by a few words.  Among the documents of large
buckets, a shingle is rare if at most RARE of them have it.  Pairs that share a rare shingle are listed from
these short lists and checked on their own.  All other pairs share no rare shingle, so their overlap is at most what
either has of frequent ones, and most are ruled out by four numbers, without their sets.  Where one of two stands in
small buckets alone, its rare shingles are in no list, and only sizes rule the pair out.

Edge cases: null or empty text, or text without words, has an empty set and is linked with nothing; its component is
its own id.  Texts of fewer words than a shingle have one shingle, the whole sequence.  A very long text is signed in
blocks.  Rows of equal text share their class, and rows of one id with different texts are different documents.  A row
without an id is linked like any other: its component is the smallest id that it reaches; if there is none, component_id
is null and kept is true.  Ids are of any type that can be ordered.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import buffers, chunks, connected_components, cut, dim_join, hashes, lower, mix, packed, parts_for, row_key, skew_join, trimmed, unused, windows, words

BANDS, ROWS = 24, 4  # a pair at 0.85 shares no band with a chance of 2e-8, at 0.8 of 3e-6
PIVOTS, MORE_PIVOTS = 8, 512  # of a bucket in its first round, in later ones
BLOCK = 1 << 18  # shingles that are signed at once
PAIRS, WIDE_ROWS = 2000, 20_000  # of a partition: pairs whose sets are compared, rows with their bands
LARGE, RARE = 16, 8  # documents of a large bucket, at least one more; of a rare shingle, at most


def super_minhash(elements: np.ndarray, row: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n, m) of n sets; elements are distinct within a row.

    Blocks of elements are taken in turn, as their minima combine: a block holds m bytes an element.
    """
    sign = np.full(n * m, np.inf)
    step = mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for lo in range(0, len(elements), BLOCK):
        part, of = elements[lo : lo + BLOCK], row[lo : lo + BLOCK]
        order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(part), 1))
        live, open_rows = np.arange(len(part)), np.ones(n, dtype=bool)
        for j in range(m):
            if not len(live):
                break
            u = mix(part[live] ^ step[j])
            swap = j + (mix(u + np.uint64(0x632BE59BD9B4E019)) % np.uint64(m - j)).astype(np.int64)
            here, there = order[live, j], order[live, swap]
            order[live, swap] = here
            order[live, j] = there
            np.minimum.at(sign, of[live] * m + there, j + (u >> np.uint64(11)) * 2.0**-53)
            open_rows &= sign.reshape(n, m).max(axis=1) >= j + 1
            live = live[open_rows[of[live]]]
    return sign.reshape(n, m)


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For ranges of rows, the sorted distinct shingle hashes of each."""
    data, at = buffers(text)
    for lo, hi in chunks(at):
        part, begin = lower(data[at[lo] : at[hi]]), at[lo : hi + 1] - at[lo]
        starts, ends, first = words(part, begin)
        sh, row = windows(hashes(part, starts, ends), first, k)
        order = np.argsort(row, kind="stable")
        sh, edges = sh[order], np.searchsorted(row[order], np.arange(hi - lo + 1))
        yield lo, hi, [np.unique(sh[edges[i] : edges[i + 1]]) for i in range(hi - lo)]


def with_text(docs: DataFrame, text_col: str, **first: Column) -> DataFrame:
    """The columns named first, then the text."""
    return docs.select(*(c.alias(name) for name, c in first.items()), F.col(text_col).alias("text"))


def signatures(rows: DataFrame, k: int, bands: int, per_band: int) -> DataFrame:
    """rows with n_shingles, set_hash and bands in place of text, the last column; the last two are null for an empty set."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in shingle_sets(batch.column(len(kept)), k):
                size = np.array([len(s) for s in sets], dtype=np.int64)
                row = np.repeat(np.arange(hi - lo), size)
                sign = super_minhash(np.concatenate(sets), row, hi - lo, bands * per_band)
                h = np.zeros((hi - lo, bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(per_band):
                    h = mix(h * np.uint64(3) + sign.view(np.uint64).reshape(hi - lo, bands, per_band)[:, :, r])
                none = size == 0
                keys = [None if none[i] else hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for i, s in enumerate(sets)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(h.view(np.int64).ravel()))
                passed = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(size), pa.array(keys, pa.string()), lists], [*kept, "n_shingles", "set_hash", "bands"])

    schema = StructType(rows.drop("text").schema.fields)
    return rows.mapInArrow(trimmed(run), schema.add("n_shingles", "long").add("set_hash", "string").add("bands", ArrayType(LongType())))


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """(node, elements) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in shingle_sets(batch.column(1), k):
                edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["node", "elements"])

    return rows.mapInArrow(trimmed(run), "node long, elements array<long>")


def link(classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) of the classes (node, n, bands, key) that have links, label being the same for all that are reachable.

    texts (key, text) has the text of each class under its key.
    """
    member = classes.select("node", "n", F.posexplode("bands").alias("band", "value")).select("node", "n", F.xxhash64("band", "value").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member, n_members = packed(skew_join(member, shared, ["bucket"]))
    few = lambda df: df.coalesce(parts_for(n_members))
    nodes = few(member.groupBy("node").agg(F.min("n").alias("n"), (F.max("size") > LARGE).alias("large"), F.collect_list(F.when(F.col("size") > LARGE, F.col("bucket"))).alias("crowds")))  # at most a bucket a band
    nodes = cut(nodes)

    # Sets of the classes that have a candidate at all, laid out by node: joins on it don't move them.
    wanted = few(skew_join(nodes.select("node"), classes.select("node", "key"), ["node"]))
    sets = full_sets(dim_join(texts, wanted, ["key"]).select("node", "text"), shingle)
    sets = cut(sets.dropDuplicates(["node"]), keep_layout=True)

    # Of classes in large buckets: how many of their shingles are rare, and who shares one.
    each = sets.join(nodes.where("large").select("node"), "node").select("node", F.explode("elements").alias("element"))
    rarely = each.groupBy("element").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE)
    rare = cut(skew_join(each, rarely, ["element"]))
    counts = rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare"), F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).alias("own"))
    nodes = cut(few(nodes.join(counts, "node", "left").select("node", "n", "large", "crowds", F.coalesce("rare", F.lit(0)).alias("rare"), F.coalesce("own", F.lit(0)).alias("own"))))
    lists = rare.where("df > 1").groupBy("element").agg(F.array_sort(F.collect_list("node")).alias("of"))  # at most RARE
    lists = lists.select(F.explode("of").alias("a"), "of").select("a", F.explode(F.filter("of", lambda x: x > F.col("a"))).alias("b")).distinct()
    member = cut(few(member.drop("n", "size").join(nodes.drop("own", "crowds"), "node")))
    crowds = nodes.select("node", "crowds")  # joined only to rows that list pairs: with every bucket of a node, these lists would be squared

    def possible(n1: str, n2: str, most: str) -> str:
        """Whether an overlap of at most this may be a link."""
        return f"100 * ({most}) >= {percent} * ({n1} + {n2} - ({most}))"

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The pairs (a, b) whose full sets are similar enough, and their number.

        The set of a travels to that of b; a may be the pivot of many, so that join can be split.
        """
        pairs, n = packed(pairs)
        of_a = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), F.col("elements").alias("ea"))
        left = skew_join(pairs.select("a", F.col("b").alias("node")), of_a, ["a"])
        both = left.join(sets, "node").select("a", F.col("node").alias("b"), F.size("ea").alias("na"), F.size("elements").alias("nb"), F.size(F.array_intersect("ea", "elements")).alias("common"))
        return packed(both.where(possible("na", "nb", "common")).select("a", "b").coalesce(parts_for(n, PAIRS)))

    # What each class meets first: the one with the fewest rare shingles in any of its buckets.
    heads = few(member.groupBy("bucket").agg(F.min(F.struct("rare", "node", "n")).alias("head")))
    first = few(skew_join(member, heads, ["bucket"])).groupBy("node", "n").agg(F.min("head").alias("head"))
    first = few(first).select(F.col("head.node").alias("a"), F.col("node").alias("b"), "n", F.col("head.n").alias("na")).where("a <> b")
    links, n_links = confirmed(first.where(possible("n", "na", "least(n, na)")).select("a", "b"))
    labels = cut(connected_components(links)) if n_links else links.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def grow(pairs: DataFrame) -> None:
        """Check pairs and take their links in."""
        nonlocal labels
        found, n = confirmed(pairs)
        if not n:
            return
        # Components, not classes, are what new links join.
        ends = found
        for x in ("a", "b"):
            ends = ends.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left").coalesce(parts_for(n))
        ends = cut(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct().coalesce(parts_for(n)))
        moved = cut(connected_components(ends))
        alone = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().coalesce(parts_for(n)).join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
        known = labels.unionByName(alone).withColumnRenamed("label", "old")
        labels = cut(few(skew_join(known, moved.select(F.col("node").alias("old"), "label"), ["old"], "left").select("node", F.coalesce("label", "old").alias("label"))))

    def from_lists() -> DataFrame:
        """Pairs of different components that share a rare shingle."""
        side = lambda x: few(nodes.join(labels, "node", "left")).select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), (F.col("n") - F.col("own")).alias(f"m{x}"), F.coalesce("label", "node").alias(f"l{x}"))
        apart = few(few(lists).join(side("a"), "a")).join(side("b"), "b").where("la <> lb")
        return few(apart).where(possible("na", "nb", "least(ma, mb)")).select("a", "b")

    tried, many = None, PIVOTS
    while True:
        at = few(member.join(labels, "node", "left")).select("bucket", "node", "n", "large", "rare", F.coalesce("label", "node").alias("label"))
        groups = few(at.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.min("large").alias("listed")))
        mixed = few(groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("size", "label")).alias("top"), F.min("least").alias("least"), F.min("listed").alias("listed"))).where("labels > 1").drop("labels")
        at = cut(few(skew_join(at, mixed, ["bucket"])))
        # A pivot that shares at most m shingles needs a partner that isn't too large for that.  Rare shingles are
        # listed among classes of large buckets only, so the bound holds where all of a bucket are such.
        hopeful = F.expr(f"not listed or {possible('n', 'greatest(least, n - rare)', 'n - rare')}")
        pivots = at.where(F.col("label") != F.col("top")).where(hopeful)
        if tried is not None:
            pivots = few(pivots.join(tried, ["bucket", "node"], "left_anti"))
        by = Window.partitionBy("bucket").orderBy("rare", "node")
        pivots = few(pivots.withColumn("nth", F.row_number().over(by))).where(F.col("nth") <= many)
        pivots, n_pivots = packed(pivots.select("bucket", F.col("node").alias("p"), F.col("n").alias("np"), F.col("label").alias("lp"), F.col("large").alias("gp"), F.col("rare").alias("rp")))
        if not n_pivots and tried is not None:
            return labels
        of = few(pivots.join(crowds.select(F.col("node").alias("p"), F.col("crowds").alias("cp")), "p")).groupBy("bucket").agg(F.collect_list(F.struct("p", "np", "lp", "gp", "rp", "cp")).alias("pivots"))  # at most so many

        def fits(x: Column) -> Column:
            most = F.when(F.col("large") & x["gp"], F.least(F.col("n") - F.col("rare"), x["np"] - x["rp"])).otherwise(F.least("n", x["np"]))
            # Of the large buckets that two share, only the first lists the pair.
            first = F.coalesce(F.array_min(F.array_intersect("crowds", x["cp"])), F.col("bucket")) == F.col("bucket")
            return (x["lp"] != F.col("label")) & (100 * most >= percent * (F.col("n") + x["np"] - most)) & first

        near = few(skew_join(few(at.join(crowds, "node")), few(of), ["bucket"])).select("node", F.inline(F.transform(F.filter("pivots", fits), lambda x: F.struct(x["p"]))))
        pairs = few(near.select(F.col("p").alias("a"), F.col("node").alias("b")).distinct())
        step = pivots.select("bucket", F.col("p").alias("node"))
        if tried is None:
            pairs, tried = pairs.unionByName(from_lists()), step
        else:
            tried = cut(few(tried.unionByName(step)))
        grow(pairs)
        many = MORE_PIVOTS  # those left are few, and mostly without links


def grouped(rows: DataFrame, shingle: int, percent: int, bands: int, per_band: int) -> DataFrame:
    """rows (doc_id, key, text) without text, with n_shingles and the first (no_id, doc_id, key) of the group; null for an empty set."""
    every = cut(signatures(rows, shingle, bands, per_band))
    usable = every.where("set_hash is not null")
    classes = usable.groupBy("set_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    parts = parts_for(every.count(), WIDE_ROWS)
    classes = classes.coalesce(parts)
    classes = cut(classes.select("set_hash", "first", "n", "bands", "first.key", F.monotonically_increasing_id().alias("node")))  # written, so the numbers are fixed
    labels = link(classes, rows.select("key", "text"), shingle, percent)
    named = cut(skew_join(labels, classes.select("node", "first"), ["node"]).coalesce(parts))
    first = named.groupBy("label").agg(F.min("first").alias("group_first"))
    named = skew_join(named.select("node", "label"), first, ["label"]).select("node", "group_first")
    heads = skew_join(classes.select("set_hash", "node", "first"), named, ["node"], "left").select("set_hash", F.coalesce("group_first", "first").alias("group_first"))
    return skew_join(every.drop("bands"), heads, ["set_hash"], "left").drop("set_hash")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Links documents with ``100 * |A & B| >= percent * |A | B|``; component_id is the smallest id
    that is reachable over links, kept whether that is the row's own.
    """
    out = grouped(with_text(docs, text_col, doc_id=F.col(id_col), key=row_key(id_col, text_col)), shingle, percent, bands, rows)
    component = F.when(F.col("group_first").isNull(), F.col("doc_id")).otherwise(F.col("group_first.doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each group: that of the smallest id (null last), of several with that id the one of the least key.

    Rows of equal id and text are one document, of which any row stays.  Rows without words all stay.
    """
    key, stays = unused(docs, "row_key"), unused(docs, "row_stays")
    all_rows = grouped(with_text(docs, text_col, doc_id=F.col(id_col), key=row_key(id_col, text_col)), shingle, percent, bands, rows).where("group_first is not null")
    marked = all_rows.select("key", (F.col("key") == F.col("group_first.key")).alias("stays")).groupBy("key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times")).where("not stays or times > 1")
    marked, n = packed(marked.select(F.col("key").alias(key), F.col("stays").alias(stays)))
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    out = dim_join(keyed, marked, [key], "left_anti", n)
    again = marked.where(F.col(stays))
    n = again.count()
    if n:  # equal rows: one of each stays
        out = out.unionByName(dim_join(keyed, again, [key], "left_semi", n).dropDuplicates([key]))
    return out.select(*docs.columns)
