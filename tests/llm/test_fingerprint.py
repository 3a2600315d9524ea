"""Digests against a plain version, neighbours against a sort, and what likeness has to tell apart."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from textquarry.llm import fingerprint
from textquarry.llm.oracle import ORACLE
from textquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_digest(text):
    data, count = text.encode(), [0] * 256
    for i in range(len(data) - 2):
        v = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
        count[v * 2654435761 % 2**32 >> 24] += 1
    edges = [sorted(count)[i] for i in (63, 127, 191)]
    bits = "".join(f"{sum(c > e for e in edges):02b}" for c in count)
    n = 0
    while len(data) ** 4 >= 2**n:
        n += 1
    return f"{int(bits, 2):0128x}{n:02x}"


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "abcabcabc", "é漢🙂" * 9, "lorem ipsum dolor " * 50, "x" * 5000])
def test_digest(text, monkeypatch):
    want = plain_digest(text)
    assert fingerprint.digest(text.encode()) == want
    monkeypatch.setattr(fingerprint, "BLOCK", 4)
    assert fingerprint.digest(text.encode()) == want
    assert fingerprint.likeness(want, want) == 1


def test_bounds():
    rng = random.Random(5)
    some = [fingerprint.digest(bytes(rng.choices(range(97, 123), k=n))) for n in (0, 1, 3, 40, 400, 400, 4000)]
    for a in some:
        for b in some:
            far, bound = fingerprint.difference(a, b)
            assert 0 <= far <= bound and 0 <= fingerprint.likeness(a, b) <= 1 and fingerprint.likeness(a, b) == fingerprint.likeness(b, a)
    assert fingerprint.likeness(some[0], some[5]) == 0


def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q]
        own, other = fingerprint.digest(text.encode()), fingerprint.digest(new.encode())
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, fingerprint.likeness(own, other), fingerprint.likeness(own, fingerprint.digest(after.encode()))))
    return sorted(out, key=repr)


ROWS = [(5, "five five five five"), (1, "one"), (None, None), (3, ""), (3, "three 漢字 three"), (3, "three 漢字 three"), (None, "null id"), (-2, "minus two"), (9, "x" * 40)]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [], ROWS * 20])
@pytest.mark.parametrize("parts", ["1", "5"])
def test_neighbours(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, first int").repartition(3)
        assert sorted((tuple(r) for r in fingerprint.with_next(docs).collect()), key=repr) == plain_next(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sql(spark):
    assert same(spark, QUERIES["op13_fingerprint"], ORACLE["op13_fingerprint"], SF)


def test_an_edited_text_is_nearer_than_the_next(spark):
    rows = [r for r in QUERIES["op13_fingerprint"](spark, SF).collect() if r["n_chars"] >= 40]
    assert all(r["near_edited"] > r["near_next"] or r["near_edited"] == 1 for r in rows)


def test_columns(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("b", None)], "doc_id string, text string")
    both = fingerprint.fingerprints(docs).withColumn("no", F.lit(None).cast("string"))
    got = {r["doc_id"]: r for r in both.select("*", fingerprint.likeness_of("fingerprint", "fingerprint").alias("same"), fingerprint.likeness_of("fingerprint", "no").alias("none")).collect()}
    assert got["a"]["fingerprint"] == plain_digest("one two three") and got["b"]["fingerprint"] == plain_digest("")
    assert all(r["same"] == 1 and r["none"] is None for r in got.values())
