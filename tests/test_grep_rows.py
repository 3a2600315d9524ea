"""Work within a row: spans across lines against a plain version, any characters, and texts of very many lines."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.functions.arrays import cut_text, grouped, highest, running
from textquarry.functions.pattern import compile_pattern, spans_in_parts
from textquarry.operators.grep import grep, grep_count, grep_documents, grep_stats, only_matching
from textquarry.plans.queries import QUERIES


def plain(pattern, text, invert=False, before=0, after=0, max_count=None):
    """Lines as {number: (kind, offset, spans, region_continued, text)} by going through all matches; ASCII texts."""
    body = text[:-1] if text.endswith("\n") else text
    lines = body.split("\n")
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    found, last = [], None
    for m in re.finditer(pattern, text):
        a, b = m.span()
        if a == b and (a == last or a == len(text) and text.endswith("\n")):
            continue
        last = b
        found.append((a, b))
    every, found = found, found[:max_count]
    spans = {}
    for a, b in found:
        for i, s in enumerate(starts):
            e = s + len(lines[i])
            if (s <= a <= e) or (s < b and a < s):
                own = (max(a, s), min(b, e))
                spans.setdefault(i, [])
                if own[0] < own[1] or a == b:
                    spans[i].append((own[0] - s, own[1] - s, a < s))
    hits = [i for i in range(len(lines)) if (i in spans) != invert]
    out = {i: ["match", [] if invert else spans[i], not invert and i - 1 in spans] for i in hits}
    for i in hits:
        for j in range(max(0, i - before), min(len(lines), i + after + 1)):
            late = not invert and max_count and len(every) >= max_count and j > max(spans) and re.search(pattern, lines[j])
            out.setdefault(j, ["match" if late else "context", [], False])
    return {i + 1: (k, starts[i], s, c, lines[i]) for i, (k, s, c) in out.items()}


TEXTS = ["a\nb\nc\n", "aa\na", "b\n\nb\n\n\nb", "\n", "x", "ab\nc\nabc\nc\n\na b\n", "a\na\na\na\na\nc\na\nb", "c\n" * 9, "b\nc\nb\nc", "\n\na\n\n"]
CASES = [(r"b\nc", {}), (r"a?\n?", {"before": 1}), (r"\s+", {"after": 2, "max_count": 1}), (r"[^b]+", {"before": 1, "after": 1}), (r"a\n", {"max_count": 2}), (r"b\n*", {"invert": True}), (r"c\n(?:\n|a)", {"invert": True, "after": 1, "max_count": 1}), (r"(?m:^)c", {"before": 2})]


@pytest.mark.parametrize("pattern,options", CASES)
def test_regions(spark, pattern, options):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choices("ab c\n\n", k=rng.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = grep(docs, "text", pattern, ["id"], multiline=True, spans=True, byte_offset=True, column=True, **options).collect()
    got = {i: {} for i in range(len(texts))}
    for r in rows:
        assert r["line_number"] not in got[r["id"]]
        got[r["id"]][r["line_number"]] = (r["kind"], r["byte_offset"], [tuple(s) for s in r["spans"]], r["region_continued"], r["text"])
        assert r["column"] == (r["spans"][0]["start"] + 1 if r["spans"] else 1)
    for i, t in enumerate(texts):
        assert got[i] == plain(pattern, t, **options), (pattern, t)


def test_what_cant_touch_a_line_feed_is_looked_for_by_line(spark):
    docs = spark.createDataFrame([(1, "aa\na")], "id long, text string")
    count = lambda p, **o: [r["n"] for r in grep_count(docs, "text", p, ["id"], multiline=True, **o).collect()]
    assert count("a") == [2] and count("a", matches=True) == [3] and count("[^b]") == [4] and count("a$") == [2]
    feeds = {"a": False, "a.": False, r"\w+": False, r"a\s": True, "[^b]": True, "^a": True, "a$": True, r"\Aa": True, r"a\z": True, r"\ba": False, r"\D": True, r"\p{Cc}": True, r"[\n]": True, "(?s:.)": True, r"\pL": False, "": False}
    for p, touches in feeds.items():
        assert compile_pattern(p, line_mode=False).feeds == touches, p
    assert compile_pattern("a.", line_mode=False, dot_all=True).feeds and compile_pattern("a", line_mode=False, line=True).feeds
    assert [tuple(s) for s in grep(docs, "text", "a", ["id"], multiline=True, spans=True).first()["spans"]] == [(0, 1, False), (1, 2, False)]


ODD = "￿"


@pytest.mark.parametrize("pattern", ["b", "b*", "", "(?:b|c)+", ODD, f"[{ODD}b]*", r"\b", "$"])
def test_any_character_may_stand_in_a_text(spark, pattern):
    texts = [ODD, f"{ODD}b{ODD}", f"b{ODD}{ODD}b", f"a{ODD}bb", "\x00b", "é\U0001f642b", "", "bcb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = compile_pattern(pattern)
    got = {r["id"]: r for r in docs.select("id", p.spans(F.col("text")).alias("spans"), p.all(F.col("text")).alias("all"), p.before_first(F.col("text")).alias("before")).collect()}
    for i, t in enumerate(texts):
        want, last = [], None
        for m in re.finditer(pattern, t):
            if m.end() > m.start() or m.start() != last:
                want.append((len(t[: m.start()].encode()), len(t[: m.end()].encode()), m[0]))
                last = m.end()
        assert [(*s, m) for s, m in zip(got[i]["spans"], got[i]["all"])] == want, (pattern, t)
        assert got[i]["before"] == (t.encode()[: want[0][0]].decode() if want else None)


def test_spans_are_summed_over_batches(spark):
    """Once for all rows of a batch, not by a fold in each row, whose steps copy what they have."""
    plan = QUERIES["grep_spans_empty"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_extract_all(") == 1 and plan.count("aggregate(") == 1
    texts = ["ab cd", None, "", "é12é", " ab", "ab"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    want = {"ab cd": [(0, 2), (3, 5)], None: None, "": [(0, 0)], "é12é": [(0, 0), (2, 2), (3, 3), (4, 4), (6, 6)], " ab": [(0, 0), (1, 3)], "ab": [(0, 2)]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r["id"]: r["s"] and [tuple(s) for s in r["s"]] for r in docs.select("id", compile_pattern("[a-z]*").spans(F.col("t")).alias("s")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(len(texts))] == [want[t] for t in texts]


def test_spans_in_parts_of_a_batch():
    found = pa.array([["ab", "", "cd", ""], None, [], [""], ["x"]] * 3, pa.list_(pa.string()))
    pieces = pa.array([["", "", " ", "", ""], None, ["é"], [""], ["é", ""]] * 3, pa.list_(pa.string()))
    want = [[(0, 2), (3, 5)], None, [], [(0, 0)], [(2, 3)]] * 3
    for most in (1, 2, 5, 1000):
        for a in (0, 2):
            got = spans_in_parts(pieces[a:], found[a:], True, most).to_pylist()
            assert [x if x is None else [(s["start"], s["end"]) for s in x] for x in got] == want[a:]
    assert len(spans_in_parts(pieces[:0], found[:0], True)) == 0


def test_very_many_lines(spark):
    """100 000 lines in one text: each way of asking takes a few seconds, as its work is in proportion to the lines."""
    lines = [f"line {i} {'hit' if i % 7 == 0 else 'miss'}" for i in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "id long, text string").coalesce(1)
    hits = len([x for x in lines if x.endswith("hit")])
    ways = [({"before": 1, "after": 1}, 3 * hits - 1), ({"byte_offset": True}, hits), ({"max_count": 500}, 500), ({"before": 10**6, "after": 10**6, "byte_offset": True}, 100_000), ({"invert": True, "after": 1}, 99_999)]
    for options, n in ways:
        began = time.time()
        found = grep(docs, "text", "hit", ["id"], **options)
        assert found.count() == n and time.time() - began < 15, options
    found = grep(docs, "text", "hit", ["id"], byte_offset=True).orderBy(F.desc("line_number")).first()
    assert found["byte_offset"] == sum(len(x) + 1 for x in lines[: found["line_number"] - 1])
    began = time.time()
    both = grep(docs, "text", r"hit\nline", ["id"], multiline=True, spans=True, before=1)
    assert both.where("kind = 'match'").count() == 2 * hits - (len(lines) % 7 == 1) and time.time() - began < 30
    assert only_matching(docs, "text", r"t\nl", ["id"], multiline=True, column=True).count() == hits - (len(lines) % 7 == 1)


def test_lines_are_matched_once(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "id long, text string")
    for options in ({"before": 1}, {"max_count": 1}, {"byte_offset": True}):
        plan = grep(docs, "text", "[ab]x*", ["id"], **options)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.upper().count("RLIKE") == 1 and plan.count("split(") == 1


def test_sums_and_groups(spark):
    values = list(range(1000)) * 30
    df = spark.createDataFrame([(values,), (values[:128],), (values[:129],), ([],)], "x array<long>")
    for r in df.select("x", running(F.col("x")).alias("r"), grouped(F.transform("x", lambda v: v.cast("long")), lambda v: F.floor(v / 100)).alias("g")).collect():
        total, want = 0, []
        for v in r["x"]:
            want.append(total)
            total += v
        assert r["r"] == want and sum(r["g"], []) == r["x"] and all(len({v // 100 for v in g}) == 1 for g in r["g"])


def test_greatest_before_and_pieces(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 10**6) for _ in range(20_000)]
    df = spark.createDataFrame([(values,), (values[:3],), ([],)], "x array<long>")
    for r in df.select("x", highest(F.col("x")).alias("h")).collect():
        assert r["h"] == [max(r["x"][:i], default=0) for i in (range(len(r["x"])) if len(r["x"]) < 9 else [])] or len(r["h"]) == 20_000 and r["h"][-1] == max(values[:-1]) and r["h"][1] == values[0]
    text = "aé\U0001f642\n" * 3000
    at = [(0, 3), (3, 3), (1020, 1030), (1024, 2048), (2048, 2049), (4000, 9999), (11_990, 12_000)]
    row = spark.createDataFrame([(text, at)], "t string, r array<struct<start:long,end:long>>").select(cut_text(F.col("t"), F.col("r")).alias("p")).first()
    assert row["p"] == [text[a:b] for a, b in at]


def test_documents_and_stats(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a\n"), (3, ""), (4, None), (5, "b\nb\n")], "id long, text string")
    ids = lambda p, **o: sorted(r["id"] for r in grep_documents(docs, "text", p, ["id"], multiline=True, **o).collect())
    assert ids(r"a\nb") == [1] and ids(r"a\nb", without=True) == [2, 3, 4, 5] and ids(r"a\s?\z") == [2] and ids(r"\z") == [1] and ids("a") == [1, 2]
    assert ids(r"b\n", invert=True) == [1, 2] and ids("b", invert=True) == [1, 2] and ids(r"a\n", invert=True) == [1, 5]
    assert tuple(grep_stats(docs, "text", r"b\n", ["id"], multiline=True).first()) == (5, 1, 2, 2, 9)
