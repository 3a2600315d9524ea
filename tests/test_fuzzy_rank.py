"""Ranks of fuzzy matches: an alignment by plain recursion, and orders worked out by hand."""

import random

import numpy as np
import pandas as pd
import pytest

from textquarry.functions import alignment, runes
from textquarry.functions.fields import parse_nth, splitter
from textquarry.operators.fuzzy import Ranking, fuzzy_rank, parse
from textquarry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_recursion(item: str, term: str, scheme: str) -> int | None:
    """Best score of a lower-case ASCII term, one cell at a time; a cell is (height, run length, whether a gap is open)."""
    white, delimiter, delimiters, start = alignment.SCHEMES[scheme]
    kinds = [runes.class_of(c, delimiters) for c in item]
    bonus = [int(alignment.bonuses(white, delimiter)[a, b]) for a, b in zip([start, *kinds], kinds)]
    low, cells, since = item.lower(), None, -1
    for i, c in enumerate(term):
        since = low.find(c, since + 1)
        if since < 0:
            return None
        row, last = {}, (0, 0, False)
        for j in range(since, len(item)):
            skip = last[0] + (-1 if last[2] else -3)
            fit, run = 0, 0
            if low[j] == c and i == 0:
                fit, run = 16 + 2 * bonus[j], 1
            elif low[j] == c:
                above = cells.get(j - 1, (0, 0, False))
                run, gain = above[1] + 1, bonus[j]
                if run > 1:
                    first = bonus[j - run + 1]
                    if gain >= 8 and gain > first:
                        run = 1
                    else:
                        gain = max(gain, 4, first)
                fit = above[0] + 16 + gain
                if fit < skip:
                    fit, run = above[0] + 16 + bonus[j], 0
            height = fit if i == 0 and run else max(fit, skip, 0)
            last = (height, run, (low[j] != c) if i == 0 else fit < skip)
            row[j] = last
        cells = row
    return max(h for h, _, _ in cells.values())


@pytest.mark.parametrize("scheme", ["default", "path", "history"])
def test_scores_equal_recursion(scheme):
    draw = random.Random(5)
    items = ["".join(draw.choices("abAB/_ -1.", k=draw.randint(1, 30))) for _ in range(1500)]
    for term in ("ab", "aba", "a1b", "b/a", "aab_b"):
        want = [by_recursion(x, term, scheme) for x in items]
        got: list = [None] * len(items)
        for index, hit, score, _, _ in Ranking(scheme).run(items, parse(term)):
            for i, h, s in zip(index, hit, score):
                got[i] = int(s) if h else None
        assert got == want


def test_long_terms_and_items_fall_back():
    item = "x" * 30000 + "/ab_cd" + "y" * 30000
    (_, hit, score, _, places), = Ranking().run([item], parse("abcd"), places=True)
    assert hit.all() and places[0].tolist() == [30001, 30002, 30004, 30005]
    assert score[0] == 16 * 4 + 9 * 2 + 9 - 3 + 8 + 8


def order(spark, items, query, ranking=Ranking(), **options):
    df = spark.createDataFrame(list(enumerate(items)), "i long, item string")
    return [r.item for r in fuzzy_rank(df, "item", query, "i", ranking=ranking, **options).collect()]


def test_orders(spark):
    assert order(spark, ["xfooxx", "a/foo", "foo", None, "fxoxo", ""], "foo") == ["foo", "a/foo", "fxoxo", "xfooxx"]  # 62 and 56
    assert order(spark, ["b", "a", ""], "") == ["b", "a", ""]
    assert order(spark, ["b", "a", "b"], "!a", tac=True) == ["b", "b"]
    assert order(spark, ["foo/x", "x/foo"], "foo", Ranking("path")) == ["x/foo", "foo/x"]
    assert order(spark, ["café", "CAFE", "cafx"], "cafe") == ["café", "CAFE"]
    assert order(spark, ["café", "cafe"], "café") == ["café"]
    assert order(spark, ["a b", "b a"], "b", Ranking(nth="1")) == ["b a"]
    assert order(spark, ["foo_bar", "foo bar", "foobar"], "'foo'") == ["foo bar", "foo_bar"]
    assert order(spark, [], "a") == []


def test_positions_are_bytes_and_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "éab", 7)], "i long, item string, score int")
    row = fuzzy_rank(df, "item", "b", "i", positions=True).first()
    assert list(row.positions) == [3] and row.score == 16


def test_fields():
    assert parse_nth("2,..-2,3..,-1,..") == [(2, 2), (1, -2), (3, -1), (-1, -1), (1, -1)]
    for bad in ("", "0", "1..0", "x", "-1..2", "1,"):
        with pytest.raises(ValueError):
            parse_nth(bad)
    assert splitter("2,1", "/")("a/bc/d") == [(2, 5), (0, 1)]
    assert splitter("1,-1", None)("  ab  c ") == [(2, 6), (6, 8)]
    assert splitter("5", "/")("a/b") == [(0, 0)]
    assert splitter("2..", "[/.]")("a/b.c.") == [(2, 5)]


@pytest.mark.parametrize("name", ["fuzzy_rank", "fuzzy_rank_path", "fuzzy_rank_chunk_end", "fuzzy_rank_nth", "fuzzy_rank_greedy"])
def test_ranked_queries_in_smaller_blocks(spark, name, monkeypatch):
    """Rows come in rank order and don't depend on how items fall into blocks."""
    got = QUERIES[name](spark, SF).toPandas()
    keys = got[["rank3", "rank2", "rank1", "rank0", "page_id"]].values.tolist()
    assert len(got) and keys == sorted(keys)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    again = QUERIES[name](spark, SF).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(got, again)


def test_plain_letters():
    plain = runes.plain_letters()
    assert runes.plain_text("ÅéßøŁłſǎ") == "AesoŁlsa" and plain["Ａ"] == "A"
    assert "ấ" not in plain and "Ā" not in plain
    assert np.array_equal(runes.plain_table(128), np.arange(128))


def test_items_are_scored_once_and_a_limit_stays_a_top_k(spark):
    plan = QUERIES["fuzzy_top"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[align(") == 1 and "TakeOrderedAndProject" in plan and "Exchange" not in plan


@pytest.mark.parametrize("ranking", [Ranking(), Ranking("history", tiebreak=("begin", "end", "pathname")), Ranking(tiebreak=("chunk", "end"), greedy=True)])
def test_native_fits_equal_whole_blocks(spark, ranking):
    """Columns and the block-wise version say the same of every item."""
    draw = random.Random(21)
    letters = "abAB/_ -1.,\\\u00e9\u00c9\u6f22\t\u00a0\U0001f642İσΣ"
    items = ["".join(draw.choices(letters, k=draw.randint(0, 14))) for _ in range(700)] + ["", " ", "ab", "_ab_", " ab ", "ab ab", "aab", "a/ab", "AB_ab-ab", "1ab1", "漢ab"]
    df = spark.createDataFrame(list(enumerate(items)), "i long, item string").coalesce(2)
    some = ("'ab", "^a", "^ab$", "b$", "'σ") if ranking == Ranking() else ("!ab", "!a | 'b | ^é")
    for query in (*some, "'ab'", "'é !b$ a"):
        sets = parse(query)
        got = {r["i"]: (r["score"], r["rank3"], r["rank2"], r["rank1"], r["rank0"]) for r in fuzzy_rank(df, "item", query, "i", ranking=ranking).collect()}
        want = {}
        for index, hit, score, ranks, _ in ranking.run(items, sets):
            want.update({int(i): (int(s), *map(int, r)) for i, h, s, r in zip(index, hit, score, ranks) if h})
        assert got == want, (query, next((items[i], got.get(i), want.get(i)) for i in range(len(items)) if got.get(i) != want.get(i)))


@pytest.mark.parametrize("name", ["fuzzy_rank_prefix", "fuzzy_rank_equal", "fuzzy_rank_inverse"])
def test_terms_that_need_no_alignment_are_native(spark, name):
    assert "Python" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
