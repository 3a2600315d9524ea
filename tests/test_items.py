"""A growing item set, streams, printing, and ranking by any key."""

import pytest
from pyspark.sql import functions as F

from textquarry.operators import fuzzy, grep
from textquarry.operators.items import ItemIndex
from textquarry.streaming import grep_stream


def test_search_sees_the_items_of_its_beginning(spark):
    index = ItemIndex(spark)
    assert index.search("a").count() == 0 and index.size == 0
    assert index.add(spark.createDataFrame([(x,) for x in ("abc", None, "xbx")], "item string").coalesce(1)) == 3
    before = index.search("b")
    index.add(spark.createDataFrame([("b",), ("ab",)], "t string").repartition(2), "t")
    assert index.size == 5 and sorted(r["index"] for r in index.items().collect()) == [0, 1, 2, 3, 4]
    assert {r["item"] for r in before.collect()} == {"abc", "xbx"}
    assert [r["item"] for r in index.search("^b$").collect()] == ["b"] and index.item(1) == "" and index.item(0) == "abc"
    with pytest.raises(IndexError):
        index.item(5)
    index.clear()
    assert index.size == 0 and index.items().count() == 0


def test_keys_and_indices_of_any_name(spark):
    df = spark.createDataFrame([(2, "x", "éab"), (1, "b", "zb")], "score int, _item string, rank0 string")
    got = fuzzy.fuzzy_rank(df, F.upper("rank0"), "b", "score", positions=True)
    assert [tuple(r["positions"]) for r in got.collect()] == [(1,), (3,)]
    shown = fuzzy.fuzzy_rank(df.select(F.col("score").alias("i"), F.col("rank0").alias("t")), "t", "b", "i", positions=True)
    assert [list(r[0]) for r in shown.select(fuzzy.char_indices(F.col("t"), F.col("positions"))).collect()] == [[1], [2]]
    assert [r["value"] for r in fuzzy.printed(shown, "t", debug=True).collect()] == ["16\t[1]\tzb", "16\t[3]\téab"]
    assert [r["d"]["text"] for r in shown.select(fuzzy.display(F.col("t"), F.col("positions")).alias("d")).collect()] == ["zb", "éab"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a\nx\nb"), (1, "x")], "id long, t string").write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: grep_stream(spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in")), "t", "x", ["id"], str(tmp_path / "out"), str(tmp_path / "state"), before=1, byte_offset=True).awaitTermination()
    run()
    spark.createDataFrame([(2, "x"), (3, None)], "id long, t string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["id"], r["line_number"], r["kind"]) for r in got.collect()) == [(1, 1, "context"), (1, 1, "match"), (1, 2, "match"), (2, 1, "match")]


def test_printed_matches(spark):
    df = spark.createDataFrame([("a-b", "x x"), ("a/c", "éx")], "path string, t string")
    lines = lambda d: [r["value"] for r in d.collect()]
    assert lines(grep.printed_matches(grep.only_matching(df, "t", "x", ["path"], column=True), "path")) == ["a/c:1:3:x", "a-b:1:1:x", "a-b:1:3:x"]
    assert lines(grep.printed_matches(grep.vimgrep(df, "t", "x", ["path"]), "path", "text")) == ["a/c:1:3:éx", "a-b:1:1:x x", "a-b:1:3:x x"]
    found = spark.createDataFrame([("b", 5)], "path string, binary_offset long")
    assert lines(grep.binary_notices(found)) == ['b: binary file matches (found "\\0" byte around offset 5)']
