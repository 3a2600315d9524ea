"""Item sets of several sessions, streams that run a batch again, searches from SQL, and searches that are ended."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from textquarry import streaming
from textquarry.cancellation import Cancellation, Cancelled
from textquarry.functions import table
from textquarry.operators import items
from textquarry.operators.items import ItemIndex


def words(spark, *some):
    return spark.createDataFrame([(x,) for x in some], "item string").coalesce(1)


def test_one_set_for_two_sessions(spark, tmp_path):
    path = str(tmp_path / "set")
    one, two = ItemIndex(spark, path), ItemIndex(spark.newSession(), path)
    assert one.add(words(spark, "a", "b")) == 2 and two.size == 2
    assert two.add(words(two.spark, "c")) == 3 and one.item(2) == "c" and two.item(0) == "a"
    assert [r["item"] for r in one.items(begin=1, end=3).orderBy("index").collect()] == ["b", "c"]
    assert len(one.items(begin=2).inputFiles()) < len(one.items().inputFiles())
    assert ItemIndex(spark, path).size == 3
    before = one.search("a")
    two.clear()
    assert one.size == 0 and before.count() == 1


def test_writers_at_once(spark, tmp_path):
    path, errors = str(tmp_path / "set"), []

    def write(k):
        try:
            index = ItemIndex(spark, path)
            for i in range(3):
                index.add(words(spark, f"{k}-{i}", f"{k}-{i}+"))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = ItemIndex(spark, path).items().collect()
    assert not errors and sorted(r["index"] for r in got) == list(range(18)) and len({r["item"] for r in got}) == 18
    place = {r["item"]: r["index"] for r in got}
    assert all(place[f"{k}-{i}+"] == place[f"{k}-{i}"] + 1 for k in range(3) for i in range(3))


def test_compaction(spark, tmp_path, monkeypatch):
    index = ItemIndex(spark, str(tmp_path / "set"))
    monkeypatch.setattr(items, "MOST_PARTS", 2)
    for x in "abc":
        index.add(words(spark, x))
    assert len(index.state()["parts"]) == 1 and [r["item"] for r in index.items().orderBy("index").collect()] == ["a", "b", "c"]
    index.vacuum()
    assert index.item(1) == "b" and len(index.log.names(f"{index.base}/data")) == 1 and index.add(words(spark, "d")) == 4


def test_a_batch_that_runs_again(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda *rows: spark.createDataFrame(rows, "id long, t string").write.mode("append").parquet(source)
    seen, fail = [], [True]

    def visit(lines, n):
        seen.append((n, sorted((r["id"], r["text"]) for r in lines.collect())))
        if n == 1 and fail:
            fail.clear()
            raise RuntimeError("lost")

    run = lambda: streaming.visit_stream(spark.readStream.schema("id long, t string").parquet(source), "t", "x", ["id"], path, str(tmp_path / "state"), visit, max_lines=3).awaitTermination()
    add((1, "x1\nx2"), (2, "no"))
    run()
    add((1, "x3\nx4"), (2, "x5"))
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert seen == [(0, [(1, "x1"), (1, "x2")]), *[(1, [(1, "x3"), (2, "x5")])] * 2]
    assert sorted((r["id"], r["text"]) for r in spark.read.parquet(f"{path}/lines").collect()) == [(1, "x1"), (1, "x2"), (1, "x3"), (2, "x5")]
    add((1, "x6"), (None, "x7"))
    run()
    assert seen[-1] == (2, [(None, "x7")])


def test_table_function(spark):
    table.register(spark)
    spark.createDataFrame([(1, "é ab\nxabab\n"), (2, None), (3, "AB")], "id long, t string").createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT id, f.* FROM some_texts, LATERAL search_lines(t, 'ab') f").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 3, 5, "é ab"), (1, 2, 1, 3, "xabab"), (1, 2, 3, 5, "xabab")]
    assert spark.sql("SELECT id FROM some_texts, LATERAL search_lines(t, 'A*', case => 'ignore') WHERE id = 3").count() == 2
    with pytest.raises(Exception, match="repeat has nothing"):
        spark.sql("SELECT * FROM some_texts, LATERAL search_lines(t, '*a')").collect()


def test_a_search_that_is_ended(spark):
    @F.udf("boolean")
    def slow(x):
        time.sleep(0.5)
        return True

    token, ended = Cancellation(spark), []

    def work():
        try:
            token.run(spark.range(0, 400, 1, 4).where(slow("id")).collect)
        except Cancelled:
            ended.append(time.time())

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(3)
    began = time.time()
    token.cancel()
    thread.join(20)
    assert ended and ended[0] - began < 10 and token.cancelled
    with pytest.raises(Cancelled):
        token.run(spark.range(1).collect)
    assert Cancellation(spark).run(spark.range(3).count) == 3 and spark.range(5).count() == 5
