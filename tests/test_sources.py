import os

from textquarry.operators.grep import grep, printed
from textquarry.sources.walk import list_files, walk


def tree(root):
    for path in ("a.txt", "b/c.txt", "b/d/e.txt", ".hid/x", "b-x/f", "Z"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x\n")
    os.symlink(root / "b", root / "b" / "d" / "up")
    os.symlink(root / "nowhere", root / "gone")
    return str(root)


def paths(df, kind=None):
    return sorted(r.path for r in df.collect() if kind in (None, r.type))


def test_files_in_byte_order(spark, tmp_path):
    assert [r.path for r in list_files(spark, tree(tmp_path)).collect()] == ["Z", "a.txt", "b-x/f", "b/c.txt", "b/d/e.txt"]


def test_walk_options(spark, tmp_path):
    root = tree(tmp_path)
    assert paths(walk(spark, root), "directory") == ["b", "b-x", "b/d"]
    assert paths(walk(spark, root), "symlink") == ["b/d/up", "gone"]
    assert paths(walk(spark, root, follow_symlinks=True), "symlink") == ["gone"]
    assert "b/d/up" not in paths(walk(spark, root, follow_symlinks=True))
    assert ".hid/x" in paths(walk(spark, root, hidden=True, partitions=2))
    assert paths(walk(spark, root, max_depth=1)) == ["Z", "a.txt", "b", "b-x", "gone"]
    assert paths(walk(spark, root, max_depth=0)) == []


def test_odd_roots(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "f").write_text("abc")
    assert walk(spark, str(tmp_path / "empty")).count() == 0
    row, = walk(spark, str(tmp_path / "f")).collect()
    assert (row.path, row.type, row.depth, row.size, row.error) == ("f", "file", 0, 3, None)
    row, = walk(spark, str(tmp_path / "missing")).collect()
    assert row.type is None and row.error


def test_printed(spark):
    df = spark.createDataFrame([("a-b/x", "k\n"), ("a/x", "k\nl\nm\nn\no\nk\n"), ("a", "none")], "path string, text string")
    assert [r.value for r in printed(grep(df, "text", "k", ["path"]), "path").collect()] == ["a/x:1:k", "a/x:6:k", "a-b/x:1:k"]
    assert [r.value for r in printed(grep(df, "text", "k", ["path"], after=1), "path").collect()] == ["a/x:1:k", "a/x-2-l", "--", "a/x:6:k", "a-b/x:1:k"]
