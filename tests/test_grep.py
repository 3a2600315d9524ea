"""Search over rows: awkward ids, whole texts, and files."""

import pytest

from textquarry.operators import grep as g
from textquarry.sources.files import binary_matches, find_files, read_files, read_items, search_files, search_tree


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_of_one_id_are_apart(spark):
    df = spark.createDataFrame([(1, "a\nx\nb"), (1, "c\nx\nd"), (None, "x"), (2, None), (3, "")], "id long, t string")
    got = [(r["id"], r["kind"], r["line_number"], r["byte_offset"], r["text"]) for r in g.grep(df, "t", "x", ["id"], before=1, byte_offset=True).collect()]
    assert sorted(got, key=repr) == sorted([(1, "context", 1, 0, "a"), (1, "match", 2, 2, "x"), (1, "context", 1, 0, "c"), (1, "match", 2, 2, "x"), (None, "match", 1, 0, "x")], key=repr)
    assert "Exchange" not in g.grep(df, "t", "x", ["id"], before=1, max_count=1, byte_offset=True)._jdf.queryExecution().executedPlan().toString()


def test_any_names_of_ids(spark):
    df = spark.createDataFrame([("k", "a\nx")], "text string, selected string")
    got = g.grep(df, "selected", "x", ["text"], after=1)
    assert got.columns == ["text", "kind", "line_number", "_text"] and rows(got) == [("k", "match", 2, "x")]
    df = spark.createDataFrame([("x", "k", 1, "m")], "t string, kind string, n int, nth string")
    assert g.grep(df, "t", "x", ["kind", "n"]).columns == ["kind", "n", "_kind", "line_number", "text"]
    assert rows(g.grep_count(df, "t", "x", ["n"])) == [(1, 1)] and g.only_matching(df, "t", "x", ["nth"]).columns == ["nth", "line_number", "_nth", "match"]


def test_folded_letters(spark):
    df = spark.createDataFrame([(1, "a\n\u017ftrea\u212a"), (2, "STREAk"), (3, "x"), (4, None)], "id long, t string")
    assert rows(g.grep(df, "t", "Streak", ["id"], case="ignore").select("id", "line_number")) == [(1, 2), (2, 1)]


def test_limits(spark):
    df = spark.createDataFrame([(1, "x\nx\na\nx x\nb")], "id long, t string")
    assert rows(g.grep(df, "t", "x", ["id"], max_count=2, after=2).select("line_number", "kind")) == [(1, "match"), (2, "match"), (3, "context"), (4, "match")]
    assert rows(g.vimgrep(df, "t", "x", ["id"])) == [(1, 1, 1, "x"), (1, 2, 1, "x"), (1, 4, 1, "x x"), (1, 4, 3, "x x")]
    assert [len(r["spans"]) for r in g.grep(df, "t", "x", ["id"], spans=True, max_spans_per_line=1).collect()] == [1, 1, 1]
    assert rows(g.grep_hits(df.selectExpr("'p' as path", "t"), "t", "x", "path", max_results=2)) == [("p", 1, 1, "x"), ("p", 2, 1, "x")]


TEXT = "alpha one\nbeta two\ngamma\nfour\nfive six\nalpha\nbeta\n"
MULTI = [(r"alpha.*\nbeta", {}, [1, 2, 6, 7]), (r"ta\s", {}, [2, 7]), (r"alpha.*\nbeta", {"invert": True}, [3, 4, 5]), (r"ta\s", {"max_count": 1}, [2]), (r"ta\s", {"invert": True, "max_count": 1}, [1, 3, 4, 5, 6, 7]), ("four.*six", {}, []), ("four.*six", {"multiline_dotall": True}, [4, 5]), (r"\Aal", {}, [1]), ("^gamma$", {}, [3]), ("$", {}, [1, 2, 3, 4, 5, 6, 7])]


@pytest.mark.parametrize("pattern,how,want", MULTI)
def test_multiline(spark, pattern, how, want):
    df = spark.createDataFrame([(1, TEXT)], "id long, t string")
    got = g.grep(df, "t", pattern, ["id"], multiline=True, **how).collect()
    assert sorted(r["line_number"] for r in got) == want
    assert all(r["text"] == TEXT.split("\n")[r["line_number"] - 1] for r in got)


def test_multiline_counts(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "none")], "id long, t string")
    assert rows(g.grep_count(df, "t", r"alpha.*\nbeta", ["id"], multiline=True)) == [(1, 2)]
    assert rows(g.grep_count(df, "t", r"alpha.*\nbeta", ["id"], multiline=True, invert=True)) == [(1, 3), (2, 1)]
    assert rows(g.only_matching(df, "t", r"ha\nbeta|ix", ["id"], multiline=True)) == [(1, 5, 1, "ix"), (1, 6, 2, "ha\nbeta")]
    assert [r["line_number"] for r in g.grep(df, "t", "five", ["id"], multiline=True, before=1).collect()] in ([4, 5], [5, 4])


def test_crlf(spark):
    df = spark.createDataFrame([(1, "one\r\ntwo\r\n")], "id long, t string")
    assert rows(g.grep(df, "t", "one$", ["id"])) == []
    assert [r["line_number"] for r in g.grep(df, "t", "^two$", ["id"], crlf=True).collect()] == [2]
    assert [r["line_number"] for r in g.grep(df, "t", "two", ["id"], crlf=True, line=True).collect()] == [2]


def test_risky_patterns(spark):
    df = spark.createDataFrame([(1, "abac\nx\n"), (2, "ab" * 9000 + "d")], "id long, t string")
    p = "^(?:ab|a)*c"
    assert rows(g.grep(df, "t", p, ["id"], after=1)) == [(1, "context", 2, "x"), (1, "match", 1, "abac")]
    assert rows(g.grep_count(df, "t", p, ["id"])) == [(1, 1)] and rows(g.grep_documents(df, "t", p, ["id"], without=True)) == [(2,)]
    assert rows(g.only_matching(df, "t", p, ["id"])) == [(1, 1, 1, "abac")]
    assert g.grep_stats(df, "t", p, ["id"]).first()["matches"] == 1


def files(root):
    for name, data in {"plain.txt": b"hello\nworld\n", "bom.txt": b"\xef\xbb\xbfhello", "le.txt": "\ufeffhell\U0001f600o\nx hello".encode("utf-16-le"), "be.txt": "\ufeffhello".encode("utf-16-be"), "odd.txt": b"\xff\xfea\x00\x00\xd8x", "bin.dat": b"hello\nab\0c hello\nhello\n", "latin.txt": b"caf\xe9 hello\n", "empty.txt": b"", "sub/big.txt": b"hello " * 100}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_files(spark, tmp_path):
    root = files(tmp_path)
    paths = spark.createDataFrame([(p,) for p in ("plain.txt", "bom.txt", "le.txt", "be.txt", "odd.txt", "bin.dat", "latin.txt", "empty.txt", "sub/big.txt", "sub", "gone", None)], "path string")
    got = {r["path"]: r for r in read_files(paths, root=root, max_filesize=200).collect()}
    assert got["bom.txt"]["text"] == got["be.txt"]["text"] == "hello" and got["odd.txt"]["text"] == "a\ufffd\ufffd" and got["latin.txt"]["text"] == "caf\ufffd hello\n"
    assert got["sub"]["error"] == "is a directory" and got["gone"]["error"] == "cannot open file" and got["sub/big.txt"]["text"] is None and got["sub/big.txt"]["error"] is None
    hit = rows(search_files(paths, "hello", root=root, max_filesize=200).select("path", "line_number"))
    assert hit == [("be.txt", 1), ("bin.dat", 1), ("bom.txt", 1), ("latin.txt", 1), ("le.txt", 2), ("plain.txt", 1)]
    assert ("bin.dat", 3) in rows(search_files(paths, "hello", root=root, binary="text").select("path", "line_number"))
    assert rows(binary_matches(paths, "^c hello$", root=root)) == [("bin.dat", 8)] and rows(binary_matches(paths, "^hello$", root=root)) == [("bin.dat", 8)]


def test_tree(spark, tmp_path):
    root = files(tmp_path)
    (tmp_path / ".gitignore").write_text("le.txt\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".ignore").write_text("sub/\n")
    got = rows(search_tree(spark, root, "hello").select("path").distinct())
    assert got == [(x,) for x in ("be.txt", "bin.dat", "bom.txt", "latin.txt", "plain.txt")]
    assert rows(search_tree(spark, f"{root}/plain.txt", "wor").select("path", "line_number")) == [("plain.txt", 2)]
    assert [r["path"] for r in find_files(spark, root, "txt pl").collect()] == ["plain.txt"]
    assert "sub/big.txt" in [r["path"] for r in find_files(spark, root, "", ignore_files=False).collect()]


def test_items(spark, tmp_path):
    (tmp_path / "n").write_bytes(b"a b\nc\0d\0")
    assert rows(read_items(spark, str(tmp_path / "n"), null_separated=True)) == [("a b\nc",), ("d",)]
    assert rows(read_items(spark, str(tmp_path / "n"))) == [("a b",), ("c\0d\0",)]
