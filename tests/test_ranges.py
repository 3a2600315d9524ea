"""Files searched by ranges give the rows of files searched whole."""

import random

import pytest

from textquarry.sources.files import search_files
from textquarry.sources.ranges import search_ranges


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("ranges"), random.Random(12)
    line = lambda: "".join(rng.choices("ab é\U0001f642", [6, 6, 3, 1, 1], k=rng.choice([0, 1, 3, 9, 70])))
    for i in range(4):
        text = "\n".join(line() for _ in range(rng.randint(1, 40))) + "\n" * rng.randint(0, 1)
        (root / f"f{i}").write_bytes(text.encode())
    (root / "mark").write_bytes(b"\xef\xbb\xbf" + b"ab\nx\nab\n" * 9)
    (root / "wide").write_bytes(b"\xff\xfe" + "ab\ncé\nab ab\n".encode("utf-16-le") * 5)
    (root / "nul").write_bytes(b"ab\nb\nab\n" * 4 + b"a\0b\nab\n" + b"ab\n" * 9)
    (root / "bad").write_bytes(b"\xffab\n\xe9\nab\xf0\x9f\n" * 6)
    (root / "empty").write_bytes(b"")
    return root


WAYS = [({"before": 2, "after": 1, "byte_offset": True, "spans": True}, 5), ({"max_count": 3, "after": 2}, 40), ({"max_count": 4, "before": 1, "invert": True}, 9), ({"binary": "text", "column": True}, 90)]


@pytest.mark.parametrize("options,size", WAYS)
def test_ranges_equal_whole_files(spark, tree, options, size):
    paths = spark.createDataFrame([(p.name,) for p in tree.iterdir()] + [("missing",), (None,)], "path string").coalesce(2)
    rows = lambda found: sorted(map(tuple, found.collect()), key=repr)
    want = rows(search_files(paths, "ab", root=str(tree), **options))
    assert rows(search_ranges(paths, "ab", root=str(tree), range_bytes=size, **options)) == want
    assert {r[0] for r in want} >= {"mark", "wide", "nul", "bad"}


def test_one_large_file_is_dealt_over_tasks(spark, tmp_path):
    (tmp_path / "big").write_text("".join(f"line {i}{' hit' if i % 1000 == 0 else ''}\n" for i in range(60_000)))
    paths = spark.createDataFrame([("big",)], "path string")
    found = search_ranges(paths, "hit", root=str(tmp_path), range_bytes=1 << 17, byte_offset=True, max_count=50)
    assert found.rdd.getNumPartitions() > 4
    assert [r["line_number"] for r in found.orderBy("line_number").collect()] == [i * 1000 + 1 for i in range(50)]
