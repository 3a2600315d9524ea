"""Alignment against a plain version that goes through tokens one by one."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import token_alignment
from textquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "one", "  two  spaces", "▁marked", "a\x00b\n\n\tc", "<|endoftext|> <s> </s> <unk>", "naïve ﬁn 漢字 🙂🙂 é", "﻿x　y", "7a" * 300, "x" * 5000 + " " * 3000 + "é" * 500, "one", "￿ ok"]


def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    files = token_alignment.Pair()
    a, b = Tokenizer.from_file(files.a), sentencepiece.SentencePieceProcessor(model_file=files.b)
    a.encode_special_tokens = True
    with open(files.a) as file:
        vocab = {i: k for k, i in json.load(file)["model"]["vocab"].items()}
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printed]
    byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(rest)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in vocab[i]), b.encode, piece


def plain(texts):
    """For each text its numbers and groups."""
    encode_a, bytes_a, encode_b, bytes_b = tools()
    found, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = encode_a(text), encode_b(text)
            if b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == b" " + text.encode():
                at, ends = [0, 0], [{}, {}]
                for side, (ids, spell) in enumerate(((a, bytes_a), (b, bytes_b))):
                    for n, i in enumerate(ids, 1):
                        at[side] += len(spell(i))
                        ends[side][at[side]] = n
                last = (0, 0)
                for end in sorted(ends[0].keys() & ends[1].keys()):
                    here = (ends[0][end], ends[1][end])
                    groups.append((a[last[0] : here[0]], b[last[1] : here[1]]))
                    last = here
        found.append(groups)
        counts.update({(x, y) for g in groups for x in set(g[0]) for y in set(g[1])})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for groups in found:
        links = Counter()
        for x, y in groups:
            one, two = Counter(x), Counter(y)
            links.update({(i, j): n * m for i, n in one.items() for j, m in two.items()})
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in links.items()), text))
    return out, counts


def test_awkward_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, groups string").repartition(3)
    done = token_alignment.align(docs)
    got = {r["id"]: tuple(r)[1:] for r in done.documents.collect()}
    want, counts = plain(TEXTS)
    for i, row in enumerate(want):
        assert got[i] == row, (TEXTS[i], got[i], row)
    assert {(r["a"], r["b"]): r["n"] for r in done.pairs.collect()} == counts
    done.close()
    assert want[TEXTS.index("▁marked")][0] == 0 and want[3][0] > 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([r["text"] for r in docs])
    got = {r["doc_id"]: r for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, row in zip(docs, want):
        r = got[d["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == row[:6]
        assert r["groups_sha256"] == (hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "")


def test_blocks_and_partial_counts_change_nothing(spark, monkeypatch):
    t = token_alignment.tokenizers(token_alignment.Pair())
    import pyarrow as pa

    some = token_alignment.encode(t, pa.array([x or "" for x in TEXTS], pa.large_string())).cut_into_groups(t)
    whole = some.pairs(t)
    for wide, block in ((1 << 40, 7), (0, 7), (0, 1 << 30)):
        monkeypatch.setattr(token_alignment, "WIDE", wide)
        monkeypatch.setattr(token_alignment, "BLOCK", block)
        assert all((x == y).all() for x, y in zip(some.pairs(t), whole))
    monkeypatch.setattr(token_alignment, "MOST_PARTIAL", 10)
    partial, sums, rng = token_alignment.Partial(), Counter(), np.random.default_rng(3)
    keys = [rng.integers(0, 40, 25) for _ in range(20)]
    for k in keys:
        for x, n in partial.add(k):
            sums.update(dict(zip(x.tolist(), n.tolist())))
    sums.update(dict(zip(*(x.tolist() for x in partial.merged()))))
    assert sums == Counter(np.concatenate(keys).tolist())


@pytest.mark.parametrize("rows", [[], [(None, "one two"), (None, "one two"), ("b", None)]])
def test_ids(spark, rows):
    done = token_alignment.align(spark.createDataFrame(rows, "doc_id string, text string"))
    got = sorted((tuple(r) for r in done.documents.collect()), key=repr)
    want, _ = plain([t for _, t in rows])
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)


def test_ranks_are_the_vocabulary(spark):
    """The quick way of encoding gives the ids of the file's own library."""
    t, (encode_a, *_) = token_alignment.tokenizers(token_alignment.Pair()), tools()
    assert t.fast is not None
    for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 3000).select("text").collect():
        assert t.encode_a(f" {r['text']}").tolist() == encode_a(r["text"])


def test_texts_on_which_the_quick_way_gives_up():
    """Its pattern needs a stack as deep as a run of white space is long; the file's own library doesn't."""
    t = token_alignment.tokenizers(token_alignment.Pair())
    with pytest.raises(ValueError):
        t.fast.encode_to_numpy(" " * 3_000_000, allowed_special=set(), disallowed_special=())
    assert len(t.encode_a(" " * 3_000_000)) == 3_000_000
