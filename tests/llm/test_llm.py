"""Each operator on the given tables, against SQL or brute force, and on awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from textquarry.llm import chat, decontaminate, language_id, license_scan, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, warc
from textquarry.llm.oracle import ORACLE
from textquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum " * 20_000
ROWS = [(1, None, "a", 0), (2, "", None, 1), (3, " \n\t", "a", 2), (4, "one", "b", 3), (5, "one", "b", 3), (5, "one", "b", 3), (None, "token = abcdefgh1234", "b", 4), (7, LONG, "c", 5), (8, LONG, "c", 6), (9, "Über Äpfel! " * 30, None, 7)]


@pytest.fixture(scope="module")
def odd(spark):
    # score, key, size, n and lang_pred clash with names that operators make.
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, score int")
    for c in ("key", "size", "n", "lang_pred", "target", "kept", "spans"):
        df = df.withColumn(c, F.lit(7))
    return df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name], SF)


def components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in texts}


def test_near_dedup_hot_group(spark):
    """Copies with few to many changed words: most are linked through the first text, some not at all."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = {}
    for i in range(220):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(60)}"
        texts[i * 3] = " ".join(words)
    texts[1], texts[2] = texts[3], "A b"
    got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(texts, 3, 85)


def test_near_dedup_beside_a_crowd(spark):
    """Pairs of near copies that hold a passage of a crowd: by chance, one of a pair shares a large bucket and the other doesn't."""
    rng = random.Random(7)
    passage, texts = [f"w{i}" for i in range(120)], {}
    for i in range(150):  # all their shingles are frequent
        texts[i] = " ".join(passage + [f"c{j}x{v}x{k}" for j in range(10) for v in [rng.randrange(2)] for k in range(4)])
    for i in range(60):
        words = passage + [f"p{i}x{j}" for j in range(150)]
        texts[1000 + 2 * i] = " ".join(words)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"y{i}"
        texts[1001 + 2 * i] = " ".join(words)
    got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(texts, 3, 85)


def test_near_dedup_odd(odd):
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 7, 8, None)] == [1, 2, 3, 4, 4, 7, 7, None]
    assert by[1]["n_shingles"] == 0 and by[4]["n_shingles"] == 1 and by[None]["kept"]
    assert near_dedup.near_dedup(odd.limit(0)).count() == 0


def test_secrets(spark, odd):
    kind = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_secret_scan"](spark, SF).collect():
        t = docs[r["doc_id"]]
        found = [(m.start(), 0, "assign", m.end()) for m in kind.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]{32,}", t)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)).encode()).hexdigest()
    assert secret_scan.secret_scan(odd).count() == len(ROWS)
    assert secret_scan.secret_scan(odd.limit(0)).count() == 0
    rows = [(i, f"é password: token:abcdefghijk Secret='{'k' * 9}' end", f"s{i}") for i in range(4)] + [(9, "api_key=ownvalue1 AKIA" + "B" * 14, "s9"), (10, "clean", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    found = {r["doc_id"]: r for r in secret_scan.secret_scan(docs).collect()}
    assert (found[0]["n_copied"], found[0]["n_live"], found[9]["n_live"]) == (1, 0, 2)
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert clean[9]["text"] == "api_key=[SECRET] [SECRET]" and clean[9]["n_chars"] == len(clean[9]["text"])
    assert clean[0]["text"] == rows[0][1] and clean[10]["text"] == "clean" and len(clean) == 6
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.redact(odd).count() == len(ROWS)


def test_private_keys(spark):
    """Keys of four sources: one is copied by all, in several wrappings; the others are each their owner's."""
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    line = lambda i, j, n=64: (hashlib.sha512(f"{i} {j}".encode()).hexdigest().upper() * 2)[:n]
    body = lambda i, sep="\n": sep.join([line(i, 0), line(i, 1), line(i, 2, 10) + "=="])
    whole = lambda i, sep="\n": f"{begin}{sep}{body(i, sep)}{sep}{end}"
    rows = [(i, f"é a\n{whole(i)}\nz {whole('shared', sep)} y", f"s{i}") for i, sep in enumerate(("\n", "\\n", "\r\n", "\n> "))]
    rows += [(4, f"a\n{begin}\nProc-Type: 4,ENCRYPTED\n\n{body(4)}\nthe rest stays", "s4"), (5, f"a {begin} is how a key begins", "s5"), (6, begin + " x-y" * 50_000, "s6"), (7, f"{begin}\n" + "\n".join(line(7, j) for j in range(3000)), "s7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "pem"] for r in secret_scan.secret_scan(docs).collect()}
    assert [[s["copied"] for s in found[i]] for i in range(8)] == [[False, True]] * 4 + [[False], [], [], [False]]
    assert len({s["hash"] for i in range(4) for s in found[i]}) == 5
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert all(clean[i] == t.replace(whole(i), "[SECRET]") for i, t, _ in rows[:4])
    assert clean[4] == "a\n[SECRET]\nthe rest stays" and clean[7] == "[SECRET]" and all(clean[i] == rows[i][1] for i in (5, 6))


def test_language(spark, odd):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_language_id"](spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    model = language_id.train(odd, "text", "lang", "doc_id")
    told = language_id.identify(odd, model).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in told if not r["text"] or not r["text"].strip())
    assert language_id.train(odd.limit(0), "text", "lang", "doc_id") is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_mixing(odd, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        a, b = (sorted(map(tuple, mixing.mix_sources(df).collect()), key=repr) for _ in range(2))
        assert a == b and len(a) == df.count()
        taken, goal, size = defaultdict(int), {}, defaultdict(int)
        for _, source, n, _, target, t, slot in a:
            assert 0 <= t <= 2 * n and (slot is None) == (t == 0)
            taken[source] += t
            size[source] += n
            goal[source] = target
        # The schedule decides, so a source is off by the discrepancy of its points, a few blocks.
        block = mixing.block_words_for(np.array(list(goal.values())), 1 << 20)
        assert all(abs(taken[s] - goal[s]) <= 8 * block + 1 for s in goal)
        assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 0.01
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mixing_follows_its_points(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {tuple(r) for r in mixing.mix_sources(docs).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 12345)
    assert {tuple(r) for r in mixing.mix_sources(docs).collect()} != before


def test_licenses(spark, odd):
    got = {(r["doc_id"], r["family"]) for r in QUERIES["op5_license_scan"](spark, SF).where("confirmed").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for needle, family in (("Released under the MIT License", "MIT"), ("GNU General Public License, version 3", "GPL"), ("CC BY-NC 4.0", "CC-BY-NC"), ("Apache License, Version 2.0", "Apache-2.0")):
        assert {r["doc_id"] for r in docs if needle in r["text"]} == {i for i, f in got if f == family}
    model = license_scan.train(odd)
    assert license_scan.license_scan(odd, model).count() == 0 and license_scan.license_scan(odd.limit(0), model).count() == 0


def test_wrapped_licenses(spark, odd):
    mit, gpl = license_scan.NOTICES["MIT"][2].split(" "), license_scan.NOTICES["GPL"][1].split(" ")
    wrap = lambda words, lead: "\n".join(lead + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = [(1, "x = 1\n\n" + wrap(mit, " * ") + "\n *\n * Other words"), (2, wrap(gpl, "dnl ") + "\n" + license_scan.NOTICES["CC-BY-NC"][0]), (3, "// SPDX-License-Identifier: MIT Copyright (c) 2020 X"), (3, wrap(mit, "# ")), (4, wrap(mit[:9], "") + "\n\n" + wrap(mit[9:14], ""))]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.train(odd)).where("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == [(1, 1, "MIT"), (2, 0, "CC-BY-NC"), (2, 0, "GPL"), (3, 0, "MIT"), (3, 0, "MIT")]


def test_license_headings(spark):
    """A heading that a source repeats in each document takes nothing from the notices."""
    rows = [(i, f"MIT License\nchapter {i} of a tale" if i % 3 == 0 else f"a tale of {i} pages\nand {i + 7} rivers") for i in range(600)] + [(1000, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = license_scan.train(docs)
    assert {"mit", "license", "mit license"} <= set(model.cues) | set(model.features) and "mit" in model.cues
    got = license_scan.license_scan(docs, model).where("doc_id = 1000").collect()
    assert [(r["family"], r["confirmed"]) for r in got] == [("MIT", True)]


def test_quality(spark, odd):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op6_quality_classifier"](spark, SF).collect()
    known = [r for r in got if r["doc_id"] in labels]
    assert len(got) == 200 and sum(r["predicted"] == labels[r["doc_id"]] for r in known) >= 0.93 * len(known)
    model = quality_classifier.train(odd, spark.createDataFrame([(4, 1), (5, None), (None, 1)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score(odd, model).collect())


def test_rules(spark, odd):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(odd).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and got[7]["n_words"] == 40_000 and got[7]["n_repeat_words"] == 40_000
    assert got[9]["word_chars"] == 30 * 10 and not got[9]["kept"]
    rows = [(1, "a b c a b c\na b c\n\na b c\n# x", "h")]
    r = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (14, 14, 1, 1, 12)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_warc(spark, odd, tmp_path):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://x/ \r\n?é").alias("url"), F.col("text").alias("html"))
    got = warc.archive_pages(pages, str(tmp_path / "w"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr((i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), "revisit" if i == 8 else "response", 7 if i == 8 else None)) for i, t, _, _ in ROWS)
    assert list((tmp_path / "w" / "records").glob("*.idx"))
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_leaks(spark, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in texts.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, SF).collect()}
    assert want <= got
    five = lambda t: {tuple(w[j : j + 5]) for w in [re.findall(r"\w+", t.lower())] for j in range(len(w) - 4)}
    for d, i in got - want:
        assert len(five(docs[d]) & five(texts[i])) >= 0.7 * len(five(texts[i]))
    assert decontaminate.find_leaks(odd, items, max_items=7).count() == 0
    short = spark.createDataFrame([(1, "one"), (2, None), (3, "zwei drei")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, short).collect()} == {(4, 1), (5, 1)}
    assert decontaminate.find_leaks(odd, short.limit(0)).count() == 0


def test_chat_odd(spark):
    rows = [(1, None, None, None), (1, 0, "user", "<|im_end|>\n<\\|x<|"), (1, 1, "as\nsist", "é"), (None, 0, "assistant", ""), (None, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chat(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("user", rows[1][3]), ("as\nsist", "é"), ("", "")]
    assert got[None]["n_turns"] == 1 and not got[None]["valid"] and chat.format_chat(df).count() == 3
    assert chat.format_chat(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaks = {r["doc_id"] for r in QUERIES["op9_decontaminate"](spark, SF).collect()}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, c in components(texts, 5, 80).items() if i == c} - leaks
    assert got == want
