"""Scores of the trained models against plain versions, a text and a feature at a time, and their held-out accuracy."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textquarry.llm import language_id, license_scan, quality_classifier
from textquarry.llm.common import crc_mod
from textquarry.llm.queries import QUERIES, language_model

SF = "/root/testdata/sf0.001"
ODD = ["", "x", "Ünï çødé ß", "a\nb\n\nb\nA1 %%", "日本語 text", "é" * 3000, "no letters 123"]


def gram_count(text):
    """Buckets of 1- to 3-grams by integer arithmetic."""
    mask, out, x = (1 << 64) - 1, Counter(), [ord(c) for c in text.lower()]
    for i in range(len(x)):
        h = (x[i] * 0x9E3779B97F4A7C15 + 1) & mask
        for n in range(3):
            if n:
                if i + n >= len(x):
                    break
                h = (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) + x[i + n] * 0x94D049BB133111EB + n) & mask
            out[((h * 0xD6E8FEB86659FD93) & mask) >> (64 - language_id.BITS)] += 1
    return out


def test_language_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_model(docs)
    train = [r["text"] for r in docs.where(crc_mod("doc_id", 4) != 2).collect()]
    df = Counter(b for t in train for b in gram_count(t))
    assert np.allclose(model.idf, [math.log((1 + len(train)) / (1 + df[b])) + 1 for b in range(1 << language_id.BITS)], rtol=1e-6)
    some = docs.limit(40).unionByName(spark.createDataFrame([(-i, t, None) for i, t in enumerate(ODD)], docs.schema))
    for r in language_id.identify(some, model).collect():
        if not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        value = {b: (1 + math.log(n)) * model.idf[b] for b, n in gram_count(r["text"]).items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        z = [(sum(v / norm * float(model.weights[b, k]) for b, v in value.items()) + model.bias[k]) / model.temperature for k in range(len(model.classes))]
        p = [math.exp(v - max(z)) for v in z]
        assert r["lang_pred"] == model.classes[p.index(max(p))] and r["score"] == pytest.approx(max(p) / sum(p), abs=1e-5)


def test_language_blocks(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = [x.tolist() for x in language_id.grams(text)]
    monkeypatch.setattr(language_id, "BLOCK", 700)
    assert [x.tolist() for x in language_id.grams(text)] == whole
    assert dict(zip(*whole)) == dict(gram_count(text))


def test_many_languages_are_refused(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    assert len(language_id.train(df, "text", "lang", "doc_id", max_languages=9).classes) == 9
    with pytest.raises(ValueError):
        language_id.train(df, "text", "lang", "doc_id", max_languages=8)


def measures(text):
    """The named measures of a text, one by one; letters are ASCII ones and all bytes beyond."""
    data = text.encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", data), [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    n, m = max(1, len(data)), max(1, len(words))
    share = lambda f: sum(map(f, data)) / n
    low, high, digit = (lambda b: 97 <= b <= 122 or b >= 128), (lambda b: 65 <= b <= 90), (lambda b: 48 <= b <= 57)
    blank = lambda b: b in (9, 11, 12, 13, 32)
    rest = lambda b: not (low(b) or high(b) or digit(b) or blank(b) or b == 10)
    triples = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    return [math.log1p(len(words)), math.log1p(len(data)) / 4, len(data) / m / 10, len(set(words)) / m, len(triples) / max(1, len(words) - 2), len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)) / 50, share(low), share(high), share(digit), share(lambda b: b == 10), share(blank), share(rest), sum(high(w[0]) for w in words) / m, sum(not any(low(b) or high(b) for b in w) for w in words) / m, 1.0]


def runs(text):
    """The shares of hashed trigrams of runs, by integer arithmetic."""
    kind = lambda b: 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b == 10 else 5 if b in (9, 11, 12, 13, 32) else 6 + b
    r, out = [], Counter()
    for b in text.encode():
        if not r or r[-1] != kind(b):
            r.append(kind(b))
    for x, y, z in zip(r, r[1:], r[2:]):
        h = (x * 0x9E3779B97F4A7C15 + y * 0xBF58476D1CE4E5B9 + z * 0x94D049BB133111EB) * 0xD6E8FEB86659FD93 % (1 << 64)
        out[h >> 56] += 1
    return [math.sqrt(out[k] / max(1, len(r) - 2)) for k in range(quality_classifier.SHAPES)]


def test_quality_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.limit(40).collect()] + ODD
    plain = np.array([measures(t) + runs(t) for t in texts])
    assert np.allclose(quality_classifier.shapes(pa.array(texts)), plain, rtol=1e-5, atol=1e-6)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.train(quality_classifier.split(docs), quality_classifier.split(labels))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    for r in quality_classifier.score(df, model).collect():
        x = quality_classifier.shapes(pa.array([(texts + [""])[r["doc_id"]]]))[0]
        z = sum(float(w) * max(-8.0, min(8.0, float(v - m) / float(s))) for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-5) and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_quality(spark):
    """On rows that didn't train, at ten times the size."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op6_quality_classifier"](spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    assert len(held) > 40 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_license_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = license_scan.train(docs)
    weights = {r["feature"]: r["w"] for r in model.weights.collect()}
    rows = [(1, "Licensed under the Mozilla Public License 2.0."), (2, "Released under the MIT License."), (3, "Licensed under the Unheard Of Public License 9."), (4, "SPDX-License-Identifier: ISC"), (5, None), (6, "")]
    got = {(r["doc_id"], r["family"]): r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows[:4]:
        words = [w for w in (x.strip(".+-") for x in re.split(r"[^\w.+-]+", text.lower())) if w]
        grams = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        z = [(sum(weights[g][k] for g in grams if g in weights) + model.bias[k]) / model.temperature for k in range(len(model.classes))]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        for (d, family), r in got.items():
            if d == i:
                assert r["probability"] == pytest.approx(p[model.classes.index(family)], abs=1e-3)
    assert {k for k, r in got.items() if r["confirmed"]} == {(1, "MPL-2.0"), (2, "MIT"), (4, "ISC")}
    assert 0.25 <= model.temperature <= license_scan.TEMPERATURES[-1]


def test_rules_judge_hosts(spark):
    """A host that breaks rules in most documents is rejected, one of two documents isn't; against a plain version."""
    from textquarry.llm.quality_rules import quality_rules

    good = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join(f"#w{i} $" for i in range(80))
    rows = [(i, noisy if i % 8 else good, "bad") for i in range(80)] + [(100 + i, good, f"h{i % 9}") for i in range(90)] + [(300, noisy, "small"), (301, good, "small"), (302, noisy, None)]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    hosts = {}
    for i, t, h in rows:
        hosts.setdefault(h, []).append(t == noisy)
    rates = [sum(v) / len(v) for v in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    strength = min(max(m * (1 - m) / v - 1, 1.0), 1000.0)
    for i, t, h in rows:
        rejected = (sum(hosts[h]) + m * strength) / (len(hosts[h]) + strength) > 0.5
        assert got[i]["host_rejected"] is rejected and got[i]["kept"] is (not rejected or t == good) and got[i]["n_soft"] == int(t == noisy) + int(t == noisy and got[i]["word_chars"] < 3 * got[i]["n_words"])
    assert got[0]["host_rejected"] and got[1]["host_rejected"] and not got[300]["host_rejected"]


def test_follow_the_leader_equals_a_plain_version():
    """One coordinate at a time, with z and n in dictionaries, from the definition of the method."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(60, 8, replace=False)), rng.random(8)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    alpha, l1, l2, epochs = 0.7, 0.05, 0.3, 2
    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(k):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((1 + math.sqrt(b)) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            some = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), (1 << language_id.BITS, 1.0)]
            w = {(f, c): weight((f, c)) for f, _ in some for c in range(3)}
            e = [math.exp(sum(v * w[f, c] for f, v in some)) for c in range(3)]
            for f, v in some:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y[i]))
                    before = n.get((f, c), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                    z[f, c] = z.get((f, c), 0.0) + g - sigma * w[f, c]
                    n[f, c] = before + g * g
    got, bias = language_id.follow_the_leader(rows, y, 3, alpha, l1, l2, epochs)
    assert np.allclose(got[:60], [[weight((f, c)) for c in range(3)] for f in range(60)]) and np.allclose(bias, [weight((1 << language_id.BITS, c)) for c in range(3)])
    assert not got[60:].any() and (got[:60] == 0).any()


def test_temperature_equals_a_search_over_all():
    rng = np.random.default_rng(2)
    logits, y = rng.normal(0, 6, (300, 4)), rng.integers(0, 4, 300)
    y = np.where(rng.random(300) < 0.6, logits.argmax(axis=1), y)
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(300), y] + 1e-12).mean()
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4000))
    assert abs(np.log(language_id.temperature_of(logits, y) / grid[np.argmin([loss(t) for t in grid])])) < 0.01
    assert language_id.temperature_of(logits[:0], y[:0]) == 1


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_positive_unlabelled_steps_equal_a_plain_version(prior):
    """The gradient of the risk by differences; below zero the part of negatives is gone up instead."""
    width = quality_classifier.MEASURES + quality_classifier.SHAPES
    rng = np.random.default_rng(4)
    positive, unlabelled = rng.normal(0.4, 1, (30, width)), rng.normal(0, 1, (50, width))
    got = quality_classifier.fit(positive, unlabelled, prior, steps=4, batch=8)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    theta = np.append(np.zeros(width), np.log(prior / (1 - prior)))
    draw, m, v, signs = np.random.default_rng(3), 0.0, 0.0, []
    for t in range(1, 5):
        xp, xu = (np.c_[x[draw.integers(len(x), size=8)], np.ones(8)] for x in (p, u))
        as_positive = lambda w: np.log1p(np.exp(-xp @ w)).mean()  # noqa: B023, E731
        negative = lambda w: np.log1p(np.exp(xu @ w)).mean() - prior * np.log1p(np.exp(xp @ w)).mean()  # noqa: B023, E731
        signs.append(negative(theta) >= 0)
        risk = (lambda w: prior * as_positive(w) + negative(w)) if signs[-1] else (lambda w: -negative(w))  # noqa: B023
        step = np.eye(width + 1) * 1e-5
        g = np.array([(risk(theta + d) - risk(theta - d)) / 2e-5 for d in step]) + 1e-3 * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.02 * (1 - t / 5) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(np.append(got.weights, got.bias), theta, atol=5e-4)
    assert prior < 0.5 or not all(signs)
