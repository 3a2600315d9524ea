"""Repairs against a search over all edits, damage and faults against plain code, and the whole query against SQL."""

import hashlib
import itertools
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from tests.oracle import same
from textquarry.llm import conversation_repair as cr
from textquarry.llm.oracle import ORACLE
from textquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain_repair(signature):
    """The cheapest, then least audit, by taking the least of all unfinished edits again and again."""
    heap, limit = [(0, "", 0, "")], 4 * len(signature) + 1
    while heap:
        cost, audit, i, roles = heappop(heap)
        if i == len(signature) and GOOD.match(roles):
            return cost, audit, roles
        if not re.match(r"(s?(ua)*u?)?\Z", roles) or cost > limit:
            continue
        for role in "ua":
            heappush(heap, (cost + 3, audit + "I", i, roles + role))
        if i < len(signature):
            sign = signature[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if sign != "-":
                extra = 3 if sign.isupper() else 0
                heappush(heap, (cost + extra, audit + "K", i + 1, roles + sign.lower()))
                for role in "ua":
                    heappush(heap, (cost + extra + 3, audit + "R", i + 1, roles + role))


def test_every_short_signature():
    solver = cr.Solver()
    for n in range(4):
        for signature in map("".join, itertools.product("suaxSUAX-", repeat=n)):
            cost, audit, steps = solver.solve(signature)
            want = plain_repair(signature)
            assert (cost, audit) == want[:2], signature
            assert "".join((s["role"] or signature[s["row"] - 1])[0].lower() for s in steps) == want[2]
    assert len(solver.memo) < 500


def test_longer_signatures():
    rng, solver = random.Random(11), cr.Solver()
    for _ in range(60):
        signature = "".join(rng.choices("suaUA-x", [1, 6, 6, 1, 1, 1, 1], k=rng.randint(4, 7)))
        assert solver.solve(signature)[:2] == plain_repair(signature)[:2], signature
    cost, audit, steps = solver.solve("ua" * 100_000 + "u")
    assert cost == 3 and len(steps) == 200_002 and audit.count("I") == 1


def plain(rows):
    """The contract's rows from (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, some in held.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, signature = set(), [], ""
        for _, role, text in some:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            sign = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "-" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        turns = {t for t, _, _ in some if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit, roles = plain_repair(signature)
        lines, left, i = [], iter(roles), 0
        for edit in audit:
            row, i = (None, i) if edit == "I" else (some[i], i + 1)
            if edit != "D":
                role = {"u": "user", "a": "assistant"}.get(r := next(left), r)
                lines.append(f"{row[1] if edit == 'K' else role}:{row[2] if row else ''}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def awkward():
    rng = random.Random(4)
    texts = ["Yes.", "No", "", None, " \x0b\n", "Really?\n ", "Really?", "x!\xa0", "...", "No"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "admin", ""]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 5))]
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (7, 1, "user", "Yes."), (7, 1, "user", "Yes."), (-1, 10**12, "user", "Far."), (-1, 1, "user", "Near.")]


@pytest.mark.parametrize("chars", [0, 10**6])
def test_awkward_rows(spark, chars, monkeypatch):
    monkeypatch.setattr(cr, "BROADCAST_CHARS", chars)
    rows = awkward()
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, signature string").repartition(3)
    done = cr.repair(cr.damage(turns), lost_col="lost")
    got = sorted((tuple(r) for r in done.withColumn("sha", cr.digest(done["repaired"])).drop("repaired").collect()), key=repr)
    want = plain(rows)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(cr.damage(turns), lost_col="lost").count() == 0


def test_sql_and_plain(spark):
    assert same(spark, QUERIES["op11_conversation_repair"], ORACLE["op11_conversation_repair"], SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_conversation_repair"](spark, SF).collect()), key=repr)
    assert got == plain(rows)
