"""Conversation structure repair by signature.

A sound conversation has an optional system turn and then pairs of user and assistant turns.  Every row gets its first
fault (blank, duplicate of an earlier row, truncated), and a conversation becomes a signature: one character a row for the
role and what has to be done about the row.  Conversations of one signature have the same cheapest repair, so each distinct
signature is solved once, and its repair is joined back and replayed on the rows.

A repair keeps a row (0), gives it the role that its place needs (3), deletes it (4) or inserts an empty row of the role
that its place needs (3); a truncated row that stays costs 3 more; blank and duplicate rows have to go.  Of the cheapest
repairs, that whose audit, the initials of its edits in order, is least by ASCII is taken.  The cost of a
signature's rest, from each of the four places in the grammar, depends only on its first character and on the costs of what
follows, relative to each other; of those there are few, so that recursion is memoised across all signatures of a
task and a solution takes a look-up for each row.

Rows meet by conversation once; what is counted, grouped and joined after that is signatures.  Solutions are broadcast
where all signatures together are short, else joined with splittable skew, as a few signatures are those of most rows.

Edge cases: null roles and texts are one space, so such texts are blank and such roles are none; null turns come first.  Rows of
one turn come by role, then text, so repeated rows stand together, and all but the first are duplicates.  A null
conversation id is an id like any other.  A conversation of which nothing is left has zeros, an empty audit and no rows.
A conversation, however long, is one row of the result and so one value in one task.  Roles count by their first letter.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, skew_join

SPACE = " \t\n\x0b\x0c\r"
#: Solutions of signatures of so many characters together are broadcast: some 20 MB.
BROADCAST_CHARS = 1_000_000
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places in the grammar: at the start, behind system, behind user, behind assistant; what an insert leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
STEPS = "array<struct<row:int,role:string>>"


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, lost): rows damaged by a checksum of conversation and turn; lost rows only name their conversation."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part(text_col), "[.!?]", "")).otherwise(part(text_col))
    role = F.when(kind == 4, "user").otherwise(part(role_col))
    times = F.explode(F.array_repeat(kind == 0, F.when(kind == 3, 2).otherwise(1)))
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), times.alias("lost"))


def signatures(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, lost_col: str | None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature, rows) of each conversation.

    A signature has s, u, a or x for a row of that role (x: another), in upper case where it is truncated, and - where it has to go.
    """
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lost = F.coalesce(F.col(lost_col), F.lit(False)) if lost_col else F.lit(False)
    some = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), one_space(role_col).alias("role"), one_space(text_col).alias("text"), lost.alias("lost"))
    some = some.repartition("conv_id")  # all that follows needs a conversation's rows in one place
    earlier = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    some = some.withColumn("again", F.row_number().over(earlier) > 1)
    some = some.withColumn("fault", F.when(bare == "", "blank").when(F.col("again"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    first = F.left("role", F.lit(1))
    role = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    item = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "again", sign.alias("sign"), role.alias("initial"))
    count = lambda c: F.count_if(~F.col("lost") & c).alias
    faults = [count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")]
    grouped = some.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.col("lost"), item))).alias("all"), *faults)
    turns = F.filter(F.transform("all", lambda x: x["turn"]), lambda t: t.isNotNull())
    gaps = F.when(F.size(turns) > 0, F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))).otherwise(0)
    initials = F.transform("all", lambda x: x["initial"])
    beside = F.zip_with(F.slice(initials, 1, F.greatest(F.size("all") - 1, F.lit(0))), F.slice(initials, 2, F.size("all")), lambda x, y: F.concat(x, y))
    illegal = F.size(F.filter(beside, lambda x: ~x.isin("su", "ua", "au")))
    kept = F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), F.array_join(F.transform("all", lambda x: x["sign"]), "").alias("signature"), kept.alias("rows"))


@dataclass(frozen=True)
class Rest:
    """The rest of a signature: its cost from each place, less base of them all, and the first edit of its best audit from there."""

    base: int
    costs: tuple[int, ...]
    edits: tuple[str, ...]


def target(sign: str, place: int, edit: str) -> int | None:
    """Where an edit of a row leads from a place; None if it can't be."""
    role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(sign.lower())
    if edit == "D":
        return place
    if sign == "-" or edit == "K" and (role is None or role != NEXT[place] and not (role == SYSTEM and place == START)):
        return None
    return role if edit == "K" else NEXT[place]


class Solver:
    def __init__(self) -> None:
        self.memo: dict[tuple[str, tuple[int, ...]], Rest] = {}

    def rest(self, sign: str, after: tuple[int, ...]) -> Rest:
        """The rest that begins with a row, from the costs of the one behind it; sign is empty at the end."""
        key = (sign, after)
        if key in self.memo:
            return self.memo[key]
        extra = TRUNCATED if sign.isupper() else 0
        price = {"D": DELETE, "K": extra, "R": REROLE + extra}
        ways: list[dict[str, int]] = []
        for place in range(4):
            to = {e: target(sign, place, e) for e in price} if sign else {}
            ways.append({e: price[e] + after[x] for e, x in to.items() if x is not None} if sign else {"": after[place]})
        direct = [min(w.values()) for w in ways]
        costs = list(direct)
        for _ in range(2):  # two inserts lead back to where the first began
            costs = [min(direct[p], INSERT + costs[NEXT[p]]) for p in range(4)]
        edits = []
        for place, way in enumerate(ways):
            best = [e for e, c in way.items() if c == costs[place]] + ["I"] * (INSERT + costs[NEXT[place]] == costs[place])
            edits.append(min(best))
        base = min(costs)
        self.memo[key] = Rest(base, tuple(c - base for c in costs), tuple(edits))
        return self.memo[key]

    def solve(self, signature: str) -> tuple[int, str, list[dict]]:
        """The cost, the audit, and the rows of the result: which row (from 1; 0: a new one) and which role, if not its own."""
        rests = [self.rest("", (0, NEVER, NEVER, 0))]
        for sign in reversed(signature):  # the shortest rest first, so that no depth of recursion limits a conversation
            rests.append(self.rest(sign, rests[-1].costs))
        cost = sum(r.base for r in rests) + rests[-1].costs[START]
        audit, steps, place, i = [], [], START, 0
        while True:
            edit = rests[len(signature) - i].edits[place]
            if not edit:
                return cost, "".join(audit), steps
            audit.append(edit)
            sign, i = ("", i) if edit == "I" else (signature[i], i + 1)
            if edit != "D":
                place = NEXT[place] if edit == "I" else target(sign, place, edit)
                steps.append({"row": i if edit != "I" else 0, "role": None if edit == "K" else "user" if place == USER else "assistant"})


def solved(signs: DataFrame) -> DataFrame:
    """(signature, cost, audit, steps) of distinct signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        steps = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
        for batch in batches:
            found = [solver.solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), steps)))], ["signature", "cost", "audit", "steps"])

    return signs.select("signature").mapInArrow(run, f"signature string, cost long, audit string, steps {STEPS}")


def replay(rows: Column, steps: Column) -> Column:
    """The rows of the result, array<struct<role, text>>."""
    row = lambda s: F.try_element_at(rows, F.greatest(s["row"], F.lit(1)))
    old = lambda s, c: F.when(s["row"] > 0, row(s)[c])
    return F.transform(steps, lambda s: F.struct(F.coalesce(s["role"], old(s, "role")).alias("role"), F.coalesce(old(s, "text"), F.lit("")).alias("text")))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired array<struct<role, text>>).

    lost_col: rows for which it is true are not there, but their conversations are.
    """
    told = cut(signatures(rows, conv_col, turn_col, role_col, text_col, lost_col))
    signs = cut(solved(told.groupBy("signature").agg(F.lit(1).alias("one"))))
    chars = signs.agg(F.coalesce(F.sum(F.length("signature") + 1), F.lit(0))).first()[0]
    both = told.join(F.broadcast(signs), "signature") if chars <= BROADCAST_CHARS else skew_join(told, signs, ["signature"])
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", replay(F.col("rows"), F.col("steps")).alias("repaired"))


def digest(repaired: Column) -> Column:
    """SHA-256 of ``role:text`` of each row, joined by line feeds."""
    return F.sha2(F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"), 256)
