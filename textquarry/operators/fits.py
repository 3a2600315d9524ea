"""How well terms fit items, as native columns; only the alignment of fuzzy terms is worked out in Arrow batches.

A fit is struct<hit, start, end, score>: whether a term is there, from which character to which, and its score.  All
characters of an exact, prefix, suffix, equal or boundary term stand together, so its score needs the classes of those
characters and of the one before them.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import alignment, runes
from ..functions.alignment import BOUNDARY, FIRST, MATCH, RUN, SCHEMES, TOP
from ..functions.arrays import cut_text, let, running
from ..functions.runes import DELIMITER, LETTER, LOWER, NON_WORD, NUMBER, UPPER, WHITE

# Fixed value: what counts as white space.
SPACES = r"[\t-\r\x{85}\p{Z}]"


def class_of(char: Column, delimiters: str) -> Column:
    """The class of a single character."""
    is_one = char.isin(*delimiters)
    kinds = [(r"\p{Ll}", LOWER), (r"\p{N}", NUMBER), (SPACES, WHITE), (r"\p{Lu}", UPPER), (r"\p{L}", LETTER)]
    return reduce(lambda c, k: c.when(char.rlike(k[0]), k[1]), kinds, F.when(is_one, DELIMITER)).otherwise(NON_WORD)


def bonus_of(before: Column, here: Column, scheme: str) -> Column:
    """The bonus of a match at a character behind another, which is empty at the beginning."""
    white, delimiter, delimiters, start = SCHEMES[scheme]
    table = F.lit([int(x) for x in alignment.bonuses(white, delimiter).ravel()])
    first = F.when(before == "", start).otherwise(class_of(before, delimiters))
    return F.element_at(table, (first * 7 + class_of(here, delimiters) + 1).cast("int"))


def walk(text: Column, scheme: str) -> Column:
    """The score of all characters of a text but the first, which is the one before them (empty, if there is none)."""
    chars = lambda t: F.transform(F.sequence(F.lit(1), F.length(t["run"])), lambda i: F.substr(t["run"], i, F.lit(1)))

    def of(t: Column) -> Column:
        def scored(c: Column) -> Column:
            own = F.transform(c, lambda x, i: bonus_of(F.when(i == 0, t["before"]).otherwise(F.element_at(c, F.greatest(i, F.lit(1)))), x, scheme))

            def step(a: Column, b: Column) -> Column:
                run = F.when((b >= BOUNDARY) & (b > a["run"]), b).otherwise(a["run"])
                later = a["score"] + MATCH + F.greatest(b, run, F.lit(RUN))
                return F.struct(F.when(a["n"] == 0, b).otherwise(run).alias("run"), F.when(a["n"] == 0, MATCH + FIRST * b).otherwise(later).alias("score"), (a["n"] + 1).alias("n"))

            return F.aggregate(own, F.struct(F.lit(0).alias("run"), F.lit(0).alias("score"), F.lit(0).alias("n")), step, lambda a: a["score"])

        return let(chars(t), scored)

    return let(text, of)


def folded(item: Column, sensitive: bool, plain: bool) -> Column:
    """The item in lower case and without marks, each character as one, so that places stay what they are."""
    if not sensitive:
        item = F.lower(F.translate(item, "İΣ", "iσ"))
    return F.translate(item, "".join(runes.plain_letters()), "".join(runes.plain_letters().values())) if plain else item


def fit(hit: Column, start: Column, length: int, score: Column) -> Column:
    at = F.when(hit, start).otherwise(0).cast("int")
    return F.struct(F.coalesce(hit, F.lit(False)).alias("hit"), at.alias("start"), (at + length).alias("end"), F.when(hit, score).otherwise(0).cast("int").alias("score"))


def around(item: Column, start: Column, m: int) -> Column:
    """m characters from a place on and the one before them."""
    return F.struct(F.when(start > 0, F.substr(item, start.cast("int"), F.lit(1))).otherwise("").alias("before"), F.substr(item, (start + 1).cast("int"), F.lit(m)).alias("run"))


def at_an_end(item: Column, term, scheme: str) -> Column:
    """A prefix or a suffix, or the whole item, but for white space around it."""
    white, m, text = SCHEMES[scheme][0], len(term.text), folded(item, term.sensitive, term.plain)
    trimmed = lambda x, edge: F.regexp_replace(x, edge, "")
    lead = F.lit(0) if runes.class_of(term.text[0], "") == WHITE else F.length(item) - F.length(trimmed(item, rf"\A{SPACES}+"))
    trail = F.lit(0) if runes.class_of(term.text[-1], "") == WHITE else F.length(item) - F.length(trimmed(item, rf"{SPACES}+\z"))
    start = lead if term.kind in ("prefix", "equal") else F.length(item) - trail - m
    hit = (start >= 0) & (F.substr(text, (F.greatest(start, F.lit(0)) + 1).cast("int"), F.lit(m)) == term.text)
    if term.kind == "equal":
        return fit(hit & (F.length(item) - lead - trail == m), start, m, F.lit((MATCH + white) * m + (FIRST - 1) * white))
    return fit(hit, start, m, walk(around(item, start, m), scheme))


def anywhere(item: Column, term, scheme: str, forward: bool) -> Column:
    """An exact or boundary term: of its occurrences the first in reading direction at a boundary, or of the best bonus."""
    white, m, text = SCHEMES[scheme][0], len(term.text), folded(item, term.sensitive, term.plain)
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in term.text)
    ahead = rf"(?={quoted})" + (r"(?<![\p{L}\p{N}])" if term.kind == "boundary" else "")
    ahead += rf"(?={quoted}(?![\p{{L}}\p{{N}}]))" if term.kind == "boundary" else ""

    def chosen(pieces: Column) -> Column:
        starts = running(F.transform(pieces, lambda p: F.length(p).cast("long")))
        first = F.when(text.rlike(rf"\A(?:{ahead})"), starts).otherwise(F.slice(starts, 2, F.size(starts)))

        def best(at: Column) -> Column:
            near = F.transform(at, lambda s: F.struct(F.greatest(s - 1, F.lit(0)).alias("start"), (s + 1).alias("end")))

            def of(chars: Column) -> Column:
                value = lambda s, c: F.when(s == 0, F.least(F.lit(white), F.lit(BOUNDARY))).otherwise(F.least(bonus_of(F.left(c, F.lit(1)), F.right(c, F.lit(1)), scheme), F.lit(BOUNDARY)))
                return F.array_max(F.zip_with(at, chars, lambda s, c: F.struct(value(s, c).alias("value"), (-s if forward else s).alias("order"))))["order"]

            return F.abs(let(cut_text(item, near), of))

        return let(first, best)

    start = let(F.split(text, ahead, -1), chosen)

    def told(s: Column) -> Column:
        if term.kind == "exact":
            return fit(s.isNotNull(), s, m, walk(around(item, s, m), scheme))
        here, after = around(item, s, m), F.substr(item, (s + m + 1).cast("int"), F.lit(1))
        own = F.when(s == 0, white).otherwise(bonus_of(here["before"], F.left(here["run"], F.lit(1)), scheme))
        loss, led = own - BOUNDARY + 1, here["before"] == "_"
        score = own + MATCH * m + white * (m + 1) - F.when(led, loss + 1).otherwise(0) - F.when(after == "_", F.when(led, 1).otherwise(loss)).otherwise(0)
        return fit(s.isNotNull(), s, m, score)

    return let(start, told)


def aligned(term, scheme: str, forward: bool, greedy: bool, by_place: bool):
    """The fit of a fuzzy term: an alignment of its characters with those of a block of items at once."""

    @F.pandas_udf("hit boolean, start int, end int, score int")
    def align(item: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"hit": False, "start": 0, "end": 0, "score": 0}, index=range(len(item)))
        items = [x or "" for x in item]
        for index in alignment.blocks(items, len(term.text) if by_place else 4):
            found = alignment.find(alignment.Block([items[i] for i in index], scheme), term, forward, greedy, by_place)
            start = found.start if by_place or found.early is None else found.early
            for name, values in (("hit", found.hit), ("start", start), ("end", found.end), ("score", found.score)):
                out.loc[index, name] = values
        return out

    # Not told to be deterministic, lest a filter gets an evaluation of its own.
    return align.asNondeterministic()


def fit_of(item: Column, term, scheme: str, forward: bool, greedy: bool, by_place: bool) -> Column:
    if term.kind == "fuzzy":
        return aligned(term, scheme, forward, greedy, by_place)(item)
    return at_an_end(item, term, scheme) if term.kind in ("prefix", "suffix", "equal") else anywhere(item, term, scheme, forward)


def of_set(terms: list, fits: list[Column]) -> Column:
    """What a set of alternatives has of an item: the first term that is there; one that must not be there holds without a place."""
    none = F.struct(F.lit(True).alias("hit"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("score"))
    out = F.struct(F.lit(False).alias("hit"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("score"))
    for t, f in reversed([*zip(terms, fits)]):
        if not t.inverse:
            out = F.when(f["hit"], f).otherwise(out)
    absent = reduce(lambda a, b: a | b, [~f["hit"] for t, f in zip(terms, fits) if t.inverse], F.lit(False))
    return F.when(~out["hit"] & absent, none).otherwise(out)


def rank(item: Column, criterion: str, found: Column) -> Column:
    """A tiebreak value, smaller first; found: array of the sets' fits that have a place."""
    begin, first_end, last_end = F.array_min(F.transform(found, lambda f: f["start"])), F.array_min(F.transform(found, lambda f: f["end"])), F.array_max(F.transform(found, lambda f: f["end"]))
    bare = F.regexp_replace(item, rf"\A{SPACES}+|{SPACES}+\z", "")
    lead = F.length(item) - F.length(F.regexp_replace(item, rf"\A{SPACES}+", ""))
    if criterion == "length":
        return F.least(F.length(bare), F.lit(TOP))
    if criterion == "pathname":
        last = F.length(item) - F.length(F.substring_index(F.translate(item, "\\", "/"), "/", -1)) - 1
        value = F.when(last <= begin, begin - last).otherwise(TOP)
    elif criterion == "chunk":
        before, behind = F.substr(item, F.lit(1), begin), F.substr(item, last_end + 1)
        low = begin - F.length(F.regexp_extract(before, rf"((?:(?!{SPACES})[\x{{0}}-\x{{10ffff}}])*)\z", 1))
        value = last_end + F.length(F.regexp_extract(behind, rf"\A((?:(?!{SPACES})[\x{{0}}-\x{{10ffff}}])*)", 1)) - low
    else:
        blank = F.least(lead, begin)
        value = first_end - blank if criterion == "begin" else TOP - F.floor(TOP * (last_end - blank) / (F.length(bare) + 1))
    # least and greatest pass over what is missing, so an item without a place is told apart first
    return F.when(F.size(found) > 0, F.least(F.greatest(value, F.lit(0)), F.lit(TOP))).otherwise(TOP).cast("int")
