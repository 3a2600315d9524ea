"""How well items fit fuzzy terms, for blocks of items at once.

A block is a matrix, an item a row, a character a column; every step is a numpy operation over all items of the
block, so the interpreter's work goes by the length of a term times that of an item and not by the number of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import runes
from .runes import DELIMITER, LETTER, LOWER, NON_WORD, NUMBER, UPPER, WHITE

# Fixed values of the scoring rules.
MATCH, GAP, MORE_GAP = 16, -3, -1
BOUNDARY, SYMBOL, CAMEL, RUN = 8, 8, 7, 4
FIRST = 2
MOST_CELLS, LONGEST_TERM = 102400, 1000
TOP = 65535
SCHEMES = {"default": (10, 9, "/,:;|", WHITE), "path": (8, 9, "/", DELIMITER), "history": (8, 8, "/,:;|", WHITE)}
TIEBREAKS = {"default": ("length",), "path": ("pathname", "length"), "history": ()}

#: Cells of a block at most, unless a single item is longer; where alignments are traced, over all rows of a term.
BLOCK = 1 << 21
PAD = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=8)
def bonuses(white: int, delimiter: int) -> np.ndarray:
    """[class before, class] -> bonus of a match there."""
    after = {WHITE: white, DELIMITER: delimiter, NON_WORD: BOUNDARY}
    alone = {NON_WORD: SYMBOL, DELIMITER: SYMBOL, WHITE: white}
    table = np.zeros((7, 7), np.int32)
    for before in range(7):
        for here in range(7):
            camel = (before == LOWER and here == UPPER) or (before != NUMBER and here == NUMBER)
            table[before, here] = after[before] if here != WHITE and before in after else CAMEL if camel else alone.get(here, 0)
    return table


class Block:
    """Items as code points, with the class and bonus of each character."""

    def __init__(self, items: list[str], scheme: str) -> None:
        self.white, self.delimiter, delimiters, start = SCHEMES[scheme]
        self.length = np.array([len(x) for x in items], np.int64)
        width = max(1, int(self.length.max()))
        codes = np.frombuffer("".join(x.ljust(width, "\0") for x in items).encode("utf-32-le"), np.uint32).reshape(len(items), width)
        self.size = 128 if codes.max() < 128 else runes.LIMIT
        self.col = np.arange(width)
        self.inside = self.col < self.length[:, None]
        self.codes = codes
        self.kind = runes.class_table(delimiters, self.size)[codes]
        before = np.concatenate([np.full((len(items), 1), start, np.int8), self.kind[:, :-1]], axis=1)
        self.bonus = bonuses(self.white, self.delimiter)[before, self.kind]
        self.space = (self.kind == WHITE) & self.inside
        solid = self.inside & ~self.space
        some = solid.any(axis=1)
        self.lead = np.where(some, solid.argmax(axis=1), self.length)
        self.trail = np.where(some, self.length - width + solid[:, ::-1].argmax(axis=1), self.length)
        self.trimmed = np.where(some, self.length - self.lead - self.trail, 0)

    def text(self, sensitive: bool, plain: bool, capitals_only: bool = False) -> np.ndarray:
        text = self.codes
        if not sensitive:
            low = runes.lower_table(self.size)[text]
            text = np.where(self.kind == UPPER, low, text) if capitals_only else low
        if plain:
            text = runes.plain_table(self.size)[text]
        return np.where(self.inside, text, PAD)


@dataclass
class Found:
    """Per item: whether the term is there, its range, its score, and (fuzzy terms) the column of each character."""

    hit: np.ndarray
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    places: np.ndarray | None = None
    early: np.ndarray | None = None


def nothing(n: int) -> Found:
    zero = np.zeros(n, np.int64)
    return Found(np.zeros(n, bool), zero, zero.copy(), zero.copy())


def leftmost(text: np.ndarray, term: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column of each character, taken as early as can be after the column `since`; and which items have them all."""
    col, has, places = np.arange(text.shape[1]), np.ones(len(text), bool), []
    for c in term:
        at = (text == c) & (col > since[:, None])
        has &= at.any(axis=1)
        since = at.argmax(axis=1)
        places.append(since)
    return np.array(places), has


def walk(bonus: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Score of characters at given columns, [character, item]."""
    rows = np.arange(places.shape[1])
    run = bonus[rows, places[0]]
    score = MATCH + FIRST * run
    for before, at in zip(places, places[1:]):
        own, gap = bonus[rows, at], at - before - 1
        run = np.where(gap > 0, own, np.where((own >= BOUNDARY) & (own > run), own, run))
        score = score + MATCH + np.where(gap > 0, own + GAP + MORE_GAP * (gap - 1), np.maximum(np.maximum(own, run), RUN))
    return score


def choose(bonus: np.ndarray, at: np.ndarray, forward: bool) -> np.ndarray:
    """The first of the marked columns in reading direction that is a boundary, or else that has the best bonus."""
    if not forward:
        return bonus.shape[1] - 1 - choose(bonus[:, ::-1], at[:, ::-1], True)
    value = np.where(at, np.minimum(bonus, BOUNDARY), -1)
    return value.argmax(axis=1)


def occurrences(block: Block, text: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Marks the columns where the whole term begins."""
    at = np.zeros(text.shape, bool)
    last = text.shape[1] - len(term)
    if last >= 0:
        part = np.ones((len(text), last + 1), bool)
        for i, c in enumerate(term):
            part &= text[:, i : last + 1 + i] == c
        at[:, : last + 1] = part
    return at


def find_exact(block: Block, text: np.ndarray, term: np.ndarray, kind: str, forward: bool) -> Found:
    at, rows, m = occurrences(block, text, term), np.arange(len(text)), len(term)
    spaced_start, spaced_end = (runes.class_of(chr(c), "") == WHITE for c in (term[0], term[-1]))
    lead = np.zeros_like(block.lead) if spaced_start else block.lead
    trail = np.zeros_like(block.trail) if spaced_end else block.trail
    if kind in ("exact", "boundary"):
        bonus = block.bonus.copy()
        bonus[:, 0] = block.white
        if kind == "boundary":
            word = np.pad((block.kind > DELIMITER) & block.inside, ((0, 0), (1, m)))
            at = at & ~word[:, : at.shape[1]] & ~word[:, m + 1 : m + 1 + at.shape[1]]
        start, hit = choose(bonus, at, forward), at.any(axis=1)
    else:
        start = lead if kind in ("prefix", "equal") else block.length - trail - m
        inside = (start >= 0) & (start < text.shape[1])
        start = np.where(inside, start, 0)
        hit = inside & at[rows, start]
        if kind == "equal":
            hit &= block.length - lead - trail == m
    start = np.where(hit, start, 0)
    end = start + m
    if kind == "equal":
        score = np.full(len(text), (MATCH + block.white) * m + (FIRST - 1) * block.white)
    elif kind == "boundary":
        own = bonus[rows, start]
        edge = np.pad(block.codes == ord("_"), ((0, 0), (1, m)))
        before, after = edge[rows, start], edge[rows, end + 1] & (end < block.length)
        loss = own - BOUNDARY + 1
        score = own + MATCH * m + block.white * (m + 1) - np.where(before, loss + 1, 0) - np.where(after, np.where(before, 1, loss), 0)
    else:
        score = np.zeros(len(text), np.int64)
        if hit.any():
            score[hit] = walk(block.bonus[hit], start[hit] + np.arange(m)[:, None])
    return Found(hit, start, end, score)


def find_greedy(block: Block, text: np.ndarray, term: np.ndarray, forward: bool) -> Found:
    """The first fit in reading direction, made as short as its end allows."""
    n = len(text)
    out = nothing(n)
    read, goal = (text, term) if forward else (text[:, ::-1], term[::-1])
    places, hit = leftmost(read, goal, np.full(n, -1))
    rows = np.flatnonzero(hit)
    out.hit, out.places = hit, np.zeros((len(term), n), np.int64)
    if not len(rows):
        return out
    width = text.shape[1]
    far = places[-1][rows]
    back, _ = leftmost(read[rows][:, ::-1], goal[::-1], width - 2 - far)
    near = width - 1 - back[-1]
    start = near if forward else width - 1 - far
    exact, _ = leftmost(text[rows], term, start - 1)
    out.places[:, rows], out.start[rows], out.end[rows] = exact, start, exact[-1] + 1
    out.score[rows] = walk(block.bonus[rows], exact)
    return out


def find_best(block: Block, text: np.ndarray, term: np.ndarray, forward: bool, trace: bool) -> Found:
    """The best local alignment of the term's characters, all of them in order."""
    n, m = len(text), len(term)
    out = nothing(n)
    first, out.hit = leftmost(text, term, np.full(n, -1))
    rows = np.flatnonzero(out.hit)
    out.places = np.zeros((m, n), np.int64)
    if not len(rows):
        return out
    text, bonus, first = text[rows], block.bonus[rows], first[:, rows]
    if m == 1:
        at = text == term[0]
        best = choose(bonus, at, True) if forward else text.shape[1] - 1 - np.where(at, bonus, -1)[:, ::-1].argmax(axis=1)
        out.start[rows], out.end[rows], out.places[0, rows] = best, best + 1, best
        out.score[rows] = MATCH + FIRST * bonus[np.arange(len(rows)), best]
        return out
    columns, bonus = np.ascontiguousarray(text.T), np.ascontiguousarray(bonus.T)
    width, k = columns.shape
    each, none = np.arange(k), np.zeros(k, np.int32)
    heights, runs = [], []
    for i, c in enumerate(term):
        height, run = np.zeros((width, k), np.int32), np.zeros((width, k), np.int32)
        left, gap = none, np.zeros(k, bool)
        for j in range(int(first[i].min()), width):
            here = (columns[j] == c) & (j >= first[i])
            skip = left + np.where(gap, MORE_GAP, GAP)
            if not here.any():
                gap = skip > 0 if i else np.ones(k, bool)
                left = np.maximum(skip, 0)
            elif i == 0:
                left = np.where(here, MATCH + FIRST * bonus[j], np.maximum(skip, 0))
                run[j], gap = here, ~here
            else:
                own = bonus[j]
                streak = runs[-1][j - 1] + 1
                lead = bonus[np.maximum(j - streak + 1, 0), each]
                again = (streak > 1) & (own >= BOUNDARY) & (own > lead)
                streak = np.where(again, 1, streak)
                gain = np.where(streak > 1, np.maximum(np.maximum(own, RUN), lead), own)
                fit = heights[-1][j - 1] + MATCH
                weak = fit + gain < skip
                fit = np.where(here, fit + np.where(weak, own, gain), 0)
                run[j] = np.where(here & ~weak, streak, 0)
                gap = fit < skip
                left = np.maximum(np.maximum(fit, skip), 0)
            height[j] = left
        heights.append(height)
        runs.append(run)
        if not trace:
            heights, runs = heights[-1:], runs[-1:]
    last = heights[-1]
    best = last.argmax(axis=0) if forward else width - 1 - last[::-1].argmax(axis=0)
    out.score[rows], out.end[rows] = last[best, each], best + 1
    out.start[rows] = first[0]
    if trace:
        out.early = out.start.copy()
        places = trace_back(np.array(heights), np.array(runs), first, best)
        out.places[:, rows], out.start[rows] = places, places[0]
    return out


def trace_back(height: np.ndarray, run: np.ndarray, first: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Columns of the characters, from the last back; where two ways tie, a run is kept together."""
    m, width, k = height.shape
    each, i, j = np.arange(k), np.full(k, m - 1), best.copy()
    places, prefer, busy = np.zeros((m, k), np.int64), np.ones(k, bool), np.ones(k, bool)
    while busy.any():
        start = first[i, each]
        value, back = height[i, j, each], np.maximum(j - 1, 0)
        above = np.where((i > 0) & (j >= start), height[np.maximum(i - 1, 0), back, each], 0)
        beside = np.where(j > start, height[i, back, each], 0)
        take = busy & (value > above) & ((value > beside) | ((value == beside) & prefer))
        places[i[take], each[take]] = j[take]
        below = (i + 1 < m) & (j + 1 < width) & (run[np.minimum(i + 1, m - 1), np.minimum(j + 1, width - 1), each] > 0)
        prefer = (run[i, j, each] > 1) | below
        busy = busy & ~(take & (i == 0)) & (j > 0)
        i, j = np.where(take & busy, i - 1, i), np.where(busy, j - 1, j)
    return places


def rank_of(block: Block, criterion: str, begin: np.ndarray, first_end: np.ndarray, last_end: np.ndarray, ranged: np.ndarray) -> np.ndarray:
    """The tiebreak value of each item, smaller first."""
    width = block.codes.shape[1]
    if criterion == "length":
        return np.minimum(block.trimmed, TOP)
    if criterion == "pathname":
        slash = ((block.codes == ord("/")) | (block.codes == ord("\\"))) & block.inside
        last = np.where(slash.any(axis=1), width - 1 - slash[:, ::-1].argmax(axis=1), -1)
        value = np.where(last <= begin, begin - last, TOP)
    elif criterion == "chunk":
        low = np.where(block.space & (block.col < begin[:, None]), block.col + 1, 0).max(axis=1)
        high = np.where(block.space & (block.col >= last_end[:, None]), block.col, block.length[:, None]).min(axis=1)
        value = high - low
    else:
        blank = np.minimum(block.lead, begin)
        value = first_end - blank if criterion == "begin" else TOP - TOP * (last_end - blank) // (block.trimmed + 1)
    return np.where(ranged, np.clip(value, 0, TOP), TOP)


def blocks(items: list[str], kept_rows: int) -> Iterator[np.ndarray]:
    """Indices of items of like length, few enough that a block stays small."""
    order, begin = np.argsort([len(x) for x in items], kind="stable"), 0
    most = BLOCK // max(1, kept_rows)
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - begin) * (len(items[order[end]]) + 1) > most:
            yield order[begin:end]
            begin = end


def find(block: Block, term, forward: bool, greedy: bool, trace: bool) -> Found:
    goal = np.array([ord(c) for c in term.text], np.uint32)
    if term.kind != "fuzzy":
        return find_exact(block, block.text(term.sensitive, term.plain), goal, term.kind, forward)
    big = block.length * len(goal) > MOST_CELLS
    if greedy or len(goal) > LONGEST_TERM or big.all():
        return find_greedy(block, block.text(term.sensitive, term.plain), goal, forward)
    found = find_best(block, block.text(term.sensitive, term.plain, capitals_only=True), goal, forward, trace)
    return merge(found, find_greedy(block, block.text(term.sensitive, term.plain), goal, forward), big) if big.any() else found


def merge(one: Found, other: Found, where: np.ndarray) -> Found:
    """The other's findings for marked items."""
    early = np.where(where, other.start if other.early is None else other.early, one.start if one.early is None else one.early)
    places = None if one.places is None else np.where(where, other.places, one.places)
    return Found(*(np.where(where, getattr(other, f), getattr(one, f)) for f in ("hit", "start", "end", "score")), places, early)


def find_in_fields(parts: list[tuple[np.ndarray, Block]], term, forward: bool, greedy: bool, trace: bool) -> Found:
    """The first field that has the term, in columns of the whole item."""
    out = None
    for offset, block in parts:
        found = find(block, term, forward, greedy, trace)
        found.start, found.end = found.start + offset, found.end + offset
        found.places = None if found.places is None else found.places + offset
        found.early = None if found.early is None else found.early + offset
        out = found if out is None else merge(out, found, ~out.hit)
    return out


def evaluate(items: list[str], sets: list, scheme: str, tiebreak: tuple[str, ...], forward: bool, by_place: bool, greedy: bool, places: bool, fields: Callable[[str], list[tuple[int, int]]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray] | None]]:
    """For each block: indices of its items, which match, their score, their rank values and matched columns.

    by_place: ranges begin where the best alignment does, not at the first character's first occurrence.
    fields: the spans of an item in which terms are looked for, one after the other.
    """
    longest = max((len(t.text) for terms in sets for t in terms), default=1)
    for index in blocks(items, longest if by_place or places else 4):
        texts, n = [items[i] for i in index], len(index)
        block = Block(texts, scheme)
        parts = [(np.zeros(n, np.int64), block)]
        if fields:
            spans = [fields(x) for x in texts]
            parts = [(np.array([s[f][0] for s in spans]), Block([x[slice(*s[f])] for x, s in zip(texts, spans)], scheme)) for f in range(len(spans[0]))]
        ok, total, ranged = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
        begin, first_end, last_end = np.full(n, TOP), np.full(n, TOP), np.zeros(n, np.int64)
        marks = np.zeros(block.codes.shape, bool) if places else None
        for terms in sets:
            held, done = np.zeros(n, bool), np.zeros(n, bool)
            low, high, own = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for t in terms:
                found = find_in_fields(parts, t, forward, greedy, by_place or places)
                if t.inverse:
                    free = ~found.hit & ~done
                    low, high, own = (np.where(free, 0, x) for x in (low, high, own))
                    held = held | free
                    continue
                new = found.hit & ~done
                start = found.start if by_place or found.early is None else found.early
                low, high, own = np.where(new, start, low), np.where(new, found.end, high), np.where(new, found.score, own)
                held, done = held | new, done | new
                if places and t.kind == "fuzzy":
                    rows = np.flatnonzero(new)
                    marks[rows, found.places[:, rows]] = True
                elif places:
                    marks |= new[:, None] & (block.col >= found.start[:, None]) & (block.col < found.end[:, None])
            ok &= held
            total += own
            wide = low < high
            begin = np.where(wide, np.minimum(low, begin), begin)
            first_end = np.where(wide, np.minimum(high, first_end), first_end)
            last_end = np.where(wide, np.maximum(high, last_end), last_end)
            ranged |= wide
        ranks = np.zeros((n, 4), np.int64)
        ranks[:, 0] = TOP - np.clip(total, 0, TOP)
        for c, name in enumerate(tiebreak, 1):
            ranks[:, c] = rank_of(block, name, begin, first_end, last_end, ranged)
        yield index, ok, total, ranks, [np.flatnonzero(r) for r in marks] if places else None
