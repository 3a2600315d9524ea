"""Fields of an item, and which of them a search looks at."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import pairwise

RANGE = re.compile(r"([+-]?\d+)?(\.\.)?([+-]?\d+)?")
Span = tuple[int, int]


def parse_nth(spec: str) -> list[tuple[int, int]]:
    """First and last field of each range, from 1, or from -1 at the end."""
    out = []
    for text in spec.split(","):
        known = RANGE.fullmatch(text)
        first, dots, last = known.groups() if known and text else (None, None, None)
        if not (first or dots) or (last and not dots):
            raise ValueError(f"not a field range: {text!r}")
        low, high = int(first or 1), int((last or -1) if dots else first)
        if not low or not high or (low < 0 < high and first and last):
            raise ValueError(f"not a field range: {text!r}")
        out.append((low, high))
    return out


def splitter(nth: str, delimiter: str | None) -> Callable[[str], list[Span]]:
    """Gives an item's spans for the ranges asked for.

    Without a delimiter, fields stand between blanks and keep those after them.  A delimiter is a fixed string, or a
    pattern if it has more than one character and any of special meaning; fields keep it, but for the last range.
    """
    ranges = parse_nth(nth)
    text = delimiter.replace("\\t", "\t") if delimiter else ""
    special = len(text) > 1 and re.search(r"[\\.+*?()|\[\]{}^$]", text)
    between = re.compile(text if special else re.escape(text)) if text else None

    def tokens(item: str) -> list[Span]:
        if between is None:
            return [m.span() for m in re.finditer(r"[^\t \n]+[\t \n]*", item)]
        ends = [0, *(m.end() for m in between.finditer(item))]
        return [*pairwise(ends), *([(ends[-1], len(item))] if not special or ends[-1] < len(item) else [])]

    def fields(item: str) -> list[Span]:
        known, out = tokens(item), []
        n = len(known)
        for low, high in ranges:
            low, high = (x + n + 1 if x < 0 else x for x in (low, high))
            low, high = max(low, 1), min(high, n)
            out.append((known[low - 1][0], known[high - 1][1]) if low <= high else (0, 0))
        if between is not None:
            begin, end = out[-1]
            last = [m for m in between.finditer(item[begin:end]) if m.end() == end - begin]
            out[-1] = (begin, begin + last[-1].start()) if last else out[-1]
        return out

    return fields
