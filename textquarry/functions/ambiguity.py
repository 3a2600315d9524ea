"""Patterns that a backtracking engine would follow in exponentially many ways.

A pattern's tree is made of tuples: ("one", class), ("seq", parts), ("or", parts), ("times", part, least, most) with most None
for no bound, and ("empty",).  Every class in it is a position; two positions follow each other if their characters may be
neighbours.  A pattern is ambiguous without bound if some position can be come back to by two different ways over the
same text: if pairs of positions that go through equal characters have a cycle through an equal and an unequal pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Characters of different kinds; those that a pattern names are tried as well.
KINDS = "aZ5_ \n\t.-\u00e9\u6f22\u0663\U0001f642"
#: Repeats are written out while the positions are so few, and no more often than this then.
MOST_POSITIONS, COPIES = 150, 3


def unrolled(tree: tuple, most_copies: int) -> tuple:
    """The tree without bounded repeats."""
    if tree[0] in ("seq", "or"):
        return (tree[0], [unrolled(x, most_copies) for x in tree[1]])
    if tree[0] != "times":
        return tree
    _, part, least, most = tree
    part = unrolled(part, most_copies)
    need = [part] * min(least, most_copies)
    if most is None:
        return ("seq", [*need, ("loop", part)])
    return ("seq", [*need, *[("or", [part, ("empty",)])] * min(most - least, most_copies)])


def count(tree: tuple) -> int:
    if tree[0] in ("seq", "or"):
        return sum(map(count, tree[1]))
    if tree[0] == "times":
        return count(tree[1]) * max(1, tree[2] if tree[3] is None else tree[3])
    return int(tree[0] == "one")


def follow(tree: tuple) -> tuple[list[str], list[set[int]]]:
    """The class of each position and the positions that may come next."""
    classes: list[str] = []
    after: list[set[int]] = []

    def of(t: tuple) -> tuple[bool, set[int], set[int]]:
        """Whether it can be empty, its first and its last positions."""
        if t[0] == "one":
            classes.append(t[1])
            after.append(set())
            return False, {len(after) - 1}, {len(after) - 1}
        if t[0] == "loop":
            _, first, last = of(t[1])
            for p in last:
                after[p] |= first
            return True, first, last
        empty, first, last = (t[0] != "or"), set(), set()
        for part in t[1] if t[0] in ("seq", "or") else []:
            e, f, end = of(part)
            if t[0] == "or":
                empty, first, last = empty or e, first | f, last | end
                continue
            for p in last:
                after[p] |= f
            first = first | f if empty else first
            last = last | end if e else end
            empty = empty and e
        return empty, first, last

    of(tree)
    return classes, after


def cycles(nodes: list, edges: Callable) -> list[list]:
    """Strongly connected components, by depth-first search without recursion."""
    low, number, stack, on, out = {}, {}, [], set(), []
    for root in nodes:
        if root in number:
            continue
        work = [(root, iter(edges(root)))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(edges(w))))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    out.append(part)
    return out


def ambiguous(tree: tuple, holds: Callable[[str, str], bool]) -> bool:
    """holds: whether a class has a character."""
    classes, after = follow(unrolled(tree, 1 << 30 if count(tree) <= MOST_POSITIONS else COPIES))
    if len(classes) > 2 * MOST_POSITIONS:
        return False
    named = {int(h, 16) + d for c in set(classes) for h in re.findall(r"\\x\{([0-9a-f]+)\}", c) for d in (-1, 0, 1)}
    named |= {ord(x) + d for c in set(classes) if len(c) == 1 for x in c for d in (-1, 0, 1)}
    some = [*KINDS, *(chr(x) for x in sorted(named) if 0 <= x < 0x110000 and not 0xD800 <= x < 0xE000)]
    has = {c: frozenset(x for x in some if holds(c, x)) for c in set(classes)}
    meet = {(a, b): bool(has[a] & has[b]) for a in has for b in has}
    edges = lambda v: [(p, q) for p in after[v[0]] for q in after[v[1]] if meet[classes[p], classes[q]]]
    every = cycles([(p, p) for p in range(len(classes))], edges)
    return any(any(p == q for p, q in part) and any(p != q for p, q in part) for part in every)
