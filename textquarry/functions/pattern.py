"""Search patterns as Spark expressions.

Patterns have leftmost-first syntax without look-around or back-references, Unicode classes by default, and ``.``
that stops only at a line feed.  They are re-printed for Java's engine, whose own readings of ``.``, ``$``,
``\\w``, ``\\b`` and stacked repeats differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ambiguity import ambiguous
from .arrays import let

# The Unicode classes behind \d, \w and \s.
DIGIT = r"\p{Nd}"
WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d"
SPACE = r"\t-\r \x{85}\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t-\r "}
UNICODE = {"d": DIGIT, "w": WORD, "s": SPACE}
CONTROL = {"t": 9, "n": 10, "r": 13, "f": 12, "v": 11, "a": 7}
PUNCTUATION = set("\\.+*?()|[]{}^$#&-~/ \"'<>!%,:;=@_`")


# The general categories by their long names.
CATEGORIES = {
    "letter": "L", "cased letter": "LC", "uppercase letter": "Lu", "lowercase letter": "Ll", "titlecase letter": "Lt", "modifier letter": "Lm", "other letter": "Lo",
    "mark": "M", "nonspacing mark": "Mn", "spacing mark": "Mc", "enclosing mark": "Me", "number": "N", "decimal number": "Nd", "letter number": "Nl", "other number": "No",
    "punctuation": "P", "connector punctuation": "Pc", "dash punctuation": "Pd", "open punctuation": "Ps", "close punctuation": "Pe", "initial punctuation": "Pi", "final punctuation": "Pf", "other punctuation": "Po",
    "symbol": "S", "math symbol": "Sm", "currency symbol": "Sc", "modifier symbol": "Sk", "other symbol": "So", "separator": "Z", "space separator": "Zs", "line separator": "Zl", "paragraph separator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "private use": "Co", "unassigned": "Cn",
}
OTHER_PROPERTIES = {"any": r"[\x{0}-\x{10ffff}]", "ascii": r"[\x{0}-\x{7f}]", "assigned": r"\P{Cn}", "white space": r"\p{IsWhite_Space}", "alphabetic": r"\p{IsAlphabetic}", "uppercase": r"\p{IsUppercase}", "lowercase": r"\p{IsLowercase}"}
# The POSIX classes, ASCII alone.
POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x{0}-\x{7f}", "blank": r"\t ", "cntrl": r"\x{0}-\x{1f}\x{7f}", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t-\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}


# Names of scripts that no character has; the last two only as extensions.
NO_SCRIPTS = ("unknown", "zzzz", "hrkt", "katakana or hiragana")
#: A pattern with its repeats written out may be so long.
MOST_SIZE = 1 << 22
#: Matches whose offsets are worked out at once, but for those of a single row.
MOST_MATCHES = 1 << 18


class PatternError(ValueError):
    """The pattern isn't valid here."""


@dataclass
class Flags:
    unicode: bool = True
    dot_all: bool = False
    swap: bool = False
    ignore_case: bool = False
    line_mode: bool = True
    multi: bool = True
    crlf: bool = False
    extended: bool = False


class Node(str):
    """A printed part.  empty: it can match nothing; one: it is one character's class, without brackets; loop: the part that it repeats
    without bound, and whether once at least; risky: it repeats without bound what has choices, which Java does by recursion;
    tree: its shape for the test of ambiguity; size: of what it prints with its repeats written out; needs: classes of which a match
    holds a character each."""

    empty: bool = False
    one: str | None = None
    tree: tuple = ("empty",)
    size: int = 0
    needs: frozenset[str] = frozenset()
    loop: tuple[Node, bool] | None = None
    risky: bool = False
    choices: bool = False


def node(text: str, **what) -> Node:
    out = Node(text)
    vars(out).update(what)
    if out.one:
        vars(out).update(tree=("one", out.one), size=len(text), needs=frozenset([out.one]))
    return out


def together(parts: list[Node]) -> dict:
    """What a sequence of parts has."""
    return {"empty": all(x.empty for x in parts), "risky": any(x.risky for x in parts), "choices": any(x.choices for x in parts), "tree": ("seq", [x.tree for x in parts]), "size": sum(x.size for x in parts), "needs": frozenset().union(*(x.needs for x in parts))}


def for_regex(java: str) -> str:
    """A printed pattern in the syntax of the regex module."""
    return "(?V1)" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java).replace(r"\z", r"\Z").replace("(?iu)", "(?i)")


@lru_cache(maxsize=4096)
def holds(java: str, char: str, ignore_case: bool = False) -> bool:
    """Whether a printed class has a character; so if one can't tell."""
    try:
        return regex.fullmatch(for_regex(java), char, regex.I if ignore_case else 0) is not None
    except regex.error:
        return True


def holds_feed(java: str) -> bool:
    return holds(java, "\n")


@lru_cache(maxsize=64)
def script_extensions(name: str) -> str:
    """The characters of a script and those it shares, as ranges of a class."""
    try:
        own = regex.compile(rf"\p{{scx={name}}}+")
    except regex.error:
        raise PatternError(f"an unknown script: {name}") from None
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return "".join(f"\\x{{{ord(m[0][0]):x}}}-\\x{{{ord(m[0][-1]):x}}}" for m in own.finditer(every))


class Printer:
    """Reads a pattern once and prints it for Java."""

    def __init__(self, text: str, flags: Flags) -> None:
        self.s, self.i, self.f, self.literals, self.names = text, 0, flags, [], set()
        self.feeds = False  # a class holds a line feed, or there is an anchor of lines or of the text

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def skip(self) -> None:
        """White space and comments, under the x flag."""
        if self.f.extended:
            self.i = re.compile(r"(?:\s|#[^\n]*)*").match(self.s, self.i).end()

    def word(self) -> str:
        return f"[{(UNICODE if self.f.unicode else ASCII)['w']}]"

    def alternation(self, depth: int = 0) -> Node:
        if depth > 250:
            raise PatternError("the pattern is nested too deeply")
        out = [self.sequence(depth)]
        while self.peek() == "|":
            self.i += 1
            out.append(self.sequence(depth))
        if len(out) == 1:
            return out[0]
        if all(x.one for x in out):
            inner = "".join(f"[{x.one}]" for x in out)
            return node(f"[{inner}]", one=inner)
        return node("|".join(out), empty=any(x.empty for x in out), risky=any(x.risky for x in out), choices=True, tree=("or", [x.tree for x in out]), size=sum(x.size for x in out), needs=out[0].needs.intersection(*(x.needs for x in out)))

    def sequence(self, depth: int) -> Node:
        out: list[Node] = []
        while True:
            self.skip()
            if self.i >= len(self.s) or self.peek() in "|)":
                break
            atom = self.atom(depth)
            self.skip()
            while (q := self.quantifier()) is not None:
                atom = self.repeated(atom, *q)
                self.skip()
            out.append(atom)
        if len(out) == 1:
            return out[0]
        return node("".join(out), **together(out))

    def repeated(self, atom: Node, least: int, most: int | None, lazy: bool) -> Node:
        if not atom:
            raise PatternError("a repeat has nothing to repeat")
        if most is None and least <= 1 and not lazy and atom.loop:  # a loop of a loop is one loop
            body, once = atom.loop
            return self.repeated(body, int(once and least == 1), None, False)
        if atom.loop and not lazy:  # and a loop so many times is one from so many times on
            body, once = atom.loop
            return self.repeated(body, least if once else 0, None, False) if not once or least > 1 or least == 0 else atom
        q = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or "{" + (str(least) if most == least else f"{least},{'' if most is None else most}") + "}"
        text = f"{atom}{q}" if atom.one else f"(?:{atom}){q}"
        loop = (atom, least == 1) if most is None and least <= 1 and not lazy else None
        size = atom.size * max(1, least if most is None else most)
        return node(text + "?" * lazy, empty=atom.empty or least == 0, loop=loop, risky=atom.risky or most is None and atom.choices, choices=not atom.one or most != least, tree=("times", atom.tree, least, most), size=size, needs=atom.needs if least else frozenset())

    def quantifier(self) -> tuple[int, int | None, bool] | None:
        c = self.peek()
        if c and c in "*+?":
            self.i += 1
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        elif m := re.compile(r"\{\s*(\d*)\s*(,?)\s*(\d*)\s*\}").match(self.s, self.i):
            if not m[1] and not m[3]:
                raise PatternError("a repeat needs a number")
            self.i = m.end()
            least = int(m[1] or 0)
            most = (int(m[3]) if m[3] else None) if m[2] else least
            if most is not None and most < least:
                raise PatternError("a repeat's range is empty")
        elif c == "{":
            raise PatternError("a repeat isn't closed")
        else:
            return None
        self.skip()
        lazy = self.peek() == "?"
        self.i += lazy
        return least, most, lazy != self.f.swap

    def atom(self, depth: int) -> Node:
        c = self.take()
        if c == "(":
            return self.group(depth)
        if c == "[":
            return self.of_class(self.bracket())
        if c == ".":
            inner = r"\x{0}-\x{10ffff}" if self.f.dot_all else r"^\n\r" if self.f.crlf else r"^\n"
            return self.of_class(f"[{inner}]")
        if c in "^$":
            self.feeds = True
            return node(self.anchor(c), empty=True)
        if c == "\\":
            return self.escape()
        if c in "*+?":
            raise PatternError("a repeat has nothing to repeat")
        return self.literal(ord(c))

    def of_class(self, text: str) -> Node:
        self.feeds |= holds_feed(text)
        return node(text, one=text)

    def anchor(self, c: str) -> str:
        if self.f.crlf and (self.f.multi or self.f.line_mode):
            return (r"(?<![^\r\n])" if c == "^" else r"(?![^\r\n])") + r"(?!(?<=\r)\n)"
        if self.f.line_mode or not self.f.multi:
            return r"\A" if c == "^" else r"\z"
        return r"(?<![^\n])" if c == "^" else r"(?![^\n])"

    def literal(self, code: int) -> Node:
        if code == 10 and self.f.line_mode:
            raise PatternError("a line pattern can't hold a line feed")
        self.literals.append(chr(code))
        self.feeds |= code == 10
        c = chr(code)
        text = c if c.isascii() and c.isalnum() else f"\\x{{{code:x}}}"
        return node(text, one=text)

    def group(self, depth: int) -> Node:
        before, case = Flags(**vars(self.f)), ""
        if self.peek() == "?":
            rest = self.s[self.i + 1 :]
            if re.match(r"<?[=!]", rest):
                raise PatternError("look-around isn't supported")
            if m := re.match(r"P?<([A-Za-z_][\w.\[\]]*)>", rest):
                if m[1] in self.names:
                    raise PatternError(f"two groups have the name {m[1]}")
                self.names.add(m[1])
                self.i += 1 + m.end()
            elif m := re.match(r"([imsUxuR]*)(?:-([imsUxuR]+))?([:)])", rest):
                self.i += 1 + m.end()
                if m[3] == ")" and not m[1] and not m[2]:
                    raise PatternError("a group has no flags")
                for names, on in ((m[1], True), (m[2] or "", False)):
                    for flag, name in (("s", "dot_all"), ("U", "swap"), ("u", "unicode"), ("i", "ignore_case"), ("x", "extended"), ("m", "multi"), ("R", "crlf")):
                        if flag in names:
                            setattr(self.f, name, on)
                case = "(?iu)" if "i" in m[1] else "(?-i)" if "i" in (m[2] or "") else ""
                if m[3] == ")":
                    return node(case, empty=True)
            else:
                raise PatternError("a group has unknown flags")
        inner = self.alternation(depth + 1)
        self.close()
        self.f = before
        if inner.one and not case:
            return inner
        return node(f"(?:{case}{inner})", empty=inner.empty, loop=None if case else inner.loop, risky=inner.risky, choices=inner.choices, tree=inner.tree, size=inner.size, needs=frozenset() if case else inner.needs)

    def close(self) -> None:
        if self.peek() != ")":
            raise PatternError("a group isn't closed")
        self.i += 1

    def code(self) -> int | None:
        """The character of an escape that names one; the backslash is behind us."""
        c = self.take() if self.i < len(self.s) else ""
        if c in CONTROL and c:
            return CONTROL[c]
        if c and c in "xuU":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}").match(self.s, self.i)
            n = {"x": 2, "u": 4, "U": 8}[c]
            m = m or re.compile(f"([0-9A-Fa-f]{{{n}}})").match(self.s, self.i)
            if not m:
                raise PatternError("an escape has no digits")
            self.i = m.end()
            return int(m[1], 16)
        if c and c in PUNCTUATION:
            return ord(c)
        self.i -= bool(c)
        return None

    def escape(self) -> Node:
        c = self.peek()
        if c and c in "dwsDWS":
            self.i += 1
            inner = (UNICODE if self.f.unicode else ASCII)[c.lower()]
            return self.of_class(f"[^{inner}]" if c.isupper() else f"[{inner}]")
        if c and c in "pP":
            return self.of_class(self.property())
        w = self.word()
        edges = {"b": f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))", "B": f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))", "<": f"(?:(?<!{w})(?={w}))", ">": f"(?:(?<={w})(?!{w}))", "A": r"\A", "z": r"\z"}
        named = {"start": edges["<"], "end": edges[">"], "start-half": f"(?<!{w})", "end-half": f"(?!{w})"}
        if m := re.compile(r"b\{([a-z-]+)\}").match(self.s, self.i):
            if m[1] not in named:
                raise PatternError("an unknown boundary")
            self.i = m.end()
            return node(named[m[1]], empty=True)
        if c and c in edges:
            self.i += 1
            self.feeds |= c in "Az"
            return node(edges[c], empty=True)
        code = self.code()
        if code is None:
            raise PatternError(f"an unknown escape: \\{self.peek()}")
        return self.literal(code)

    def property(self) -> str:
        m = re.compile(r"([pP])(?:\{(\^?)([^}]+)\}|(\w))").match(self.s, self.i)
        if not m:
            raise PatternError("a property isn't closed")
        self.i = m.end()
        kind, _, value = (m[3] or m[4]).rpartition("=")
        kind, name = kind.lower().replace("_", ""), re.sub(r"[\s_-]+", " ", value).strip().lower()
        if kind not in ("", "gc", "generalcategory", "sc", "script", "scx", "scriptextensions"):
            raise PatternError(f"an unknown property: {kind}")
        if name in NO_SCRIPTS[:2] and not kind.startswith("g") or name in NO_SCRIPTS and kind in ("scx", "scriptextensions"):
            raise PatternError(f"a script without characters: {value}")
        short = {v.lower(): v for v in CATEGORIES.values()}
        if kind.startswith("scx") or kind == "scriptextensions":
            java = f"[{script_extensions(value)}]"
        elif kind not in ("sc", "script") and (name in CATEGORIES or name in short):
            java = f"\\p{{{CATEGORIES.get(name) or short[name]}}}"
        elif not kind and name in OTHER_PROPERTIES:
            java = OTHER_PROPERTIES[name]
        elif kind in ("gc", "generalcategory"):
            raise PatternError(f"an unknown category: {value}")
        else:
            java = f"\\p{{script={name.replace(' ', '_')}}}"
        return f"[^{java}]" if (m[1] == "P") != bool(m[2]) else java

    def bracket(self) -> str:
        """A class from behind its ``[``: unions of members, joined by && -- ~~ from the left."""
        negated = self.peek() == "^"
        self.i += negated
        left = self.union(first=True)
        while (op := self.peek(2)) in ("&&", "--", "~~"):
            self.i += 2
            right = self.union()
            left = {"&&": f"[{left}&&{right}]", "--": f"[{left}&&[^{right}]]", "~~": f"[[{left}&&[^{right}]][{right}&&[^{left}]]]"}[op]
        self.i += 1
        return f"[^{left}]" if negated else left

    def union(self, first: bool = False) -> str:
        """Members up to an operator or the end of the class, which is left to be read."""
        out = []
        while True:
            if self.f.extended:
                self.skip()
            c = self.peek()
            if not c:
                raise PatternError("a class isn't closed")
            if c == "]" and not (first and not out):
                break
            if self.peek(2) in ("&&", "~~") or self.peek(2) == "--" and self.s[self.i + 2 : self.i + 3] != "]":
                break
            if m := re.compile(r"\[:(\^?)([a-z]+):\]").match(self.s, self.i):
                if m[2] not in POSIX:
                    raise PatternError(f"an unknown class: {m[2]}")
                self.i = m.end()
                out.append(f"[{m[1]}{POSIX[m[2]]}]")
            elif c == "[":
                self.i += 1
                out.append(self.bracket())
            else:
                out.append(self.member())
        if not out:
            raise PatternError("a class has nothing on one side")
        return f"[{''.join(out)}]"

    def member(self) -> str:
        """A character, a range, or a class escape within brackets."""
        c = self.take()
        if c == "\\":
            k = self.peek()
            if k and k in "dwsDWS":
                self.i += 1
                inner = (UNICODE if self.f.unicode else ASCII)[k.lower()]
                return f"[^{inner}]" if k.isupper() else inner
            if k and k in "pP":
                return self.property()
            code = self.code()
            if code is None:
                raise PatternError(f"an unknown escape: \\{k}")
        else:
            code = ord(c)
        self.literals.append(chr(code))
        if self.peek() == "-" and self.peek(2) not in ("-]", "--") and len(self.peek(2)) == 2:
            self.i += 1
            end = self.take()
            if end == "\\":
                last = self.code()
                if last is None:
                    raise PatternError("a range ends in a class")
            else:
                last = ord(end)
            if last < code:
                raise PatternError("a range is empty")
            return f"\\x{{{code:x}}}-\\x{{{last:x}}}"
        return f"\\x{{{code:x}}}"


@dataclass(frozen=True)
class Pattern:
    """A pattern for Java, and the fixed string that it is, if it is one.

    Java repeats choices by recursion, so a long text could exhaust its stack.  Such patterns go to Python's regex module,
    which doesn't, in Arrow batches.
    """

    java: str
    fixed: str | None
    empty: bool = False
    risky: bool = False
    whole: bool = False  # a text without it has no line with it
    feeds: bool = False  # a match may hold a line feed or depend on where lines begin
    needs: str | None = None  # a character that every match holds

    def find(self, col: Column, start: int = 0) -> Column:
        """struct<start, end> in bytes of the first match from the start-th character on; what is before is seen by boundaries."""
        if self.risky:
            raise PatternError("a repeat of choices can't be looked for from a start")
        ahead = rf"\A([\x{{0}}-\x{{10ffff}}]{{{start}}}[\x{{0}}-\x{{10ffff}}]*?)({self.java})"
        begin = F.octet_length(F.regexp_extract(col, ahead, 1)).alias("start")
        return F.when(col.rlike(ahead), F.struct(begin, (begin + F.octet_length(F.regexp_extract(col, ahead, 2))).alias("end")))

    def python(self) -> str:
        """The same for the regex module."""
        return for_regex(self.java)

    def matches(self, col: Column) -> Column:
        if self.fixed is not None:
            return col.contains(self.fixed)
        if self.needs:
            return col.contains(self.needs) & self.searched(col)
        return self.searched(col)

    def searched(self, col: Column) -> Column:
        if not self.risky:
            return col.rlike(self.java)
        python = self.python()

        @F.pandas_udf("boolean")
        def searched(texts: pd.Series) -> pd.Series:
            found = regex.compile(python).search
            return texts.map(lambda t: None if t is None else found(t) is not None)

        return searched(col)

    def flags(self, lines: Column) -> Column:
        """Of an array of lines, which match."""
        if not self.risky:
            return F.transform(lines, self.matches)
        python = self.python()

        @F.pandas_udf("array<boolean>")
        def searched(arrays: pd.Series) -> pd.Series:
            found = regex.compile(python).search
            return arrays.map(lambda a: None if a is None else [found(t) is not None for t in a])

        return searched(lines)

    def counts(self, lines: Column) -> Column:
        """Of an array of lines, how many matches each has."""
        if self.fixed:
            bare = lambda x: F.octet_length(F.replace(x, F.lit(self.fixed), F.lit("")))
            return F.transform(lines, lambda x: ((F.octet_length(x) - bare(x)) / len(self.fixed.encode())).cast("int"))
        if not self.risky:
            return F.transform(lines, lambda x: F.size(self.all(x)))
        python = self.python()

        @F.pandas_udf("array<int>")
        def counted(arrays: pd.Series) -> pd.Series:
            found = regex.compile(python)

            def n(text: str) -> int:
                last, total = -1, 0
                for m in found.finditer(text):
                    total += m.end() > m.start() or m.start() != last
                    last = m.end()
                return total

            return arrays.map(lambda a: None if a is None else [n(t) for t in a])

        return counted(lines)

    def pairs(self, col: Column) -> Column:
        """array<struct<gap, match>>: each match with the text between it and the one before, without empty matches that touch one.

        Matches and the pieces between them come from the same search, so each match follows its piece; only an empty match
        at the very beginning has no piece.  The gap of a match behind one that was left out is whole, as that one had no text.
        """
        if self.risky:
            return self.searched_pairs(col)

        def of(x: Column) -> Column:
            found, pieces = x["found"], x["pieces"]
            gaps = F.when(F.size(pieces) == F.size(found), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces) if self.empty else pieces
            every = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
            if self.empty:
                every = F.filter(every, lambda p, i: (p["match"] != "") | (p["gap"] != "") | (i == 0))
            return F.when(found.isNotNull(), every)

        found = F.regexp_extract_all(col, F.lit(self.java), F.lit(0))
        return let(F.struct(found.alias("found"), F.split(col, self.java, -1).alias("pieces")), of)

    def searched_pairs(self, col: Column) -> Column:
        python = self.python()

        @F.pandas_udf("array<struct<gap:string,match:string>>")
        def searched(texts: pd.Series) -> pd.Series:
            found = regex.compile(python)

            def of(text: str) -> list[dict]:
                out, last = [], 0
                for m in found.finditer(text):
                    if m.end() > m.start() or m.start() > last or not out and m.start() == 0:
                        out.append({"gap": text[last : m.start()], "match": m[0]})
                        last = m.end()
                return out

            return texts.map(lambda t: None if t is None else of(t))

        return searched(col)

    def all(self, col: Column) -> Column:
        """The matches, as strings."""
        if self.empty or self.risky:
            return F.transform(self.pairs(col), lambda x: x["match"])
        return F.regexp_extract_all(col, F.lit(self.java), F.lit(0))

    def before_first(self, col: Column) -> Column:
        """What stands before the first match; null without one."""
        if self.empty or self.risky:
            return F.try_element_at(self.pairs(col), F.lit(1))["gap"]
        return let(F.split(col, self.java, 2), lambda p: F.when(F.size(p) == 2, F.element_at(p, 1)))

    def spans(self, col: Column) -> Column:
        """array<struct<start, end>> of byte offsets: of what pairs says, the sums over whole batches of rows at once."""
        empty = self.empty and not self.risky  # what is searched in Python comes without the empty ones, each with its piece

        @F.arrow_udf("array<struct<start:int,end:int>>")
        def offsets(pieces: pa.Array, found: pa.Array) -> pa.Array:
            return spans_in_parts(pieces, found, empty)

        if not self.risky:
            return offsets(F.split(col, self.java, -1), F.regexp_extract_all(col, F.lit(self.java), F.lit(0)))
        each = self.searched_pairs(col)
        return offsets(F.transform(each, lambda x: x["gap"]), F.transform(each, lambda x: x["match"]))


def spans_in_parts(pieces: pa.Array, found: pa.Array, empty: bool, most: int = MOST_MATCHES) -> pa.Array:
    """The same as spans_of, for some rows after the other, as a batch of long lines has very many matches."""
    part = np.cumsum(counts_of(found)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(found)]
    return pa.concat_arrays([spans_of(pieces[a:b], found[a:b], empty) for a, b in zip(cuts, cuts[1:])])


def counts_of(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def spans_of(pieces: pa.Array, found: pa.Array, empty: bool) -> pa.Array:
    """Spans of the matches of each row, given the pieces between them; if they may be empty, without empty ones that touch one.

    The first match of a row has no piece where there are as many pieces as matches and it is empty.
    """
    wide = lambda x: pc.binary_length(x.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    n, m, match, piece = counts_of(found), counts_of(pieces), wide(found), wide(pieces)
    first = np.cumsum(n) - n
    nth = np.arange(len(match)) - np.repeat(first, n)
    own = nth - np.repeat((m == n) & empty, n)  # the piece before each match, in its row
    gap = np.where(own >= 0, np.append(piece, 0)[np.maximum(np.repeat(np.cumsum(m) - m, n) + own, 0)], 0)
    end = np.cumsum(gap + match)
    end -= np.repeat(np.append(0, end)[first], n)
    keep = (match > 0) | (gap > 0) | (nth == 0) if empty else np.ones(len(match), bool)
    counts = np.append(0, np.cumsum(keep))[np.append(first, len(match))]
    spans = pa.StructArray.from_arrays([pa.array((end - match)[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), spans, mask=found.is_null())


def check(java: str) -> None:
    """Refuse now what Java can't compile, where a session runs."""
    sc = SparkContext._active_spark_context
    if sc is None or sc._jvm is None:
        return
    try:
        sc._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, IllegalArgumentException) as error:
        raise PatternError(str(error).split("\n")[0]) from None


@lru_cache(maxsize=128)
def compile_pattern(text: str | tuple[str, ...], fixed: bool = False, case: str = "sensitive", word: bool = False, line: bool = False, line_mode: bool = True, dot_all: bool = False, crlf: bool = False) -> Pattern:
    """case is sensitive, ignore or smart (ignore if there are letters and none is upper case); several texts are alternatives."""
    texts = (text,) if isinstance(text, str) else text
    printed, literals, empty, risky, feeds, needs = [], [], False, False, line, []
    for t in texts:
        if fixed:
            printed.append("".join(f"\\x{{{ord(c):x}}}" for c in t))
            literals += t
            empty, feeds = empty | (not t), feeds | ("\n" in t)
            needs.append(frozenset())
        else:
            p = Printer(t, Flags(line_mode=line_mode, dot_all=dot_all, crlf=crlf))
            out = p.alternation()
            if p.i < len(t):
                raise PatternError("a group isn't opened")
            if out.size > MOST_SIZE:
                raise PatternError(f"the pattern with its repeats written out is longer than {MOST_SIZE}")
            if ambiguous(out.tree, lambda c, x: holds(c, x, case != "sensitive" or "(?iu)" in out)):
                raise PatternError("a repeat can match the same text in too many ways")
            printed.append(out)
            literals += p.literals
            needs.append(out.needs)
            empty, risky, feeds = empty | out.empty, risky | out.risky, feeds | p.feeds
    ignore = case == "ignore" or case == "smart" and bool(literals) and not any(c.isupper() for c in literals)
    java = printed[0] if len(printed) == 1 else "|".join(f"(?:{x})" for x in printed)
    if line:
        java = f"\\A(?:{java})\\r?\\z" if crlf else f"\\A(?:{java})\\z" if line_mode else f"(?<![^\\n])(?:{java})(?![^\\n])"
    elif word:
        java = f"(?<![{WORD}])(?:{java})(?![{WORD}])"
    java = f"(?iu)(?:{java})" if ignore else str(java)
    if empty and not risky:  # Java would also find nothing in the middle of a character of two units
        java = f"(?![\\x{{dc00}}-\\x{{dfff}}])(?:{java})"
    check(java)
    plain = fixed or not re.search(r"[\\.+*?()|\[\]{}^$]", texts[0])
    only = texts[0] if len(texts) == 1 and plain and not (ignore or word or line) else None
    whole = len(texts) == 1 and plain and ignore and not (word or line) and bool(texts[0])
    needed = needs[0] if len(needs) == 1 and "(?iu)" not in java else frozenset()
    rare = max((chr(int(m[1], 16)) if (m := re.fullmatch(r"\\x\{([0-9a-f]+)\}", c)) else c for c in needed if len(c) == 1 or re.fullmatch(r"\\x\{[0-9a-f]+\}", c)), default=None)
    return Pattern(java, only, empty, risky and not fixed, whole, feeds, rare)
