"""Ignore rules as data: the last rule that matches a path decides.

Rules are lines as in ignore files: ``#`` comments, ``!`` re-includes, a trailing ``/`` is for directories, a ``/``
elsewhere anchors the rule to its base.  Two dialects differ in their globs and in how lines are read: ``git`` has POSIX
classes and trims spaces; ``rg`` has alternatives in braces, classes that match a slash, and works on bytes.

Rules are few and known when a plan is made, so up to CHAIN of them are one expression over the path, the rule that wins
first: no join, no shuffle.  More rules, up to MAX_RULES, are joined: literal names by equality, the rest in a broadcast
join, and the verdict is a maximum of integers, so it is partially aggregated before the shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAIN = 300
MAX_RULES = 100_000
# The named character classes of globs.
POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": " \\t", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t-\\r ", "upper": "A-Z", "xdigit": "0-9A-Fa-f"}


def glob_regex(glob: str, path: bool = True, icase: bool = False) -> str | None:
    """An anchored Java pattern, or None where the glob can't match.  With path, ``*`` and ``?`` stop at a slash.

    With icase ASCII letters match in either case, but for escaped ones.
    """
    out, i, n = [], 0, len(glob)
    one = "[^/]" if path else "(?s:.)"
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            whole = path and j - i >= 2 and (i == 0 or glob[i - 1] == "/") and (j == n or glob[j] == "/")
            if whole and j < n:
                out.append("(?:(?s:.)*/)?")
                j += 1
            else:
                out.append("(?s:.)*" if whole or not path else "[^/]*")
            i = j
            continue
        if c == "?":
            out.append(one)
        elif c == "[":
            m = re.compile(r"\[([!^]?)(\]?(?:\[:\w*:\]|\\.|[^\]\\])*)\]", re.S).match(glob, i)
            if not m:
                return None
            body, bad = [], False
            for part in re.finditer(r"\[:(\w*):\]|(\\?.)-(\\?.)|\\?(.)", m[2], re.S):
                if part[1] is not None:
                    bad |= part[1] not in POSIX
                    body.append(POSIX.get(part[1], ""))
                elif part[2]:
                    lo, hi = part[2][-1], part[3][-1]
                    body.append(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}" if lo <= hi else "")
                else:
                    body.append(f"\\x{{{ord(part[4]):x}}}")
            if bad:
                return None
            inner = "".join(body)
            slash = "(?!/)" if path else ""
            out.append(slash + (f"[{'^' if m[1] else ''}{inner}]" if inner else one if m[1] else "(?!)"))
            i = m.end()
            continue
        elif c == "\\":
            i += 1
            if i == n:
                return None
            out.append(f"(?-i:\\x{{{ord(glob[i]):x}}})" if icase else f"\\x{{{ord(glob[i]):x}}}")
        else:
            out.append(c if c.isascii() and c.isalnum() or c == "/" else f"\\x{{{ord(c):x}}}")
        i += 1
    return f"\\A(?i:{''.join(out)})\\z" if icase else f"\\A{''.join(out)}\\z"


class GlobError(ValueError):
    """The glob isn't valid; the text says why."""


def rg_glob_regex(glob: str, icase: bool = False) -> str:
    """The anchored pattern of a glob of the rg dialect, over the path's UTF-8 bytes as characters below 256."""
    text = glob.encode("utf-8", "surrogateescape").decode("latin-1")
    char = lambda c: c if c.isascii() and c.isalnum() or c == "/" else f"\\x{{{ord(c):x}}}"
    i, n, open_braces = 0, len(text), 0
    levels: list[list[list[str]]] = [[[]]]  # of each open brace its alternatives, of each its parts
    while i < n:
        c, parts = text[i], levels[-1][-1]
        if c == "*":
            j = i
            while j < n and text[j] == "*":
                j += 1
            begins, ends = i == 0 or text[i - 1] == "/", j == n or text[j] == "/"
            if j - i >= 2 and begins and ends:
                if j >= n - 1:  # at the end, also before a last slash, any path
                    parts.append("(?s:.)*")
                    j = n
                else:
                    parts.append("(?:(?s:.)*/)?")
                    j += 1
            else:
                parts.append("[^/]*")
            i = j
            continue
        if c == "?":
            parts.append("[^/]")
        elif c == "[":
            end, body = rg_class(text, i)
            if end:
                parts.append(body)
                i = end
                continue
            parts.append(char(c))  # without an end it is a bracket
        elif c == "{":
            levels.append([[]])
            open_braces += 1
        elif c == "}":
            if not open_braces:
                raise GlobError("an alternative isn't opened")
            open_braces -= 1
            some = ["".join(x) for x in levels.pop() if x]
            levels[-1][-1].append(f"(?:{'|'.join(some)})" if some else "")
        elif c == "," and open_braces:
            levels[-1].append([])
        elif c == "\\":
            i += 1
            if i == n:
                raise GlobError("an escape has nothing to escape")
            parts.append(char(text[i]))
        else:
            parts.append(char(c))
        i += 1
    if open_braces:
        raise GlobError("an alternative isn't closed")
    body = "".join(levels[0][0])
    return f"\\A(?i:{body})\\z" if icase else f"\\A{body}\\z"


def rg_class(text: str, at: int) -> tuple[int | None, str]:
    """Where the class that begins here ends, and its pattern; None where it has no end.  A backslash is a member."""
    i = at + 1
    negated = text[i : i + 1] in ("!", "^")
    i += negated
    end = text.find("]", i + 1)
    if end < 0:
        return None, ""
    members, ranges = text[i:end], []
    k, last = 0, None
    while k < len(members):
        c = members[k]
        if c == "-" and last is not None and k + 1 < len(members):
            c = members[k + 1]
            if ord(c) < ord(last):
                raise GlobError("a range is empty")
            ranges.append(f"\\x{{{ord(last):x}}}-\\x{{{ord(c):x}}}")
            k += 1
        else:
            ranges.append(f"\\x{{{ord(c):x}}}")
        last = c
        k += 1
    return end + 1, f"[{'^' * negated}{''.join(ranges)}]"


def rg_glob_valid(glob: str) -> str | None:
    """Why a glob of the rg dialect isn't valid; None if it is."""
    try:
        rg_glob_regex(glob)
    except GlobError as error:
        return str(error)
    return None


@dataclass(frozen=True)
class Rule:
    """regex is anchored; it meets the last component, or the path below the base.  literal: the last component that it is.

    key: what a path has to have to match, where that can be looked up: a name, the end or the beginning of one, or a path below the base.
    """

    base: str
    ord: int
    negated: bool
    dir_only: bool
    basename_only: bool
    regex: str
    literal: str | None
    bytewise: bool
    key: tuple[str, str] | None = None


PLAIN = re.compile(r"[^*?\[\]{}\\,]+")


def key_of(glob: str, by_name: bool) -> tuple[str, str] | None:
    """What a path is looked up by for a glob of a name, or of a path: a glob with at most one star, at an end of a name."""
    for kind, plain in (("end", glob[1:] if glob.startswith("*") else ""), ("begin", glob[:-1] if glob.endswith("*") else ""), ("name" if by_name else "path", glob)):
        if PLAIN.fullmatch(plain) and (by_name or kind == "path"):
            return kind, plain
    return None  # classes, braces, escapes, other stars


def git_line(line: str) -> tuple[bool, bool, bool, str, str] | None:
    """(negated, for directories alone, by name alone, glob, name as written) of a line; None for none."""
    while line.endswith(" ") and not re.search(r"(?<!\\)(?:\\\\)*\\ \Z", line):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    dir_only = line.endswith("/")
    line = line[: len(line) - dir_only]
    return (negated, dir_only, "/" not in line, line.removeprefix("/"), line) if line else None


def rg_line(line: str) -> tuple[bool, bool, bool, str, str] | None:
    if line.startswith("#"):
        return None
    if not line.endswith("\\ "):
        line = re.sub(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+\Z", "", line)
    if not line:
        return None
    negated = absolute = False
    if line[:2] in ("\\!", "\\#"):
        line = line[1:]
    else:
        negated = line.startswith("!")
        line = line[negated:]
        absolute = line.startswith("/")
        line = line[absolute:]
    dir_only = line.endswith("/")
    if dir_only:
        line = line[:-1].removesuffix("\\")
    anywhere = not absolute and "/" not in line
    glob = line if not anywhere or line.startswith("**/") or line == "**" else f"**/{line}"
    return negated, dir_only, anywhere and bool(PLAIN.fullmatch(line)), glob + "/*" * glob.endswith("/**"), line


def parse_rules(text: str, base: str = "", dialect: str = "git", icase: bool = False) -> list[Rule]:
    """The usable lines of an ignore file; lines that can't match anything, or aren't valid, are left out.

    Undecodable bytes are surrogates here; the rg dialect stops at the first line with one.
    """
    rows: list[Rule] = []
    for line in text.removeprefix("\ufeff").split("\n"):
        if dialect == "rg" and re.search("[\ud800-\udfff]", line):
            break
        got = (rg_line if dialect == "rg" else git_line)(line.removesuffix("\r"))
        if got is None:
            continue
        negated, dir_only, by_name, glob, name = got
        literal = name if by_name and PLAIN.fullmatch(name) and not icase else None
        try:
            regex = rg_glob_regex(glob, icase) if dialect == "rg" else glob_regex(glob, path=not by_name, icase=icase)
        except GlobError:
            continue
        if regex:
            anywhere = by_name if dialect == "git" else glob.startswith("**/") and "/" not in glob[3:]
            key = None if icase else key_of(glob.removeprefix("**/") if anywhere and dialect == "rg" else glob, anywhere)
            rows.append(Rule(base, len(rows), negated, dir_only, by_name and dialect == "git", regex, literal, dialect == "rg", key))
    return rows


class Rules:
    """The rules of (base, text) ignore files: deeper bases win, then later files of one base, then later lines."""

    def __init__(self, files: list[tuple[str, str]] = (), dialect: str = "git", icase: bool = False) -> None:
        self.dialect, self.icase, self.all = dialect, icase, []
        for base, text in files:
            self.add(text, base)

    def add(self, text: str, base: str = "") -> Rules:
        base = base.strip("/").removeprefix("./")
        at = len(self.all)
        self.all += [Rule(**{**vars(r), "ord": at + r.ord}) for r in parse_rules(text, base, self.dialect, self.icase)]
        if len(self.all) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        return self

    def add_file(self, path: str, base: str = "") -> Rules:
        with open(path, encoding="utf-8", errors="surrogateescape", newline="") as file:
            return self.add(file.read(), base)

    def clear(self) -> None:
        self.all = []

    @property
    def rule_count(self) -> int:
        return len(self.all)

    @property
    def whitelist_count(self) -> int:
        return sum(r.negated for r in self.all)

    def code(self, r: Rule) -> int:
        depth = r.base.count("/") + 1 if r.base else 0
        return (depth * MAX_RULES + r.ord) * 2 + r.negated


def rules(spark: SparkSession, files: list[tuple[str, str]], dialect: str = "git", icase: bool = False) -> Rules:
    return Rules(files, dialect, icase)


def normalised(path: Column, root: str | None = None) -> Column:
    """A path without leading ``./`` and outer slashes; an absolute one below root is taken from there."""
    if root:
        top = "/" + root.strip("/")
        path = F.when((path == top) | path.startswith(top + "/"), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)
    path = F.regexp_replace(F.regexp_replace(path, r"\A(?:\./)+", ""), r"\A/+|/+\z", "")
    return F.when(path == ".", "").otherwise(path)


def bytewise(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def verdict_of(path: Column, is_dir: Column, known: Rules) -> Column:
    """none, ignore or whitelist for one path, without its ancestors: the first that matches, from the rule that wins."""
    name = F.element_at(F.split(path, "/", -1), -1)
    same = (lambda a, b: F.lower(a) == b.lower()) if known.icase else (lambda a, b: a == b)

    def hit(r: Rule) -> Column:
        below = path if not r.base else F.substring(path, F.lit(len(r.base) + 2), F.length(path))
        if r.literal is not None:
            found = name == r.literal
        else:
            subject = name if r.basename_only else below
            found = (bytewise(subject) if r.bytewise else subject).rlike(r.regex)
        if r.base:
            found = same(F.substring(path, F.lit(1), F.lit(len(r.base) + 1)), r.base + "/") & found
        return is_dir & found if r.dir_only else found

    ordered = sorted(known.all, key=known.code, reverse=True)
    chain = reduce(lambda c, r: c.when(hit(r), "whitelist" if r.negated else "ignore"), ordered, F.when(F.lit(False), "none"))
    return F.when(path == "", "none").otherwise(chain.otherwise("none"))


def verdicts(paths: DataFrame, path_col: str, known: Rules, is_dir_col: str, root: str | None = None) -> DataFrame:
    """(path, is_dir, verdict) of the distinct paths: none, ignore or whitelist; rules of deeper bases win, then later ones."""
    p = paths.select(F.col(path_col).alias("path"), F.col(is_dir_col).alias("is_dir")).distinct().withColumn("_at", normalised(F.col("path"), root))
    if len(known.all) <= CHAIN:
        return p.select("path", "is_dir", verdict_of(F.col("_at"), F.col("is_dir"), known).alias("verdict"))
    return joined(p, known)


def joined(p: DataFrame, known: Rules) -> DataFrame:
    """The same for very many rules, by look-up: rules with a key by their base and key, the rest by their base.

    A path meets the bases above it by equality, and of a base only the rules whose key it has: its name, as many ends and
    beginnings of it as rules have different lengths, and its path below the base.  The other rules of a base are tested in
    the path's row.  The tables of rules have at most MAX_RULES entries and are broadcast.
    """
    spark, fold = p.sparkSession, F.lower if known.icase else (lambda c: c)
    one = "array<struct<code:long,dir_only:boolean,basename_only:boolean,regex:string,bytewise:boolean>>"
    entries: dict[tuple, list] = {}
    for r in known.all:
        base = r.base.lower() if known.icase else r.base
        entries.setdefault((base, *(r.key or ("other", ""))), []).append((known.code(r), r.dir_only, r.basename_only, None if r.key else r.regex, r.bytewise))
    index = spark.createDataFrame([(*k, v) for k, v in entries.items()], f"base string, kind string, key string, rules {one}")
    bases = spark.createDataFrame([(b,) for b in sorted({k[0] for k in entries})], "base string")
    parts = F.split("_at", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(fold(F.array_join(F.slice(parts, 1, i), "/")).alias("base"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("_below")))
    p = p.withColumn("_name", F.element_at(parts, -1))
    met = p.where("_at <> ''").select("path", "is_dir", "_name", F.inline(above)).join(F.broadcast(bases), "base")
    lengths = {kind: sorted({len(k[2]) for k in entries if k[1] == kind}) for kind in ("begin", "end")}
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("key"))
    keys = [key("name", F.col("_name")), key("path", F.col("_below")), key("other", F.lit(""))]
    for kind, take in (("begin", F.left), ("end", F.right)):
        keys += [F.when(F.length("_name") >= n, key(kind, take("_name", F.lit(n)))) for n in lengths[kind]]
    looked = met.select("path", "is_dir", "base", "_name", "_below", F.inline(F.filter(F.array(*keys), lambda k: k.isNotNull())))

    def holds(r: Column) -> Column:
        subject = F.when(r["basename_only"], F.col("_name")).otherwise(F.col("_below"))
        subject = F.when(r["bytewise"], bytewise(subject)).otherwise(subject)
        return (~r["dir_only"] | F.col("is_dir")) & (r["regex"].isNull() | F.call_function("rlike", subject, r["regex"]))

    best = F.array_max(F.transform(F.filter("rules", holds), lambda r: r["code"]))
    hits = looked.join(F.broadcast(index), ["base", "kind", "key"]).select("path", "is_dir", best.alias("code"))
    hits = hits.unionByName(p.select("path", "is_dir", F.lit(None).cast("long").alias("code")))
    best = hits.groupBy("path", "is_dir").agg(F.max("code").alias("code"))
    return best.select("path", "is_dir", F.when(F.col("code").isNull(), "none").when(F.col("code") % 2 == 1, "whitelist").otherwise("ignore").alias("verdict"))


def ignored(paths: DataFrame, path_col: str, known: Rules, is_dir: Column | None = None, root: str | None = None) -> DataFrame:
    """(path, ignored) of the distinct paths, files unless is_dir says otherwise: ignored if it or any directory above it is."""
    last = F.lit(False) if is_dir is None else is_dir
    p = paths.select(F.col(path_col).alias("path"), last.alias("_last")).distinct().withColumn("_at", normalised(F.col("path"), root))
    parts = F.split("_at", "/", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), ((i < F.size(parts)) | F.col("_last")).alias("is_dir")))
    if len(known.all) <= CHAIN:
        return p.select("path", F.exists(up, lambda x: verdict_of(x["prefix"], x["is_dir"], known) == "ignore").alias("ignored"))
    each = p.select("path", F.inline(up))
    told = verdicts(each, "prefix", known, "is_dir").withColumnRenamed("path", "prefix")
    return each.join(told, ["prefix", "is_dir"]).groupBy("path").agg(F.max((F.col("verdict") == "ignore").cast("int")).alias("m")).select("path", (F.col("m") == 1).alias("ignored"))
