import pytest
from pyspark.sql import functions as F

from textquarry.functions.pattern import PatternError, compile_pattern
from textquarry.operators.fuzzy import parse
from textquarry.operators.ignore import Rules, bytewise, glob_regex, ignored, parse_rules, rg_glob_regex, rg_glob_valid, verdicts
import re


@pytest.mark.parametrize("bad", [r"(?=a)", r"(?<!a)b", r"a\1", "(", ")", "[a", "*a", r"\y", "a{3,2}", "a\nb", "[b-a]", "(?P<n>a)(?P<n>b)", r"\p{Nope}", r"\p{gc=Greek}", r"\p{scx=Nope}", "[[:nope:]]", "[a&&]", "(?q)a"])
def test_bad_patterns(spark, bad):
    with pytest.raises(PatternError):
        compile_pattern(bad)


CASES = [("a.b", "a\u2028b", True), ("a$", "a\r", False), ("(?i)k", "\u212a", True), ("(?i)straße", "STRASSE", False), (r"\d", "٣", True), (r"(?-u)\d", "٣", False), ("x{,2}y", "xxy", True), (r"[\w--\d]", "7", False), (r"[\w--\d]", "q", True), ("a++b", "aab", True), (r"\bfoo\b", "éfoo", False), (r"\<foo\>", "a foo b", True), ("[]a]", "]", True), ("[^]a]", "b", True), ("[[:alpha:]]", "é", False), (r"\p{Greek}", "λ", True), (r"a|b|", "", True), ("^[a-c~~b-d]$", "a", True), ("^[a-c~~b-d]$", "d", True), ("^[a-c~~b-d]$", "b", False), ("^[a-c~~b-d]$", "~", False), ("[a-z--aeiou]", "e", False), ("[a-z--aeiou]", "f", True), (r"^\p{Lowercase_Letter}$", "é", True), (r"^\p{Lowercase_Letter}$", "É", False), (r"^\p{Any}$", "\U0001f600", True), (r"\p{White_Space}", "\u2003", True), (r"\p{scx=Hira}", "ー", True), (r"\p{sc=Hira}", "ー", False), (r"\p{^Greek}", "λ", False), ("^[[:word:]]+$", "a_1", True), ("(?x) a b # c", "ab", True), ("(?x) a b # c", "a b", False), ("(?R)a$", "a\r", True), ("a$", "a\r", False), ("(?-m)^a$", "a", True), ("(?sR).", "\r", True), ("(?R)^.$", "\r", False)]


def test_long_lines_end_no_session(spark):
    """Repeats of choices over long lines, which recursion can't follow."""
    texts = ["ab" * 10_000 + "c", "ab" * 10_000, "a" * 20_000 + "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, want in (("(a|b)*c", [True, False, False]), ("(?:ab|a)*c", [True, False, False]), ("^(a*)*b$", [False, False, True])):
        assert [r[0] for r in df.select(compile_pattern(pattern).matches(F.col("t"))).collect()] == want
    assert spark.range(1).count() == 1


SPANS = [("a*", "ba", [(0, 0), (1, 2)]), ("a*", "", [(0, 0)]), ("", "é", [(0, 0), (2, 2)]), ("x*", "axxb", [(0, 0), (1, 3), (4, 4)]), (r"\b", "ab c", [(0, 0), (2, 2), (3, 3), (4, 4)]), ("b", "éb b", [(2, 3), (4, 5)]), ("(?:ab|a)*", "aabc", [(0, 3), (4, 4)])]


@pytest.mark.parametrize("pattern,text,want", SPANS)
def test_spans(spark, pattern, text, want):
    p = compile_pattern(pattern)
    row = spark.createDataFrame([(text,)], "t string").select(p.spans(F.col("t")).alias("s"), p.all(F.col("t")).alias("m"), p.counts(F.array("t")).alias("n")).first()
    assert [tuple(x) for x in row["s"]] == want and row["n"] == [len(want)]
    assert row["m"] == [text.encode()[a:b].decode() for a, b in want]


@pytest.mark.parametrize("pattern,text,hit", CASES)
def test_matches(spark, pattern, text, hit):
    row = spark.createDataFrame([(text,)], "t string").select(compile_pattern(pattern).matches(F.col("t"))).first()
    assert row[0] is hit


def test_find_from_a_start(spark):
    df = spark.createDataFrame([("éab ab\nb",)], "t string")
    find = lambda pattern, start: df.select(compile_pattern(pattern, line_mode=False).find(F.col("t"), start)).first()[0]
    assert tuple(find("ab", 0)) == (2, 4) and tuple(find("ab", 2)) == (5, 7) and find("ab", 6) is None
    assert tuple(find(r"\bb", 3)) == (8, 9) and tuple(find("a*", 3)) == (4, 4)


@pytest.mark.parametrize("glob,text,hit", [("*.c", "a.c", True), ("*.c", "a/b.c", False), ("**/b", "b", True), ("**/b", "x/y/b", True), ("a/**", "a", False), ("a/**", "a/b/c", True), ("a/**/b", "a/b", True), ("[!a]x", "bx", True), ("[!a]x", "/x", False), ("[[:digit:]]", "5", True), ("[[:nope:]]", "5", None), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("[]-]", "]", True)])
def test_globs(glob, text, hit):
    regex = glob_regex(glob)
    if hit is None:
        assert regex is None
    else:
        assert bool(re.match(regex.replace(r"\x{", r"\x{").replace(r"\z", r"\Z") if "x{" not in regex else re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", regex).replace(r"\z", r"\Z"), text)) is hit


def test_fuzzy_terms():
    sets = parse(r"^core go$ | rb$ | py$ !x 'a\ b")
    assert [[(t.kind, t.text, t.inverse) for t in s] for s in sets] == [[("prefix", "core", False)], [("suffix", "go", False), ("suffix", "rb", False), ("suffix", "py", False)], [("exact", "x", True)], [("exact", "a b", False)]]


# Own cases: classes without POSIX names, a bracket that comes first, a chain of ranges, negation, what is unclosed, braces, depth, bytes.
RG = [
    ("q[[:upper:]]", "qp]", True),
    ("q[[:upper:]]", "qU", False),
    ("v[]k]w", "v]w", True),
    ("[0-4-9]", "7", True),
    ("[0-4-9]", "-", False),
    ("[!]t]", "t", False),
    ("mo[!n]th", "mo/th", True),
    ("mo?th", "mo/th", False),
    ("part[12", "part[12", True),
    ("{red,green}.css", "green.css", True),
    ("id{,_2}.h", "id.h", False),
    ("s{hort,{mall,lim}}", "slim", True),
    ("tab{}le", "table", True),
    ("**/notes", "notes", True),
    ("doc/**/ch1", "doc/en/v2/ch1", True),
    ("up**down", "up/down", False),
    ("?", "ß", False),
    ("??", "ß", True),
    ("[ß]?", "ß", True),
]


def test_rg_globs(spark):
    rows = [(i, g, t, h) for i, (g, t, h) in enumerate(RG)]
    for _, glob, text, hit in rows:
        assert spark.createDataFrame([(text,)], "t string").select(bytewise(F.col("t")).rlike(rg_glob_regex(glob))).first()[0] is hit, (glob, text)
    bad, good = ["x{1,2", "end}", "[9-0]", "[t-,]", "dir\\"], ["dir\\/", "[]]", "{a,b}", "\\{"]
    assert all(rg_glob_valid(g) for g in bad) and not any(rg_glob_valid(g) for g in good)


def test_rule_lines():
    line = lambda text, dialect="git": [(r.regex, r.negated, r.dir_only) for r in parse_rules(text, dialect=dialect)]
    flags = lambda text: [(r[1], r[2]) for r in line(text)]
    assert line("#note\n\n \n#\n") == [] and len(line("\\#7\n#8\n\\!9\n")) == 2
    assert flags("!kept\nout/\n!/both/\n") == [(True, False), (False, True), (True, True)]
    assert [parse_rules(x)[0].basename_only for x in ("/top", "top", "in/side", "/in/side")] == [False, True, False, False]
    assert line("q\t\n", "rg") == line("q\n", "rg") != line("q\t\n")
    assert line("end\\  \n", "rg") == [] and len(line("end\\  \n")) == 1
    assert line("x{1\n[5-2]\nfine\n", "rg") == line("fine", "rg") and line("one\n\udcfe\ntwo\n", "rg") == line("one", "rg")
    rules = Rules([("", "*.a\n!b\n"), ("x", "c")])
    assert (rules.rule_count, rules.whitelist_count) == (3, 1)
    rules.clear()
    assert rules.rule_count == 0


@pytest.mark.parametrize("chain", [300, 0])
def test_verdicts(spark, monkeypatch, chain):
    """The same by one expression and by joins."""
    from textquarry.operators import ignore

    monkeypatch.setattr(ignore, "CHAIN", chain)
    rules = Rules([("", "*.log\n!keep.log\nbuild/\n/top\nlit\na/*.x\n"), ("sub", "!*.log\nlit/\n")])
    paths = [("x.log", "ignore"), ("keep.log", "whitelist"), ("sub/x.log", "whitelist"), ("./top/", "ignore"), ("q/top", "none"), ("/lit", "ignore"), ("sub/lit", "ignore"), ("a/q.x", "ignore"), ("a/b/q.x", "none"), (".", "none"), ("", "none")]
    df = spark.createDataFrame([(p, False) for p, _ in paths], "p string, d boolean")
    assert {r["path"]: r["verdict"] for r in verdicts(df, "p", rules, "d").collect()} == dict(paths)
    below = {"build/x/y": True, "/r/build/z": True, "build": False, "sub/keep": False, "lit/q": True}
    df = spark.createDataFrame([(p,) for p in below], "p string")
    assert {r["path"]: r["ignored"] for r in ignored(df, "p", rules, root="/r").collect()} == below
    folded = Rules([("Sub", "A*.TXT")], icase=True)
    df = spark.createDataFrame([("sub/ab.txt", False), ("sub/xab.txt", False)], "p string, d boolean")
    assert {r["path"]: r["verdict"] for r in verdicts(df, "p", folded, "d").collect()} == {"sub/ab.txt": "ignore", "sub/xab.txt": "none"}


def test_admission(spark):
    rejected = [r"\p{Unknown}", r"\p{sc=Zzzz}", r"\p{scx=Zzzz}", r"\p{scx=Hrkt}", r"(?:\w{1000}){1000}", "((((b{90}){90}){90}){90})", r"(?:x+x+)+y", "(?:a|aa)+b", r"(?:\w+\s?)*!x", r"(?:[ab]*[bc]*)+d", r"((?i:k)|K)*z", r"(?:a{2}|a{3})+$"]
    for p in rejected:
        with pytest.raises(PatternError):
            compile_pattern(p)
    for p in (r"\p{scx=Deva}", r"\w{1000}", "(?:ab|a)*c", r"(?:\w+\s)*!", r"(?:[ab]+[cd])+e", "(a|b)*c", r"(?:a|b|cd)+", r"(?:\d{3},)*\d", "(?:a*)*b", "(?:.*){20}z", "(?:(?:a+){3})?b"):
        compile_pattern(p)


def test_long_lines_that_lead_nowhere(spark):
    """What a search would try again from every character is told apart by a character that has to be there."""
    import time

    began = time.time()
    texts = ["a" * 200_000, "x" * 100_000, "αβ " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p, want in (("(?:a*)*b", [False] * 3), ("(?:.*){20}z", [False] * 3), (r"\bzz\b", [False] * 3), ("(?:a|a)*a{20}", [True, False, False])):
        assert [r[0] for r in df.select(compile_pattern(p).matches(F.col("t"))).collect()] == want, p
    assert df.select(F.size(compile_pattern(r"\bα").all(F.col("t")))).collect()[2][0] == 20_000
    assert time.time() - began < 20


@pytest.mark.parametrize("dialect", ["git", "rg"])
def test_rules_by_look_up(spark, monkeypatch, dialect):
    """Ten thousand rules of a hundred bases: no path meets all of them, and verdicts are those of one expression."""
    from textquarry.operators import ignore

    kinds = {"name": "name", "*.tmp": "end", "log*": "begin", "/out/bin": "path", "a/b": "path", "a*b": None, "x/**": None, "[ab]c": None}
    for glob, kind in kinds.items():
        (rule,) = parse_rules(glob, dialect=dialect)
        assert (rule.key or (None,))[0] == kind, glob
    some = [("", "*.o\nlit\n!keep*\n/top/x\nq?\nd/\n"), ("s", "!*.o\nlit\n*é\n"), ("s/t", "x.o\n!/in/deep\n[a-c]z\n")]
    rules = Rules(some, dialect)
    names = ["a.o", "lit", "keep.o", "x", "qq", "d", "é", "aé", "az", "x.o", "deep"]
    paths = [f"{d}{n}" for d in ("", "s/", "s/t/", "top/", "s/t/in/", "z/d/") for n in names]
    df = spark.createDataFrame([(p, i % 2 == 0) for p in paths for i in range(2)], "p string, d boolean")
    told = lambda: {(r["path"], r["is_dir"]): r["verdict"] for r in verdicts(df, "p", rules, "d").collect()}
    want = told()
    monkeypatch.setattr(ignore, "CHAIN", 0)
    assert told() == want and set(want.values()) == {"none", "ignore", "whitelist"}
    many = Rules([(f"b{i}", "".join(f"n{j}\n*.e{j}\n/p{j}/q\nf{j}*\n" for j in range(25))) for i in range(100)], dialect)
    found = verdicts(spark.createDataFrame([("b7/x/n3",), ("b7/n25",), ("b99/a.e24",), ("b5/p6/q",), ("b5/x/p6/q",), ("b0/d/f12x",), ("c/n3",), ("n3",)], "p string").withColumn("d", F.lit(False)), "p", many, "d")
    assert {r["path"]: r["verdict"] for r in found.collect()} == {"b7/x/n3": "ignore", "b7/n25": "none", "b99/a.e24": "ignore", "b5/p6/q": "ignore", "b5/x/p6/q": "none", "b0/d/f12x": "ignore", "c/n3": "none", "n3": "none"}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
