"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Candidates are found in whole texts, each with its kind and code-point span.  The hash of every
candidate's value (of a private key, its body) is then counted over the corpus by distinct repositories and owners.  A value that
many owners have is a widely copied example; one that few have looks live.

Counting first reduces candidates to distinct (hash, repository, owner), with partial aggregation, and
verdicts come back to documents by a join in which hot hashes can be split.

Edge cases: null text is empty.  A null repository or owner counts as one of its own.  Rows are told apart as rows,
whatever their ids, so null and repeated ids do no harm; repeated rows are of one repository and owner and count once.
Spans of one kind never overlap; spans of two kinds may, and stand in the order of KINDS where they begin together.  Long
texts are searched whole, in work linear in their spans.  A private key is redacted from its BEGIN line to its END line; a BEGIN line without a body
is no candidate.  Extra columns are ignored (and kept by ``redact``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cut_text, highest, let, numbers, running
from .common import cut, skew_join, unused

either_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
NAMES = "|".join([*(either_case(w) for w in ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A key's block ends at its END line; without one, at the end of its base64 body: headers, a long run, and then long runs or lines of one run.
EDGE = "PRIVATE KEY-----"
LEAD = r"""(?:[\s"'#>*,;|]|//\x20|\\+[nrt])*+"""
RUN = LEAD + "[A-Za-z0-9+/]{16,}+={0,2}+"
LAST = r"""(?:\n|\\+n)""" + LEAD + r"""[A-Za-z0-9+/]++={0,2}+(?=[\x20\t"',;]*+(?:[\r\n]|\\+[nr]|\z))"""
BODY = rf"(?:(?:{LEAD}[A-Za-z][A-Za-z-]*+:\x20[^\n\\]*+)*+{RUN}(?:{RUN}|{LAST})*+)?+"
PEM = rf"-----BEGIN [A-Z ]{{0,20}}{EDGE}([^-]*+(?:-{{1,4}}[^-]++)*+(?=-----END [A-Z ]{{0,20}}{EDGE})|{BODY})(?:-----END [A-Z ]{{0,20}}{EDGE})?+"
#: What isn't part of a key's body: line breaks (written out, too), leaders, quotes.
WRAPPING = r"\\+[nrt]|[^A-Za-z0-9+/=]"
#: kind: (pattern, group of the value, least length of the value), in the order that breaks ties.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (ASSIGN, 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 26),
    "pem": (PEM, 1, 20),
}
BASE = ("assign", "access", "hex")
ANY = "|".join(f"(?:{p})" for p, _, _ in KINDS.values())
SPAN = "array<struct<start:int,no:int,kind:string,end:int,hash:string,width:int>>"


def spans_of(text: Column, kind: str) -> Column:
    """The spans of one kind: matches and the pieces between them give the offsets."""
    pattern, group, least = KINDS[kind]
    no = list(KINDS).index(kind)
    match, value, piece = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    if kind == "pem":  # one key has one hash, however it is wrapped
        value = F.transform(value, lambda v: F.regexp_replace(v, WRAPPING, ""))
    rows = F.zip_with(match, F.zip_with(value, F.slice(piece, 1, F.size(match)), lambda v, p: F.struct(v.alias("v"), F.length(p).cast("long").alias("gap"))), lambda m, x: F.struct(x["v"], x["gap"], F.length(m).cast("long").alias("m")))

    def placed(rows: Column) -> Column:
        before = running(F.transform(rows, lambda x: x["gap"] + x["m"]))

        def span(x: Column, at: Column) -> Column:
            start = (at + x["gap"]).cast("int")
            width = x["m"].cast("int") if kind == "pem" else F.length(x["v"])
            return F.struct(start.alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (start + x["m"]).cast("int").alias("end"), F.sha2(x["v"], 256).alias("hash"), width.alias("width"), F.length(x["v"]).alias("value"))

        long_enough = F.filter(F.zip_with(rows, before, span), lambda s: s["value"] >= least)
        return F.transform(long_enough, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "no", "kind", "end", "hash", "width"))))

    return let(rows, placed)


def all_spans(text: Column) -> Column:
    """All spans of a text by start, then kind; texts without any are told by one search."""
    none = F.array().cast(SPAN)
    kinds = [F.when(text.rlike(KINDS[k][0]), spans_of(text, k)).otherwise(none) for k in KINDS]
    return F.when(text.rlike(ANY), F.array_sort(F.concat(*kinds))).otherwise(none)


def named(col: str | Column) -> Column:
    """A repository or owner as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), (F.col(col) if isinstance(col, str) else col).cast("string")), F.lit(""))


def copied_by_key(rows: DataFrame, min_repos: int, min_owners: int) -> DataFrame:
    """(key, copied): which of each key's candidates, counted from 1, are widely copied, where it has any."""
    seen = rows.where(F.size("spans") > 0).select("key", "repo", "owner", F.posexplode("spans.hash").alias("at", "hash"))
    owned = seen.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("one"))
    counts = owned.groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    copied = counts.where((F.col("repos") >= min_repos) & (F.col("owners") >= min_owners)).select("hash")
    return skew_join(seen.select("key", "at", "hash"), copied, ["hash"]).groupBy("key").agg(F.collect_list((F.col("at") + 1).cast("long")).alias("copied"))


def flags(copied: Column, n: Column) -> Column:
    """For each of n candidates whether it is among those copied."""
    flagged = lambda at, flag: F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(flag).alias("copied")))
    return F.transform(F.array_sort(F.concat(flagged(copied, True), flagged(F.array_except(numbers(n), copied), False))), lambda x: x["copied"])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | Column = "source", owner_col: str | Column = "source", min_repos: int = 3, min_owners: int = 3) -> DataFrame:
    """(doc_id, spans, n_live, n_copied); a span has start, kind, end, hash of the value and copied."""
    spans = all_spans(F.coalesce(F.col(text_col), F.lit("")))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), named(repo_col).alias("repo"), named(owner_col).alias("owner"), spans.alias("spans"), F.monotonically_increasing_id().alias("key")))  # written, so the keys are fixed
    has = F.size("spans") > 0
    found = rows.where(has).join(copied_by_key(rows, min_repos, min_owners), "key", "left")
    copied = F.coalesce("copied", F.array().cast("array<long>"))
    span = lambda s, c: F.struct(s["start"], s["kind"], s["end"], s["hash"], c.alias("copied"))
    told = F.zip_with("spans", flags(copied, F.size("spans")), span).alias("spans")
    n = lambda c: F.size(F.filter("spans", c)).cast("long")
    out = found.select("doc_id", told).unionByName(rows.where(~has).withColumn("copied", F.array().cast("array<long>")).select("doc_id", told))
    return out.select("doc_id", "spans", n(lambda s: ~s["copied"]).alias("n_live"), n(lambda s: s["copied"]).alias("n_copied"))


def marked(text: Column, spans: Column, mark: str) -> Column:
    """A text with a mark for each run of spans that overlap; it is cut once, at the runs' ends."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct((s["end"] - s["width"]).cast("long").alias("start"), s["end"].cast("long").alias("end"))))

    def of(s: Column) -> Column:
        def runs(done: Column) -> Column:
            """done: how far the spans before each one reach; a span that begins there or later begins a run."""
            firsts = F.filter(numbers(F.size(s)), lambda i: F.element_at(s, i.cast("int"))["start"] >= F.element_at(done, i.cast("int")))

            def gaps(first: Column) -> Column:
                whole = F.length(text).cast("long")
                gap = lambda i: F.struct(F.element_at(done, i.cast("int")).alias("start"), F.element_at(s, i.cast("int"))["start"].alias("end"))
                last = F.struct(F.array_max(F.transform(s, lambda x: x["end"])).alias("start"), whole.alias("end"))
                return F.array_join(cut_text(text, F.concat(F.transform(first, gap), F.array(last))), mark)

            return let(firsts, gaps)

        return F.when(F.size(s) == 0, text).otherwise(let(highest(F.transform(s, lambda x: x["end"])), runs))

    return let(by_start, of)


def redact(docs: DataFrame, text_col: str = "text", repo_col: str | Column = "source", owner_col: str | Column = "source", min_repos: int = 3, min_owners: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """docs with every live-looking value replaced by mark; widely copied examples stay.

    Texts are searched once and written with their spans.  Only documents that have candidates are joined to their
    verdicts; all others pass by.
    """
    key, found, copied, repo, owner = (unused(docs, c) for c in ("secret_key", "secret_spans", "secret_copied", "secret_repo", "secret_owner"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({found: all_spans(text), repo: named(repo_col), owner: named(owner_col), key: F.monotonically_increasing_id()})
    rows = cut(rows)  # the keys are fixed from here on
    has = F.size(found) > 0
    verdicts = copied_by_key(rows.select(F.col(key).alias("key"), F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.col(found).alias("spans")), min_repos, min_owners)
    hit = rows.where(has).join(verdicts.select(F.col("key").alias(key), F.col("copied").alias(copied)), key, "left")
    known = F.coalesce(copied, F.array().cast("array<long>"))
    live = F.transform(F.array_except(numbers(F.size(found)), known), lambda i: F.element_at(found, i.cast("int")))
    hit = hit.withColumn(text_col, marked(text, live, mark))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.where(~has).select(*docs.columns).unionByName(hit.select(*docs.columns))
