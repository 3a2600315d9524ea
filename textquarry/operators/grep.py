"""Line search over a text column.

A line is what stands between line feeds; a final line feed doesn't begin another line.  A document's lines are in
its row already, so nothing here moves rows between tasks: lines are selected in one narrow stage (a whole-text test
first, where the pattern is a fixed string), and context, limits and offsets are worked out over the row's array of lines.

With ``multiline`` a pattern meets whole texts and may span lines: all lines that a match touches are selected, and
limits count matches.  Documents are rows, whatever their ids.  A limit may be a column, so that each row has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import grouped, let, numbers, running
from ..functions.pattern import Pattern, compile_pattern


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it where an id column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def body_of(text: Column) -> Column:
    return F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def lines_of(text: Column) -> Column:
    """The lines of a text; of none, null or empty, no lines."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body_of(text), "\n", -1))


def selected(pattern: Pattern, text: Column, invert: bool) -> Column:
    hit = pattern.matches(text)
    return ~hit if invert else hit


def column_of(pattern: Pattern, text: Column) -> Column:
    """The byte column, from 1, of the first match; 1 where there is none."""
    return F.coalesce(F.octet_length(pattern.before_first(text)) + 1, F.lit(1)).cast("long")


def matcher(pattern: str | tuple[str, ...], multiline: bool, multiline_dotall: bool, **options) -> tuple[Pattern, bool]:
    """The pattern, and whether its matches may span lines: one that can't touch a line feed is looked for line by line."""
    p = compile_pattern(pattern, line_mode=not multiline, dot_all=multiline_dotall, **options)
    if multiline and not p.feeds:
        return compile_pattern(pattern, **options), False
    return p, multiline


def starts_of(lines: Column) -> Column:
    """Where each line begins, in bytes."""
    return running(F.transform(lines, lambda x: (F.octet_length(x) + 1).cast("long")))


def matches_in(pattern: Pattern, text: Column) -> Column:
    """array<struct<line, last, start, end, match>>: the matches of a whole text, the first and last line and the bytes that each touches.

    An empty match behind the final line feed is on no line.
    """
    feeds = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long")
    size = lambda x: F.octet_length(x).cast("long")

    def of(p: Column) -> Column:
        lines = running(F.transform(p, lambda x: feeds(x["gap"]) + feeds(x["match"])))
        ends = running(F.transform(p, lambda x: size(x["gap"]) + size(x["match"])))

        def match(x: Column, at: Column) -> Column:
            first, start = at["line"] + feeds(x["gap"]) + 1, at["end"] + size(x["gap"])
            last = first + feeds(x["match"]) - x["match"].endswith("\n").cast("long")
            return F.struct(first.alias("line"), last.alias("last"), start.alias("start"), (start + size(x["match"])).alias("end"), x["match"].alias("match"))

        return F.zip_with(p, F.zip_with(lines, ends, lambda n, e: F.struct(n.alias("line"), e.alias("end"))), match)

    behind = lambda x: (x["match"] == "") & (x["start"] == size(text)) & (text.endswith("\n") | (text == ""))
    return F.filter(let(pattern.pairs(F.coalesce(text, F.lit(""))), of), lambda x: ~behind(x))


def lines_touched(found: Column) -> Column:
    """The lines of matches, each once, in order: what each match touches behind what the one before it does."""

    def own(x: Column, i: Column) -> Column:
        before = F.coalesce(F.try_element_at(found, F.when(i > 0, i.cast("int")))["last"], F.lit(0).cast("long"))
        return between(F.greatest(x["line"], before + 1), x["last"])

    return F.flatten(F.transform(found, own))


def between(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def with_context(kept: Column, n: Column, before: int, after: int) -> Column:
    """The lines kept and those around them, each once, in order, of n lines."""

    def own(i: Column, k: Column) -> Column:
        done = F.coalesce(F.try_element_at(kept, F.when(k > 0, k.cast("int"))) + after, F.lit(0).cast("long"))
        return between(F.greatest(i - before, done + 1), F.least(i + after, n.cast("long")))

    return F.flatten(F.transform(kept, own))


def pieces_by_line(found: Column, lines: Column, starts: Column) -> Column:
    """For each line that matches touch, in order, the spans of them in it; none for a piece that is only the line feed."""

    def pieces(x: Column) -> Column:
        def piece(i: Column) -> Column:
            begin, width = F.element_at(starts, i.cast("int")), F.octet_length(F.element_at(lines, i.cast("int"))).cast("long")
            start, end = F.greatest(x["start"] - begin, F.lit(0)), F.least(x["end"] - begin, width)
            span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), (x["start"] < begin).alias("continued"))
            return F.struct(i.alias("line"), span.alias("span"), ((start < end) | (x["start"] == x["end"])).alias("shown"))

        return F.transform(F.sequence(x["line"], x["last"]), piece)

    spans = lambda g: F.transform(F.filter(g, lambda x: x["shown"]), lambda x: x["span"])
    return F.transform(grouped(F.flatten(F.transform(found, pieces)), lambda x: x["line"]), spans)


NO_SPANS = "array<struct<start:int,end:int,continued:boolean>>"


def regions(p: Pattern, text: Column, invert: bool, before: int, after: int, max_count: int | None, spans: bool) -> Column:
    """array<struct<_kind, _number, _line, _offset, _spans, _continued>> of a text whose matches may span lines."""
    no_spans = F.array().cast(NO_SPANS)

    def of(x: Column) -> Column:
        lines, starts, every = x["lines"], x["starts"], x["every"]
        found = F.slice(every, 1, max_count) if max_count else every

        def shown(y: Column) -> Column:
            touched, by_line = y["touched"], y["by_line"]
            n = F.size(lines)
            hits = F.array_except(numbers(n), touched) if invert else touched

            def row(i: Column, kind: Column, its: Column, run_on: Column) -> Column:
                return F.struct(kind.alias("_kind"), i.alias("_number"), F.element_at(lines, i.cast("int")).alias("_line"), F.element_at(starts, i.cast("int")).alias("_offset"), its.alias("_spans"), run_on.alias("_continued"))

            def match(i: Column, k: Column) -> Column:
                if invert:
                    return row(i, F.lit("match"), no_spans, F.lit(False))
                its = F.element_at(y["by_line"], (k + 1).cast("int")) if spans else no_spans
                return row(i, F.lit("match"), its, (k > 0) & (F.element_at(touched, F.greatest(k, F.lit(1)).cast("int")) == i - 1))

            def context(i: Column) -> Column:
                kind = F.lit("context")
                if max_count and not invert:  # behind the last match that counts, others show as matches
                    late = (F.size(every) >= max_count) & (i > F.element_at(touched, -1)) & p.matches(F.element_at(lines, i.cast("int")))
                    kind = F.when(late, "match").otherwise(kind)
                return row(i, kind, no_spans, F.lit(False))

            def rows(h: Column) -> Column:
                def all_of(all_lines: Column) -> Column:
                    return F.concat(F.transform(h, match), F.transform(F.array_except(all_lines, h), context))

                return let(with_context(h, n, before, after), all_of) if before or after else F.transform(h, match)

            return let(hits, rows)

        return let(F.struct(lines_touched(found).alias("touched"), (pieces_by_line(found, lines, starts) if spans else F.lit(0)).alias("by_line")), shown)

    whole = lambda lines: F.struct(lines.alias("lines"), starts_of(lines).alias("starts"), matches_in(p, text).alias("every"))
    return let(let(lines_of(text), whole), of)


def lines_around(p: Pattern, text: Column, flags: Column | None, invert: bool, before: int, after: int, max_count: int | Column | None, offsets: bool) -> Column:
    """array<struct<_kind, _number, _line, _offset>> of the lines of a text that match, those around them, and their offsets.

    flags: which lines match, where that is known already.
    """

    def of(x: Column) -> Column:
        lines, hit = x["lines"], lambda i: F.element_at(x["flags"], i.cast("int")) != F.lit(invert)

        def shown(kept: Column) -> Column:
            around = with_context(kept, F.size(lines), before, after) if before or after else kept
            # hits behind the last that counts may be around it, and are matches as well
            return F.transform(around, lambda i: F.struct(F.when(hit(i), "match").otherwise("context").alias("_kind"), i.alias("_number"), F.element_at(lines, i.cast("int")).alias("_line"), (F.element_at(x["starts"], i.cast("int")) if offsets else F.lit(0)).alias("_offset")))

        hits = F.filter(numbers(F.size(lines)), hit)
        return let(hits if max_count is None else F.slice(hits, 1, max_count), shown)

    whole = lambda lines: F.struct(lines.alias("lines"), (p.flags(lines) if flags is None else flags).alias("flags"), (starts_of(lines) if offsets else F.array(F.lit(0))).alias("starts"))
    return let(let(lines_of(text), whole), of)


def grep(
    df: DataFrame,
    text_col: str,
    pattern: str | tuple[str, ...],
    id_cols: list[str],
    invert: bool = False,
    before: int = 0,
    after: int = 0,
    max_count: int | Column | None = None,
    byte_offset: bool = False,
    column: bool = False,
    spans: bool = False,
    max_spans_per_line: int | None = None,
    multiline: bool = False,
    multiline_dotall: bool = False,
    **options,
) -> DataFrame:
    """Matching lines, with context lines where asked for: (ids, kind, line_number, [byte_offset, column, spans, region_continued,] text).

    Names that an id column has get an underscore.  Inverted lines have no spans.  With multiline, spans tell whether
    their match began on an earlier line (continued), and a line whether it is of one region with the line before it.
    """
    p, whole_text = matcher(pattern, multiline, multiline_dotall, **options)
    text = F.col(text_col)
    per_row, max_count = max_count if isinstance(max_count, Column) else None, None if isinstance(max_count, Column) else max_count or None
    if per_row is not None and whole_text:
        raise ValueError("a limit for each row goes by lines")
    rows = df.where(p.matches(text)) if (p.fixed or p.whole or whole_text and not p.risky) and not invert else df.where(text.isNotNull() & (text != ""))
    ids = [f"_id{i}" for i in range(len(id_cols))]
    rows = rows.select(*(F.col(c).alias(i) for c, i in zip(id_cols, ids)), text.alias("_text"), *([] if per_row is None else [per_row.alias("_most")]))
    limit = max_count if per_row is None else F.col("_most")
    line = F.col("_line")
    if whole_text:
        rows = rows.select(*ids, F.inline(regions(p, F.col("_text"), invert, before, after, max_count, spans or column)))
    else:
        if before or after or limit is not None or byte_offset:
            if p.risky:
                rows = rows.withColumn("_known", p.flags(lines_of(F.col("_text"))))
            rows = rows.select(*ids, F.inline(lines_around(p, F.col("_text"), F.col("_known") if p.risky else None, invert, before, after, limit, byte_offset)))
        else:
            rows = rows.select(*ids, F.posexplode(lines_of(F.col("_text"))).alias("_pos", "_line")).where(selected(p, line, invert))
            rows = rows.select(*ids, F.lit("match").alias("_kind"), (F.col("_pos") + 1).cast("long").alias("_number"), "_line")
    out = {"kind": F.col("_kind"), "line_number": F.col("_number")}
    if byte_offset:
        out["byte_offset"] = F.col("_offset")
    if column:
        out["column"] = F.coalesce(F.try_element_at("_spans", F.lit(1))["start"] + 1, F.lit(1)).cast("long") if whole_text else column_of(p, line)
    if spans:
        its = F.col("_spans") if whole_text else F.array().cast("array<struct<start:int,end:int>>") if invert else p.spans(line)
        if multiline and not whole_text:
            its = F.transform(its, lambda x: F.struct(x["start"], x["end"], F.lit(False).alias("continued")))
        out["spans"] = F.slice(its, 1, max_spans_per_line) if max_spans_per_line else its
        if multiline:
            out["region_continued"] = F.col("_continued") if whole_text else F.lit(False)
    out["text"] = line
    return rows.select(*(F.col(i).alias(c) for i, c in zip(ids, id_cols)), *(v.alias(free(k, id_cols)) for k, v in out.items()))


def grep_count(df: DataFrame, text_col: str, pattern: str | tuple[str, ...], id_cols: list[str], invert: bool = False, matches: bool = False, multiline: bool = False, multiline_dotall: bool = False, **options) -> DataFrame:
    """(ids, n): selected lines, or matches, of every document that has any; matches that may span lines are always counted, unless inverted."""
    p, whole_text = matcher(pattern, multiline, multiline_dotall, **options)
    text = F.col(text_col)
    if whole_text:
        found = matches_in(p, text)
        n = F.size(lines_of(text)) - let(found, lambda x: F.size(lines_touched(x))) if invert else F.size(found)
    elif matches:
        n = F.lit(0) if invert else F.aggregate(p.counts(lines_of(text)), F.lit(0), lambda a, x: a + x)
    else:
        n = F.size(F.filter(p.flags(lines_of(text)), lambda x: x != F.lit(invert)))
    name = free("n", id_cols)
    # n is asked for twice, by the filter and the result, so it comes from one array
    return df.where(text.isNotNull() & (text != "")).select(*id_cols, F.explode(F.filter(F.array(n.cast("long")), lambda x: x > 0)).alias(name))


def grep_documents(df: DataFrame, text_col: str, pattern: str | tuple[str, ...], id_cols: list[str], without: bool = False, invert: bool = False, multiline: bool = False, multiline_dotall: bool = False, **options) -> DataFrame:
    """The ids of documents with (or without) a selected line: one that matches or, inverted, one that doesn't."""
    p, whole_text = matcher(pattern, multiline, multiline_dotall, **options)
    text = F.col(text_col)
    if whole_text and invert:
        hit = let(matches_in(p, text), lambda x: F.size(lines_touched(x))) < F.size(lines_of(text))
    elif whole_text:  # an empty match may be on no line
        hit = F.size(matches_in(p, text)) > 0 if p.empty or p.risky else F.coalesce(p.matches(text), F.lit(False))
    elif p.fixed is not None and "\n" not in p.fixed and not invert:
        hit = F.coalesce(text.contains(p.fixed), F.lit(False))
    elif p.risky:
        hit = F.exists(p.flags(lines_of(text)), lambda x: x != F.lit(invert))
    else:
        hit = F.exists(lines_of(text), lambda x: selected(p, x, invert))
    return df.where(~hit if without else hit).select(*id_cols)


def only_matching(df: DataFrame, text_col: str, pattern: str | tuple[str, ...], id_cols: list[str], column: bool = False, multiline: bool = False, multiline_dotall: bool = False, needs: str | None = None, **options) -> DataFrame:
    """(ids, line_number, nth from 1, [column,] match): a row for each match, nth within its line or, with multiline, its text.

    With column, the byte column from 1 where the match begins in its line.  needs: a simpler pattern that is found in every
    line with a match; texts and lines without it are passed over.
    """
    p, whole_text = matcher(pattern, multiline, multiline_dotall, **options)
    text = F.col(text_col)
    names = {k: free(k, id_cols) for k in ("line_number", "nth", "column", "match")}
    if whole_text:
        begins = lambda x: F.struct(x["found"]["line"].alias("line"), (x["found"]["start"] - F.element_at(x["starts"], x["found"]["line"].cast("int")) + 1).alias("column"), x["found"]["match"].alias("match"))
        both = lambda found: let(starts_of(lines_of(text)), lambda starts: F.transform(found, lambda x: begins({"found": x, "starts": starts})))
        found = df.where(text.isNotNull() & (text != "")).select(*id_cols, F.posexplode(let(matches_in(p, text), both)).alias("_pos", "_found"))
        return found.select(*id_cols, F.col("_found.line").alias(names["line_number"]), (F.col("_pos") + 1).cast("long").alias(names["nth"]), *([F.col("_found.column").alias(names["column"])] if column else []), F.col("_found.match").alias(names["match"]))
    first = compile_pattern(needs) if needs else p
    some = df.where(first.matches(text)) if needs else df
    rows = some.select(*id_cols, F.posexplode(lines_of(text)).alias("_pos", "_line")).where(first.matches(F.col("_line")))
    each = F.transform(p.all(F.col("_line")), lambda m: F.struct(m.alias("match")))
    if column:
        each = F.zip_with(p.all(F.col("_line")), p.spans(F.col("_line")), lambda m, s: F.struct(m.alias("match"), (s["start"] + 1).cast("long").alias("column")))
    rows = rows.select(*id_cols, (F.col("_pos") + 1).cast("long").alias("_number"), F.posexplode(each).alias("_nth", "_found"))
    return rows.select(*id_cols, F.col("_number").alias(names["line_number"]), (F.col("_nth") + 1).cast("long").alias(names["nth"]), *([F.col("_found.column").alias(names["column"])] if column else []), F.col("_found.match").alias(names["match"]))


def vimgrep(df: DataFrame, text_col: str, pattern: str | tuple[str, ...], id_cols: list[str], **options) -> DataFrame:
    """(ids, line_number, column, text): the line once for each of its matches."""
    found = grep(df, text_col, pattern, id_cols, spans=True, **options)
    spans, number, text = (free(c, id_cols) for c in ("spans", "line_number", "text"))
    return found.select(*id_cols, number, F.explode(spans).alias("_span"), text).select(*id_cols, number, (F.col("_span.start") + 1).cast("long").alias(free("column", id_cols)), text)


def grep_hits(df: DataFrame, text_col: str, pattern: str | tuple[str, ...], path_col: str, max_results: int | None = None, **options) -> DataFrame:
    """(path, line, column, text) of matching lines; with max_results the first so many by path component and line."""
    found = grep(df, text_col, pattern, [path_col], column=True, **options)
    found = found.select(F.col(path_col).alias("path"), F.col(free("line_number", [path_col])).alias("line"), F.col(free("column", [path_col])).alias("column"), F.col(free("text", [path_col])).alias("text"))
    return found.orderBy(F.split("path", "/"), "line").limit(max_results) if max_results else found


def grep_stats(df: DataFrame, text_col: str, pattern: str | tuple[str, ...], id_cols: list[str], multiline: bool = False, multiline_dotall: bool = False, **options) -> DataFrame:
    """One row: documents searched and matched, matching lines (of matches that may span lines, matches), matches, and bytes searched."""
    p, whole_text = matcher(pattern, multiline, multiline_dotall, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if whole_text:
        each = df.select(F.octet_length(text).alias("bytes"), F.explode(F.array(F.size(matches_in(p, text)))).alias("hit")).withColumn("found", F.col("hit"))
    else:
        each = df.select(F.octet_length(text).alias("bytes"), p.counts(lines_of(text)).alias("counts"))
        each = each.select("bytes", F.size(F.filter("counts", lambda x: x > 0)).alias("hit"), F.aggregate("counts", F.lit(0), lambda a, x: a + x).alias("found"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(F.count(F.lit(1)).alias("searched"), total((F.col("hit") > 0).cast("long")).alias("matched"), total("hit").alias("matched_lines"), total("found").alias("matches"), total("bytes").alias("bytes_searched"))


GIT_HASH = r"\b[0-9a-f]{7,40}\b"


def detect_git_hashes(df: DataFrame, text_col: str, id_cols: list[str], column: bool = False) -> DataFrame:
    return only_matching(df, text_col, GIT_HASH, id_cols, column=column, needs="[0-9a-f]{7}")


# Fixed value: what counts as an address; marks that end a sentence don't end an address.
URL = r"(?:https?|ftp|file)://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*[A-Za-z0-9\-_~/#@$&*+=%]"


def detect_urls(df: DataFrame, text_col: str, id_cols: list[str], column: bool = False) -> DataFrame:
    """(ids, line_number, nth from 1, [column,] match) of every address."""
    return only_matching(df, text_col, URL, id_cols, column=column)


def printed(found: DataFrame, path_col: str, column: bool = False) -> DataFrame:
    """Search results as text lines, by path component and line: path:line:text, with - around context lines.

    Where context lines are among them, a line ``--`` goes before each new region of a document but the first.
    """
    by = Window.partitionBy(path_col).orderBy("line_number")
    mark = F.when(F.col("kind") == "match", ":").otherwise("-")
    fields = ["line_number", *(["column"] if column else [])]
    text = F.concat(path_col, mark, *[x for c in fields for x in (F.col(c).cast("string"), mark)], "text")
    apart = F.col("line_number") - F.lag("line_number").over(by) > 1
    context = F.max((F.col("kind") == "context").cast("int")).over(Window.partitionBy(path_col)) == 1
    shown = found.select(path_col, "line_number", F.when(apart & context, F.array(F.lit("--"), text)).otherwise(F.array(text)).alias("_lines"))
    return shown.select(F.split(path_col, "/").alias("_key"), "line_number", F.posexplode("_lines").alias("_nth", "value")).orderBy("_key", "line_number", "_nth").select("value")


def printed_matches(found: DataFrame, path_col: str, text_col: str = "match") -> DataFrame:
    """Matches, or lines of vimgrep (text_col: text), as text lines path:line:column:text, in the order of printed."""
    nth = [c for c in ("nth", "column") if c in found.columns][:1]
    line = F.concat_ws(":", path_col, F.col("line_number").cast("string"), *([F.col("column").cast("string")] if "column" in found.columns else []), text_col)
    return found.orderBy(F.split(path_col, "/"), "line_number", *nth).select(line.alias("value"))


def binary_notices(found: DataFrame, path_col: str = "path") -> DataFrame:
    """The notice of each file with a NUL that matches behind it."""
    told = F.concat(path_col, F.lit(': binary file matches (found "\\0" byte around offset '), F.col("binary_offset").cast("string"), F.lit(")"))
    return found.orderBy(F.split(path_col, "/")).select(told.alias("value"))
