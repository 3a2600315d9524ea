"""Queries of the search operators over whole tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import table
from ..operators import fuzzy, grep, ignore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LINES = """lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line_number, l[i] AS text FROM (
  SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (
    SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l
    FROM documents WHERE text <> '')))"""
IGNORE = "# what crawlers skip\n*?page=*\n/fr/\n!/fr/1*\n[0-4]*\n!*7\nde/**\n"
SCOPED = "!*#top\n9?\n"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def on_lines(name: str, pattern: str | tuple[str, ...], where: str, **options) -> None:
    register(name, lambda s, d: grep.grep(read(s, d, "documents"), "text", pattern, ["doc_id"], **options), f"WITH {LINES} SELECT doc_id, 'match' AS kind, line_number, text FROM lines WHERE {where}")


on_lines("grep_lines", "sch", "contains(text, 'sch')")
on_lines("grep_regex", "th[aeiou]+n", "regexp_matches(text, 'th[aeiou]+n')")
on_lines("grep_invert", "the", "NOT contains(text, 'the')", invert=True)
on_lines("grep_ignore_case", "STREA", "regexp_matches(text, '(?i)strea')", case="ignore")
on_lines("grep_smart_case", "ist die", "regexp_matches(text, '(?i)ist die')", case="smart")
on_lines("grep_smart_case_upper", "Ist", "contains(text, 'Ist')", case="smart")
on_lines("grep_fixed", "n. T", "contains(text, 'n. T')", fixed=True)
on_lines("grep_word", "on", r"regexp_matches(text, '(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])on([^\p{L}\p{M}\p{Nd}\p{Pc}]|$)')", word=True)
on_lines("grep_line_regexp", r"\w{1,3}\.", r"regexp_matches(text, '^[\p{L}\p{M}\p{Nd}\p{Pc}]{1,3}\.$')", line=True)
on_lines("grep_multi_pattern", ("ouai", "sche", r"\d{3}"), r"regexp_matches(text, 'ouai|sche|\p{Nd}{3}')")
on_lines("grep_anchors", r"^Is\b.*\.$", r"regexp_matches(text, '^Is($|[^\p{L}\p{M}\p{Nd}\p{Pc}].*\.$)') AND text LIKE '%.'")
on_lines("grep_unicode_class", r"^\p{Lu}\w+è\b", r"regexp_matches(text, '^\p{Lu}[\p{L}\p{M}\p{Nd}\p{Pc}]+è($|[^\p{L}\p{M}\p{Nd}\p{Pc}])')")
register("grep_empty_lines", lambda s, d: grep.grep(read(s, d, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n"))), "text", "^$", ["doc_id"]), f"WITH {LINES.replace('FROM documents', "FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents)")} SELECT doc_id, 'match' AS kind, line_number, text FROM lines WHERE text = ''")

register("grep_column", lambda s, d: grep.grep(read(s, d, "documents"), "text", "è", ["doc_id"], column=True).select("doc_id", "line_number", "column"), f"WITH {LINES} SELECT doc_id, line_number, CAST(strlen(left(text, instr(text, 'è') - 1)) + 1 AS BIGINT) AS \"column\" FROM lines WHERE contains(text, 'è')")
register("grep_byte_offset", lambda s, d: grep.grep(read(s, d, "documents"), "text", "que", ["doc_id"], byte_offset=True).select("doc_id", "line_number", "byte_offset"), f"WITH {LINES}, o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lines) SELECT doc_id, line_number, CAST(b AS BIGINT) AS byte_offset FROM o WHERE contains(text, 'que')")
CONTEXT = "SELECT doc_id, CASE WHEN s THEN 'match' ELSE 'context' END AS kind, line_number, text FROM (SELECT *, max(CAST(k AS INT)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS m FROM (SELECT *, s AND n <= {c} AS k FROM (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY doc_id ORDER BY line_number) AS n FROM (SELECT *, contains(text, 'ing') AS s FROM lines)))) WHERE m = 1"
register("grep_context", lambda s, d: grep.grep(read(s, d, "documents"), "text", "ing", ["doc_id"], before=1, after=2), f"WITH {LINES} " + CONTEXT.format(a=2, b=1, c=1 << 40))
register("grep_max_count", lambda s, d: grep.grep(read(s, d, "documents"), "text", "ing", ["doc_id"], max_count=2, after=1), f"WITH {LINES} " + CONTEXT.format(a=1, b=0, c=2))
register("grep_count", lambda s, d: grep.grep_count(read(s, d, "documents"), "text", "tion", ["doc_id"]), f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE contains(text, 'tion') GROUP BY doc_id")
register("grep_count_matches", lambda s, d: grep.grep_count(read(s, d, "documents"), "text", "t[hi]+", ["doc_id"], matches=True), f"WITH {LINES} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, 't[hi]+'))) AS BIGINT) AS n FROM lines WHERE regexp_matches(text, 't[hi]+') GROUP BY doc_id")
register("grep_files", lambda s, d: grep.grep_documents(read(s, d, "documents"), "text", "lich", ["doc_id"]), "SELECT doc_id FROM documents WHERE contains(text, 'lich')")
register("grep_files_without", lambda s, d: grep.grep_documents(read(s, d, "documents"), "text", "^Th", ["doc_id"], without=True), f"WITH {LINES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE text LIKE 'Th%')")
register("grep_only_matching", lambda s, d: grep.only_matching(read(s, d, "documents"), "text", r"[A-Z]\w*schen", ["doc_id"]), rf"WITH {LINES}, m AS (SELECT doc_id, line_number, regexp_extract_all(text, '[A-Z][\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]*schen') AS m FROM lines) SELECT doc_id, line_number, CAST(i AS BIGINT) AS nth, m[i] AS match FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m)")
register("grep_stats", lambda s, d: grep.grep_stats(read(s, d, "documents"), "text", "tion", ["doc_id"]), f"WITH {LINES}, h AS (SELECT * FROM lines WHERE contains(text, 'tion')) SELECT (SELECT count(*) FROM documents) AS searched, (SELECT count(DISTINCT doc_id) FROM h) AS matched, (SELECT count(*) FROM h) AS matched_lines, (SELECT CAST(coalesce(sum(len(regexp_extract_all(text, 'tion'))), 0) AS BIGINT) FROM h) AS matches, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes_searched")
register("grep_spans", lambda s, d: grep.grep(read(s, d, "documents"), "text", "è[a-z]", ["doc_id"], spans=True).select("doc_id", "line_number", F.explode("spans").alias("x")).select("doc_id", "line_number", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end")), f"WITH {LINES}, m AS (SELECT doc_id, line_number, regexp_extract_all(text, 'è[a-z]') AS m, string_split_regex(text, 'è[a-z]') AS p FROM lines), e AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m), o AS (SELECT doc_id, line_number, CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + 3 * (i - 1) AS BIGINT) AS start FROM e) SELECT doc_id, line_number, start, start + 3 AS \"end\" FROM o")
BEFORE, BEHIND = r"(?:^|[^\p{L}\p{M}\p{Nd}\p{Pc}])", r"(?:$|[^\p{L}\p{M}\p{Nd}\p{Pc}])"
# Words are told apart by doubling what stands between them, so that one mark can end a word and begin the next.
HASHES = rf"SELECT doc_id, line_number, [regexp_extract(x, '[0-9a-f]{{7,40}}') FOR x IN regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])', '\1\1', 'g'), '{BEFORE}[0-9a-f]{{7,40}}{BEHIND}')] AS m FROM lines"
register("detect_git_hashes", lambda s, d: grep.detect_git_hashes(read(s, d, "documents"), "text", ["doc_id"]), f"WITH {LINES}, m AS ({HASHES}) SELECT doc_id, line_number, CAST(i AS BIGINT) AS nth, m[i] AS match FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m)")
register("grep_vimgrep", lambda s, d: grep.vimgrep(read(s, d, "documents"), "text", "est ", ["doc_id"]), f"WITH {LINES}, p AS (SELECT *, string_split(text, 'est ') AS p FROM lines WHERE contains(text, 'est ')), i AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM p) SELECT doc_id, line_number, CAST(strlen(array_to_string(p[1:i], 'est ')) + 1 AS BIGINT) AS \"column\", text FROM i")
register("grep_hits", lambda s, d: grep.grep_hits(read(s, d, "documents").withColumn("path", F.concat("source", F.lit("/"), "doc_id")), "text", "que l", "path", max_results=500), f"WITH {LINES} SELECT path, line, \"column\", text FROM (SELECT source || '/' || doc_id AS path, line_number AS line, CAST(strlen(left(lines.text, instr(lines.text, 'que l') - 1)) + 1 AS BIGINT) AS \"column\", lines.text FROM lines JOIN documents USING (doc_id) WHERE contains(lines.text, 'que l') ORDER BY source, CAST(doc_id AS VARCHAR), line_number LIMIT 500)")
# A repeat that can match nothing: between letters there is an empty match, but none that touches the match before it.
register("grep_spans_empty", lambda s, d: grep.grep(read(s, d, "documents"), "text", "[a-z]*", ["doc_id"], spans=True).select("doc_id", "line_number", F.size("spans").cast("long").alias("n"), F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("width")), f"WITH {LINES} SELECT doc_id, line_number, CAST(len(regexp_extract_all(text, '[a-z]+')) + length(regexp_replace(regexp_replace(text, '[a-z]+.?', 'a', 'g'), 'a', '', 'g')) + CAST(regexp_matches(text, '^$|[^a-z]$') AS INT) AS BIGINT) AS n, CAST(strlen(regexp_replace(text, '[^a-z]', '', 'g')) AS BIGINT) AS width FROM lines")
register("grep_multiline", lambda s, d: grep.grep(read(s, d, "documents"), "text", r"[.]\n[A-D]", ["doc_id"], multiline=True), f"WITH {LINES} SELECT doc_id, 'match' AS kind, line_number, text FROM (SELECT *, lead(text) OVER w AS after, lag(text) OVER w AS before FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)) WHERE (text LIKE '%.' AND regexp_matches(after, '^[A-D]')) OR (before LIKE '%.' AND regexp_matches(text, '^[A-D]'))")
register("grep_multiline_count", lambda s, d: grep.grep_count(read(s, d, "documents"), "text", r"e\s+[A-Z]", ["doc_id"], multiline=True), r"SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, 'e[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+[A-Z]')) AS BIGINT) AS n FROM documents) WHERE n > 0")
register("grep_multiline_matches", lambda s, d: grep.only_matching(read(s, d, "documents"), "text", r"\w+[.]\n+\w", ["doc_id"], multiline=True), r"WITH m AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+[.]\n+[\p{L}\p{M}\p{Nd}\p{Pc}]') AS m, string_split_regex(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+[.]\n+[\p{L}\p{M}\p{Nd}\p{Pc}]') AS p FROM documents), e AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m) SELECT doc_id, CAST(1 + length(regexp_replace(array_to_string(p[1:i], ''), '[^\n]', '', 'g')) + length(regexp_replace(array_to_string(m[1:i - 1], ''), '[^\n]', '', 'g')) AS BIGINT) AS line_number, CAST(i AS BIGINT) AS nth, m[i] AS match FROM e")
# Each match is the end of a line and the beginning of the next.
TWO = "t AS (SELECT *, coalesce(right(before, 1) = 'e' AND regexp_matches(text, '^[A-Z]'), false) AS tail, coalesce(right(text, 1) = 'e' AND regexp_matches(after, '^[A-Z]'), false) AS head FROM (SELECT *, lead(text) OVER w AS after, lag(text) OVER w AS before FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)))"
CUT = LINES.replace("lines AS", "cut AS").replace("FROM documents", "FROM (SELECT doc_id, replace(text, '. ', chr(10)) AS text FROM documents)")
cut_lines = lambda s, d: read(s, d, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit("\n")))
register("grep_multiline_spans", lambda s, d: grep.grep(cut_lines(s, d), "text", r"e\n[A-Z]", ["doc_id"], multiline=True, spans=True, column=True, byte_offset=True).select("doc_id", "line_number", "byte_offset", "column", "region_continued", F.explode("spans").alias("x")).select("doc_id", "line_number", "byte_offset", "column", "region_continued", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.continued").alias("continued")), f"""WITH {CUT}, {TWO},
o AS (SELECT *, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, lag(head OR tail, 1, false) OVER (PARTITION BY doc_id ORDER BY line_number) AS region_continued FROM t)
SELECT doc_id, line_number, byte_offset, CASE WHEN tail THEN 1 ELSE strlen(text) END AS "column", region_continued, x.s AS start, x.e AS "end", x.c AS continued FROM (
  SELECT *, unnest(CASE WHEN tail THEN [{{'s': 0::BIGINT, 'e': 1::BIGINT, 'c': true}}] ELSE [] END || CASE WHEN head THEN [{{'s': strlen(text) - 1, 'e': strlen(text), 'c': false}}] ELSE [] END) AS x FROM o)""")
register("grep_multiline_context", lambda s, d: grep.grep(cut_lines(s, d), "text", r"e\n[A-Z]", ["doc_id"], multiline=True, before=1), f"WITH {CUT}, {TWO} SELECT doc_id, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, line_number, text FROM (SELECT *, head OR tail AS hit, lead(head OR tail, 1, false) OVER (PARTITION BY doc_id ORDER BY line_number) AS next FROM t) WHERE hit OR next")
register("grep_multiline_invert", lambda s, d: grep.grep(cut_lines(s, d), "text", r"e\n[A-Z]", ["doc_id"], multiline=True, invert=True), f"WITH {CUT}, {TWO} SELECT doc_id, 'match' AS kind, line_number, text FROM t WHERE NOT head AND NOT tail")
register("grep_multiline_files", lambda s, d: grep.grep_documents(cut_lines(s, d), "text", r"e\n[A-D]", ["doc_id"], multiline=True, without=True), "SELECT doc_id FROM documents WHERE NOT regexp_matches(replace(text, '. ', chr(10)), 'e\n[A-D]')")
register("grep_multiline_stats", lambda s, d: grep.grep_stats(cut_lines(s, d), "text", r"e\n[A-D]", ["doc_id"], multiline=True), "WITH m AS (SELECT strlen(replace(text, '. ', chr(10))) AS b, len(regexp_extract_all(replace(text, '. ', chr(10)), 'e\n[A-D]')) AS n FROM documents) SELECT count(*) AS searched, count(*) FILTER (WHERE n > 0) AS matched, CAST(sum(n) AS BIGINT) AS matched_lines, CAST(sum(n) AS BIGINT) AS matches, CAST(sum(b) AS BIGINT) AS bytes_searched FROM m")
register("grep_multiline_by_line", lambda s, d: grep.grep_count(read(s, d, "documents"), "text", "th[aeiou]+n", ["doc_id"], multiline=True), f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE regexp_matches(text, 'th[aeiou]+n') GROUP BY doc_id")
register("grep_multiline_dotall", lambda s, d: grep.grep_count(read(s, d, "documents"), "text", "en.[A-Z]", ["doc_id"], multiline=True, multiline_dotall=True), "SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '(?s)en.[A-Z]')) AS BIGINT) AS n FROM documents) WHERE n > 0")
on_lines("grep_flags", r"(?i:DIE)\s(?-i:S)", r"regexp_matches(text, '(?i:die)[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]S')")
on_lines("grep_class_algebra", "[a-z&&[^aeiou]]{5}", "regexp_matches(text, '[b-df-hj-np-tv-z]{5}')")
on_lines("grep_category", r"^\p{Lu}\p{Ll}{2}\P{L}", r"regexp_matches(text, '^\p{Lu}\p{Ll}{2}\P{L}')")
on_lines("grep_escapes", r"\x{2e}\x20\u0041n", r"regexp_matches(text, '\. An')")


def sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, called from SQL for each row of a table."""
    table.register(spark)
    return spark.sql("SELECT doc_id, f.line_number, f.start, f.`end` FROM {docs}, LATERAL search_lines(text, 'tion') f", docs=read(spark, sf_dir, "documents"))


register("sql_search", sql_search, f"WITH {LINES}, p AS (SELECT *, string_split(text, 'tion') AS p FROM lines WHERE contains(text, 'tion')), i AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM p) SELECT doc_id, line_number, s AS start, s + 4 AS \"end\" FROM (SELECT *, strlen(array_to_string(p[1:i], 'tion')) AS s FROM i)")
register("grep_crlf", lambda s, d: grep.grep(read(s, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n"))), "text", r"on\.$", ["doc_id"], crlf=True).select("doc_id", "line_number"), f"WITH {LINES} SELECT doc_id, line_number FROM lines WHERE ends_with(text, 'on.')")


def on_names(name: str, query: str, where: str, table: str = "part", key: str = "p_partkey", item: str = "p_name", **options) -> None:
    register(name, lambda s, d: fuzzy.fuzzy_filter(read(s, d, table).select(key, item), item, query, **options), f"SELECT {key}, {item} FROM {table} WHERE {where}")


PAGES = {"table": "pages", "key": "page_id", "item": "url"}
on_names("fuzzy_prefix", "^https", "starts_with(lower(url), 'https')", **PAGES)
on_names("fuzzy_suffix", "top$", "ends_with(lower(url), 'top')", **PAGES)
on_names("fuzzy_exact", "'example.org", "contains(lower(url), 'example.org')", **PAGES)
on_names("fuzzy_inverse", "!blog !fr", "NOT contains(lower(url), 'blog') AND NOT contains(lower(url), 'fr')", **PAGES)
on_names("fuzzy_subsequence", "exorg7", "lower(url) LIKE '%e%x%o%r%g%7%'", **PAGES)
on_names("fuzzy_or", "^http: org$ | net/en | 'de", "starts_with(lower(url), 'http:') AND (ends_with(lower(url), 'org') OR lower(url) LIKE '%n%e%t%/%e%n%' OR contains(lower(url), 'de'))", **PAGES)
on_names("fuzzy_names", "ld bt", "lower(p_name) LIKE '%l%d%' AND lower(p_name) LIKE '%b%t%'")
on_names("fuzzy_case", "Customer 9$", "contains(c_name, 'C') AND c_name LIKE '%C%u%s%t%o%m%e%r%' AND ends_with(c_name, '9')", table="customer", key="c_custkey", item="c_name")
on_names("fuzzy_boundary", "'en' 'example'", r"regexp_matches(lower(url), '(^|[^\p{L}\p{N}])en($|[^\p{L}\p{N}])') AND regexp_matches(lower(url), '(^|[^\p{L}\p{N}])example($|[^\p{L}\p{N}])')", **PAGES)
on_names("fuzzy_equal", "^http://ththre.example.com/fr/825?page=2&ref=x$", "lower(url) = 'http://ththre.example.com/fr/825?page=2&ref=x'", **PAGES)

on_names("fuzzy_literal", "example.com/fr", "contains(lower(url), 'example.com/fr')", extended=False, exact=True, **PAGES)
register("fuzzy_marks", lambda s, d: fuzzy.fuzzy_filter(read(s, d, "documents").select("doc_id", F.left("text", F.lit(40)).alias("start")), "start", "'etion"), "SELECT * FROM (SELECT doc_id, left(text, 40) AS start FROM documents) WHERE contains(lower(strip_accents(start)), 'etion')")
register("fuzzy_last", lambda s, d: fuzzy.fuzzy_rank(read(s, d, "pages").select("page_id", "url"), "url", "'org", "page_id", 25, sort=False, tac=True).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE contains(lower(url), 'org') ORDER BY page_id DESC LIMIT 25")
register("fuzzy_printed", lambda s, d: fuzzy.printed(fuzzy.fuzzy_rank(read(s, d, "pages").select("page_id", "url"), "url", "^http:", "page_id", positions=True), "url", debug=True), "SELECT CAST(5 * 16 + 10 * 2 + 4 * 10 AS VARCHAR) || chr(9) || '[0,1,2,3,4]' || chr(9) || url AS value FROM pages WHERE starts_with(lower(url), 'http:')")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("path")).where("path <> ''")


def rules_sql(files: list[tuple[str, str]]) -> str:
    quoted = lambda x: x.replace("'", "''")
    rows = ignore.Rules(files).all
    return "rules(base, ord, negated, dir_only, basename_only, regex) AS (VALUES " + ", ".join(f"('{quoted(r.base)}', {r.ord}, {r.negated}, {r.dir_only}, {r.basename_only}, '{quoted(r.regex)}')" for r in rows) + ")"


FILES = [("", IGNORE), ("en", SCOPED)]
VERDICT = r"""p AS (SELECT DISTINCT path, is_dir FROM ({source})), hits AS (
  SELECT path, is_dir, (CASE WHEN base = '' THEN 0 ELSE len(string_split(base, '/')) END * 100000 + ord) * 2 + CAST(negated AS INT) AS code
  FROM p LEFT JOIN rules ON (base = '' OR starts_with(path, base || '/')) AND (NOT dir_only OR is_dir) AND
    regexp_matches(CASE WHEN basename_only THEN string_split(path, '/')[-1] WHEN base = '' THEN path ELSE substring(path, length(base) + 2) END, regex)),
v AS (SELECT path, is_dir, CASE WHEN max(code) IS NULL THEN 'none' WHEN max(code) % 2 = 1 THEN 'whitelist' ELSE 'ignore' END AS verdict FROM hits GROUP BY path, is_dir)"""
PATHS = r"paths AS (SELECT DISTINCT path, trim(regexp_replace(path, '^(\./)+', ''), '/') AS place FROM (SELECT regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path FROM pages) WHERE path <> '')"
register("ignore_match", lambda s, d: ignore.verdicts(paths(s, d).withColumn("is_dir", F.lit(False)), "path", ignore.rules(s, FILES), "is_dir").drop("is_dir"), f"WITH {rules_sql(FILES)}, {PATHS}, {VERDICT.format(source='SELECT place AS path, false AS is_dir FROM paths')} SELECT paths.path, verdict FROM paths JOIN v ON v.path = place")
UP = "SELECT array_to_string(l[1:i], '/') AS path, i < len(l) AS is_dir FROM (SELECT l, unnest(generate_series(1, len(l))) AS i FROM (SELECT string_split(place, '/') AS l FROM paths))"
register("ignore_check", lambda s, d: ignore.ignored(paths(s, d), "path", ignore.rules(s, FILES)), f"WITH {rules_sql(FILES)}, {PATHS}, {VERDICT.format(source=UP)} SELECT paths.path, bool_or(verdict = 'ignore') AS ignored FROM paths JOIN v ON (v.path = place AND NOT v.is_dir) OR (v.is_dir AND starts_with(place, v.path || '/')) GROUP BY paths.path")


RG_FILES = [("", "{en,de}/[!0-4]*\n!**/*{5,7}\n*.{html,htm}\n?page\n")]
RG_SQL = [(r.negated, r.dir_only, r.regex) for r in ignore.Rules(RG_FILES, "rg").all]
register("ignore_rg", lambda s, d: ignore.verdicts(paths(s, d).withColumn("is_dir", F.lit(False)), "path", ignore.rules(s, RG_FILES, "rg"), "is_dir").drop("is_dir"), f"WITH {PATHS} SELECT path, CASE " + " ".join(f"WHEN regexp_matches(place, '{x}') THEN '{'whitelist' if n else 'ignore'}'" for n, _, x in reversed(RG_SQL)) + " ELSE 'none' END AS verdict FROM paths")
# So many rules that paths are joined to them: names by equality, the rest by pattern.
MANY = [("", "".join(f"{i}\n" for i in range(400)) + "!37\n" + "*#top\n"), ("en", "!4?\n")]
register("ignore_many", lambda s, d: ignore.verdicts(paths(s, d).withColumn("is_dir", F.lit(False)), "path", ignore.rules(s, MANY), "is_dir").drop("is_dir"), f"WITH {PATHS}, n AS (SELECT *, string_split(place, '/')[-1] AS name FROM paths) SELECT path, CASE WHEN place LIKE 'en/%' AND name LIKE '4_' THEN 'whitelist' WHEN name LIKE '%#top' THEN 'ignore' WHEN name = '37' THEN 'whitelist' WHEN regexp_matches(name, '^(0|[1-9][0-9]?|[1-3][0-9][0-9])$') THEN 'ignore' ELSE 'none' END AS verdict FROM n")


def on_ranks(name: str, query: str, sql: str | None = None, limit: int | None = None, **options) -> None:
    """Best matches of every page address; a limit is a top-k report."""
    register(name, lambda s, d: fuzzy.fuzzy_rank(read(s, d, "pages").select("page_id", "url"), "url", query, "page_id", limit, **options), sql)


RANKED = """SELECT page_id, url, CAST({score} AS INT) AS score, CAST(65535 - ({score}) AS INT) AS rank3, CAST(length(trim(url)) AS INT) AS rank2, 0 AS rank1, 0 AS rank0 FROM pages WHERE {where}"""
# A whole prefix scores 16 a letter, the bonus of a white boundary twice for the first and once for the others.
on_ranks("fuzzy_rank_prefix", "^http", RANKED.format(score="4 * 16 + 10 * 2 + 3 * 10", where="starts_with(lower(url), 'http')"))
on_ranks("fuzzy_rank_equal", "^http://ththre.example.com/fr/825?page=2&ref=x$", RANKED.format(score="(16 + 10) * length(url) + 10", where="lower(url) = 'http://ththre.example.com/fr/825?page=2&ref=x'"))
on_ranks("fuzzy_rank_inverse", "!blog", RANKED.format(score="0", where="NOT contains(lower(url), 'blog')"))
# Two letters are aligned by a formula: each place of the second goes with the nearest place of the first before it.
CHARS = """chars AS (
  SELECT page_id, i, c, CASE WHEN k >= 1 AND before = 0 THEN {white} WHEN k >= 1 AND before = 2 THEN {delimiter} WHEN k >= 1 AND before = 1 THEN 8
    WHEN before = 3 AND k = 4 OR before <> 6 AND k = 6 THEN 7 WHEN k IN (1, 2) THEN 8 WHEN k = 0 THEN {white} ELSE 0 END AS bonus
  FROM (SELECT *, lag(k, 1, {start}) OVER (PARTITION BY page_id ORDER BY i) AS before FROM (
    SELECT page_id, i, c, CASE WHEN c = ' ' THEN 0 WHEN regexp_matches(c, '[a-z]') THEN 3 WHEN regexp_matches(c, '[A-Z]') THEN 4 WHEN regexp_matches(c, '[0-9]') THEN 6
      WHEN contains('{delimiters}', c) THEN 2 ELSE 1 END AS k
    FROM (SELECT page_id, unnest(generate_series(1, length({text}))) AS i, {text}[i] AS c FROM pages)))),
{name} AS (SELECT b.page_id, b.i AS last, max(a.i) AS first FROM chars a JOIN chars b ON a.page_id = b.page_id AND a.i < b.i AND lower(a.c) = '{one}' AND lower(b.c) = '{two}' GROUP BY b.page_id, b.i),
fits AS (
  SELECT m.page_id, first, last, CASE WHEN last = first + 1 THEN 16 + 2 * a.bonus + 16 + CASE WHEN b.bonus >= 8 AND b.bonus > a.bonus THEN b.bonus ELSE greatest(b.bonus, 4, a.bonus) END
    ELSE greatest(16 + 2 * a.bonus - 3 - (last - first - 2), 0) + 16 + b.bonus END AS score
  FROM {name} m JOIN chars a ON a.page_id = m.page_id AND a.i = first JOIN chars b ON b.page_id = m.page_id AND b.i = last),
best AS (SELECT page_id, max(score) AS score, arg_max(first, (score, {turn}last)) AS first, arg_max(last, (score, {turn}last)) AS last FROM fits GROUP BY page_id)"""
SHOWN = "CAST(score AS INT) AS score, CAST(65535 - score AS INT) AS rank3, CAST({rank2} AS INT) AS rank2, CAST({rank1} AS INT) AS rank1, 0 AS rank0"


def aligned(one: str, two: str, backward: bool = False, path: bool = False) -> str:
    how = {"white": 8, "delimiter": 9, "start": 2, "delimiters": "/"} if path else {"white": 10, "delimiter": 9, "start": 0, "delimiters": "/,:;|"}
    return CHARS.format(one=one, two=two, name="pairs", text="url", turn="" if backward else "-", **how)


SLASH = "CASE WHEN length(url) - instr(reverse(url), '/') < first THEN first - 1 - (length(url) - instr(reverse(url), '/')) ELSE 65535 END"
on_ranks("fuzzy_rank", "eg", f"WITH {aligned('e', 'g')} SELECT page_id, url, {SHOWN.format(rank2='length(url)', rank1=0)} FROM best JOIN pages USING (page_id)")
on_ranks("fuzzy_rank_path", "ex", f"WITH {aligned('e', 'x', backward=True, path=True)} SELECT page_id, url, {SHOWN.format(rank2=SLASH, rank1='length(url)')} FROM best JOIN pages USING (page_id)", ranking=fuzzy.Ranking("path"))
PAGE = "SELECT page_id, first, last, greatest(last, p + 3) AS stop, score + 16 + 2 * bonus + 3 * (16 + greatest(bonus, 4)) AS score, url FROM best JOIN (SELECT page_id, url, length(url) - instr(reverse(lower(url)), 'egap') - 2 AS p FROM pages WHERE contains(lower(url), 'page')) USING (page_id) JOIN chars USING (page_id) WHERE i = p"
on_ranks("fuzzy_rank_chunk_end", "ex 'page", f"WITH {aligned('e', 'x', backward=True)} SELECT page_id, url, {SHOWN.format(rank2='length(url)', rank1='65535 - 65535 * stop // (length(url) + 1)')} FROM ({PAGE})", ranking=fuzzy.Ranking(tiebreak=("chunk", "end")))
on_ranks("fuzzy_rank_nth", "8", "WITH f AS (SELECT *, string_split(url, '/')[-1] AS f, instr(f, '8') AS p FROM pages WHERE contains(f, '8')), g AS (SELECT *, [CASE WHEN i = 1 THEN 10 WHEN regexp_matches(f[i - 1], '[0-9]') THEN 0 WHEN regexp_matches(f[i - 1], '[a-zA-Z]') THEN 7 WHEN contains(',:;|', f[i - 1]) THEN 9 ELSE 8 END FOR i IN generate_series(1, length(f)) IF f[i] = '8'] AS b FROM f), h AS (SELECT *, 16 + 2 * CASE WHEN list_max(b) >= 8 THEN [x FOR x IN b IF x >= 8][1] ELSE list_max(b) END AS score FROM g) SELECT page_id, url, " + SHOWN.format(rank2="length(url)", rank1=0) + " FROM h", ranking=fuzzy.Ranking(nth="-1", delimiter="/"))
on_ranks("fuzzy_rank_greedy", "eg", f"WITH {aligned('e', 'g')}, nearest AS (SELECT page_id, min(last) AS last FROM fits GROUP BY page_id) SELECT page_id, url, {SHOWN.format(rank2='length(url)', rank1=0)} FROM nearest JOIN fits USING (page_id, last) JOIN pages USING (page_id)", ranking=fuzzy.Ranking(greedy=True))
register("fuzzy_top", lambda s, d: fuzzy.fuzzy_rank(read(s, d, "pages").select("page_id", "url"), "url", "pf", "page_id", 20, ranking=fuzzy.Ranking("path"), positions=True).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ",")), f"WITH {aligned("p", "f", backward=True, path=True)} SELECT page_id, url, {SHOWN.format(rank2=SLASH, rank1='length(url)')}, (first - 1) || ',' || (last - 1) AS positions FROM best JOIN pages USING (page_id) ORDER BY rank3, rank2, rank1, page_id LIMIT 20")
URLS = grep.URL.replace("'", "''")
LINKS = LINES.replace("doc_id", "page_id").replace("documents", "(SELECT page_id, 'see ' || url || ', or <' || url || '>.' || chr(10) || 'no http:// here' AS text FROM pages)")
register("detect_urls", lambda s, d: grep.detect_urls(read(s, d, "pages").withColumn("text", F.concat(F.lit("see "), "url", F.lit(", or <"), "url", F.lit(">.\nno http:// here"))), "text", ["page_id"]), f"WITH {LINKS}, m AS (SELECT page_id, line_number, regexp_extract_all(text, '{URLS}') AS m FROM lines) SELECT page_id, line_number, CAST(i AS BIGINT) AS nth, m[i] AS match FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM m)")
