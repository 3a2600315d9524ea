"""The queries of this subpackage that SQL can state, for DuckDB."""

from __future__ import annotations

CHAT = r"""
WITH n AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM n),
o AS (SELECT *, lag(role, 1, 'start') OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS BIGINT) AS formatted_chars,
    bool_and(CASE before WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
      WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role = 'assistant' ELSE false END AND (after IS NOT NULL OR role = 'assistant')) AS valid
  FROM o GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM g
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(CASE WHEN doc_id IS NULL THEN '0:' ELSE (length(CAST(doc_id AS VARCHAR)) + 1) || ':=' || doc_id END || coalesce('=' || text, '')) AS place FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
w AS (SELECT *, CAST(CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s),
k AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(source_size) OVER b, 0) AS filled, coalesce(sum(weight) OVER b, 0) AS off, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY source_size / weight, n), b AS (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT k AS at_k, 1.5::DOUBLE * words - 2 * filled AS rest, weights - off AS rest_weight FROM k WHERE (1.5::DOUBLE * words - 2 * filled) * weight / (weights - off) <= 2 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, n, CASE WHEN k < at_k THEN CAST(2 * source_size AS DOUBLE) ELSE rest * weight / rest_weight END AS target FROM k, c),
u AS (SELECT sum(target) AS total, count(*) AS sources, min(target) FILTER (WHERE target > 0) AS least FROM t),
b AS (SELECT total, greatest(1, CAST(floor(least(total / (4096 * sources), greatest(least / 512, total / 16777216), 1048576)) AS BIGINT), CAST(ceil(total / 2147483648) AS BIGINT)) AS block FROM u),
e AS (
  SELECT t.*, greatest(1, (source_size + block - 1) // block) AS blocks,
    CAST(floor(sum(target) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) / total * 4294967296 + 0.5) AS BIGINT) AS edge FROM t, b),
g AS (SELECT *, source_size // blocks AS least, source_size % blocks AS over, lag(edge, 1, 0) OVER (ORDER BY n) AS edge_before FROM e),
slots AS (SELECT slot, (slot * 2654435769) % 4294967296 AS point FROM b, unnest(range(0, CAST(round(total / block) AS BIGINT))) AS x(slot)),
ranked AS (SELECT n, blocks, slot, row_number() OVER (PARTITION BY n ORDER BY slot) - 1 AS rank FROM slots JOIN g ON point >= edge_before AND point < edge),
schedule AS (SELECT n, rank % blocks AS block, count(*) AS turns, min(slot) AS slot FROM ranked WHERE rank < 2 * blocks GROUP BY ALL),
placed AS (
  SELECT d.*, g.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY n ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    row_number() OVER () AS row FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
edges AS (
  SELECT *, CASE WHEN start < over * (least + 1) THEN start // (least + 1) ELSE over + (start - over * (least + 1)) // least END AS first,
    CASE WHEN start + size - 1 < over * (least + 1) THEN (start + size - 1) // (least + 1) ELSE over + (start + size - 1 - over * (least + 1)) // least END AS last FROM placed WHERE size > 0),
touched AS (SELECT *, unnest(generate_series(first, last)) AS block FROM edges),
met AS (
  SELECT row, sum((least(start + size, (block + 1) * x.least + least(block + 1, over)) - greatest(start, block * x.least + least(block, over))) * coalesce(turns, 0)) AS taken, min(slot) AS first_slot
  FROM touched x LEFT JOIN schedule USING (n, block) GROUP BY row)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot FROM placed LEFT JOIN met USING (row)
"""

RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
v AS (SELECT row, i, array_to_string(w[i:i + 2], ' ') AS three FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
a AS (SELECT row, i, count(*) OVER (PARTITION BY row, three) AS times FROM v),
r AS (SELECT row, count(DISTINCT i + j) AS n FROM a, range(3) AS x(j) WHERE times > 1 GROUP BY row),
c AS (
  SELECT row, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (row)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(CAST(10 * n_symbols > n_words AS INT) + CAST(10 * n_dup_lines > 3 * n_lines AS INT) + CAST(word_chars < 3 * n_words OR word_chars > 12 * n_words AS INT) AS BIGINT) AS n_soft FROM c),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE base_failed OR n_soft > 0) AS failures FROM f GROUP BY source),
m AS (SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v FROM h),
p AS (SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000) ELSE 1 END AS strength FROM m),
j AS (SELECT source, (failures + m * strength) / (docs + strength) > 0.5 AS host_rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_soft, host_rejected, NOT base_failed AND (NOT host_rejected OR n_soft = 0) AS kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
"""

def _with(f: str, cost: int | str, edit: str) -> str:
    """A state, nine digits of cost and an audit, after one more edit; nothing stays nothing."""
    return f"(lpad(CAST(CAST(left({f}, 9) AS INT) + ({cost}) AS VARCHAR), 9, '0') || substr({f}, 10) || '{edit}')"


_PLACE = "CASE WHEN must THEN NULL ELSE least({}) END"
_TO = lambda role, *fs: ", ".join(f"CASE WHEN initial = '{role}' THEN {_with(f, 'extra', 'K')} ELSE {_with(f, '3 + extra', 'R')} END" for f in fs)
REPAIR = rf"""
WITH RECURSIVE table32 AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT k.*, xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(key, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, table32),
n AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (
  SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc JOIN n ON crc.conv_id IS NOT DISTINCT FROM n.conv_id, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM o),
r AS (SELECT c, i, role, text, initial, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
s AS (
  SELECT n.conv_id, n.c, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    count(i) AS n FROM n LEFT JOIN f USING (c) GROUP BY ALL),
p(c, i, f0, f1, f2, f3) AS (
  SELECT c, 0::BIGINT, '000000000', NULL::VARCHAR, {_with("'000000000'", 3, 'I')}, {_with(_with("'000000000'", 3, 'I'), 3, 'I')} FROM n
  UNION ALL
  SELECT c, i, g0, g1, h2, least(g3, {_with('h2', 3, 'I')}) FROM (
    SELECT *, least(g2, {_with('g0', 3, 'I')}, {_with('g1', 3, 'I')}, {_with('g3', 3, 'I')}) AS h2 FROM (
      SELECT c, r.i, {_with('f0', 4, 'D')} AS g0, least({_with('f1', 4, 'D')}, CASE WHEN initial = 's' AND NOT must THEN {_with('f0', 'extra', 'K')} END) AS g1,
        least({_with('f2', 4, 'D')}, {_PLACE.format(_TO('u', 'f0', 'f1', 'f3'))}) AS g2, least({_with('f3', 4, 'D')}, {_PLACE.format(_TO('a', 'f2') + ', NULL')}) AS g3
      FROM p JOIN r USING (c) WHERE r.i = p.i + 1))),
best AS (SELECT c, least(f0, f3) AS best FROM p JOIN s USING (c) WHERE p.i = s.n),
e AS (SELECT c, k, substr(best, 9 + k, 1) AS edit FROM (SELECT c, best, unnest(range(1, length(best) - 8)) AS k FROM best)),
w AS (SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER x AS i, sum(CAST(edit <> 'D' AS INT)) OVER x AS place FROM e WINDOW x AS (PARTITION BY c ORDER BY k)),
j AS (SELECT w.*, r.role, r.text, max(CAST(w.edit = 'K' AND place = 1 AND r.initial = 's' AS INT)) OVER (PARTITION BY w.c) AS led FROM w LEFT JOIN r ON r.c = w.c AND r.i = w.i AND w.edit <> 'I'),
l AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS repaired FROM j WHERE edit <> 'D' GROUP BY c)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM s JOIN best USING (c) LEFT JOIN l USING (c)
"""

PRINT = """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS row, doc_id, coalesce(text, '') AS text FROM documents),
e AS (
  SELECT row, doc_id, text, lead(row, 1, 1::BIGINT) OVER (ORDER BY row) AS next,
    left(text, length(text) - length(text) // 4) || left(coalesce(lead(text) OVER (ORDER BY row), first_value(text) OVER (ORDER BY row)), length(text) // 4) AS edited FROM d),
t AS (SELECT row, 0 AS version, text FROM e UNION ALL SELECT row, 1, edited FROM e),
h AS (SELECT row, version, strlen(text) AS n, hex(encode(text)) AS h FROM t),
g AS (SELECT row, version, CAST('0x' || substr(h, 2 * i - 1, 6) AS BIGINT) * 2654435761 % 4294967296 // 16777216 AS bucket FROM (SELECT row, version, h, unnest(range(1, n - 1)) AS i FROM h)),
c AS (SELECT row, version, bucket, count(*) AS c FROM g GROUP BY ALL),
l AS (SELECT row, version, n, CASE WHEN n = 0 THEN 0 ELSE length(ltrim(bin(CAST(n AS HUGEINT) * n * n * n), '0')) END AS steps, unnest(range(256)) AS bucket FROM h),
a AS (SELECT row, version, steps, bucket, coalesce(c, 0) AS c FROM l LEFT JOIN c USING (row, version, bucket)),
q AS (SELECT row, version, steps, list_sort(list(c)) AS s, list(c ORDER BY bucket) AS c FROM a GROUP BY row, version, steps),
v AS (SELECT row, version, steps, [CAST(x > s[64] AS INT) + CAST(x > s[128] AS INT) + CAST(x > s[192] AS INT) FOR x IN c] AS v FROM q),
f AS (
  SELECT row, version, steps, v, array_to_string([lower(format('{:02X}', v[i] * 64 + v[i + 1] * 16 + v[i + 2] * 4 + v[i + 3])) FOR i IN range(1, 257, 4)], '') || lower(format('{:02X}', steps)) AS fingerprint FROM v),
p AS (
  SELECT e.row, e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, x.fingerprint, y.fingerprint AS edited_fingerprint,
    x.v AS xv, y.v AS yv, z.v AS zv, 4 * least(abs(x.steps - y.steps), 16) AS sy, 4 * least(abs(x.steps - z.steps), 16) AS sz, z.fingerprint AS next_fingerprint
  FROM e JOIN f x ON x.row = e.row AND x.version = 0 JOIN f y ON y.row = e.row AND y.version = 1 JOIN f z ON z.row = e.next AND z.version = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1 ELSE 1 - (list_sum([abs(xv[i] - yv[i]) FOR i IN range(1, 257)]) + sy)::DOUBLE / (list_sum([greatest(xv[i], yv[i]) FOR i IN range(1, 257)]) + sy) END AS near_edited,
  CASE WHEN fingerprint = next_fingerprint THEN 1 ELSE 1 - (list_sum([abs(xv[i] - zv[i]) FOR i IN range(1, 257)]) + sz)::DOUBLE / (list_sum([greatest(xv[i], zv[i]) FOR i IN range(1, 257)]) + sz) END AS near_next
FROM p
"""

ORACLE: dict[str, str] = {"op3_mixing": MIX, "op4_near_dedup": NEAR, "op7_quality_rules": RULES, "op8_warc": WARC, "op10_chat_format": CHAT, "op11_conversation_repair": REPAIR, "op13_fingerprint": PRINT}
