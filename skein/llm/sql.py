"""Queries of the operators that SQL can express, for DuckDB, written apart from the Spark plans to check them."""

from __future__ import annotations

from skein.llm.quality_rules import BOILERPLATE, CLOSING, ENTRIES, ENTRY_CHARS, ENTRY_WORDS, LOUD, MARKS, NAVIGATION, SEPARATORS, SYMBOLS

_BLANK = r"[\x20\x09-\x0D]"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '" + _BLANK + "+'), lambda x: x <> '')"


def _strip(text: str, chars: str) -> str:
    return f"translate({text}, '{chars}', '')"


_SOLID = "regexp_replace({0}, '" + _BLANK + "', '', 'g')"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach(id, here) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.here = link.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(here) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN reach ON w.doc_id = reach.id GROUP BY w.doc_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
iss AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p:p + least(5, len(w)) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
kk AS (SELECT DISTINCT k FROM iss),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM d, kk WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n FROM iss GROUP BY 1)
SELECT doc_id, item_id, any_value(n) AS n_item, count(*) AS n_shared FROM ds JOIN iss USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""

_ESCAPED = r"replace(replace(replace(replace({0}, '\', '\s'), '###', '\h'), '</turn>', '\t'), '</part>', '\p')"
CHAT_FORMAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
c AS (SELECT *, CASE WHEN before = role THEN 7 ELSE 4 + length(replace({_ESCAPED.format("role")}, ':', '\c')) + 2 + 8 END + length({_ESCAPED.format("text")}) AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
_TRIMMED = f"regexp_replace(regexp_replace({{0}}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"
_FAILS = f"""(length(x) <= {LOUD} AND lower({_TRIMMED.format("x")}) IN ({_quoted(NAVIGATION)}))
  OR (length(x) - length({_strip("x", MARKS)})) * 14 > length(x) OR (length(x) > {LOUD} AND length(replace(x, '!', '')) * 25 < length(x) * 24)
  OR (len(list_filter(lw, lambda w: w IN ({_quoted(SEPARATORS)}) OR regexp_matches(w, '^(https?://|www[.])'))) >= 2
      AND 3 * len(list_filter(lw, lambda w: w IN ({_quoted(SEPARATORS)}) OR regexp_matches(w, '^(https?://|www[.])'))) >= len(lw))
  OR regexp_matches(lower(x), {_quoted(["|".join(BOILERPLATE)])})"""
_ENTRY = f"""length(x) <= {2 * ENTRY_CHARS} AND length({_TRIMMED.format("x")}) BETWEEN 1 AND {ENTRY_CHARS} AND len(lw) <= {ENTRY_WORDS} AND right({_TRIMMED.format("x")}, 1) NOT IN ({_quoted(CLOSING)})"""
QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM p),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM h WHERE n > 1),
rep AS (SELECT doc_id, CAST(sum(least(8, i - coalesce(b, -8))) AS BIGINT) AS n FROM r GROUP BY doc_id),
l0 AS (SELECT doc_id, t, len(w) AS n_words, string_split(t, chr(10)) AS lines, list_filter(string_split(t, chr(10)), lambda x: {_SOLID.format("x")} <> '') AS filled FROM d),
x0 AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS x FROM l0),
x1 AS MATERIALIZED (SELECT *, {_WORDS.format("x")} AS lw FROM x0),
x2 AS (SELECT doc_id, i, x, {_ENTRY} AS entry, {_FAILS} AS fails FROM x1),
x3 AS (SELECT *, sum(CASE WHEN entry THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x2),
x4 AS (SELECT doc_id, i, x, fails OR (entry AND count(*) FILTER (entry) OVER (PARTITION BY doc_id, run) >= {ENTRIES}) AS fails FROM x3),
g AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT fails), '') AS good FROM x4 GROUP BY doc_id),
l AS (SELECT * FROM l0 JOIN g USING (doc_id)),
m AS (SELECT l.doc_id, n_words, length({_SOLID.format("t")}) AS word_chars, length(t) - length({_strip("t", SYMBOLS)}) AS n_symbols, len(filled) - len(list_distinct(filled)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, length({_SOLID.format("good")}) AS kept_chars FROM l LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * kept_chars >= word_chars AS kept FROM m
"""

_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _matches(kind: str, order: int, pattern: str, group: int, least: int, also: str = "true") -> str:
    """Spans of a pattern: the texts between the matches and the matches, in order, give the places."""
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, start, start + length(hit) AS stop, value FROM (
      SELECT doc_id, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS start FROM (
        SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[:len(hits)]) AS gap FROM (
          SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals, regexp_split_to_array(t, '{pattern}') AS gaps FROM d)))
      WHERE length(value) >= {least} AND {also}"""


SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner FROM documents),
b AS MATERIALIZED ({_matches("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_matches("hex", 2, "[0-9a-f]{24,}", 0, 24)}),
k AS ({_matches("token", 3, "[A-Za-z0-9+/_=-]{20,}", 0, 20, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')")}),
c AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = k.doc_id AND b.start < k.stop AND k.start < b.stop)),
v AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, sha256(t))) AS repositories FROM c JOIN d USING (doc_id) GROUP BY value),
j AS (SELECT c.*, owners, repositories, CASE WHEN owners <= 2 AND repositories <= 5 THEN 'live' ELSE 'copied' END AS verdict FROM c JOIN v USING (value)),
s AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < 3), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans,
  string_agg(verdict || ':' || owners || ':' || repositories, ',' ORDER BY start, o) AS verdicts FROM j WHERE o < 3 OR verdict = 'live' GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts
FROM d LEFT JOIN s USING (doc_id)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("text")}) AS size, CAST('0x' || substr(md5('17:' || doc_id || ':' || coalesce(text, '')), 1, 10) AS BIGINT) / 1099511627776e0 AS chance FROM documents),
z AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM z),
c AS (SELECT *, 2e0 * size AS cap, coalesce(sum(2e0 * size) OVER o, 0e0) AS capped, coalesce(sum(weight) OVER o, 0e0) AS weighed FROM w WINDOW o AS (ORDER BY 2e0 * size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((1.5e0 * (SELECT sum(size) FROM z) - capped) / ((SELECT sum(weight) FROM w) - weighed)) AS level FROM c),
t AS (SELECT source, size, least(cap, level * weight) AS target, CASE WHEN size > 0 THEN least(cap, level * weight) / size ELSE 0e0 END AS rate FROM c, l)
SELECT doc_id, d.size, CAST(t.size AS BIGINT) AS source_size, target, d.size * CAST(floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

CONTENT_DEDUP = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, {_SOLID.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t ORDER BY chars DESC, doc_id)
"""

_LINES = r"regexp_extract_all(t, '[^\n]*\n|[^\n]+')"
FILL_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
l AS (SELECT *, {_LINES} AS u, {", ".join(f"CAST('0x' || h[{8 * i + 1}:{8 * i + 8}] AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM l),
p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

# CRC-32 by its definition, bit by bit; then the cheapest edits turn by turn, forward, each state with its least cost and audit.
_CRC = "xor(list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split({0}, '')], lambda crc, b: list_reduce(range(8), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)), xor(crc, b)), 4294967295), 4294967295)"
_NO = "{'c': 1000000000, 'a': ''}"
_STATES = ("z", "s", "u", "a")
_plus = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}}"
_least = lambda *xs: f"list_min([{', '.join(xs)}])"
_into_u = lambda cost, edit: [_plus(x, cost, edit) for x in ("z", "s", "a")]
_when = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {_NO} END"
TURN_REPAIR = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS x FROM conversations),
t AS (SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE x WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE x <> 0),
n AS (SELECT *, row_number() OVER w AS i, {_SOLID.format("text")} AS solid, lag(role[1]) OVER w AS b FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM n),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, role[1] AS r, b, solid = '' AS blank, solid <> '' AND seen > 1 AS duplicate, solid <> '' AND seen = 1 AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated FROM o),
p(conv_id, i, z, s, u, a) AS (
  SELECT DISTINCT conv_id, 0, {{'c': 0, 'a': ''}}, {_NO}, {_plus("{'c': 0, 'a': ''}", 3, "I")}, {_plus("{'c': 0, 'a': ''}", 6, "II")} FROM f
  UNION ALL
  SELECT conv_id, i, z, s, {_least("u", *_into_u(3, "I"))}, {_least("a", _plus(_least("u", *_into_u(3, "I")), 3, "I"))} FROM (
    SELECT p.conv_id, f.i, {_plus("z", 4, "D")} AS z, {_least(_plus("s", 4, "D"), _when("NOT gone AND r = 's'", _plus("z", "e", "K")))} AS s,
      {_least(_plus("u", 4, "D"), *(_when("NOT gone AND r = 'u'", x) for x in _into_u("e", "K")), *(_when("NOT gone", x) for x in _into_u("(3 + e)", "R")))} AS u,
      {_least(_plus("a", 4, "D"), _when("NOT gone AND r = 'a'", _plus("u", "e", "K")), _when("NOT gone", _plus("u", "(3 + e)", "R")))} AS a
    FROM p JOIN (SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS e FROM f) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)),
best AS (SELECT conv_id, {_least("z", "a")} AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM p) WHERE last = 1),
e AS (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, unnest(range(1, len(best.a) + 1)) AS j, len(replace(best.a, 'D', '')) % 2 AS odd FROM best),
q AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w - 1 AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
h AS (SELECT q.conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (place + odd) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h
  FROM q LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i WHERE edit <> 'D' GROUP BY q.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (i > 1 AND b || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SQL = {"op13_content_dedup": CONTENT_DEDUP, "op12_fill_middle": FILL_MIDDLE, "op11_turn_repair": TURN_REPAIR, "op9_mixing": MIXING, "op7_secret_scan": SECRET_SCAN, "op1_ngram_jaccard_join": NGRAM_JOIN, "op4_decontaminate": DECONTAMINATE, "op5_chat_format": CHAT_FORMAT, "op10_quality_rules": QUALITY_RULES}
