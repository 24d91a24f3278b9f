"""DuckDB SQL for the results of those queries that SQL can express.

Written from the definitions, by other means than the operators: all pairs that share a shingle, all
pairs of vectors, one row a word.
"""

from __future__ import annotations

from . import chat_format, quality_rules, url_filters

_SPACE = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _reach(edges: str, nodes: str, key: str) -> str:
    """The smallest node that each node reaches over ``edges`` (a, b), both ways round."""
    return f"""reach AS (SELECT {key} AS a, {key} AS b FROM {nodes} UNION SELECT r.a, e.b FROM reach r JOIN {edges} e ON r.b = e.a),
least AS (SELECT a AS {key}, min(b) AS component_id FROM reach GROUP BY a)"""


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
{_reach("links", "documents", "doc_id")}
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)"""

_CONTROL = f"([<\\[])(\\\\*)({'|'.join(chat_format.CONTROL_TAILS)})"
_ESCAPED = lambda c: f"regexp_replace({c}, '{_CONTROL}', '\\1\\2\\\\\\3', 'g')"
_MARKS = len(chat_format.ROLE + chat_format.TEXT + chat_format.END)

CHAT = f"""WITH r AS (SELECT conv_id, turn, role AS own, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, own NULLS FIRST, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum({_MARKS} + length({_ESCAPED("role")}) + length({_ESCAPED("text")})) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

_WORDS = ", ".join(f"('{lang}')" for lang in sorted(quality_rules.COMMON_WORDS))
_COMMON = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.COMMON_WORDS.values() for w in ws}))
_TERM = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (p + q)) ELSE 0 END"
_PART = f"({_TERM.format('p')} + {_TERM.format('q')}) / 2"

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws FROM d),
words AS (SELECT k, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
windows AS (SELECT k, i, count(*) OVER (PARTITION BY k, word, w2, w3) AS met FROM (
  SELECT k, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE w3 IS NOT NULL),
repeats AS (SELECT k, count(DISTINCT i + j) AS n FROM windows, (VALUES (0), (1), (2)) v(j) WHERE met > 1 GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
m AS (SELECT d.k, d.doc_id, d.lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '{quality_rules.SYMBOLS}')) AS n_symbols,
  len(regexp_extract_all(text, '[0-9]')) AS n_digits, strlen(text) - length(text) AS more, length(text) AS chars,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN w ON d.k = w.k LEFT JOIN lines l ON d.k = l.k LEFT JOIN repeats r ON d.k = r.k),
bins AS (SELECT k, 'chars' AS h, unnest(['space', 'symbol', 'digit', 'beyond_ascii', 'other']) AS bin,
    unnest([chars - word_chars, n_symbols, n_digits, more, greatest(word_chars - n_symbols - n_digits - more, 0)]) AS n FROM m
  UNION ALL SELECT k, 'common', lower(word), count(*) FROM words WHERE lower(word) IN ({_COMMON}) GROUP BY k, lower(word)),
totals AS (SELECT k, h, CASE WHEN h = 'chars' THEN max(chars) ELSE sum(n) END AS n FROM bins JOIN m USING (k) GROUP BY k, h),
refs AS (SELECT lang, h, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, h) AS q FROM bins JOIN m USING (k) WHERE lang IN (VALUES {_WORDS}) GROUP BY lang, h, bin),
langs AS (SELECT DISTINCT lang FROM refs),
met AS (SELECT b.k, l.lang, b.h, b.n / t.n AS p, coalesce(r.q, 0) AS q FROM bins b JOIN totals t ON b.k = t.k AND b.h = t.h CROSS JOIN langs l
  LEFT JOIN refs r ON r.lang = l.lang AND r.h = b.h AND r.bin = b.bin WHERE t.n > 0),
js AS (SELECT k, lang, h, sqrt(greatest(0.5 + sum({_PART} - q / 2), 0)) AS d FROM met GROUP BY k, lang, h),
near AS (SELECT m.k, min(CASE WHEN m.n_words >= {quality_rules.GUARD_WORDS} THEN (c.d + coalesce(w.d, 1)) / 2 ELSE c.d END) AS d
  FROM m JOIN js c ON c.k = m.k AND c.h = 'chars' LEFT JOIN js w ON w.k = m.k AND w.lang = c.lang AND w.h = 'common' WHERE m.chars >= {quality_rules.GUARD_CHARS} GROUP BY m.k),
judged AS (SELECT m.*, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, near.d FROM m LEFT JOIN near ON m.k = near.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d <= {quality_rules.MAX_DISTANCE}, true) AS kept FROM judged"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT k, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.k AS ka, a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.k <> b.k AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
{_reach("links", "embeddings", "vec_id")}
SELECT v.vec_id, count(l.ka) AS n_links, any_value(least.component_id) AS component_id, v.vec_id = any_value(least.component_id) AS kept
FROM v JOIN least ON v.vec_id = least.vec_id LEFT JOIN links l ON v.k = l.ka GROUP BY v.k, v.vec_id"""

_TWO = ", ".join(f"'{s}'" for s in url_filters.TWO_LABEL_SUFFIXES)
_LOW, _HIGH = url_filters.STRENGTH
_TAIL = lambda n: f"array_to_string(labels[greatest(len(labels) - {n - 1}, 1):len(labels)], '.')"


def _strength(level: str) -> str:
    return f"""(SELECT CASE WHEN n IS NULL OR n = 0 OR members < 2 THEN {_LOW} WHEN u = 0 OR b <= 0 THEN {_HIGH} ELSE least(greatest(u / b - 1, {_LOW}), {_HIGH}) END FROM (
  SELECT n, members, mean * (1 - mean) AS u, (square - n * mean * mean - mean * (1 - mean) * (members - 1)) / greatest(n - members, 1) AS b FROM (
  SELECT sum(n) AS n, count(*) AS members, sum(good) / sum(n) AS mean, sum(n * (good / n) * (good / n)) AS square FROM {level} WHERE n > 0)))"""


URLS = f"""WITH parts AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM p LEFT JOIN known USING (page_id) GROUP BY host),
h AS (SELECT host, n, good, CASE WHEN {_TAIL(2)} IN ({_TWO}) THEN {_TAIL(2)} ELSE labels[len(labels)] END AS suffix,
  CASE WHEN {_TAIL(2)} IN ({_TWO}) THEN {_TAIL(3)} ELSE {_TAIL(2)} END AS domain FROM h0),
dm AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h GROUP BY suffix, domain),
sf AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM dm GROUP BY suffix),
k AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 0.5) / (sum(n) + 1) ELSE 0.5 END AS mean, {_strength("sf")} AS s0, {_strength("dm")} AS s1, {_strength("h")} AS s2 FROM sf),
sm AS (SELECT suffix, (good + s0 * mean) / (n + s0) AS m FROM sf, k),
dd AS (SELECT domain, dm.suffix, (good + s1 * sm.m) / (n + s1) AS m FROM k, dm JOIN sm ON dm.suffix = sm.suffix),
hm AS (SELECT host, (good + s2 * dd.m) / (n + s2) AS m, n + s2 AS weight FROM k, h JOIN dd ON h.suffix = dd.suffix AND h.domain = dd.domain),
named AS (SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN m + {url_filters.Z} * sqrt(m * (1 - m) / (weight + 1)) < {url_filters.MIN_GOOD} THEN 'block' ELSE 'allow' END AS verdict FROM named JOIN hm USING (host)"""
