"""DuckDB twins of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op3_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
occ AS (SELECT p.doc_id, p.i, p.n, w.item FROM places p JOIN wins w ON p.win = w.win AND p.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)(\||/s>|s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g')"

ORACLE["op6_chat"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|><|says|><|done|>') + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_HOST = _LOWER.format(r"regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")
_PATH = r"coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"



def _resolved(href: str, base: str) -> str:
    """The url that ``href`` names on a page of url ``base``; NULL if none."""
    own, rest = (rf"regexp_extract({href}, '(?s)^([^?#]*)(.*)$', {k})" for k in (1, 2))
    folder = rf"regexp_replace({_PATH.format(base)}, '[^/]*$', '')"
    path = f"CASE WHEN {own} = '' THEN {_PATH.format(base)} WHEN starts_with({own}, '/') THEN {own} ELSE CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {own} END"
    # segments one after the other: none for ., one back for ..
    kept = (f"list_reduce(list_prepend('', list_slice(string_split(regexp_replace({path}, '(/\\.\\.?)$', '\\1/'), '/'), 2, NULL)), "
            "lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)")
    clean = f"CASE WHEN regexp_matches({path}, '/\\.\\.?(?:/|$)') THEN CASE WHEN {kept} = '' THEN '/' ELSE {kept} END ELSE {path} END"
    query = rf"CASE WHEN {own} = '' AND NOT starts_with({rest}, '?') THEN regexp_extract({base}, '(?s)\?[^#]*') ELSE '' END"
    scheme = "'^[A-Za-z][A-Za-z0-9+.-]*:'"
    return (f"CASE WHEN regexp_matches({href}, {scheme[:-1]}//') THEN {href} WHEN regexp_matches({href}, {scheme}) THEN NULL WHEN starts_with({href}, '//') THEN 'http:' || {href} "
            f"WHEN regexp_matches({base}, {scheme[:-1]}//') THEN 'http://' || {_HOST.format(base)} || {clean} || {query} || {rest} END")


ORACLE["op8_url_rules"] = rf"""
WITH RECURSIVE based AS (
  SELECT url, html, CASE WHEN tag = '' THEN url ELSE coalesce({_resolved("replace(tag, '&amp;', '&')", 'url')}, url) END AS base
  FROM (SELECT url, html, coalesce(regexp_extract(html, '(?is)<base\s(?:[^>]*\s)?href\s*=\s*["'']?([^"''\s>]+)', 1), '') AS tag FROM pages)),
rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
tags AS (
  SELECT url, base, replace(href, '&amp;', '&') AS href FROM (
    SELECT url, base, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical["''\s>][^>]*>?')), '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1) AS href FROM based
    UNION ALL
    SELECT url, base, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["''\s][^>]*>')), '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1) FROM based)),
named AS (
  SELECT url AS a, {_resolved('href', 'base')} AS target FROM tags WHERE href <> '' AND url IS NOT NULL AND {_resolved('href', 'base')} IS NOT NULL
  UNION SELECT url, url FROM pages WHERE url IS NOT NULL),
cut AS (
  SELECT a, target, {_HOST.format('target')} AS host, regexp_replace({_PATH.format('target')}, '(?:/index)?\.html?$|/+$', '', 'g') AS path,
         regexp_replace(regexp_replace(regexp_extract(target, '(?s)\?([^#]*)', 1), '(?:^|&)(?:utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS q FROM named),
edges AS (SELECT a, CASE WHEN NOT contains(target, '://') THEN target ELSE host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS b FROM cut),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
u AS (SELECT DISTINCT url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM pages),
ruled AS (
  SELECT u.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.url),
shared AS (SELECT reach.a AS url, bool_or(verdict = 'allow') AS allowed FROM reach JOIN ruled ON reach.b = ruled.url GROUP BY reach.a)
SELECT p.page_id, {_HOST.format('p.url')} AS host, {_PATH.format('p.url')} AS path, ruled.rule,
       coalesce(ruled.verdict, CASE WHEN shared.allowed THEN 'allow' WHEN NOT shared.allowed THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN ruled USING (url) LEFT JOIN shared USING (url)
"""

# crc32 of a decimal number, bit by bit: a byte is taken in, then eight times one bit is shifted out (marked -1)
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

ORACLE["op11_trie"] = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS r
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, {_CRC.format('c')} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (
  SELECT c.c, t.role, t.text, 0 AS own, t.r FROM c JOIN t ON t.c = c.c - c.c % 5 AND t.r < c.h
  UNION ALL SELECT c.c, t.role, t.text, 1, t.r FROM c JOIN t ON t.c = c.c AND t.r >= c.h),
p AS (
  SELECT c, row_number() OVER w AS d, octet_length(encode(text)) AS bytes,
         list(sha256(length(role) || ':' || role || text)) OVER w AS node
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, r ROWS UNBOUNDED PRECEDING)),
paths AS (SELECT c, d, bytes, sha256(array_to_string(node, '')) AS node, CASE WHEN d > 1 THEN sha256(array_to_string(node[:-2], '')) ELSE 'root' END AS up FROM p
  UNION ALL SELECT c, 0, 0, 'root', NULL FROM c),
nodes AS (SELECT node, d, any_value(up) AS up, any_value(bytes) AS bytes, min(c) AS m, count(*) AS n FROM paths GROUP BY node, d),
kids AS (SELECT up AS node, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT nodes.*, coalesce(k, 0) AS k, (n - 1) * bytes AS saved FROM nodes LEFT JOIN kids USING (node)),
sums AS (SELECT a.node, sum(CAST(u.k = 0 AS BIGINT)) AS leaves, sum(u.saved) AS saved FROM own u JOIN paths a ON a.c = u.m AND a.d <= u.d GROUP BY a.node),
last AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM paths JOIN last USING (c, d) GROUP BY node)
SELECT own.m AS conv_id, CAST(own.d AS BIGINT) AS depth, u.m AS parent_conv_id, own.n AS n_convs, own.k AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM own JOIN sums USING (node) LEFT JOIN nodes u ON u.node = own.up LEFT JOIN ends ON ends.node = own.node
"""
