"""Checking SQL (DuckDB) of the text queries that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT p.r, p.i, p.n, windows.item
  FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS words FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) AS p
  JOIN windows ON windows.n = p.n AND windows.words = p.words),
words_hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)"""

# CRC-32 bit by bit: each byte is followed by eight shifts, marked -1
_CRC32 = """xor(list_reduce(
  [CAST(4294967295 AS BIGINT)] || flatten([[CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT conv_id, t, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM own),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.t[1 : h], []), s.t[h + 1 :]) AS t FROM sized AS s LEFT JOIN own AS b ON b.conv_id = s.base),
named AS (SELECT conv_id, len(t) AS length, [sha256(CAST(t[1 : d] AS VARCHAR)) FOR d IN range(0, len(t) + 1)] AS keys, t FROM rebuilt),
members AS (
  SELECT conv_id, d AS depth, keys[d + 1] AS key, keys[d] AS parent, d = length AS ends,
    CASE WHEN d = 0 THEN 0 ELSE strlen(t[d].text) END AS bytes
  FROM named, unnest(range(0, length + 1)) AS u(d)),
nodes AS (
  SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY key, depth),
children AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
-- each node beside all nodes above it and itself
paths AS (
  SELECT DISTINCT keys[a + 1] AS top, a AS top_depth, keys[d + 1] AS key, d AS depth
  FROM named, unnest(range(0, length + 1)) AS u(d), unnest(range(0, d + 1)) AS v(a)),
sums AS (
  SELECT top AS key, top_depth AS depth, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM paths JOIN nodes USING (key, depth) LEFT JOIN children USING (key, depth) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums USING (key, depth) LEFT JOIN children USING (key, depth)
LEFT JOIN nodes AS p ON p.key = n.parent AND p.depth = n.depth - 1"""
