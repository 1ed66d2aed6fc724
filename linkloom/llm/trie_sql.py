"""The conversation trie in SQL. crc32 goes byte by byte through a table of 256 that eight steps of bits give; a node
is known by the hashes of all its turns, written out; subtrees are joined by the nodes' smallest members."""

OP12 = """
WITH crc_table AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx,
         sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS step, strlen(coalesce(text, '')) AS n_bytes
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, own,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS own FROM ordered GROUP BY conv_id), crc_table),
rebuilt AS (
  SELECT c.conv_id, o.idx + 1 AS depth, step, n_bytes FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.idx < c.h
  UNION ALL
  SELECT c.conv_id, o.idx - c.h + least(c.h, coalesce(b.own, 0)) + 1, step, n_bytes
  FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.idx >= c.h LEFT JOIN convs b ON b.conv_id = c.base),
paths AS (
  SELECT conv_id, depth, n_bytes, string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (SELECT conv_id, depth, n_bytes, sha256(path) AS node, sha256(CASE WHEN depth = 0 THEN NULL ELSE left(path, 128 * (depth - 1)) END) AS parent FROM paths),
lengths AS (SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id),
nodes AS (
  SELECT node, depth, min(parent) AS parent, min(m.conv_id) AS conv_id, count(*) AS n_convs, min(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(CASE WHEN length = depth THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
  FROM members m JOIN lengths l ON l.conv_id = m.conv_id GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
subtrees AS (
  SELECT m.node, m.depth, sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM nodes n LEFT JOIN kids k ON k.node = n.node JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node, m.depth)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.node = n.node AND s.depth = n.depth LEFT JOIN kids k ON k.node = n.node
LEFT JOIN nodes p ON p.node = n.parent AND p.depth = n.depth - 1
"""
