"""Spelling variants in SQL. Runs are counted by document and word before crc32, byte by byte through a table of 256,
decides about the letter that goes; near words share a word with one letter masked, or are it with one taken away."""

OP13 = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT id, run, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY id, run),
coded AS (
  SELECT run, k, list_transform(string_split(id || ':' || run, ''), lambda x: unicode(x)) AS points FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [CAST(p AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(p - 64 AS BIGINT)] END))),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc_table),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m
  FROM (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS masked FROM places) a
  JOIN (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS masked FROM places) b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM places a JOIN words b ON b.word = left(a.word, a.i - 1) || substr(a.word, a.i + 1)
  UNION SELECT b.word, b.n, a.word, a.n FROM places a JOIN words b ON b.word = left(a.word, a.i - 1) || substr(a.word, a.i + 1)),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m, n, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS place FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
steps(word, stop) AS (
  SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.stop WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.stop AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN steps s ON s.word = f.word JOIN forms e ON e.word = s.stop AND e.form IS NULL
"""
