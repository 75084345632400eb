"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOPK = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# Links are counted from common shingles; components follow links step by step.
MINHASH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s,
    len(w) < 5 AS short FROM w
), n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.short = y.short AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION SELECT r.start, l.b FROM reach r JOIN links l ON r.node = l.a
), lowest AS (SELECT start AS doc_id, min(node) AS component_id FROM reach GROUP BY start)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l USING (doc_id) LEFT JOIN n USING (doc_id)
"""

DECONTAMINATION = f"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), windows AS (
  SELECT id AS item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: w[i:i + least(10, len(w)) - 1])) AS win
  FROM split WHERE kind = 'b' AND len(w) > 0
), places AS (
  SELECT id, i, w[i] AS head, w FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE kind = 'd')
), found AS (
  SELECT DISTINCT p.id, p.i, x.n, x.item FROM places p JOIN windows x ON p.head = x.win[1] AND p.w[p.i:p.i + x.n - 1] = x.win
), hit AS (
  SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY id
), items AS (
  SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS names FROM found GROUP BY id
)
SELECT s.id AS doc_id, len(s.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit h ON h.id = s.id LEFT JOIN items i ON i.id = s.id WHERE s.kind = 'd'
"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces
), grams AS (
  SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(g) = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM often WHERE len(g) > 1) c
  JOIN often x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN often y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
), lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM cuts) WHERE place = 1
), around AS (
  SELECT lang, g[s:s + m - 1] AS g, max(f) AS f
  FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS s FROM often, (SELECT unnest([2, 3]) AS m) WHERE len(g) > m) GROUP BY ALL
), ranked AS (
  SELECT c.lang, array_to_string(c.g, ' ') AS phrase, c.a, c.l, c.r, c.score,
    row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, array_to_string(c.g, ' ')) AS rank
  FROM lowest c LEFT JOIN around x ON x.lang = c.lang AND x.g = c.g WHERE x.f IS NULL OR 100 * x.f < 80 * c.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""

# Targets: sources stop in the order of size by weight; the level is that of the first prefix of
# stopped sources after which no further one passes its bound.
MIXTURE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS schedule FROM d GROUP BY source
), w AS (SELECT *, [5.0, 2.0, 1.0][schedule + 1]::DOUBLE AS weight FROM s),
levels AS (
  SELECT ((SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE
    / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER earlier, 0)) AS level, weight, source_size
  FROM w WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT w.*, least(w.weight * (SELECT max(level) FROM levels), (3 * w.source_size)::DOUBLE) AS target FROM w
), streams AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.schedule, t.weight,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, list_sum(list_transform([0, 1, 2], lambda p: greatest(least(size, floor(target + 0.5)::BIGINT - (p * source_size + start)), 0)))::BIGINT AS taken,
    start::DOUBLE / target * weight AS area
  FROM streams
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN size = 0 OR start >= floor(target + 0.5) THEN NULL WHEN area <= 0 THEN 0 WHEN area >= weight THEN 1.0
    WHEN schedule = 0 THEN 2.0::DOUBLE * area / (7.5::DOUBLE + sqrt(greatest(56.25::DOUBLE + (-10.0)::DOUBLE * area, 0)))
    WHEN schedule = 1 THEN 2.0::DOUBLE * area / (2.0::DOUBLE + sqrt(greatest(4.0::DOUBLE + 0.0::DOUBLE * area, 0)))
    ELSE 2.0::DOUBLE * area / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * area, 0))) END AS position
FROM passes
"""

# CRC-32 byte by byte over a table made here; two words are near if deleting one letter from the
# longer, or one at the same place from both, makes them equal.
SPELLING = """
WITH RECURSIVE crc(v, b, i) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b, i + 1 FROM crc WHERE i < 8
), crc_table AS (SELECT list(v ORDER BY b) AS tab FROM crc WHERE i = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc_table
), counts AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY ALL
), words AS (SELECT word, n FROM counts WHERE length(word) >= 7 AND n >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), forms AS (
  SELECT w.word, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END::BIGINT AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), chains AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.at AS root FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NULL
)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r ON r.word = f.word
"""
