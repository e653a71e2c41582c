"""DuckDB counterparts of the corpus queries."""

OP10_NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_id AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_id USING (doc_id)
"""

OP4_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(role) + 1 + length(regexp_replace(text, '([\\<\[\]])', '\\\1', 'g'))
    + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_LINES = r"""
lines AS (
  SELECT doc_id, i AS line_no, l[i] AS line,
    list_filter(regexp_split_to_array(lower(l[i]), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM
    (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
sets AS (
  SELECT doc_id, line_no, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM lines WHERE len(w) > 0)"""

OP2_LINE_DEDUP = "WITH " + _LINES + r""",
flat AS (SELECT doc_id, line_no, len(s) AS n, unnest(s) AS g FROM sets),
gone AS (
  SELECT DISTINCT b.doc_id, b.line_no FROM (
    SELECT b.doc_id, b.line_no FROM flat a JOIN flat b
      ON a.g = b.g AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.line_no < b.line_no)
    GROUP BY a.doc_id, a.line_no, b.doc_id, b.line_no, a.n, b.n
    HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 80) b),
left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM lines ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id)
SELECT doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(left_over.text, '') END AS text
FROM documents LEFT JOIN left_over USING (doc_id)
"""

OP7_DECONTAMINATE = r"""
WITH parts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w FROM parts),
shingles AS (
  SELECT kind, id, len(w) AS n, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
  FROM words WHERE len(w) > 0),
placed AS (SELECT kind, id, n, len(s) AS m, unnest(s) AS g, unnest(range(0, len(s))) AS p FROM shingles),
hits AS (
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id, least(d.p, greatest(d.n - b.n, 0)) AS start, b.n AS length
  FROM placed d JOIN placed b ON d.kind = 'd' AND b.kind = 'b' AND d.g = b.g),
bags AS (
  SELECT h.doc_id, h.item_id, h.start, d.g, count(*) AS n
  FROM hits h JOIN placed d ON d.kind = 'd' AND d.id = h.doc_id
    AND d.p BETWEEN h.start AND greatest(h.start + h.length - 5, h.start) GROUP BY ALL),
sizes AS (SELECT doc_id, item_id, start, sum(n) AS n FROM bags GROUP BY ALL),
items AS (SELECT id AS item_id, g, count(*) AS n, any_value(m) AS m FROM placed WHERE kind = 'b' GROUP BY ALL),
shared AS (
  SELECT x.doc_id, x.item_id, x.start, sum(least(x.n, i.n)) AS c, any_value(i.m) AS m
  FROM bags x JOIN items i USING (item_id, g) GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, start, CAST(c AS DOUBLE) / CAST(s.n + m - c AS DOUBLE) AS similarity
  FROM shared JOIN sizes s USING (doc_id, item_id, start)
  UNION ALL SELECT d.id, b.id, d.p, 1.0 FROM (
    SELECT id, w, unnest(range(0, len(w))) AS p FROM words WHERE kind = 'd') d
  JOIN (SELECT id, w FROM words WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4) b ON d.w[d.p + 1:d.p + len(b.w)] = b.w)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

OP13_REPEATS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS w
  FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM texts WHERE len(h) >= 400)),
twice AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
marked AS (
  SELECT r, p, CASE WHEN lag(p) OVER (PARTITION BY r ORDER BY p) >= p - 200 THEN 0 ELSE 1 END AS new FROM twice),
numbered AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
runs AS (SELECT r, run, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, run),
edges AS (
  SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM runs
  UNION ALL SELECT r, 0, min(a) FROM runs GROUP BY r),
kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS k
  FROM edges JOIN texts USING (r) GROUP BY r),
spans AS (SELECT r, count(*) AS n, sum(b - a) AS s FROM runs GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(s, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""

OP12_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS sizes(k))),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
many AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM many)),
cuts AS (
  SELECT p.lang, p.phrase, p.a, p.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * p.a * p.a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.x JOIN counts y ON y.lang = p.lang AND y.phrase = p.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM many WHERE k = 3
  UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM many WHERE k = 3),
around AS (SELECT lang, phrase, max(a) AS around FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
    b.phrase, b.a, b.l, b.r, CAST(t.n AS BIGINT) AS n, CAST(b.score AS BIGINT) AS score
  FROM best b JOIN totals t USING (lang) LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.around IS NULL OR 100 * o.around < 50 * b.a)
SELECT * FROM ranked WHERE rank <= 2000
"""

OP11_VARIANTS = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (
  SELECT run, hex(encode(concat(doc_id, ':', run))) AS h, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM counted, crc_table),
changed AS (
  SELECT CASE WHEN crc % 97 = 0
    THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (
  SELECT word, n, length(word) AS len, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN holes b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM v a JOIN holes b ON a.word = b.rest),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM pairs GROUP BY word),
known AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
    CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain(word, tip, step) AS (
  SELECT word, word, 0 FROM known
  UNION ALL SELECT c.word, k.form, step + 1 FROM chain c JOIN known k ON k.word = c.tip WHERE k.form IS NOT NULL),
roots AS (SELECT word, arg_max(tip, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM known JOIN roots USING (word)
"""
