"""DuckDB SQL for the thin queries that SQL can express."""

OP1_SQL = r"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '<|im_end|><|im_start|>assistant ok'),
                        (CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '<|im_end|><|im_start|>assistant ok'))
), sized AS (
  SELECT *, turn // 4096 AS block,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
         length('<|im_start|>') + length(replace(replace(role, '<|', '<||'), chr(10), '<|nl|>')) + 1
           + length(replace(text, '<|', '<||')) + length('<|im_end|>') + 1 AS chars
  FROM talks
), summed AS (
  SELECT *, sum(tokens) OVER o - tokens AS before, row_number() OVER o AS pos
  FROM sized WINDOW o AS (PARTITION BY conv_id, block ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), celled AS (
  SELECT *, before // 384 AS cell, (before + tokens - 1) // 384 > before // 384 AS crosses FROM summed
), opened AS (
  SELECT *, pos = 1 OR crosses OR lag(crosses, 1, false) OVER o OR cell <> lag(cell, 1, -1) OVER o AS opens
  FROM celled WINDOW o AS (PARTITION BY conv_id, block ORDER BY pos)
), repeated AS (
  SELECT *, role = 'system' AND pos = 1 AND block = min(block) OVER (PARTITION BY conv_id) AS is_system,
         coalesce(lead(opens, 1) OVER o AND lead(before, 1) OVER o - before <= 64, false) AS r1,
         coalesce(lead(opens, 2) OVER o AND lead(before, 2) OVER o - before <= 64, false) AS r2
  FROM opened WINDOW o AS (PARTITION BY conv_id, block ORDER BY pos)
), counted AS (
  SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY conv_id) AS windows FROM repeated
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY block, pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY block, pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars * CASE WHEN is_system THEN windows ELSE 1 + r1::INT + r2::INT END)::BIGINT AS formatted_chars,
       max(windows)::BIGINT AS n_windows,
       sum(CASE WHEN is_system THEN windows - 1 ELSE r1::INT + r2::INT END)::BIGINT AS n_context
FROM counted GROUP BY conv_id
"""

OP8_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM normal
"""

#: Every position's 100 bytes, as hex digits and by their MD5; texts are cut into chunks first, so that taking
#: substrings stays in proportion to the text. A string's earliest place keeps it, all others lose their bytes.
OP5_SQL = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
), chunks AS (
  SELECT doc_id, origin, substr(digits, 2 * origin + 1, 2 * (500 + 99)) AS part
  FROM (SELECT doc_id, digits, unnest(range(0, n_bytes - 99, 500)) AS origin FROM texts)
), strings AS (
  SELECT doc_id, origin + i AS pos, md5_number(substr(part, 2 * i + 1, 200)) AS string
  FROM (SELECT doc_id, origin, part, unnest(range(0, least(500, length(part) // 2 - 99))) AS i FROM chunks)
), earliest AS (
  SELECT string, min((doc_id, pos)) AS place FROM strings GROUP BY string HAVING count(*) > 1
), later AS (
  SELECT doc_id, pos FROM strings JOIN earliest USING (string) WHERE (doc_id, pos) <> place
), opened AS (
  SELECT doc_id, pos, coalesce(pos > lag(pos) OVER o + 100, true) AS opens FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  SELECT doc_id, pos, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM opened
), runs AS (
  SELECT doc_id, run, min(pos) AS s, max(pos) + 100 AS e FROM numbered GROUP BY doc_id, run
), kept AS (
  -- What stands before each run, and after the last.
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM runs
  UNION ALL
  SELECT doc_id, coalesce(max(e), 0), max(n_bytes) FROM texts LEFT JOIN runs USING (doc_id) GROUP BY doc_id
), cleaned AS (
  SELECT doc_id, string_agg(substr(digits, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS digits
  FROM kept JOIN texts USING (doc_id) GROUP BY doc_id
), removed AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(cleaned.digits)) AS kept_sha256
FROM texts JOIN cleaned USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

#: All pairs of different sets that share a shingle, their exact similarity, and what the links connect.
OP7_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS shingles
  FROM worded
), named AS (
  SELECT doc_id, shingles, len(shingles) AS n_shingles, min(doc_id) OVER same AS set_id, count(*) OVER same AS size
  FROM (SELECT doc_id, shingles, md5(array_to_string(shingles, chr(10))) AS hash FROM shingled) WINDOW same AS (PARTITION BY hash)
), sets AS (
  SELECT set_id, size, n_shingles, unnest(shingles) AS shingle FROM named WHERE doc_id = set_id
), links AS (
  SELECT a.set_id AS a, b.set_id AS b, any_value(b.size) AS size
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.set_id <> b.set_id
    AND least(a.n_shingles, b.n_shingles) >= 0.8 * greatest(a.n_shingles, b.n_shingles)
  GROUP BY a.set_id, b.set_id
  HAVING 5 * count(*) >= 4 * (any_value(a.n_shingles) + any_value(b.n_shingles) - count(*))
), reached AS (
  SELECT a AS node, a AS origin FROM links
  UNION
  SELECT b, origin FROM reached JOIN links ON a = node
), classes AS (
  SELECT node, min(origin) AS class_id FROM reached GROUP BY node
), counted AS (
  SELECT a AS node, sum(size) AS others FROM links GROUP BY a
)
SELECT doc_id, coalesce(class_id, set_id) AS class_id, set_id, size - 1 AS n_copies,
       (CASE WHEN n_shingles > 0 THEN size - 1 ELSE 0 END + coalesce(others, 0))::BIGINT AS n_links, n_shingles::BIGINT AS n_shingles
FROM named LEFT JOIN classes ON classes.node = set_id LEFT JOIN counted ON counted.node = set_id
"""
