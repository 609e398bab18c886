"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"


#: The rules written out anew, so that a wrong one in the operator would show.
_FAIL_BITS = """(n_words < 50)::INT + 2 * (2 * n_repeat_words > n_words)::INT + 4 * (n_symbols > 0.3 * n_words)::INT + 8 * (word_chars < 2 * n_words)::INT
  + 16 * (word_chars > 20 * n_words)::INT + 32 * (n_dup_lines > n_lines / 2)::INT + 64 * (n_marks > 0.3 * n_words)::INT"""


OP1 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
wins AS (SELECT r, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) AS x, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM wins) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM w),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM ln WHERE regexp_matches(x, {_WORDS}) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN lc USING (r)),
b AS (SELECT *, CAST({_FAIL_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

OP3 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, doc_id, unnest(range(0, n - 99)) AS p, h FROM d WHERE n >= 100),
x AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 200) AS x FROM w),
m AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM x) WHERE k > 1),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 1 ELSE 0 END AS new FROM m)),
s AS (SELECT r, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY r, g),
t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT t.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM t JOIN d USING (r) GROUP BY t.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] for i in range(1, len(ws) - 3)] END) AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM sizes UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r) AS component_id FROM sizes s JOIN reach ON reach.id = s.doc_id GROUP BY s.doc_id, s.n
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) AS sha, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
d AS (SELECT *, [CAST('0x' || sha[1 + 5 * i : 5 + 5 * i] AS BIGINT) for i in range(0, 8)] AS parts FROM s)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (parts[1 + k // 4] // (CASE k % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END)) % 32] for k in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

# A byte's steps of CRC-32 by its polynomial, then the bytes of a text one by one; heavy rows one by one to the least loaded shard;
# light rows in order of ids, cut where shards are full.
OP11 = """
WITH RECURSIVE bits AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(0, 256))::BIGINT AS b))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) for i in range(0, size - 1)]), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) AS crc FROM d, bits),
w AS (SELECT *, size * 1024 > sum(size) OVER () AS heavy FROM s),
big AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY size DESC, doc_id) AS k FROM w WHERE heavy),
lpt(k, loads, taken, shard, slot) AS (SELECT 0::BIGINT, [0::BIGINT for x in range(0, 16)], [0::BIGINT for x in range(0, 16)], 0::BIGINT, 0::BIGINT
  UNION ALL SELECT b.k, [loads[x] + (CASE WHEN x = place THEN size ELSE 0 END)::BIGINT for x in range(1, 17)], [taken[x] + (CASE WHEN x = place THEN 1 ELSE 0 END)::BIGINT for x in range(1, 17)], (place - 1)::BIGINT, taken[place]
  FROM (SELECT *, list_position(loads, list_min(loads)) AS place FROM lpt) l JOIN big b ON b.k = l.k + 1),
ended AS (SELECT loads, taken, (SELECT coalesce(sum(size), 0)::BIGINT FROM w WHERE NOT heavy) AS light FROM lpt ORDER BY k DESC LIMIT 1),
levels AS (SELECT n, light + list_sum(list_sort(loads)[1:n])::BIGINT AS level, loads, taken FROM ended, (SELECT unnest(range(1, 17)) AS n)),
level AS (SELECT * FROM levels ORDER BY level / n, n LIMIT 1),
borders AS (SELECT k, 2 * sum(greatest(0, level - loads[k] * n)) OVER (ORDER BY k) // n AS border FROM level, (SELECT unnest(range(1, 17)) AS k)),
placed AS (SELECT *, 2 * sum(size) OVER (ORDER BY doc_id) - size AS middle FROM w WHERE NOT heavy),
dealt AS (SELECT doc_id, size, crc, (SELECT count(*) FROM borders WHERE k < 16 AND border <= middle) AS shard FROM placed),
every AS (SELECT doc_id, size, crc, shard, (SELECT taken[shard + 1] FROM level) + row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot FROM dealt
  UNION ALL SELECT doc_id, size, crc, shard, slot FROM big JOIN lpt USING (k))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(slot AS BIGINT) AS slot, NULL::INTEGER AS grown_shard FROM every
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM grid JOIN size USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY 1, 2),
q AS (SELECT lang, term, CAST(1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q FROM whole JOIN size USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER k AS INTEGER) AS rank FROM both_parts WINDOW k AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR rank <= 10
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(ts) AS term FROM d) GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
m AS (SELECT r, 50 + (50 * len(ts) * n) // l AS m FROM d, total WHERE len(ts) > 0),
asked AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, n),
scores AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER k AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW k AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id) QUALIFY rank <= 50
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op3_suffix_dedup": OP3, "op6_ngram_jaccard": OP6, "op8_warc": OP8, "op11_sharding": OP11, "op12_source_divergence": OP12, "op13_ranked_search": OP13}
