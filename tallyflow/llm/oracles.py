"""DuckDB SQL of the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, MIN(doc_id) AS keep_id, COUNT(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, ROW_NUMBER() OVER (PARTITION BY t.norm ORDER BY t.doc_id NULLS LAST) = 1 AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON g.norm = t.norm
"""

MIX = r"""
WITH t AS (SELECT doc_id, source, COALESCE(doc_id::VARCHAR, 'text:' || md5(COALESCE(text, ''))) AS drawn, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM t GROUP BY source),
r AS (SELECT *, CAST([5, 2, 1] AS DOUBLE[])[((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
q AS (SELECT *, cap / weight AS ratio FROM r),
l AS (SELECT *, (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / SUM(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
f AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1) AS fit),
g AS (SELECT source, source_size, LEAST(COALESCE(fit * weight, cap), cap) AS target FROM l, f),
d AS (SELECT doc_id, size, t.source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats,
             ('0x' || substr(md5('7:' || drawn), 1, 8))::BIGINT AS draw
      FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, floor(target - repeats * source_size)::BIGINT
             - COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS space FROM d)
SELECT doc_id, size, source_size, target, repeats * size + LEAST(size, GREATEST(space, 0)) AS taken, repeats, LEAST(size, GREATEST(space, 0)) AS part_words FROM p
"""

WARC = r"""
WITH t AS (SELECT page_id, COALESCE(html, '') AS p FROM pages),
g AS (SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS h, MIN(page_id) OVER (PARTITION BY p) AS first_id FROM t)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""

DECONTAMINATE = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS window_text, len(w[s : s + 9]) AS size FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
dw AS (SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS window_text FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT r, s, dw.size, item_id FROM dw JOIN p ON p.window_text = dw.window_text AND p.size = dw.size),
h AS (SELECT r, COUNT(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS pos FROM m) GROUP BY r),
k AS (SELECT r, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, COALESCE(len(w), 0) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, COUNT(*) AS size FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, COUNT(*) AS overlap FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * overlap >= 75 * (x.size + y.size - overlap)),
c(r, reached) AS (SELECT r, r FROM d UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.reached)
SELECT d.doc_id, COALESCE(ANY_VALUE(n.size), 0) AS n_shingles, MIN(t.doc_id) AS component_id
FROM c JOIN d ON d.r = c.r JOIN d t ON t.r = c.reached LEFT JOIN n ON n.r = c.r GROUP BY d.r, d.doc_id
"""

# DuckDB's levenshtein counts bytes, so characters are renamed to those of one byte; a corpus of over 127 different
# characters would need another way.
LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, ROW_NUMBER() OVER (ORDER BY doc_id, i) AS pos FROM n),
f AS (SELECT line, length(line) AS size, MIN(pos) AS first_pos FROM l WHERE length(line) >= 20 GROUP BY line),
c AS (SELECT c, ROW_NUMBER() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT unnest(string_split(line, '')) AS c FROM f)),
m AS (SELECT string_agg(c, '' ORDER BY k) AS chars, string_agg(chr(k::INT), '' ORDER BY k) AS bytes FROM c),
b AS (SELECT line, size, first_pos, translate(line, chars, bytes) AS code FROM f, m),
s AS (SELECT *, code[1 : size // 3] AS s1, code[size // 3 + 1 : 2 * size // 3] AS s2, code[2 * size // 3 + 1 : size] AS s3, unnest(range(size - 2, size + 3)) AS meets FROM b),
near AS (SELECT DISTINCT x.line FROM s x JOIN b y ON y.size = x.meets AND y.first_pos < x.first_pos
         WHERE (contains(y.code, x.s1) OR contains(y.code, x.s2) OR contains(y.code, x.s3)) AND levenshtein(x.code, y.code) <= 2),
g AS (SELECT l.doc_id, l.i, l.raw, f.first_pos IS NOT NULL AND (l.pos > f.first_pos OR near.line IS NOT NULL) AS gone
      FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line),
k AS (SELECT doc_id, COALESCE(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped FROM g GROUP BY doc_id)
SELECT doc_id, k.text, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_dropped, 0) AS n_dropped FROM d LEFT JOIN k USING (doc_id)
"""

PHRASES = r"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, w[i : i + k - 1] AS g, COUNT(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, SUM(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.g, c.k, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g x ON x.lang = c.lang AND x.g = c.g[1 : j] JOIN g y ON y.lang = c.lang AND y.g = c.g[j + 1 : c.k]),
lowest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, g ORDER BY score, j) AS nth FROM cuts) WHERE nth = 1),
around AS (SELECT lang, part, MAX(f) AS f FROM (SELECT lang, unnest([g[1 : 2], g[2 : 3]]) AS part, f FROM c WHERE k = 3) GROUP BY ALL),
ranked AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM lowest b LEFT JOIN around o ON o.lang = b.lang AND o.part = b.g WHERE o.f IS NULL OR 100 * o.f < 50 * a)
SELECT * FROM (SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang)) WHERE rank <= 2000
"""

# DuckDB has no crc32, so its table of 256 entries and its loop over bytes are written out.
RESAMPLE = r"""
WITH step AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step FROM range(256) t(i)),
d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d),
h AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, step),
s AS (SELECT bucket, COUNT(*) AS s FROM dw JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, COUNT(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT COUNT(*) FROM dw)::DOUBLE AS ss, (SELECT COUNT(*) FROM b)::DOUBLE AS ts),
gains AS (SELECT bucket, floor(1000 * ln((COALESCE(t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((COALESCE(s, 0) + 1.0::DOUBLE) * (ts + 10000)))) AS gain FROM s FULL JOIN t USING (bucket), sums),
weights AS (SELECT row, floor(SUM(gain) / COUNT(*))::BIGINT AS weight FROM dw JOIN k USING (word) JOIN gains USING (bucket) GROUP BY row),
scores AS (SELECT row, doc_id, len(w) AS n_features, COALESCE(weight, 0) AS weight,
                  COALESCE(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
           FROM d LEFT JOIN weights USING (row)),
ranked AS (SELECT row, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, COUNT(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scores LEFT JOIN ranked USING (row)
"""

LICENSE_BASE = r"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, list_filter(range(1, len(w)), lambda i: w[i : i + 1] = ['cc', 'by']) AS cc,
             list_filter(range(1, len(w) - 1), lambda i: w[i : i + 2] = ['general', 'public', 'license']) AS gpl, list_filter(range(1, len(w) - 1), lambda i: w[i : i + 2] = ['all', 'rights', 'reserved']) AS reserved FROM d)
SELECT doc_id, n_words, len(cc) + len(gpl) + len(reserved) AS n_base, list_min(cc || gpl || reserved) - 1 AS first_word, list_max(cc || gpl || reserved) - 1 AS last_word,
       array_to_string(list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(reserved) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p
"""

PII_COUNTS = r"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
             list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
             list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) AS phone FROM t)
SELECT doc_id, len(email) AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 OR ('0' || ltrim(p, '0')[1:3])::INT > 255)) = 0)) AS n_ip,
       len(list_filter(card, lambda x: len(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN x[len(x) - i + 1]::INT
           ELSE 2 * x[len(x) - i + 1]::INT - CASE WHEN x[len(x) - i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
       len(list_filter(phone, lambda n: n BETWEEN 10 AND 15)) AS n_phone FROM m
"""
