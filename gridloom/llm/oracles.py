"""DuckDB SQL with the rows of the queries that SQL can express, by plain means of its own."""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS window_text FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM n)),
p AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS window_text FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM n) WHERE len(w) >= k)),
h AS (SELECT doc_id, s, p.k, item_id FROM p JOIN g ON p.k = g.k AND p.window_text = g.window_text),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
o AS (SELECT item_id, term, min(k) AS first FROM (SELECT item_id, unnest(w) AS term, unnest(range(0, len(w))) AS k FROM i WHERE len(w) >= 10) GROUP BY ALL),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
s AS (SELECT term, count(*) AS seen FROM t SEMI JOIN o USING (term) GROUP BY term),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seen, term) AS nth, count(*) OVER (PARTITION BY item_id) AS terms FROM o JOIN s USING (term)),
q AS (SELECT doc_id, item_id, nth, pos - first AS diagonal FROM t JOIN r USING (term) WHERE nth <= 4 AND terms >= 4),
nearby AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT a.doc_id, a.item_id FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.diagonal BETWEEN a.diagonal AND a.diagonal + 5 GROUP BY a.doc_id, a.item_id, a.diagonal HAVING count(DISTINCT b.nth) = 4) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id LEFT JOIN nearby ON nearby.doc_id = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (html)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) AS n, length(text) + length(regexp_replace(text, '[^\\<>"]', '', 'g')) AS long, length(role) + length(regexp_replace(role, '[^\\<>"]', '', 'g')) AS role_long FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role), '')) AS loss_sha256,
  CAST(sum(length('<turn role="">') + 1 + role_long + long + 1 + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

MIXING = r"""
WITH RECURSIVE b AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM b GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM s),
f AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS unit, 0 AS n
  UNION ALL
  SELECT step + 1, (SELECT (CAST((SELECT sum(source_size) FROM w) AS DOUBLE) - coalesce(sum(CASE WHEN unit * weight > 3 * source_size THEN 3 * source_size END), 0)) / sum(CASE WHEN NOT unit * weight > 3 * source_size THEN weight END) FROM w), step
  FROM f WHERE step < 30),
u AS (SELECT unit FROM f ORDER BY step DESC LIMIT 1),
t AS (SELECT source, rank, source_size, least(unit * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM w, u),
q AS (SELECT b.*, rank, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, rank, k, size, pass, (pass * source_size + upto) / target AS finish FROM q, (VALUES (0), (1), (2)) v(pass) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, k, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM i),
x AS (SELECT doc_id, sum(CASE WHEN running <= (SELECT sum(target) FROM t) * (1 + 1e-12) THEN size ELSE 0 END) AS taken FROM c GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN x USING (doc_id)
"""

TEMPLATES = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, pos, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda v: CASE WHEN regexp_matches(v, '[0-9]') THEN '<*>' ELSE v END) AS tokens FROM l),
k AS (SELECT *, len(tokens) AS n, tokens[1:3] AS heads, CASE WHEN len(tokens) >= 50 THEN 3 ELSE 10 END AS least FROM t WHERE len(tokens) >= 3),
d AS (SELECT DISTINCT n, heads, least, tokens, doc_id FROM k),
f AS (SELECT n, heads FROM d GROUP BY n, heads, least HAVING count(DISTINCT tokens) > 1 AND count(*) >= least),
v AS (SELECT DISTINCT n, heads, tokens FROM d JOIN f USING (n, heads)),
p AS (SELECT n, heads, place, token, count(*) AS c FROM (SELECT n, heads, unnest(range(1, n + 1)) AS place, unnest(tokens) AS token FROM v) GROUP BY ALL),
o AS (SELECT n, heads, place, CASE WHEN max(c) * 2 >= sum(c) THEN arg_max(token, struct_pack(c := c, token := token)) END AS token FROM p GROUP BY ALL),
u AS (SELECT n, heads, list(token ORDER BY place) AS made, count(token) - 3 AS constants FROM o GROUP BY n, heads HAVING count(token) > 3 AND (count(token) - 3) * 2 >= n - 3),
g AS (SELECT tokens, made FROM v JOIN u USING (n, heads) WHERE 100 * len(list_filter(range(4, v.n + 1), lambda i: coalesce(made[i] = tokens[i], false))) >= 80 * constants),
m AS (SELECT d.tokens, doc_id, least, n, coalesce(list_transform(made, lambda v: coalesce(v, '<*>')), d.tokens) AS template, made IS NOT NULL AS of_leaf FROM d LEFT JOIN g ON g.tokens = d.tokens),
r AS (SELECT template, of_leaf FROM m GROUP BY template, of_leaf, least HAVING count(DISTINCT doc_id) >= least),
x AS (SELECT DISTINCT tokens FROM m JOIN r USING (template, of_leaf)),
s AS (SELECT doc_id, pos, unnest(range(1, len(parts) + 1)) AS part, unnest(parts) AS sentence FROM (SELECT doc_id, pos, regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+') AS parts FROM k WHERE n >= 50)),
w AS (SELECT *, list_transform(regexp_extract_all(sentence, '[^\x20\x09-\x0D]+'), lambda v: CASE WHEN regexp_matches(v, '[0-9]') THEN '<*>' ELSE v END) AS words FROM s),
q AS (SELECT words FROM w WHERE len(words) >= 8 GROUP BY words HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT doc_id, pos, coalesce(string_agg(sentence, '' ORDER BY part) FILTER (q.words IS NULL), '') AS rest FROM w LEFT JOIN q USING (words) GROUP BY doc_id, pos HAVING count(q.words) > 0),
z AS (SELECT l.doc_id, l.pos, l.line, CASE WHEN x.tokens IS NOT NULL THEN NULL WHEN c.rest IS NULL THEN l.line WHEN regexp_matches(c.rest, '[^\x20\x09-\x0D]') THEN c.rest END AS stays
  FROM l JOIN t USING (doc_id, pos) LEFT JOIN x ON x.tokens = t.tokens AND len(t.tokens) >= 3 LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos)
SELECT documents.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut
FROM documents LEFT JOIN (
  SELECT doc_id, string_agg(stays, chr(10) ORDER BY pos) AS kept, count(*) AS n_lines, count(*) FILTER (stays IS NULL) AS n_dropped, count(*) FILTER (stays <> line) AS n_cut
  FROM z GROUP BY doc_id) y USING (doc_id)
"""

RESAMPLING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
y AS (SELECT list(list_reduce(list_concat([k], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS steps FROM (SELECT unnest(range(0, 256)) AS k)),
v AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM i)),
x AS (SELECT word, list_concat([4294967295], list_transform(range(1, strlen(word) + 1), lambda k: (instr('0123456789ABCDEF', hex(encode(word))[2 * k - 1]) - 1) * 16 + instr('0123456789ABCDEF', hex(encode(word))[2 * k]) - 1)) AS bytes FROM v),
b AS (SELECT word, xor(list_reduce(bytes, lambda a, c: xor(a >> 8, steps[(xor(a, c) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, y),
s AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS word FROM i) JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM s)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM t)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM (SELECT r, unnest(w) AS word FROM (SELECT row_number() OVER () AS r, w FROM d)) JOIN b USING (word) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n_features, list_reduce(list_concat([0], list_transform(range(1, 9), lambda k: instr('0123456789abcdef', sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[k]) - 1)), lambda a, c: a * 16 + c) AS h FROM (SELECT row_number() OVER () AS r, doc_id, w FROM d)),
c AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN m USING (r)),
k AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST, weight) AS place FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM c WHERE n_features >= 20) // 100 THEN place END AS rank FROM k
"""

COLLOCATIONS = r"""
WITH p AS (SELECT row_number() OVER () AS r, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score
  FROM k JOIN t USING (lang) JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND len(c.w) > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM x)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
