"""The results of some queries again, as DuckDB SQL over the given tables."""

OP1 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS pos FROM d),
strings AS (
  SELECT doc_id, pos, substr(h, 2 * pos + 1, 2) AS b,
    CASE WHEN 2 * (pos + 100) <= length(h) THEN row_number() OVER (
      PARTITION BY CASE WHEN 2 * (pos + 100) <= length(h) THEN substr(h, 2 * pos + 1, 200) ELSE doc_id || '/' || pos END
      ORDER BY doc_id, pos) > 1 ELSE false END AS again
  FROM places),
bytes AS (
  SELECT doc_id, pos, b, max(again::INT) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM strings),
ends AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM bytes),
found AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    coalesce(string_agg(b, '' ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM ends GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN found USING (doc_id)
"""

OP4 = r"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS query,
    regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS origin
  FROM parts),
nodes AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM p),
targets AS (
  SELECT node, url, origin, path, trim(unnest([
    regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'i'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i'),
    regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'i'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'i')])) AS t
  FROM nodes WHERE node IS NOT NULL),
absolute AS (
  SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?:)//', 1) || t WHEN starts_with(t, '/') THEN origin || t
    ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS u
  FROM targets WHERE t <> ''),
linked AS (SELECT node AS a, substr(u, strpos(u, '://') + 3) AS rest FROM absolute WHERE contains(u, '://')),
edges AS (
  SELECT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END
    || regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS b
  FROM linked WHERE regexp_extract(rest, '^[^/?#]*') <> ''),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
members AS (
  SELECT a AS node, b AS other, min(b) OVER (PARTITION BY a) AS alias_of,
    regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path
  FROM reach),
member_rule AS (
  SELECT node, any_value(alias_of) AS alias_of, other, arg_max(v, length(rh || rp)) AS v
  FROM members LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY node, other),
shared AS (
  SELECT node, any_value(alias_of) AS alias_of,
    CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v
  FROM member_rule GROUP BY node),
own AS (
  SELECT page_id, host, path, node, (SELECT max({'n': length(rh || rp), 'rule': rh || rp, 'v': v}) FROM rules
    WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS r
  FROM nodes)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.v, shared.v, 'allow') AS verdict, alias_of
FROM own LEFT JOIN shared USING (node)
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN low ON a = doc_id
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE n > 1)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: list_contains(string_split('the of and to in a is that it for was on are with as be at by this have from or an'
      || ' der die das und in zu den ist von mit auf für nicht ein eine im dem des sich als'
      || ' le la les de des et un une est en que qui dans pour sur pas au du par avec'
      || ' el los las y del se por con para su al lo como más o', ' '), lower(x)))) AS n_stop_words
  FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
    AND 2 * n_symbols <= n_words AND 100 * n_stop_words >= n_words AND 2 * n_dup_lines <= n_lines
    AND n_words >= 2 * n_lines AS kept
FROM m
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, g)),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS x FROM hits) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

# The polynomial of crc32, and its start and end value below.
_CRC = r"""
crc_steps(b, v, k) AS (
  SELECT i, i, 0 FROM range(256) AS r(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_steps WHERE k = 8),
"""

OP11 = (
    r"""
WITH RECURSIVE """
    + _CRC
    + r"""
d AS (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, text,
    array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
      lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), '') AS front,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM documents, crc_table),
leaves AS (
  SELECT lang, doc_id, i, sha256(front || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(front || CASE WHEN changed IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS other
  FROM d),
nodes(lang, level, i, h, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, i // 8),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1),
top(level, i, h, n) AS (
  SELECT 0, i, h, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY i // 8),
root AS (SELECT h FROM top WHERE n = 1),
runs AS (
  SELECT lang, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8),
top_runs AS (SELECT level, i // 8 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY level, i // 8),
fold(lang, doc_id, above, level, i, cur, proof) AS (
  SELECT lang, doc_id, 0, 0, i, other, '' FROM leaves
  UNION ALL
  SELECT f.lang, f.doc_id, above, f.level + 1, i // 8, sha256(array_to_string(hs[:i % 8], '') || cur || array_to_string(hs[i % 8 + 2:], '')),
    proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
  FROM fold AS f JOIN runs AS r ON r.lang IS NOT DISTINCT FROM f.lang AND r.level = f.level AND r.run = f.i // 8 WHERE above = 0),
up AS (
  SELECT f.lang, f.doc_id, s.h AS subroot, s.i, f.cur, f.proof FROM fold AS f JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM f.lang
  WHERE f.level = (SELECT max(level) FROM nodes AS m WHERE m.lang IS NOT DISTINCT FROM f.lang)),
fold_top(lang, doc_id, subroot, level, i, cur, proof) AS (
  SELECT lang, doc_id, subroot, 0, i, cur, proof FROM up
  UNION ALL
  SELECT lang, doc_id, subroot, f.level + 1, i // 8, sha256(array_to_string(hs[:i % 8], '') || cur || array_to_string(hs[i % 8 + 2:], '')),
    proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
  FROM fold_top AS f JOIN top_runs AS r ON r.level = f.level AND r.run = f.i // 8)
SELECT l.doc_id, l.leaf, f.subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = root.h AS verified
FROM leaves AS l JOIN fold_top AS f USING (doc_id), root WHERE f.level = (SELECT max(level) FROM top)
"""
)

OP12 = (
    r"""
WITH RECURSIVE """
    + _CRC
    + r"""
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
per_doc AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(k)), lambda j: ('0x' || substr(hex(encode(k)), 2 * j + 1, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, doc_id::VARCHAR || ':' || w AS k FROM per_doc), crc_table),
cut AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, j, substr(word, 1, j) || substr(word, j + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS j FROM words)),
one_way AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM less AS x JOIN less AS y ON x.j = y.j AND x.v = y.v AND x.word <> y.word
  UNION SELECT word, v FROM less WHERE v IN (SELECT word FROM words)),
near AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
best AS (
  SELECT a, count(*) AS n_near, min({'less': -n, 'word': b}) AS m FROM near JOIN words ON word = b GROUP BY a),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 10 * n THEN m.word END AS form,
    CASE WHEN -m.less >= 10 * n THEN -m.less END AS form_n
  FROM words LEFT JOIN best ON a = words.word),
steps(word, root, k) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT s.word, f.form, k + 1 FROM steps AS s JOIN forms AS f ON f.word = s.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
)

OP13 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN low ON a = doc_id
"""
