"""DuckDB SQL for the numbered operators that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"

LINES = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', ''), '{UP}', '{LOW}') AS key FROM lines),
often AS (SELECT key FROM (SELECT DISTINCT doc_id, key FROM keyed) WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

COPIES = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS k FROM documents),
g AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(x) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(y) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""

WORDS = rf"regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
ks AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d JOIN ks ON len(w) >= k)),
met AS (SELECT p.doc_id, p.s, p.k, x.item_id FROM places p JOIN windows x ON p.win = x.win AND p.k = x.k),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM met) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN who USING (doc_id)"""

CRC32 = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS varchar), ''), lambda d: CAST(ascii(d) AS bigint)),
       lambda crc, byte: list_reduce(range(8), lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295), 4294967295)"""
TRIE = f"""
WITH turns AS (SELECT conv_id, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || octet_length(encode(coalesce(text, ''))) || ':' || coalesce(text, '') AS x,
               octet_length(encode(coalesce(text, ''))) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {CRC32} % 9 AS h FROM conversations),
built AS (SELECT c.conv_id, 0 AS part, t.i, t.x, t.size FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
          UNION ALL SELECT c.conv_id, 1, t.i, t.x, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
paths AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM convs
          UNION ALL SELECT conv_id, row_number() OVER w, string_agg(x, '') OVER w, size FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM paths GROUP BY path, depth),
lasts AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT path, string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) AS ids FROM paths JOIN lasts USING (conv_id, depth) GROUP BY path),
ups AS (SELECT n.path, n.depth, q.conv_id AS parent_conv_id, q.path AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.path = p.path AND q.depth = p.depth),
kids AS (SELECT parent AS path, depth - 1 AS depth, count(*) AS n_children FROM ups GROUP BY parent, depth),
below AS (SELECT p.path, p.depth, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved_tokens
          FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth LEFT JOIN kids k ON k.path = u.path AND k.depth = u.depth GROUP BY p.path, p.depth)
SELECT n.conv_id, CAST(n.depth AS bigint) AS depth, u.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS bigint) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN ups u USING (path, depth) LEFT JOIN kids k USING (path, depth) JOIN below b USING (path, depth) LEFT JOIN ends e ON e.path = n.path"""

RANKED_WORDS = rf"regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {RANKED_WORDS} AS w FROM documents WHERE text IS NOT NULL),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS bigint) AS n_words FROM d WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({RANKED_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL)),
tfs AS (SELECT row, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, n, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
adds AS (SELECT row, doc_id, term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))) AS worth
         FROM tfs JOIN dfs USING (term) CROSS JOIN whole),
scores AS (SELECT item_id, row, doc_id, CAST(sum(worth) AS bigint) AS score FROM adds JOIN asked USING (term) GROUP BY item_id, row, doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS integer) AS rank, doc_id, score FROM ranks WHERE rank <= 10"""
