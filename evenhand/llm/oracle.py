"""What SQL can express of the operators, for DuckDB over the same tables."""

LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+')"
ITEM_WORDS = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

REACH = "reach(a, b) AS (SELECT {node}, {node} FROM {nodes} UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
{REACH.format(node='doc_id', nodes='documents')},
m AS (SELECT a, min(b) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.least AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{REACH.format(node='vec_id', nodes='embeddings')},
m AS (SELECT a, min(b) AS least FROM reach GROUP BY 1), k AS (SELECT a, count(*) AS n FROM edges GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.least AS component_id, vec_id = m.least AS kept FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS.format('text')} AS w FROM documents), b AS (SELECT item_id, {ITEM_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS s, len(w[i : i + 12]) AS n FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
hits AS (SELECT doc_id, i, l.n, item_id FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - l.n + 2)) t(i), win WHERE win.n = l.n AND win.s = array_to_string(w[i : i + l.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM hits, unnest(range(i, i + n)) u(j) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)"""

LINES = f"""
WITH l AS (SELECT doc_id, k, x, {WORDS.format('x')} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + 4], ' ') AS g FROM l, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
sets AS (SELECT doc_id, k, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS cls FROM s GROUP BY ALL),
f AS (SELECT cls, any_value(n) AS n, min((doc_id, k)) AS at FROM sets GROUP BY 1),
g AS (SELECT cls, unnest(string_split(cls, chr(10))) AS g FROM f),
c AS (SELECT x.cls AS a, y.cls AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.cls <> y.cls GROUP BY ALL),
late AS (SELECT DISTINCT p.cls FROM c JOIN f p ON p.cls = a JOIN f q ON q.cls = b WHERE 100 * c.k >= 75 * (p.n + q.n - c.k) AND q.at < p.at),
gone AS (SELECT sets.doc_id, sets.k FROM sets JOIN f USING (cls) WHERE (sets.doc_id, sets.k) <> f.at OR cls IN (SELECT cls FROM late)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY l.k) FILTER (WHERE gone.k IS NULL), '') AS t
 FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_lines END::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(t) AS kept_sha256 FROM kept JOIN documents USING (doc_id)"""

SOURCE_MIX = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
w AS (SELECT *, 2 * CAST(source_size AS DOUBLE) AS cap, CAST(CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s),
-- the level that the sources of smaller cap per weight leave to the others; the first that it does not lift above its cap sets it for all that follow
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS k, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
f AS (SELECT rest, free, k FROM l WHERE weight * rest / free <= cap ORDER BY k LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN l.cap ELSE l.weight * f.rest / f.free END AS target FROM l LEFT JOIN f ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', '1', CAST(d.doc_id AS VARCHAR))), d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(whole + CASE WHEN target - whole * source_size > 0 AND upto - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""

_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({chars} AS VARCHAR)", "text")) + ")"


def _levels(base: str) -> str:
    return f"""SELECT * FROM ({base}) UNION ALL
SELECT g, level + 1, (n + 1) // 2, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {{0}} WHERE n > 1 GROUP BY g, level, n, pos // 2"""


def _climb(rows: str, tree: str, me: str) -> str:
    """Folding of every row level by level, with the siblings met."""
    return f"""SELECT id, g, pos, 0 AS level, node AS found, '' AS siblings FROM {rows} UNION ALL
SELECT x.id, x.g, x.pos // 2, x.level + 1, CASE WHEN s.node IS NULL THEN sha256(x.found) WHEN x.pos % 2 = 1 THEN sha256(s.node || x.found) ELSE sha256(x.found || s.node) END,
       x.siblings || coalesce(s.node, '')
FROM {me} x JOIN {tree} own ON own.g = x.g AND own.level = x.level AND own.pos = x.pos AND own.n > 1
LEFT JOIN {tree} s ON s.g = x.g AND s.level = x.level AND s.pos = xor(x.pos, 1)"""


MERKLE = f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS id, * FROM documents),
crc AS (SELECT id, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b >> 1, CAST(3988292384 AS BIGINT)) ELSE b >> 1 END)), CAST(4294967295 AS BIGINT)) AS sum
  FROM src WHERE doc_id IS NOT NULL),
leaves AS (SELECT src.id, doc_id, lang, {_leaf('n_chars')} AS leaf,
             CASE WHEN crc.sum % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS node FROM src LEFT JOIN crc ON crc.id = src.id),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS g FROM leaves GROUP BY lang),
placed AS (SELECT id, doc_id, leaf, node, g, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
           FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang),
tree AS ({_levels('SELECT g, 0 AS level, n, pos, leaf AS node FROM placed').format('tree')}),
subroots AS (SELECT g, node FROM tree WHERE n = 1),
crown AS ({_levels('SELECT 0 AS g, 0 AS level, (SELECT count(*) FROM subroots) AS n, g AS pos, node FROM subroots').format('crown')}),
low AS ({_climb('placed', 'tree', 'low')}),
done AS (SELECT id, g, found, siblings FROM low JOIN tree USING (g, level, pos) WHERE tree.n = 1),
upper_rows AS (SELECT id, 0 AS g, g AS pos, found AS node FROM done),
high AS ({_climb('upper_rows', 'crown', 'high')}),
ended AS (SELECT id, found, siblings FROM high JOIN crown USING (g, level, pos) WHERE crown.n = 1)
SELECT doc_id, leaf, subroots.node AS subroot, (SELECT node FROM crown WHERE n = 1) AS root, sha256(done.siblings || ended.siblings) AS proof_sha256,
       ended.found AS folded_root, ended.found = (SELECT node FROM crown WHERE n = 1) AS verified
FROM placed JOIN subroots USING (g) JOIN done USING (id) JOIN ended USING (id)
"""
