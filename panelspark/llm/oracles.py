"""SQL twins of the queries that SQL can express."""

# CRC-32 (polynomial 3988292384) of the decimal conv_id, eight shifts a digit
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
    lambda i: [ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
steps AS (
    SELECT c.conv_id, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
    UNION ALL
    SELECT c.conv_id, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
lists AS (
    SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS seq
    FROM convs c LEFT JOIN steps s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
members AS (SELECT conv_id, d, seq[1:d] AS node, d = len(seq) AS ends FROM lists, unnest(range(0, len(seq) + 1)) AS u(d)),
nodes AS (
    SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS end_ids
    FROM members GROUP BY node, d),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(n.node[depth].t) ELSE 0 END AS saved
    FROM nodes n LEFT JOIN children c ON c.node = n.node),
sums AS (
    SELECT m.node, sum((v.n_children = 0)::INT) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM valued v JOIN members m ON m.conv_id = v.conv_id AND m.d <= v.depth GROUP BY m.node)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(v.end_ids) AS ends_sha256
FROM valued v JOIN sums s ON s.node = v.node LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SEARCH = f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE doc_id IS NOT NULL),
sized AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
found AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*)::BIGINT AS df FROM found GROUP BY term), corpus),
norms AS (SELECT doc_id, 50 + ((50 * n * docs) // total) AS m FROM sized, corpus),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
           FROM items JOIN found USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
