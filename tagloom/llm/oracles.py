"""DuckDB SQL for the operators that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components_sql(nodes: str, links: str) -> str:
    """CTE ``comp(id, component_id)`` over the CTE ``nodes(id)`` and the symmetric CTE ``links(a, b)``."""
    return f"""
reach AS (
  SELECT id, id AS root FROM {nodes}
  UNION
  SELECT l.b, r.root FROM reach r JOIN {links} l ON l.a = r.id WHERE r.root < l.b
),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""


OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM w
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS k
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id AND x.n * 100 >= y.n * 85 AND y.n * 100 >= x.n * 85
  GROUP BY ALL
),
linked AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (n + m - k)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
nodes AS (SELECT doc_id AS id FROM sets),
{components_sql("nodes", "links")}
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN comp ON id = doc_id
"""

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
able AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM v
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda y: y * y)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM able x JOIN able y ON x.vec_id <> y.vec_id AND len(x.u) = len(y.u)
  WHERE list_dot_product(x.u, y.u) >= 0.95
),
nodes AS (SELECT vec_id AS id FROM v),
{components_sql("nodes", "links")},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM comp LEFT JOIN counts ON a = id
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""

#: Lengths of the template's control strings: start and sep, turn, end.
OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)
),
o AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS l, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS rl,
    coalesce(lag(role) OVER w = role, false) AS goes_on
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(l + CASE WHEN goes_on THEN 11 ELSE 12 + rl + 10 + 11 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

OP11 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT doc_id, x, unnest(range((len(x) + 199) // 200)) AS j FROM d),
y AS (SELECT doc_id, j, substr(x, CAST(200 * j + 1 AS INTEGER), 298) AS y FROM t),
b AS (SELECT doc_id, j, y, unnest(range(least(100, len(y) // 2))) AS k FROM y),
w AS (
  SELECT doc_id, 100 * j + k AS i, substr(y, CAST(2 * k + 1 AS INTEGER), 2) AS byte,
    CASE WHEN 2 * k + 100 <= len(y) THEN substr(y, CAST(2 * k + 1 AS INTEGER), 100) END AS s
  FROM b
),
f AS (SELECT s, min(doc_id) AS first_doc FROM w WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.doc_id, w.i, w.byte, coalesce(f.first_doc < w.doc_id, false) AS found FROM w LEFT JOIN f ON f.s = w.s),
c AS (
  SELECT doc_id, i, byte, coalesce(bool_or(found) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM r
),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM e GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

#: CRC-32 bit by bit, lowest bit of each byte first; near words meet at the word with one code point masked or left out.
OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
),
per AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
sums AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(x) // 2), lambda i:
    list_transform(range(8), lambda b: (CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT) >> b) & 1)))),
    lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) AS h
  FROM per
),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM sums GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (
  SELECT DISTINCT word, n, substr(word, 1, CAST(i - 1 AS INTEGER)) || '?' || substr(word, CAST(i + 1 AS INTEGER)) AS key FROM spots
),
cut AS (SELECT DISTINCT word, n, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS key FROM spots),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM masked x JOIN masked y ON x.key = y.key AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.key
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.key
),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS top, max(m) AS top_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * w.n THEN top END AS form, CASE WHEN top_n >= 5 * w.n THEN top_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
),
chain AS (
  SELECT word, word AS up, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN forms f ON f.word = c.up WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, last(up ORDER BY steps) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""

OP13 = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
),
k AS (
  SELECT *, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 1 + 8 * CAST(i AS INTEGER), 8) AS BIGINT)) AS r FROM u
),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
      WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""

ORACLES = {
    "op2_embedding_near_dedup": OP2,
    "op3_zip_warc": OP3,
    "op5_chat_formatting": OP5,
    "op9_ngram_jaccard_join": OP9,
    "op11_suffix_dedup": OP11,
    "op12_spelling_variants": OP12,
    "op13_fill_in_middle": OP13,
}
