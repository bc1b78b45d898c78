"""The same results in DuckDB SQL, worked out from the star-schema tables.

For the code and config trees nothing is parsed: definitions, references,
documentation and links follow from the rows the files were written from. For
documents the text is read with RE2.
"""

from __future__ import annotations


def _natkey(expr: str) -> str:
    """Natural order as a list of (class, number of digits, text): lists and structs compare by their parts."""
    return f"""list_transform(regexp_extract_all({expr}, '[0-9]+|[^0-9]'), lambda p: CASE
        WHEN p = '~' THEN {{'c': 0, 'n': 0, 't': ''}}
        WHEN regexp_matches(p, '^[0-9]') THEN {{'c': 1, 'n': length(ltrim(p, '0')), 't': ltrim(p, '0')}}
        WHEN regexp_matches(p, '^[A-Za-z]$') THEN {{'c': 2, 'n': 0, 't': p}} ELSE {{'c': 3, 'n': 0, 't': p}} END)"""


def _git_id(expr: str) -> str:
    return f"sha1(encode('blob ' || octet_length(encode({expr}))) || '\\x00'::BLOB || encode({expr}))"


def _dir(expr: str) -> str:
    return f"regexp_extract({expr}, '^(.*)/[^/]*$', 1)"


def _base(expr: str) -> str:
    return f"regexp_extract({expr}, '([^/]*)$', 1)"


def _ext(expr: str) -> str:
    return rf"regexp_extract({_base(expr)}, '^\.*[^.].*(\.[^.]*)$', 1)"


def _stem(expr: str) -> str:
    return f"left({_base(expr)}, length({_base(expr)}) - length({_ext(expr)}))"


def _family(expr: str) -> str:
    ext, stem = f"lower({_ext(expr)})", f"lower({_stem(expr)})"
    return f"""CASE WHEN {ext} IN ('.c', '.cc', '.cpp', '.c++', '.cxx', '.h', '.s') THEN 'C'
        WHEN {ext} IN ('.dts', '.dtsi') THEN 'D'
        WHEN starts_with({stem}, 'kconfig') AND {ext} <> '.rst' THEN 'K'
        WHEN (starts_with({stem}, 'makefile') AND {ext} <> '.rst') OR {ext} = '.mk' THEN 'M' END"""


# --- code tree -----------------------------------------------------------------

CODE = f"""
used AS (SELECT DISTINCT 'v' || year(l_shipdate) || '.' || month(l_shipdate) AS version,
                l_orderkey AS k, l_partkey AS pk, l_linenumber AS ln FROM lineitem),
order_f AS (SELECT 'v' || year(o_orderdate) || '.' || month(o_orderdate) AS version, o_orderkey AS k,
                'drivers/q' || (o_orderkey % 7) || '/order_' || o_orderkey || '.c' AS path,
                CASE WHEN o_orderkey % 3 = 0 THEN '/*' ELSE '/**' END || chr(10)
                || ' * order_' || o_orderkey || ' - priority ' || o_orderpriority || chr(10)
                || ' */' || chr(10) || 'int order_' || o_orderkey || '(void)' || chr(10) || '{{' || chr(10)
                || chr(9) || 'return ' || (o_orderkey % 100) || ';' || chr(10) || '}}' || chr(10) AS content
            FROM orders),
order_b AS (SELECT k, content, {_git_id('content')} AS blob_id FROM order_f),
item_t AS (SELECT DISTINCT pk, ln FROM used),
item_c AS (SELECT pk, ln, '#include "../../../include/part_' || (pk // 64) || '.h"' || chr(10)
                || CASE WHEN ln % 2 = 0 THEN '#include <part_' || (pk // 64) || '.h>' ELSE '#include <none.h>' END || chr(10)
                || '/* order_' || pk || ' */' || chr(10) || 'int item_' || pk || '_' || ln || '(void)' || chr(10)
                || '{{' || chr(10)
                || repeat(chr(9) || 'use(part_' || pk || ', "supp_' || (pk % 10) || '", part_' || pk || '); // part_' || pk || chr(10), ln)
                || '}}' || chr(10) AS content FROM item_t),
item_b AS (SELECT pk, ln, content, {_git_id('content')} AS blob_id FROM item_c),
item_f AS (SELECT u.version, u.k, u.pk, u.ln, b.blob_id, b.content,
                'drivers/q' || (u.k % 7) || '/o' || u.k || '/item_' || u.pk || '_' || u.ln || '.c' AS path
            FROM used u JOIN item_b b USING (pk, ln)),
part_c AS (SELECT p_partkey // 64 AS chunk,
                string_agg('#define part_' || p_partkey || ' ' || p_size || chr(10), '' ORDER BY p_partkey) AS content
            FROM part GROUP BY 1),
part_b AS (SELECT chunk, content, {_git_id('content')} AS blob_id FROM part_c),
part_f AS (SELECT version, chunk, 'include/part_' || chunk || '.h' AS path, blob_id, content
            FROM (SELECT DISTINCT version, pk // 64 AS chunk FROM used) JOIN part_b USING (chunk)),
supp_c AS (SELECT s_suppkey // 100 AS chunk,
                string_agg('extern int supp_' || s_suppkey || ';' || chr(10), '' ORDER BY s_suppkey) AS content
            FROM supplier GROUP BY 1),
supp_b AS (SELECT chunk, content, {_git_id('content')} AS blob_id FROM supp_c),
supp_f AS (SELECT version, chunk, 'include/supp_' || chunk || '.h' AS path, blob_id, content
            FROM (SELECT DISTINCT 'v' || year(l_shipdate) || '.' || month(l_shipdate) AS version,
                         l_suppkey // 100 AS chunk FROM lineitem) JOIN supp_b USING (chunk)),
paths AS (SELECT version, path, b.blob_id, b.content FROM order_f f JOIN order_b b USING (k)
          UNION ALL SELECT version, path, blob_id, content FROM item_f
          UNION ALL SELECT version, path, blob_id, content FROM part_f
          UNION ALL SELECT version, path, blob_id, content FROM supp_f),
blobs AS (SELECT blob_id, any_value(content) AS content FROM paths GROUP BY blob_id),
defs AS (SELECT 'order_' || k AS ident, blob_id, 'function' AS type, 4 AS line FROM order_b
         UNION ALL SELECT 'item_' || pk || '_' || ln, blob_id, 'function', 4 FROM item_b
         UNION ALL SELECT 'part_' || p_partkey, blob_id, 'macro',
                (row_number() OVER (PARTITION BY chunk ORDER BY p_partkey))::INT
            FROM part JOIN part_b ON p_partkey // 64 = chunk
            WHERE chunk IN (SELECT chunk FROM part_f)
         UNION ALL SELECT 'supp_' || s_suppkey, blob_id, 'externvar',
                (row_number() OVER (PARTITION BY chunk ORDER BY s_suppkey))::INT
            FROM supplier JOIN supp_b ON s_suppkey // 100 = chunk
            WHERE chunk IN (SELECT chunk FROM supp_f)),
refs AS (SELECT 'part_' || pk AS ident, blob_id, (5 + i)::INT AS line
         FROM item_b, unnest(range(1, ln + 1)) AS t(i), (VALUES (1), (2)) AS twice(x)
         WHERE pk IN (SELECT p_partkey FROM part)),
docs AS (SELECT 'order_' || k AS ident, blob_id, 1 AS line FROM order_b WHERE k % 3 <> 0),
first_paths AS (SELECT version, blob_id, min(path) AS path FROM paths GROUP BY ALL),
vkeys AS (SELECT version, {_natkey("version || '.0'")} AS natkey, {_natkey('version')} AS latest_key
          FROM (SELECT DISTINCT version FROM paths))
"""

PATH_QUERIES = """
path_queries AS (SELECT DISTINCT 'v' || year(o_orderdate) || '.' || month(o_orderdate) AS version, unnest([
        '/drivers/q' || (o_orderkey % 7) || '/order_' || o_orderkey || '.c/', 'drivers/q' || (o_orderkey % 7),
        'drivers/', '', 'gone/' || o_orderkey]) AS path FROM orders)
"""

DIRS = f"""
parents AS (SELECT DISTINCT version, {_dir('path')} AS dir FROM paths),
dirs AS (SELECT DISTINCT version, dir FROM (
        SELECT version, dir FROM parents UNION ALL SELECT version, '' FROM parents
        UNION ALL SELECT version, array_to_string(list_slice(string_split(dir, '/'), 1, i), '/')
        FROM parents, unnest(range(1, 20)) AS t(i) WHERE i < length(string_split(dir, '/'))))
"""

LATEST = """
latest AS (SELECT arg_max(version, latest_key) AS latest, arg_max(version, natkey) AS latest_rc FROM vkeys)
"""

IDENT_QUERIES = f"""
{LATEST},
ident_queries AS (
    SELECT 'v' || (1995 + p_partkey % 7) || '.' || (1 + p_partkey % 12) AS version, 'part_' || p_partkey AS ident,
           ['C', 'A', 'K', 'D', 'M', 'Z'][p_partkey % 6 + 1] AS family FROM part
    UNION ALL SELECT 'v' || year(o_orderdate) || '.' || month(o_orderdate), 'order_' || o_orderkey,
           CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'C' END FROM orders
    UNION ALL SELECT latest, 'supp_' || s_suppkey, 'C' FROM supplier, latest
    UNION ALL SELECT latest_rc, 'none_' || c_custkey, 'C' FROM customer, latest),
asked AS (SELECT DISTINCT version, ident, CASE WHEN family = 'Z' THEN 'C' ELSE family END AS family FROM ident_queries)
"""

# Every definition of this tree lies in a C file; parts are macros.
SEARCH = """
found AS (
    SELECT q.version, q.ident, q.family, 'definitions' AS section, d.type, p.path, d.line::VARCHAR AS lines, 1 AS n_lines
    FROM asked q JOIN defs d USING (ident) JOIN first_paths p ON p.version = q.version AND p.blob_id = d.blob_id
    WHERE q.family IN ('C', 'A') OR (q.family = 'D' AND starts_with(q.ident, 'part_'))
    UNION ALL
    SELECT q.version, q.ident, q.family, 'references', NULL, p.path, r.lines, r.n_lines
    FROM asked q JOIN (SELECT ident, blob_id, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines, count(*) AS n_lines
                       FROM refs GROUP BY ALL) r USING (ident)
         JOIN paths p ON p.version = q.version AND p.blob_id = r.blob_id
    WHERE q.family IN ('C', 'A', 'K')
    UNION ALL
    SELECT q.version, q.ident, q.family, 'documentations', NULL, p.path, d.line::VARCHAR, 1
    FROM asked q JOIN docs d USING (ident) JOIN paths p ON p.version = q.version AND p.blob_id = d.blob_id)
"""

# --- config tree ---------------------------------------------------------------

CONFIG = f"""
nat AS (SELECT n, name, 'v1.' || r AS version, 'net/r' || r || '/n' || n AS dir FROM (
        SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation
        UNION ALL SELECT c_custkey, c_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey > 24)),
sup AS (SELECT n, s_suppkey AS sk, s_suppkey // 100 AS c, version, dir,
               row_number() OVER (PARTITION BY n, s_suppkey // 100 ORDER BY s_suppkey) AS i
        FROM supplier JOIN nat ON s_nationkey = n),
grp AS (SELECT n, c, version, dir, count(*) AS m,
               string_agg(chr(9) || '{{ .compatible = "vendor' || n || ',supp' || sk || '" }},' || chr(10), '' ORDER BY sk) AS in_code,
               string_agg(chr(9) || 'compatible = "vendor' || n || ',supp' || sk || '", "vendor' || n || ',any";' || chr(10), '' ORDER BY sk) AS in_dts
        FROM sup GROUP BY ALL),
kconfig AS (SELECT n, version, dir, dir || '/Kconfig' AS path,
        'config NATION_' || n || chr(10) || chr(9) || 'bool "' || name || '"' || chr(10) || chr(9) || 'depends on NATION_' || n || chr(10)
        || 'source "' || dir || '/sub/Makefile"' || chr(10) AS content FROM nat),
makefile AS (SELECT n, version, dir, dir || '/Makefile' AS path,
        'obj-$(CONFIG_NATION_' || n || ') += nation_' || n || '.o' || chr(10) || 'obj-y += sub/' || chr(10) || 'obj-y += gone/' || chr(10)
        || 'subdir-y += doc' || chr(10) || 'dtb-y += board_' || n || '.dtb' || chr(10)
        || 'include $(srctree)/' || dir || '/Kconfig' || chr(10) || 'include $(srctree)/' || dir || '/absent' || chr(10)
        || 'extra-y += sub/Makefile' || chr(10) || ' nation_' || n || '.o := none' || chr(10) AS content FROM nat),
sub AS (SELECT n, version, dir, dir || '/sub/Makefile' AS path, 'obj-y += leaf.o' || chr(10) AS content FROM nat),
config_in AS (SELECT n, version, dir, dir || '/Config.in' AS path,
        'source "' || dir || '/Kconfig"' || chr(10) || '  source "' || dir || '/none.in"' || chr(10) AS content FROM nat),
defconfig AS (SELECT DISTINCT n, version, dir, 'net/configs/' || lower(c_mktsegment) || '_' || n || '_defconfig' AS path,
        'CONFIG_NATION_' || n || '=y' || chr(10) || 'CONFIG_ABSENT=y' || chr(10) AS content
        FROM customer JOIN nat ON c_nationkey = n),
code AS (SELECT n, c, m, version, dir, dir || '/drv_' || n || '_' || c || '.c' AS path,
        '#include <linux/of.h>' || chr(10) || '#define VENDOR' || n || '_' || c || ' 1' || chr(10) || '#ifdef CONFIG_NATION_' || n || chr(10)
        || in_code || '#endif' || chr(10) AS content FROM grp),
dts AS (SELECT n, c, m, version, dir, dir || '/board_' || n || '_' || c || '.dts' AS path,
        '/include/ "common_' || n || '.dtsi"' || chr(10) || 'node_' || n || '_' || c || ': node {{' || chr(10) || in_dts
        || chr(9) || 'reg = <VENDOR' || n || '_' || c || '>;' || chr(10) || '}};' || chr(10) AS content FROM grp),
bindings AS (SELECT n, sk, version, dir, 'Documentation/devicetree/bindings/n' || n || '/supp' || sk || '.txt' AS path,
        'Compatible: vendor' || n || ',supp' || sk || ' or vendor' || n || ',none' || chr(10) || chr(10)
        || 'see vendor' || n || ',supp' || sk || chr(10) AS content FROM sup),
all_files AS (SELECT version, path, content FROM kconfig UNION ALL SELECT version, path, content FROM makefile
        UNION ALL SELECT version, path, content FROM sub UNION ALL SELECT version, path, content FROM config_in
        UNION ALL SELECT version, path, content FROM defconfig UNION ALL SELECT version, path, content FROM code
        UNION ALL SELECT version, path, content FROM dts UNION ALL SELECT version, path, content FROM bindings),
paths AS (SELECT version, path, {_git_id('content')} AS blob_id FROM all_files),
first_paths AS (SELECT version, blob_id, min(path) AS path FROM paths GROUP BY ALL),
loc AS (SELECT path, version, blob_id FROM paths),
defs AS (SELECT 'CONFIG_NATION_' || n AS ident, blob_id, 'config' AS type, 1 AS line, 'K' AS family FROM kconfig JOIN loc USING (path, version)
         UNION ALL SELECT 'VENDOR' || n || '_' || c, blob_id, 'macro', 2, 'C' FROM code JOIN loc USING (path, version)
         UNION ALL SELECT 'node_' || n || '_' || c, blob_id, 'label', 2, 'D' FROM dts JOIN loc USING (path, version)),
refs AS (SELECT 'CONFIG_NATION_' || n AS ident, blob_id, 3 AS line, 'K' AS family FROM kconfig JOIN loc USING (path, version)
         UNION ALL SELECT 'CONFIG_NATION_' || n, blob_id, 1, 'M' FROM makefile JOIN loc USING (path, version)
         UNION ALL SELECT 'CONFIG_NATION_' || n, blob_id, 3, 'C' FROM code JOIN loc USING (path, version)
         UNION ALL SELECT 'VENDOR' || n || '_' || c, blob_id, (3 + m)::INT, 'D' FROM dts JOIN loc USING (path, version)),
comps AS (SELECT 'vendor' || sup.n || ',supp' || sk AS ident, blob_id, (3 + i)::INT AS line, 'C' AS family
            FROM sup JOIN code USING (n, c) JOIN loc ON loc.path = code.path
          UNION ALL SELECT unnest(['vendor' || sup.n || ',supp' || sk, 'vendor' || sup.n || ',any']), blob_id, (2 + i)::INT, 'D'
            FROM sup JOIN dts USING (n, c) JOIN loc ON loc.path = dts.path),
comp_docs AS (SELECT 'vendor' || n || ',supp' || sk AS ident, blob_id, unnest([1, 3])::INT AS line, 'B' AS family
            FROM bindings JOIN loc USING (path, version)),
asked AS (SELECT DISTINCT version, ident, unnest(['A', 'B', 'C', 'D', 'K', 'M']) AS family FROM (
            SELECT version, 'CONFIG_NATION_' || n AS ident FROM nat
            UNION ALL SELECT version, unnest(['VENDOR' || n || '_' || c, 'node_' || n || '_' || c,
                   'vendor' || n || ',supp' || sk, 'vendor' || n || ',any']) FROM sup)),
found AS (
    SELECT q.version, q.ident, q.family, 'definitions' AS section, d.type, p.path, d.line::VARCHAR AS lines
    FROM asked q JOIN defs d USING (ident) JOIN first_paths p ON p.version = q.version AND p.blob_id = d.blob_id
    WHERE q.family <> 'B' AND (q.family IN ('A', d.family) OR (q.family = 'D' AND q.ident IN (SELECT ident FROM defs WHERE type = 'macro' AND family = 'C')))
    UNION ALL
    SELECT q.version, q.ident, q.family, 'references', NULL, p.path, r.lines
    FROM asked q JOIN (SELECT ident, blob_id, family AS rf, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM refs GROUP BY ALL) r USING (ident)
         JOIN paths p ON p.version = q.version AND p.blob_id = r.blob_id
    WHERE q.family = 'A' OR q.family = rf AND rf IN ('C', 'D', 'K') OR (q.family = 'K' AND rf IN ('C', 'M')))
"""

# --- documents -----------------------------------------------------------------


def _pieces(word: str) -> str:
    return (
        r"/\*(?s:.*?)\*/|//[^\n]*\n"
        r"""|[^'']"(?:[^"\\]|\\(?s:.))*\""""
        rf"|# *include *<[^>]*>|[{word}]+|[^{word}]"
    )


def _marks(files: str, defs: str) -> str:
    """CTE ``marks``: tokens with their spans and whether their family knows them; ``files`` has blobs with content and path."""
    before = "PARTITION BY blob_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
mf AS (SELECT DISTINCT blob_id, content, {_family('path')} AS family FROM {files}),
mp AS (SELECT blob_id, family, unnest(ls) AS piece, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (
        SELECT blob_id, family, CASE family WHEN 'D' THEN regexp_extract_all(content, '{_pieces("A-Za-z0-9_-")}')
            ELSE regexp_extract_all(content, '{_pieces("A-Za-z0-9_")}') END AS ls FROM mf WHERE family IS NOT NULL)),
mo AS (SELECT *, coalesce(sum(length(piece)) OVER w, 0) AS off,
          1 + coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER w, 0) AS line FROM mp WINDOW w AS ({before})),
mc AS (SELECT *, off - coalesce(max(CASE WHEN contains(piece, chr(10)) THEN off + length(piece) - length(regexp_extract(piece, '[^\n]*$')) END) OVER w, 0) AS start
       FROM mo WINDOW w AS ({before})),
kd AS (SELECT DISTINCT ident, t.f AS family FROM {defs} d JOIN (VALUES ('C', 'C'), ('C', 'K'), ('K', 'K'), ('D', 'D'), ('M', 'K')) t(f, df) ON d.family = t.df
       UNION SELECT ident, 'D' FROM {defs} d WHERE family = 'C' AND type = 'macro'),
mt AS (SELECT blob_id, family, line::INT AS line, start::INT AS start, (start + length(piece))::INT AS "end", piece,
          CASE WHEN family = 'K' THEN 'CONFIG_' || piece ELSE piece END AS ident FROM mc
       WHERE i > 1 AND i < n AND (regexp_matches(piece, '^[A-Za-z0-9_]+$') OR (family = 'D' AND regexp_matches(piece, '^[A-Za-z0-9_-]+$')))),
marks AS (SELECT mt.*, kd.ident IS NOT NULL AS known FROM mt LEFT JOIN kd ON kd.ident = mt.ident AND kd.family = mt.family)"""


PROSE = f"""
doc_f AS (SELECT source AS version, lang || '/' || CASE doc_id % 7
            WHEN 0 THEN 'f' || doc_id || '.c' WHEN 1 THEN 'f' || doc_id || '.H' WHEN 2 THEN 'Kconfig-' || doc_id
            WHEN 3 THEN 'f' || doc_id || '.dts' WHEN 4 THEN 'Makefile.' || doc_id
            WHEN 5 THEN 'Kconfig' || doc_id || '.rst' ELSE 'README' || doc_id END AS path,
            text AS content, {_git_id('text')} AS blob_id FROM documents),
doc_n AS (SELECT *, {_natkey("version || '.0'")} AS natkey FROM doc_f),
doc_b AS (SELECT blob_id, content, version AS first_version, natkey, {_base('path')} AS filename, {_family('path')} AS family
          FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY natkey, path) AS rn FROM doc_n) WHERE rn = 1),
doc_p AS (SELECT blob_id, family, CASE WHEN family = 'D' THEN regexp_extract_all(content, '{_pieces('A-Za-z0-9_-')}')
                 ELSE regexp_extract_all(content, '{_pieces('A-Za-z0-9_')}') END AS pieces
          FROM doc_b WHERE family IS NOT NULL),
doc_x AS (SELECT blob_id, family, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i, length(pieces) AS n FROM doc_p),
doc_l AS (SELECT blob_id, family, piece, i, n,
                 (1 + coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER
                    (PARTITION BY blob_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line
          FROM doc_x),
toks AS (SELECT blob_id, family, line, piece AS token FROM doc_l
         WHERE i > 1 AND i < n AND (regexp_matches(piece, '^[A-Za-z0-9_]+$') OR (family = 'D' AND regexp_matches(piece, '^[A-Za-z0-9_-]+$')))),
doc_lines AS (SELECT blob_id, family, unnest(ls) AS txt, generate_subscripts(ls, 1) AS line
              FROM (SELECT blob_id, family, string_split(content, chr(10)) AS ls FROM doc_b WHERE family IN ('C', 'D', 'K'))),
raw_defs AS (SELECT blob_id, family, line::INT AS line, regexp_extract(txt, '^([A-Z][A-Za-z0-9_]*)[,. ]', 1) AS name,
                CASE regexp_extract(txt, '^[A-Z][A-Za-z0-9_]*([,. ])', 1) WHEN ',' THEN 'variable' WHEN '.' THEN 'macro' ELSE 'function' END AS type
             FROM doc_lines WHERE regexp_matches(txt, '^[A-Z][A-Za-z0-9_]*[,. ]')),
defs AS (SELECT CASE WHEN family = 'K' THEN 'CONFIG_' || name ELSE name END AS ident, blob_id, type, line, family
         FROM raw_defs WHERE family = 'K' OR (length(name) >= 2 AND NOT (family = 'C' AND starts_with(name, 'CONFIG_')))),
cand AS (SELECT CASE WHEN family = 'K' THEN 'CONFIG_' || token ELSE token END AS ident, blob_id, line, family FROM toks
         WHERE family <> 'M' OR starts_with(token, 'CONFIG_')),
occ AS (SELECT c.* FROM cand c ANTI JOIN defs d ON d.ident = c.ident AND d.blob_id = c.blob_id AND d.line = c.line),
refs AS (SELECT * FROM occ WHERE ident IN (SELECT ident FROM defs))
"""

WEB = f"""
web_f AS (SELECT regexp_extract(u, '^[a-z]+://([^/]*)', 1) AS version,
                 regexp_replace(regexp_replace(u, '^[a-z]+://[^/]*/*', ''), '/*$', '') AS path, html AS content
          FROM (SELECT regexp_replace(url, '[?#].*$', '') AS u, html FROM pages))
"""


def _fold(expr: str) -> str:
    """Path normalisation as a fold over text."""
    return f"""ltrim(list_reduce(list_prepend('', string_split({expr}, '/')), lambda acc, p:
        CASE WHEN p IN ('', '.') THEN acc WHEN p = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || p END), '/')"""


# --- tags ----------------------------------------------------------------------


def _tags(name: str, source: str) -> str:
    """Tags of the orders in ``source`` in nine habits, then their versions."""
    y, yy, m = "year(o_orderdate)", "(year(o_orderdate) % 100)", "month(o_orderdate)"
    n = "((o_orderkey // 9) % 50)"
    rc = "(CASE WHEN o_orderstatus = 'P' THEN '-rc' || (o_orderkey % 5 + 1) ELSE '' END)"
    is_p, is_f = "o_orderstatus = 'P'", "o_orderstatus = 'F'"
    mm = f"lpad({m}::VARCHAR, 2, '0')"
    return f"""
{name}_raw AS (SELECT DISTINCT
    ['plain', 'dashed', 'shipped', 'codename', 'calendar', 'labelled', 'backwards', 'archive', 'early'][o_orderkey % 9 + 1] AS project,
    CASE o_orderkey % 9
      WHEN 0 THEN format('v{{}}.{{}}.{{}}{{}}', {yy}, {m}, {n}, {rc})
      WHEN 1 THEN format('{{}}-{{}}-{{}}', {y} % 10, {m}, {n})
      WHEN 2 THEN CASE WHEN {is_p} THEN format('{{}}.{{}}+try', {yy}, {m}) ELSE format('{{}}.{{}}.{{}}+ship', {yy}, {m}, o_orderkey % 3) END
      WHEN 3 THEN CASE WHEN {is_p} THEN format('fox-{{}}.{{}}', {yy}, {m}) WHEN {is_f} THEN format('owl-{{}}.{{}}.{{}}', {yy}, {m}, {n})
                       ELSE format('fox-{{}}.{{}}.{{}}', {yy}, {m}, {n}) END
      WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN format('{{}}w{{}}.{{}}', {y}, {mm}, {n}) ELSE format('v{{}}.{{}}{{}}', {m}, {n}, {rc}) END
      WHEN 5 THEN CASE WHEN {is_p} THEN format('draft/{{}}.{{}}', {yy}, {m}) WHEN {is_f} THEN format('L_{{}}_{{}}', {y}, {m})
                       ELSE format('v{{}}.{{}}.{{}}', {yy}, {m}, {n}) END
      WHEN 6 THEN format('v{{}}.{{}}.{{}}', {y}, {mm}, {n})
      WHEN 7 THEN CASE WHEN {is_p} THEN format('attic:{{}}:{{}}', {m}, {n}) ELSE format('v{{}}.{{}}', {m}, {n}) END
      ELSE CASE WHEN {is_p} THEN format('early:{{}}.{{}}', {yy}, {m}) WHEN {is_f} THEN format('{{}}.{{}}.{{}}', {yy}, {m}, {n})
                ELSE format('{{}}.{{}}', {yy}, {m}) END
    END AS rev FROM {source}),
{name}_v AS (SELECT project, rev, CASE project
      WHEN 'dashed' THEN translate(rev, '-.', '.-')
      WHEN 'shipped' THEN CASE WHEN suffix(rev, '+ship') THEN 'v' || left(rev, -5) END
      ELSE rev END AS version FROM {name}_raw),
{name} AS (SELECT *, {_natkey("(CASE WHEN prefix(version, 'early:') THEN substr(version, 7) || '~early' ELSE version END) || '.0'")} AS natkey,
      {_natkey('version')} AS latest_key, contains(version, '-rc') AS is_rc,
      NOT contains(version, 'draft') AS is_listed,
      CASE WHEN project = 'calendar' THEN contains(version, 'w') ELSE NOT contains(version, '-rc') END AS is_stable
      FROM {name}_v WHERE version IS NOT NULL)"""


TAGS = _tags("tags", "orders")
BOTH_TAGS = TAGS + "," + _tags("done", "(SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")


# Sections by (project, test, number, text that is split, separator, lead, fixed major, fixed minor).
_SECTIONS = [
    ("plain", "", 0, "version", ".", "", "", ""),
    ("dashed", "", 0, "version", ".", "s", "", ""),
    ("shipped", "", 0, "version", ".", "", "", ""),
    ("codename", "fox-", 0, "substr(version, 5)", ".", "", "fox", ""),
    ("codename", "owl-", 1, "substr(version, 5)", ".", "", "owl", ""),
    ("calendar", "", 0, "version", "w", "", "", ""),
    ("calendar", "v", 1, "version", ".", "", "", ""),
    ("labelled", "v", 0, "version", ".", "", "", ""),
    ("labelled", "L_", 1, "version", ".", "", "labels", "by date"),
    ("backwards", "", 0, "version", ".", "", "", ""),
    ("archive", "v", 0, "version", ".", "", "", ""),
    ("archive", "attic:", 1, "substr(version, 7)", ":", "", "attic", ""),
    ("early", "", 0, "replace(version, 'early:', '')", ".", "v", "", ""),
]


def _section(project, starts, number, text, sep, lead, major, minor) -> str:
    first, second = f"split_part({text}, '{sep}', 1)", f"split_part({text}, '{sep}', 2)"
    major = f"'{major}'" if major else f"'{lead}' || {first}"
    minor = f"'{minor}'" if minor else f"'{lead}' || {first} || '{sep}' || regexp_extract({second}, '^[0-9]*')"
    more = " AND NOT contains(version, 'v')" if (project, number) == ("calendar", 0) else ""
    return f"""SELECT project, {number} AS grp, {major} AS major, {minor} AS minor, version, natkey
        FROM tags WHERE project = '{project}' AND prefix(version, '{starts}'){more}"""


GROUPED = "grouped AS (" + " UNION ALL ".join(_section(*x) for x in _SECTIONS) + f"""
    UNION ALL SELECT DISTINCT project, 2, 'attic', 'start', 'start', {_natkey("'start.0'")} FROM tags WHERE project = 'archive')"""

LINKS = "version, path, line::INT AS line"


def oracles() -> dict[str, str]:
    code, config, prose = f"WITH {CODE}", f"WITH {CONFIG}", f"WITH {PROSE}"
    search = f"WITH {CODE}, {IDENT_QUERIES}, {SEARCH}"
    made = {
        # versions
        "versions_natural": f"WITH {TAGS} SELECT project, version, row_number() OVER (PARTITION BY project ORDER BY natkey, version) AS seq FROM tags",
        "projects": f"WITH {TAGS} SELECT DISTINCT project FROM tags",
        "versions_new": f"WITH {BOTH_TAGS} SELECT t.project, t.version, t.rev FROM tags t ANTI JOIN done d ON d.project = t.project AND d.version = t.version",
        "versions_rules": f"WITH {TAGS} SELECT project, version, is_rc, is_listed, is_stable FROM tags",
        "versions_filter": f"WITH {TAGS} SELECT project, version FROM tags WHERE regexp_matches(version, 'V.*RC|l_|ATTIC', 'i')",
        "versions_grouped": f"WITH {TAGS}, {GROUPED} SELECT project, grp, major, minor, version FROM grouped",
        "version_tree": f"WITH {BOTH_TAGS}, {GROUPED} SELECT g.project, g.grp, g.major, g.minor, g.version FROM grouped g SEMI JOIN done d ON d.project = g.project AND d.version = g.version",
        "version_tree_nodes": f"""WITH {BOTH_TAGS}, {GROUPED}
            SELECT project, major, minor, count(*) AS n_versions, arg_max(version, (natkey, version)) AS newest
            FROM grouped g SEMI JOIN done d ON d.project = g.project AND d.version = g.version GROUP BY ALL""",
        "latest_version": f"""WITH {BOTH_TAGS}, x AS (SELECT t.*, d.version IS NOT NULL AS ok FROM tags t LEFT JOIN
                (SELECT DISTINCT project, version FROM done) d ON d.project = t.project AND d.version = t.version)
            SELECT project,
                coalesce(arg_max(version, (latest_key, version)) FILTER (ok AND is_stable), arg_min(version, (latest_key, version)) FILTER (is_stable)) AS latest,
                CASE WHEN project = 'backwards'
                  THEN coalesce(arg_min(version, (natkey, version)) FILTER (ok AND is_listed), arg_max(version, (natkey, version)) FILTER (is_listed))
                  ELSE coalesce(arg_max(version, (natkey, version)) FILTER (ok AND is_listed), arg_min(version, (natkey, version)) FILTER (is_listed)) END AS latest_rc
            FROM x GROUP BY project""",
        "version_rewrite": f"WITH {TAGS} SELECT project, rev, version, rev AS rev_again FROM tags",
        "queries_resolved": f"WITH {CODE}, {IDENT_QUERIES} SELECT DISTINCT 'code' AS project, version, ident, family FROM ident_queries",
        # files
        "paths_scan": f"{code} SELECT 'code' AS project, version, path, blob_id, octet_length(encode(content)) AS size FROM paths",
        "blob_hash": f"SELECT doc_id, {_git_id('text')} AS blob_id FROM documents",
        "blob_dedup": f"{prose} SELECT 'prose' AS project, blob_id, filename, family, first_version, octet_length(encode(content)) AS size FROM doc_b",
        "blob_lookup": f"{code} SELECT 'code' AS project, blob_id, octet_length(encode(content)) AS size, content FROM blobs WHERE blob_id IN (SELECT blob_id FROM part_f UNION ALL SELECT blob_id FROM supp_f)",
        "blobs_new": f"""{code}, p AS (SELECT p.*, natkey FROM paths p JOIN vkeys USING (version))
            SELECT 'code' AS project, blob_id, {_base('arg_min(path, (natkey, path))')} AS filename, arg_min(version, (natkey, path)) AS first_version
            FROM p WHERE substr(version, 2, 4)::INT >= 2000
              AND blob_id NOT IN (SELECT blob_id FROM paths WHERE substr(version, 2, 4)::INT < 2000) GROUP BY blob_id""",
        "new_blobs_per_version": f"""{code}, f AS (SELECT blob_id, arg_min(version, natkey) AS version FROM paths JOIN vkeys USING (version) GROUP BY blob_id)
            SELECT 'code' AS project, version, count(*) AS new_blobs FROM f GROUP BY version""",
        "file_raw": f"{code}, {PATH_QUERIES} SELECT p.version, p.path, p.content FROM paths p JOIN path_queries q ON q.version = p.version AND trim(q.path, '/') = p.path",
        "dir_listing": f"""{code}, {DIRS}
            SELECT version, {_dir('path')} AS dir, 'blob' AS kind, {_base('path')} AS name, octet_length(encode(content)) AS size, '100644' AS perm FROM paths
            UNION ALL SELECT version, {_dir('dir')}, 'tree', {_base('dir')}, NULL, '040000' FROM dirs WHERE dir <> ''""",
        "dir_listing_asked": f"""{code}, {DIRS}, {PATH_QUERIES}, asked AS (SELECT DISTINCT version, trim(path, '/') AS dir FROM path_queries), every AS (
            SELECT version, {_dir('path')} AS dir, 'blob' AS kind, {_base('path')} AS name, octet_length(encode(content)) AS size, '100644' AS perm FROM paths
            UNION ALL SELECT version, {_dir('dir')}, 'tree', {_base('dir')}, NULL, '040000' FROM dirs WHERE dir <> '')
            SELECT * FROM every SEMI JOIN asked USING (version, dir)""",
        "directory_nodes": f"""{code}, {DIRS}, held AS (
                SELECT version, {_dir('path')} AS dir, {_base('path')} AS name, blob_id AS child FROM paths),
            leaves AS (SELECT version, dir, string_agg(name || ' ' || child, chr(10) ORDER BY name) AS content FROM held GROUP BY ALL),
            under AS (SELECT d.version, d.dir, string_agg(substr(l.dir, length(d.dir) + 1) || chr(9) || l.content, chr(12) ORDER BY l.dir) AS content,
                    (SELECT count(*) FROM held h WHERE h.version = d.version AND h.dir = d.dir)
                    + (SELECT count(*) FROM dirs s WHERE s.version = d.version AND s.dir <> '' AND {_dir('s.dir')} = d.dir) AS n_entries,
                    least((SELECT min(name) FROM held h WHERE h.version = d.version AND h.dir = d.dir),
                          (SELECT min({_base('s.dir')}) FROM dirs s WHERE s.version = d.version AND s.dir <> '' AND {_dir('s.dir')} = d.dir)) AS first_name
                FROM dirs d JOIN leaves l ON l.version = d.version AND (d.dir = '' OR l.dir = d.dir OR starts_with(l.dir, d.dir || '/')) GROUP BY d.version, d.dir)
            SELECT count(*) AS n_places, min(dir) AS first_dir, any_value(n_entries) AS n_entries, any_value(first_name) AS first_name FROM under GROUP BY md5(content)""",
        "path_type": f"""{code}, {DIRS}, {PATH_QUERIES}
            SELECT q.version, q.path, CASE WHEN p.path IS NOT NULL THEN 'blob' WHEN d.dir IS NOT NULL THEN 'tree' END AS type
            FROM path_queries q LEFT JOIN paths p ON p.version = q.version AND p.path = trim(q.path, '/')
                 LEFT JOIN dirs d ON d.version = q.version AND d.dir = trim(q.path, '/')""",
        "path_exists": f"""{code}, {DIRS}, {PATH_QUERIES} SELECT q.version, q.path FROM path_queries q SEMI JOIN
            (SELECT version, path FROM paths UNION ALL SELECT version, dir FROM parents) e ON e.version = q.version AND e.path = trim(q.path, '/')""",
        "path_parts": f"{prose} SELECT path, {_dir('path')} AS dir, {_base('path')} AS base, {_stem('path')} AS stem, {_ext('path')} AS ext FROM doc_f",
        "path_ancestors": f"{code}, {DIRS} SELECT version, dir FROM dirs",
        "path_normalize": f"""WITH {WEB}, h AS (SELECT path, unnest(regexp_extract_all(content, 'href="([^"]*)"', 1)) AS href FROM web_f)
            SELECT DISTINCT path, href, {_fold(f"(CASE WHEN starts_with(href, '/') THEN href ELSE {_dir('path')} || '/' || href END)")} AS target,
            {_fold("(path || '/.././../' || href)")} AS above FROM h""",
        "family_counts": f"WITH {PROSE} SELECT {_family('path')} AS family, count(*) AS n_files FROM doc_f GROUP BY 1",
        # tokens
        "tokens": f"{prose} SELECT family, token, count(*) AS n FROM toks GROUP BY ALL",
        "tokens_by_line": f"{prose} SELECT blob_id, line, count(*) AS n_tokens FROM toks GROUP BY ALL",
        "tokens_dts": f"""WITH {PROSE}, {CONFIG.replace('defs AS', 'defs_c AS').replace('refs AS', 'refs_c AS').split('asked AS')[0].rstrip().rstrip(',')}
            SELECT 'prose' AS project, token, count(*) AS n FROM toks WHERE family = 'D' GROUP BY ALL
            UNION ALL SELECT 'config', token, count(*) FROM (
                SELECT 'node_' || n || '_' || c AS token FROM dts UNION ALL SELECT 'VENDOR' || n || '_' || c FROM dts
                UNION ALL SELECT unnest(['include', 'node', 'reg']) FROM dts
                UNION ALL SELECT 'compatible' FROM sup) GROUP BY token""",
        "token_lines": f"""{code} SELECT blob_id, token, line::INT AS line, count(*) AS n FROM (
                SELECT blob_id, unnest(['int', 'order_' || k, 'void']) AS token, 4 AS line FROM order_b
                UNION ALL SELECT blob_id, unnest(['return', (k % 100)::VARCHAR]), 6 FROM order_b
                UNION ALL SELECT blob_id, 'include', 1 FROM item_b
                UNION ALL SELECT blob_id, unnest(['int', 'item_' || pk || '_' || ln, 'void']), 4 FROM item_b
                UNION ALL SELECT blob_id, unnest(['use', 'part_' || pk, 'part_' || pk]), 5 + i FROM item_b, unnest(range(1, ln + 1)) AS t(i)
                UNION ALL SELECT blob_id, unnest(['define', 'part_' || p_partkey, p_size::VARCHAR]), row_number() OVER (PARTITION BY chunk ORDER BY p_partkey)
                    FROM part JOIN part_b ON p_partkey // 64 = chunk WHERE chunk IN (SELECT chunk FROM part_f)
                UNION ALL SELECT blob_id, unnest(CASE WHEN r = 1 THEN ['int', 'supp_' || s_suppkey] ELSE ['extern', 'int', 'supp_' || s_suppkey] END), r
                    FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY s_suppkey) AS r FROM supplier JOIN supp_b ON s_suppkey // 100 = chunk
                          WHERE chunk IN (SELECT chunk FROM supp_f))) GROUP BY ALL""",
        "masked_tokens": f"""{code} SELECT token, count(*) AS n FROM (
                SELECT unnest(['int', 'order_' || k, 'void', 'return', (k % 100)::VARCHAR]) AS token FROM order_b
                UNION ALL SELECT unnest(['include', 'int', 'item_' || pk || '_' || ln, 'void']) FROM item_b
                UNION ALL SELECT unnest(['use', 'part_' || pk, 'part_' || pk]) FROM item_b, unnest(range(1, ln + 1)) AS t(i)
                UNION ALL SELECT unnest(['define', 'part_' || p_partkey, p_size::VARCHAR]) FROM part WHERE p_partkey // 64 IN (SELECT chunk FROM part_f)
                UNION ALL SELECT unnest(CASE WHEN s_suppkey % 100 = 0 THEN ['int', 'supp_' || s_suppkey] ELSE ['extern', 'int', 'supp_' || s_suppkey] END)
                    FROM supplier WHERE s_suppkey // 100 IN (SELECT chunk FROM supp_f)) GROUP BY token""",
        # definitions
        "defs_extract": f"{code} SELECT 'code' AS project, ident, blob_id, type, line, 'C' AS family FROM defs",
        "defs_extract_config": f"{config} SELECT 'config' AS project, ident, blob_id, type, line, family FROM defs",
        "defs_old_style": f"""WITH f AS (SELECT p_partkey AS k, 'int take_' || p_partkey || '(size, name)' || chr(10) || 'int size;' || chr(10) || 'char *name;' || chr(10)
                    || '{{' || chr(10) || chr(9) || 'return size;' || chr(10) || '}}' || chr(10) || CASE WHEN p_size % 2 = 0
                    THEN 'put_' || p_partkey || '(n)' || chr(10) || 'long n;' || chr(10) || '{{' || chr(10) || '}}' || chr(10) ELSE '' END
                    || 'int told_' || p_partkey || '(int size);' || chr(10) || 'int kept_' || p_partkey || ';' || chr(10) AS content,
                CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END AS more, p_size FROM part),
            b AS (SELECT *, {_git_id('content')} AS blob_id FROM f)
            SELECT 'old' AS project, x.ident, blob_id, x.type, x.line, 'C' AS family FROM b, unnest([
                {{'ident': 'take_' || k, 'type': 'function', 'line': 1}}, {{'ident': 'put_' || k, 'type': 'function', 'line': 7}},
                {{'ident': 'told_' || k, 'type': 'prototype', 'line': 7 + more}}, {{'ident': 'kept_' || k, 'type': 'variable', 'line': 8 + more}}]) AS t(x)
            WHERE more > 0 OR NOT starts_with(x.ident, 'put_')""",
        "defs_extract_prose": f"{prose} SELECT 'prose' AS project, ident, blob_id, type, line, family FROM defs",
        "defs_stop_filtered": f"""{prose} SELECT 'prose' AS project, ident, blob_id, type, line, family FROM defs
            WHERE ident NOT IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) FROM benchmark)""",
        "def_postings": f"{prose} SELECT ident, blob_id, family, string_agg(line || ':' || type, ',' ORDER BY line, type) AS postings FROM defs GROUP BY ALL",
        "ident_families": f"{config} SELECT 'config' AS project, ident, family, bool_or(type = 'macro') AS is_macro FROM defs GROUP BY ALL",
        "ident_macro_families": f"""{prose} SELECT 'prose' AS project, ident, string_agg(DISTINCT family, ',' ORDER BY family) AS families,
            coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (type = 'macro'), '') AS macro_families FROM defs GROUP BY ident""",
        "defs_cache": f"""{prose} SELECT DISTINCT 'prose' AS project, ident, unnest(CASE family WHEN 'C' THEN CASE WHEN type = 'macro' THEN ['C', 'D'] ELSE ['C'] END
            WHEN 'D' THEN ['D'] ELSE ['C', 'K', 'M'] END) AS family FROM defs""",
        "defs_first_path": f"{code} SELECT p.version, p.path, d.ident, d.type, d.line FROM defs d JOIN first_paths p USING (blob_id)",
        # references
        "refs": f"{code} SELECT 'code' AS project, ident, blob_id, 'C' AS family, line FROM refs",
        "refs_prose": f"{prose} SELECT 'prose' AS project, ident, blob_id, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines, family FROM refs GROUP BY ALL",
        "refs_config": f"{config} SELECT 'config' AS project, ident, blob_id, family, line FROM refs",
        "refs_excluding_defs": f"{prose} SELECT DISTINCT r.ident, r.blob_id, r.line FROM refs r SEMI JOIN defs d ON d.ident = r.ident AND d.blob_id = r.blob_id",
        "refs_as_of": f"""{prose}, since AS (SELECT ident, min(natkey) AS since FROM defs JOIN doc_b USING (blob_id) GROUP BY ident)
            SELECT o.ident, o.blob_id, count(*) AS n FROM occ o JOIN doc_b b USING (blob_id) JOIN since s ON s.ident = o.ident WHERE since <= b.natkey GROUP BY ALL""",
        "ref_line_lists": f"{code} SELECT ident, blob_id, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines, sum(line)::BIGINT AS line_sum FROM refs GROUP BY ALL",
        "index_stats_code": f"""{code} SELECT 'code' AS project, 'versions' AS what, count(*) AS n FROM vkeys UNION ALL SELECT 'code', 'blobs', count(*) FROM blobs
            UNION ALL SELECT 'code', 'definitions', count(DISTINCT ident) FROM defs UNION ALL SELECT 'code', 'references', count(DISTINCT ident) FROM refs""",
        # documentation
        "docs": f"{code} SELECT 'code' AS project, ident, blob_id, line, 'C' AS family FROM docs",
        "docs_first": f"{code} SELECT ident, blob_id, 'C' AS family, max(line) AS line FROM docs GROUP BY ALL",
        # compatible strings
        "comps": f"{config} SELECT 'config' AS project, ident, blob_id, family, line FROM comps",
        "comp_docs": f"{config} SELECT 'config' AS project, ident, blob_id, family, line FROM comp_docs",
        "quote": f"""{config} SELECT DISTINCT project, replace(url_encode(ident), '%2F', '/') AS quoted, ident AS unquoted FROM (
            SELECT 'config' AS project, ident FROM comps UNION ALL SELECT 'talk', text FROM conversations)""",
        "search_compatible": f"""{config} SELECT 'config' AS project, q.version, q.ident, 'B' AS family,
                CASE c.family WHEN 'C' THEN 'code' WHEN 'D' THEN 'dts' ELSE 'documentations' END AS section,
                CASE c.family WHEN 'C' THEN 'compatible' END AS type, p.path, string_agg(c.line::VARCHAR, ',' ORDER BY c.line) AS lines
            FROM (SELECT * FROM asked WHERE family = 'B') q JOIN (SELECT * FROM comps UNION ALL SELECT * FROM comp_docs) c USING (ident)
                 JOIN paths p ON p.version = q.version AND p.blob_id = c.blob_id GROUP BY ALL""",
        # lookups
        "search_ident": f"{search} SELECT 'code' AS project, version, ident, family, section, type, path, lines FROM found",
        "search_ident_config": f"{config} SELECT 'config' AS project, version, ident, family, section, type, path, lines FROM found",
        "ident_exists": f"""WITH {CODE}, {IDENT_QUERIES} SELECT 'code' AS project, version, ident, family,
            ident IN (SELECT ident FROM defs) AS symbol_exists, version IN (SELECT version FROM vkeys) AS version_indexed FROM asked""",
        "ident_defs_by_family": f"{config} SELECT family, type, count(*) AS n FROM found WHERE section = 'definitions' GROUP BY ALL",
        "ident_refs_by_family": f"""{config} SELECT requested, ident, count(*) AS n FROM refs JOIN (VALUES ('A', 'C'), ('A', 'D'), ('A', 'K'), ('A', 'M'),
            ('C', 'C'), ('D', 'D'), ('K', 'C'), ('K', 'K'), ('K', 'M')) AS t(requested, family) USING (family) GROUP BY ALL""",
        "defs_by_type": f"{search} SELECT 'code' AS project, version, ident, family, type, count(*) AS n_rows, count(DISTINCT path) AS n_files FROM found WHERE section = 'definitions' GROUP BY ALL",
        "result_summary": f"""{search} SELECT 'code' AS project, version, ident, family, section, type, path, n_rows, n_lines::BIGINT AS n_lines,
            lines, CASE WHEN n_rows <= 3 THEN lines END AS shown_lines FROM (SELECT *, count(*) OVER (PARTITION BY version, ident, family, section) AS n_rows FROM found)""",
        "queries_validated": """WITH w AS (SELECT DISTINCT role AS version, unnest(regexp_split_to_array(text, '[ \\n]+')) AS ident FROM conversations)
            SELECT 'code' AS project, version, ident, 'C' AS family, regexp_matches(ident, '^[A-Za-z0-9_,.+?#-]+$') AS accepted,
            CASE WHEN NOT regexp_matches(ident, '^[A-Za-z0-9_,.+?#-]+$') THEN 'ident' END AS rejected_for FROM w""",
        "autocomplete": f"""{code}, asked AS (SELECT DISTINCT unnest(['order_' || o_orderkey, 'part_' || substr(o_orderkey::VARCHAR, 1, 2),
                'supp_', 'item_1', 'zz' || o_orderkey]) AS prefix FROM orders),
            names AS (SELECT DISTINCT ident FROM defs),
            cut AS (SELECT ident, substr(ident, 1, i) AS prefix FROM names, unnest(range(1, 30)) AS t(i) WHERE i <= length(ident)),
            ranked AS (SELECT prefix, ident, row_number() OVER (PARTITION BY prefix ORDER BY ident) AS rank FROM cut)
            SELECT 'code' AS project, prefix, 'C' AS family, rank::INT AS rank, ident FROM ranked SEMI JOIN asked USING (prefix) WHERE rank <= 10""",
        "autocomplete_compatible": f"""{config}, ranked AS (SELECT DISTINCT 'vendor' || n || ',' AS prefix, ident, dense_rank() OVER (PARTITION BY n ORDER BY ident) AS rank
                FROM nat JOIN comps ON starts_with(ident, 'vendor' || n || ','))
            SELECT 'config' AS project, prefix, 'B' AS family, rank::INT AS rank, ident FROM ranked WHERE rank <= 10""",
        # links
        "links_comp_code": f"{config} SELECT p.version, p.path, line, 'comp_code' AS rule, ident AS text, 'ident B' AS target_kind, ident AS target FROM comps JOIN paths p USING (blob_id) WHERE family = 'C'",
        "links_comp_dts": f"{config} SELECT p.version, p.path, line, 'comp_dts' AS rule, ident AS text, 'ident B' AS target_kind, ident AS target FROM comps JOIN paths p USING (blob_id) WHERE family = 'D'",
        "links_comp_docs": f"{config} SELECT p.version, p.path, line, 'comp_docs' AS rule, ident AS text, 'ident B' AS target_kind, ident AS target FROM comp_docs JOIN paths p USING (blob_id)",
        "links_include": f"""{code} SELECT version, path, 1 AS line, 'include' AS rule, '../../../include/part_' || (pk // 64) || '.h' AS text, 'path' AS target_kind,
            'include/part_' || (pk // 64) || '.h' AS target FROM item_f""",
        "links_resolved": f"""{code} SELECT i.version, i.path, 1 AS line, 'nearest' AS rule, '../../../include/part_' || (pk // 64) || '.h' AS text, 'path' AS target_kind, p.path AS target
            FROM item_f i JOIN part_f p ON p.version = i.version AND p.chunk = pk // 64 WHERE (k % 7) % 2 = 0""",
        "links_sysinclude": f"""{code} SELECT i.version, i.path, 2 AS line, 'sysinclude' AS rule, 'part_' || (pk // 64) || '.h' AS text, 'path' AS target_kind, p.path AS target
            FROM item_f i JOIN part_f p ON p.version = i.version AND p.chunk = pk // 64 WHERE ln % 2 = 0""",
        "links_defconfig": f"""{config} SELECT version, path, 1 AS line, 'defconfig' AS rule, 'CONFIG_NATION_' || n AS text, 'ident K' AS target_kind, 'CONFIG_NATION_' || n AS target FROM defconfig
            UNION ALL SELECT version, path, 2, 'defconfig', 'CONFIG_ABSENT', 'ident K', 'CONFIG_ABSENT' FROM defconfig""",
        "ingest_blobs": f"{config} SELECT version, path, {_git_id('content')} AS blob_id, octet_length(encode(content)) AS size FROM all_files",
        "link_rules": f"""{config} SELECT 'config' AS project, p.version, p.path, line, CASE family WHEN 'C' THEN 'comp_code' ELSE 'comp_dts' END AS rule,
                ident AS text, 'ident B' AS target_kind, ident AS target FROM comps JOIN paths p USING (blob_id) WHERE family IN ('C', 'D')
            UNION ALL SELECT 'config', version, path, x.line, 'defconfig', x.name, 'ident K', x.name FROM defconfig,
                unnest([{{'line': 1, 'name': 'CONFIG_NATION_' || n}}, {{'line': 2, 'name': 'CONFIG_ABSENT'}}]) AS t(x)
            UNION ALL SELECT 'bare', version, path, 1, 'dtsi', 'common_' || n || '.dtsi', 'path', dir || '/common_' || n || '.dtsi' FROM dts""",
        "links_config_in": f"""{config} SELECT version, path, 1 AS line, 'config_in' AS rule, dir || '/Kconfig' AS text, 'path' AS target_kind, dir || '/Kconfig' AS target FROM config_in
            UNION ALL SELECT version, path, 2, 'config_in', dir || '/none.in', 'path', dir || '/none.in' FROM config_in""",
        "links_kconfig": f"{config} SELECT version, path, 4 AS line, 'kconfig' AS rule, dir || '/sub/Makefile' AS text, 'path' AS target_kind, dir || '/sub/Makefile' AS target FROM kconfig",
        "links_kconfig_idents": f"""{config} SELECT version, path, unnest([1, 3])::INT AS line, 'NATION_' || n AS text, 'ident K' AS target_kind, 'CONFIG_NATION_' || n AS target FROM kconfig
            UNION ALL SELECT version, path, 1, 'CONFIG_NATION_' || n, 'ident K', 'CONFIG_NATION_' || n FROM makefile
            UNION ALL SELECT version, path, 3, 'CONFIG_NATION_' || n, 'ident K', 'CONFIG_NATION_' || n FROM code""",
        "links_idents": f"""{config} SELECT version, path, 2 AS line, 'VENDOR' || n || '_' || c AS text, 'ident C' AS target_kind, 'VENDOR' || n || '_' || c AS target FROM code
            UNION ALL SELECT version, path, 2, 'node_' || n || '_' || c, 'ident D', 'node_' || n || '_' || c FROM dts
            UNION ALL SELECT version, path, (3 + m)::INT, 'VENDOR' || n || '_' || c, 'ident D', 'VENDOR' || n || '_' || c FROM dts""",
        "links_dtsi": f"{config} SELECT version, path, 1 AS line, 'dtsi' AS rule, 'common_' || n || '.dtsi' AS text, 'path' AS target_kind, dir || '/common_' || n || '.dtsi' AS target FROM dts",
        "links_make_dir": f"{config} SELECT version, path, 2 AS line, 'make_dir' AS rule, 'sub' AS text, 'path' AS target_kind, dir || '/sub/Makefile' AS target FROM makefile",
        "links_make_dtb": f"{config} SELECT version, path, 5 AS line, 'make_dtb' AS rule, 'board_' || n AS text, 'path' AS target_kind, dir || '/board_' || n || '.dts' AS target FROM makefile",
        "links_make_file": f"{config} SELECT version, path, 8 AS line, 'make_file' AS rule, 'sub/Makefile' AS text, 'path' AS target_kind, dir || '/sub/Makefile' AS target FROM makefile",
        "links_make_o": f"""{config} SELECT version, path, 1 AS line, 'make_o' AS rule, 'nation_' || n AS text, 'path' AS target_kind, dir || '/nation_' || n || '.c' AS target FROM makefile
            UNION ALL SELECT version, path, 1, 'make_o', 'leaf', 'path', dir || '/sub/leaf.c' FROM sub""",
        "links_make_srctree": f"{config} SELECT version, path, 6 AS line, 'make_srctree' AS rule, dir || '/Kconfig' AS text, 'path' AS target_kind, dir || '/Kconfig' AS target FROM makefile",
        "links_make_subdir": f"{config} SELECT version, path, 4 AS line, 'make_subdir' AS rule, 'doc' AS text, 'path' AS target_kind, dir || '/doc/Makefile' AS target FROM makefile",
        "links_html": f"""WITH {WEB}, l AS (SELECT version, path, unnest(ls) AS txt, generate_subscripts(ls, 1) AS line
                FROM (SELECT version, path, string_split(content, chr(10)) AS ls FROM web_f)),
            h AS (SELECT version, path, line::INT AS line, unnest(regexp_extract_all(txt, 'href="(/[^"]*)"', 1)) AS text FROM l),
            t AS (SELECT *, {_fold('text')} AS target FROM h),
            e AS (SELECT version, path AS target FROM web_f UNION SELECT version, {_dir('path')} FROM web_f)
            SELECT t.*, e.target IS NOT NULL AS target_exists FROM t LEFT JOIN e ON e.version = t.version AND e.target = t.target""",
    }
    trees = (("code", CODE, "paths", "(SELECT *, 'C' AS family FROM defs)"), ("config", CONFIG, "(SELECT * FROM all_files JOIN loc USING (path, version))", "defs"))
    made["marked_tokens"] = " UNION ALL ".join(
        f"""(WITH {tree}, {_marks(files, defs)} SELECT '{project}' AS project, blob_id, family, line, start, "end", ident, known FROM marks)"""
        for project, tree, files, defs in trees
    )
    made["marked_file"] = " UNION ALL ".join(
        f"""(WITH {tree}, {_marks(files, defs)}, placed AS (
                SELECT DISTINCT version, path, blob_id FROM paths),
            rows AS (SELECT version, path, line, start, "end", piece AS text, known FROM placed JOIN marks USING (blob_id)
                UNION ALL SELECT version, path, NULL, NULL, NULL, content, false FROM placed JOIN mf USING (blob_id) WHERE family IS NULL)
            SELECT '{project}' AS project, version, path, count(*) AS n_tokens, count(*) FILTER (known) AS n_known,
                sum(line::BIGINT * 1000000 + start * 1000 + "end")::BIGINT AS spots, sum(length(text))::BIGINT AS chars,
                min(text) AS first_text, max(text) AS last_text FROM rows GROUP BY ALL)"""
        for project, tree, files, defs in trees
    )
    order = "type DESC NULLS LAST, path, CASE WHEN section = 'definitions' THEN lines::INT END"
    made["search_ident_ranked"] = f"""SELECT *, row_number() OVER (PARTITION BY version, ident, family, section ORDER BY {order}) AS rank FROM ({made["search_ident"]})"""
    made["search_compatible_ranked"] = f"""SELECT *, row_number() OVER (PARTITION BY version, ident, family, section ORDER BY path) AS rank FROM ({made["search_compatible"]})"""
    made["search_ident_json"] = f"""WITH q AS ({config} SELECT version, ident, family FROM asked),
        r AS (SELECT * FROM ({made["search_ident_config"]}) UNION ALL BY NAME SELECT * FROM ({made["search_compatible"]})),
        i AS (SELECT version, ident, family, CASE section WHEN 'code' THEN 'definitions' WHEN 'dts' THEN 'references' ELSE section END AS part,
                CASE section WHEN 'code' THEN 1 WHEN 'definitions' THEN 1 WHEN 'documentations' THEN 3 ELSE 2 END AS k,
                row_number() OVER (PARTITION BY version, ident, family, section ORDER BY {order}) AS n,
                '{{"path":"' || path || '","line":' || CASE section WHEN 'definitions' THEN lines ELSE '"' || lines || '"' END
                    || ',"type":' || coalesce('"' || type || '"', 'null') || '}}' AS item FROM r),
        b AS (SELECT *, coalesce(sum(length(item) + 1) OVER (PARTITION BY version, ident, family ORDER BY k, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 200 AS piece FROM i),
        t AS (SELECT version, ident, family, piece, {", ".join(f"coalesce(string_agg(item, ',' ORDER BY n) FILTER (part = '{x}'), '') AS {x}" for x in ("definitions", "references", "documentations")).replace(" AS references", " AS refs")} FROM b GROUP BY ALL)
        SELECT 'config' AS project, q.version, q.ident, q.family, coalesce(piece, 0) AS piece,
            '{{"definitions":[' || coalesce(definitions, '') || '],"references":[' || coalesce(refs, '') || '],"documentations":[' || coalesce(documentations, '') || ']}}' AS json
        FROM q LEFT JOIN t ON t.version = q.version AND t.ident = q.ident AND t.family = q.family"""
    return made
