"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from shotweave.llm import license_scan, url_filter


def _words_sql(values: dict[str, str]) -> str:
    rows = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in values.items())
    return f"(VALUES {rows}) t(license, text)"


def license_sql(min_dice: float = license_scan.MIN_DICE) -> str:
    return f"""
WITH units AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
    UNION ALL SELECT doc_id, p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS p FROM documents) WHERE contains(p, chr(10))
    UNION ALL SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\\n[ \\t]*\\n')),
words AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM units),
grams AS (SELECT u, doc_id, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
counted AS (SELECT u, doc_id, n, g, count(*) AS c FROM grams GROUP BY ALL),
template AS (SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {_words_sql(license_scan.TEMPLATES)}),
tgrams AS (SELECT license, len(w) - 1 AS m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM template),
tcounted AS (SELECT license, m, g, count(*) AS c FROM tgrams GROUP BY ALL),
met AS (SELECT u, doc_id, license, n, m, sum(least(a.c, b.c)) AS shared FROM counted a JOIN tcounted b USING (g) GROUP BY ALL),
whole AS (SELECT row_number() OVER () AS t, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
placed AS (SELECT t, doc_id, unnest(range(1, len(w))) AS place, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM whole WHERE len(w) > 1),
hits AS (SELECT t, doc_id, license, m, c, place, g FROM placed JOIN tcounted USING (g)),
spans AS (SELECT s.t, s.doc_id, s.license, s.m, s.place AS start, x.g, least(x.c, count(*)) AS shared FROM hits s JOIN hits x ON x.t = s.t AND x.license = s.license AND x.place >= s.place AND x.place < s.place + s.m
    GROUP BY s.t, s.doc_id, s.license, s.m, s.place, x.g, x.c),
stretches AS (SELECT doc_id, license, sum(shared) / m::DOUBLE AS dice FROM spans GROUP BY t, doc_id, license, m, start)
SELECT doc_id, license, sum(unit)::BIGINT AS n_units, round(max(dice), 6) AS dice FROM (
    SELECT doc_id, license, 1 AS unit, 2 * shared / (n + m)::DOUBLE AS dice FROM met WHERE 2 * shared >= {min_dice} * (n + m)
    UNION ALL SELECT doc_id, license, 0, dice FROM stretches WHERE dice >= {min_dice}) GROUP BY doc_id, license"""


def url_sql(rules: list[url_filter.Rule]) -> str:
    host = "CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
    path = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    text = verdict = "NULL"
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        text, verdict = f"CASE WHEN {fits} THEN '{r.text}' ELSE {text} END", f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {verdict} END"

    def level(name: str, nodes: str, parents: str, key: str, parent: str) -> str:
        return f"""
{name}_j AS (SELECT x.{key}, x.bad, x.n, p.mean AS prior FROM {nodes} x JOIN {parents} p ON x.{parent} = p.{parent}),
{name}_f AS (SELECT sum(power(bad - n * prior, 2)) AS spread, sum(n * prior * (1 - prior)) AS plain, sum(n * (n - 1) * prior * (1 - prior)) AS pairs FROM {name}_j),
{name}_s AS (SELECT CASE WHEN pairs > 0 AND (spread - plain) / pairs > 0 THEN least(greatest(1 / ((spread - plain) / pairs) - 1, {url_filter.MIN_STRENGTH}), {url_filter.MAX_STRENGTH})
    ELSE {url_filter.MAX_STRENGTH} END AS strength FROM {name}_f),
{name} AS (SELECT {key}, (bad + prior * strength) / (n + strength) AS mean, n + strength AS weight FROM {name}_j, {name}_s),"""

    second = "|".join(url_filter.SECOND_LEVEL)
    return f"""
WITH marked AS (SELECT page_id, coalesce({host}, '') AS host, coalesce({path}, '') AS path FROM pages),
numbered AS (SELECT *, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:/|\\.html)?$', 1), '') AS BIGINT) AS doc FROM marked),
outcome AS (SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
hosts AS (SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n FROM numbered LEFT JOIN outcome USING (doc) GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM hosts),
suffixed AS (SELECT *, CASE WHEN regexp_matches(name, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\])$') THEN name
    ELSE coalesce(nullif(regexp_extract(name, '((?:^|\\.)((?:{second})\\.[a-z]{{2}}))$', 2), ''), split_part(name, '.', -1)) END AS suffix FROM named),
placed AS (SELECT *, CASE WHEN name = suffix THEN name ELSE split_part(left(name, length(name) - length(suffix) - 1), '.', -1) || '.' || suffix END AS domain FROM suffixed),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM placed GROUP BY ALL),
suffixes AS (SELECT suffix, '' AS root, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY ALL),
root AS (SELECT '' AS root, (coalesce(sum(bad), 0) + {url_filter.ROOT_MEAN * url_filter.ROOT_STRENGTH}) / (coalesce(sum(n), 0) + {url_filter.ROOT_STRENGTH}) AS mean FROM suffixes),
{level("by_suffix", "suffixes", "root", "suffix", "root")}{level("by_domain", "domains", "by_suffix", "domain", "suffix")}{level("by_host", "placed", "by_domain", "host", "domain")}
judged AS (SELECT host, CASE WHEN mean - {url_filter.BOUND_Z} * sqrt(mean * (1 - mean) / (weight + 1)) > {url_filter.MAX_BAD} THEN 'block' ELSE 'allow' END AS by_host FROM by_host)
SELECT page_id, host, path, {text} AS rule, coalesce({verdict}, by_host) AS verdict FROM marked JOIN judged USING (host)"""


NEAR_DUPLICATE_SQL = """
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))
        WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node AND r.root < l.y),
least_root AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_root USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII string, bit by bit."""
    step = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(acc, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT), lambda acc, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, nodes: str) -> str:
    """Levels of the trees over ``nodes`` (tree, pos, node, total) and the siblings of every node below a top."""
    return f"""
{name} AS (SELECT 0 AS level, tree, pos, node, total FROM {nodes}
    UNION ALL SELECT level + 1, tree, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (total + 2) // 3 FROM {name} WHERE total > 1 GROUP BY level, tree, pos // 3, total),
{name}_near AS (SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {name} a JOIN {name} b ON a.level = b.level AND a.tree = b.tree AND a.pos // 3 = b.pos // 3 WHERE a.total > 1 GROUP BY ALL)"""


MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT row_number() OVER () AS k, doc_id, source, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed FROM documents),
seats AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM leaves)),
placed AS (SELECT k, doc_id, leaf, changed, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS total
    FROM leaves JOIN seats ON leaves.source IS NOT DISTINCT FROM seats.source),{_tree_sql("low", "placed")},
subroots AS (SELECT tree AS pos, 0 AS tree, node, count(*) OVER () AS total FROM low WHERE total = 1),{_tree_sql("high", "subroots")},
folded AS (SELECT k, 0 AS level, tree, pos, changed AS node, '' AS proof FROM placed
    UNION ALL SELECT k, f.level + 1, tree, pos // 3, sha256(l || f.node || r), proof || l || r FROM folded f JOIN low_near USING (level, tree, pos)),
risen AS (SELECT k, 0 AS level, tree AS pos, node, proof FROM folded WHERE NOT EXISTS (FROM low_near x WHERE x.level = folded.level AND x.tree = folded.tree AND x.pos = folded.pos)
    UNION ALL SELECT k, f.level + 1, pos // 3, sha256(l || f.node || r), proof || l || r FROM risen f JOIN high_near USING (level, pos)),
ended AS (SELECT k, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM risen GROUP BY k)
SELECT doc_id, leaf, s.node AS subroot, h.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = h.node AS verified
FROM placed p JOIN ended e USING (k) JOIN subroots s ON s.pos = p.tree JOIN (SELECT node FROM high WHERE total = 1) h ON true"""


WARC_SQL = """
WITH held AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, row_number() OVER w AS k, first_value(page_id) OVER w AS least
    FROM held WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to FROM hashed"""


TRIE_SQL = f"""
WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS dg
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, dg, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(dg, 1, 15), substr(dg, 17, 15)) - 1 AS pos FROM said),
convs AS (SELECT DISTINCT conv_id, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base FROM own),
full_turns AS (SELECT c.conv_id, 0 AS part, pos, dg, words FROM convs c JOIN own o ON o.conv_id = c.base WHERE pos < h
    UNION ALL SELECT conv_id, 1, pos, dg, words FROM own JOIN convs USING (conv_id) WHERE pos >= h),
steps AS (SELECT conv_id, words, row_number() OVER w AS d, string_agg(dg, '') OVER w AS key FROM full_turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM steps),
nodes AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM ended GROUP BY d, key),
kids AS (SELECT left(key, 64 * (d::INTEGER - 1)) AS key, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
grown AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.key = n.key AND k.d = n.d),
upward AS (SELECT (n_convs - 1) * words AS save, (n_children = 0)::INTEGER AS leaf, key, unnest(range(0, d + 1)) AS up FROM grown),
sums AS (SELECT left(key, 64 * up::INTEGER) AS key, sum(leaf)::BIGINT AS n_leaves, sum(save)::BIGINT AS saved_tokens FROM upward GROUP BY ALL)
SELECT g.conv_id, g.d AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves, saved_tokens, g.ends_sha256
FROM grown g JOIN sums s ON s.key = g.key LEFT JOIN nodes p ON g.d > 0 AND p.d = g.d - 1 AND p.key = left(g.key, 64 * (g.d::INTEGER - 1))"""
