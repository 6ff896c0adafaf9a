"""DuckDB SQL for the queries that SQL can express."""

#: A-Z to a-z only, as DuckDB says it.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256 FROM d JOIN g USING (t)""",
    "op11_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS own FROM d),
        sets AS (SELECT min(doc_id) AS one, len(own) AS n, own, list(doc_id) AS ids FROM s WHERE len(own) > 0 GROUP BY list_sort(own), own),
        each AS (SELECT one, n, unnest(own) AS x FROM sets),
        twins AS (SELECT a.one AS u, b.one AS v FROM each a JOIN each b ON a.x = b.x AND a.one < b.one AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
            GROUP BY a.one, b.one, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        links AS (SELECT u, v FROM twins UNION SELECT v, u FROM twins),
        reach AS (SELECT one AS node, one AS root FROM sets UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node),
        roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
        named AS (SELECT unnest(ids) AS doc_id, root FROM sets JOIN roots ON one = node)
        SELECT s.doc_id, len(own) AS n_shingles, coalesce(root, s.doc_id) AS component_id, coalesce(root, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN named USING (doc_id)""",
    "op12_ranked": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_TERM}') AS w FROM documents),
        size AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0),
        whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
        tf AS (SELECT doc_id, x, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY ALL),
        weight AS (SELECT x, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY x, docs),
        asked AS (SELECT item_id, x, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_FOLD}, '{_TERM}')) AS x FROM benchmark) GROUP BY ALL),
        m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM size, whole),
        scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM asked JOIN weight USING (x) JOIN tf USING (x) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
        SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scored
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20""",
    "op13_prefix_trie": """
        WITH RECURSIVE bytes AS (SELECT conv_id, cast(conv_id AS VARCHAR) AS id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
        crc AS (SELECT conv_id, id, 0 AS i, 4294967295::BIGINT AS c FROM bytes UNION ALL
            SELECT conv_id, id, i + 1, list_reduce([xor(c, ascii(id[i + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) FROM crc WHERE i < length(id)),
        h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE i = length(id)),
        own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
        again AS (SELECT h.conv_id, 0 AS part, place, role, text FROM h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.place <= h.h
            UNION ALL SELECT conv_id, 1, place, role, text FROM own JOIN h USING (conv_id) WHERE place > h),
        turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text FROM again),
        walk AS (SELECT conv_id, 0 AS depth, '' AS node, NULL::VARCHAR AS parent, 0 AS size FROM h UNION ALL
            SELECT w.conv_id, t.depth, sha256(w.node || sha256(t.text) || t.role), w.node, strlen(t.text) FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.depth = w.depth + 1),
        ends AS (SELECT arg_max(node, depth) AS node, conv_id FROM walk GROUP BY conv_id),
        lists AS (SELECT node, sha256(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY node),
        nodes AS (SELECT node, depth, parent, size, count(*) AS n_convs, min(conv_id) AS conv_id FROM walk GROUP BY ALL),
        children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
        up AS (SELECT node AS top, node AS here FROM nodes UNION ALL SELECT u.top, n.node FROM up u JOIN nodes n ON n.parent = u.here),
        sums AS (SELECT top AS node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM up JOIN nodes n ON n.node = up.here LEFT JOIN children c ON c.node = up.here GROUP BY top)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node LEFT JOIN lists l ON l.node = n.node JOIN sums s ON s.node = n.node""",
}
