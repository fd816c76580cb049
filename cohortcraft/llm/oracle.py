"""DuckDB SQL of the registered queries that SQL can express; the others are tested against brute force."""

#: CRC-32 of a decimal number's text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                       lambda c, bit: xor(c // 2, 3988292384::UBIGINT * (c % 2)))))"""

OP7 = """
    WITH p AS (
        SELECT page_id, sha1(coalesce(html, '')) AS payload_digest,
               CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
        FROM pages),
    w AS (SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT p.page_id, p.payload_bytes, p.payload_digest,
           CASE WHEN w.last_id IS NOT NULL AND w.last_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN w.last_id <> p.page_id THEN w.last_id END AS refers_to
    FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND p.payload_bytes >= 1000"""

OP13 = f"""
    WITH t AS (
        SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               length(coalesce(text, '')) AS chars, turn
        FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
    c AS (SELECT DISTINCT conv_id, {_CRC32} % 6 AS h FROM t),
    r AS (SELECT c.conv_id, 0 AS own, o.pos, digest, chars FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
          UNION ALL
          SELECT c.conv_id, 1, o.pos, digest, chars FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
    d AS (SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS node
          FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
    a AS (SELECT conv_id, node, depth, chars FROM d UNION ALL SELECT conv_id, '', 0, 0 FROM c),
    e AS (SELECT conv_id, max(depth) AS last FROM a GROUP BY conv_id),
    s AS (SELECT node, min(depth) AS depth, min(a.conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
                 sha256(coalesce(string_agg(CASE WHEN depth = last THEN a.conv_id::VARCHAR END, ',' ORDER BY a.conv_id), '')) AS ends_sha256
          FROM a JOIN e ON a.conv_id = e.conv_id GROUP BY node),
    p AS (SELECT s.*, u.conv_id AS parent_conv_id, u.node AS parent
          FROM s LEFT JOIN s u ON s.depth > 0 AND u.depth = s.depth - 1 AND u.node = s.node[:-33]),
    k AS (SELECT parent, count(*) AS n FROM p WHERE parent IS NOT NULL GROUP BY parent),
    x AS (SELECT s.node AS top, v.node, (v.n_convs - 1) * v.chars AS saved, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf
          FROM (SELECT node, conv_id, generate_series AS up FROM s, generate_series(0, s.depth)) AS g
          JOIN s v ON v.node = g.node JOIN s ON s.node = g.node[:32 * g.up] LEFT JOIN k ON k.parent = v.node),
    f AS (SELECT top, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM x GROUP BY top)
    SELECT p.conv_id, CAST(p.depth AS BIGINT) AS depth, p.parent_conv_id, p.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
           CAST(f.n_leaves AS BIGINT) AS n_leaves, CAST(f.saved_tokens AS BIGINT) AS saved_tokens, p.ends_sha256
    FROM p LEFT JOIN k ON k.parent = p.node JOIN f ON f.top = p.node"""


OP11 = """
    WITH t AS (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\n-\r]')), '[ \t]+'), lambda x: x <> '') AS w
          FROM t),
    g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM p
          UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
          UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p
          UNION ALL SELECT lang, 4, unnest(list_transform(range(1, len(w) - 2), lambda i:
                                       w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) FROM p),
    c AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM c WHERE m = 1 GROUP BY lang),
    k AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE f >= 30 AND m > 1),
    h AS (SELECT *, unnest(range(1, m)) AS cut FROM k),
    i AS (SELECT *, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM h),
    s AS (SELECT i.lang, i.m, i.phrase, i.f, a.f AS l, b.f AS r, i.cut, 2000000 * i.f // (a.f + b.f) AS score
          FROM i JOIN c a ON a.lang = i.lang AND a.phrase = i.head JOIN c b ON b.lang = i.lang AND b.phrase = i.tail),
    q AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    e AS (SELECT lang, w, f, unnest([w[:2], w[2:3], w[3:], w[:3], w[2:]]) AS v FROM k),
    d AS (SELECT lang, array_to_string(v, ' ') AS phrase, max(f) AS longer FROM e WHERE len(v) > 1 AND len(v) < len(w) GROUP BY ALL)
    SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, q.f DESC, q.phrase) AS rank, q.phrase,
           q.f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM q JOIN n ON n.lang = q.lang LEFT JOIN d ON d.lang = q.lang AND d.phrase = q.phrase
    WHERE d.longer IS NULL OR 100 * d.longer < 80 * q.f
    QUALIFY rank <= 2000"""
