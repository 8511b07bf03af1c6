"""Check SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

# Control strings of the template add 5 characters before and 12 after a role and a text, 1 for each escape.
CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)
)
SELECT
    conv_id,
    count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<s>[INST]  [/INST]</s>') + length(role) + length(text)
        + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

CONTAMINATION = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS gram
    FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(k) WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), hits AS (
    SELECT doc_id, k, s.size, item_id
    FROM (SELECT doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS gram
          FROM words, sizes, unnest(range(1, len(w) - size + 2)) AS r(k) WHERE len(w) >= size) AS s
    JOIN windows AS b ON s.size = b.size AND s.gram = b.gram
), places AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + size)) AS r(p) GROUP BY doc_id
), owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT
    doc_id,
    len(w)::BIGINT AS n_words,
    coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

RECORDS = """
WITH sized AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), named AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
    FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM named
"""


PASSAGES = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, k, sha256(array_to_string(list_slice(w, k, k + 34), ' ')) AS gram
    FROM words, unnest(range(1, len(w) - 33)) AS r(k) WHERE len(w) >= 35
), twice AS (
    SELECT doc_id, k FROM windows WHERE gram IN (SELECT gram FROM windows GROUP BY gram HAVING count(*) > 1)
), gone AS (
    SELECT DISTINCT doc_id, p FROM twice, unnest(range(k, k + 35)) AS r(p)
), placed AS (
    SELECT doc_id, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) AS r(p)
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
    FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


# Sources in order of how soon they are full: the level of the others is the largest that any number of full ones gives.
CURRICULUM = r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
    FROM docs GROUP BY source
), weights AS (
    SELECT *, [3.0, 1.0, 2.0][kind + 1]::DOUBLE AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM sources
), levels AS (
    SELECT 1.5 * total AS words, sum(weight) OVER () AS everyone,
        sum(2.0 * source_size) OVER w AS held, sum(weight) OVER w AS full_ones
    FROM weights WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING)
), level AS (
    SELECT max(v) AS v FROM (
        SELECT words / everyone AS v FROM levels
        UNION ALL SELECT (words - held) / (everyone - full_ones) FROM levels WHERE everyone > full_ones)
), targets AS (
    SELECT source, source_size, kind, least(2.0 * source_size::DOUBLE, v * weight)::DOUBLE AS target,
        floor(least(2.0 * source_size::DOUBLE, v * weight)::DOUBLE + 0.5)::BIGINT AS goal
    FROM weights, level
), placed AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, goal, kind,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
    FROM docs AS d JOIN targets AS t ON d.source IS NOT DISTINCT FROM t.source
), timed AS (
    SELECT *, start::DOUBLE / goal * [3.0, 1.0, 2.0][kind + 1]::DOUBLE AS area,
        [1.75, 0.375, 0.875][kind + 1]::DOUBLE AS half,
        [4.0, 0.5, 1.0][kind + 1]::DOUBLE AS w0, [3.0, 1.0, 2.5][kind + 1]::DOUBLE AS w1, [2.0, 1.5, 2.0][kind + 1]::DOUBLE AS w2
    FROM placed
)
SELECT doc_id, size, source_size, target,
    (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)))::BIGINT AS taken,
    CASE WHEN least(size, goal - start) <= 0 THEN NULL
        WHEN area <= 0 THEN 0::DOUBLE
        WHEN area < half THEN 2::DOUBLE * area / (w0 + sqrt(w0 * w0 + 4::DOUBLE * (w1 - w0) * area))
        WHEN area <= half THEN 0.5::DOUBLE
        ELSE 0.5::DOUBLE + 2::DOUBLE * (area - half) / (w1 + sqrt(w1 * w1 + 4::DOUBLE * (w2 - w1) * (area - half)))
    END AS first_position
FROM timed
"""


# CRC-32 by a table of 256 entries; a path is the digest of its turns' digests, and a node's sums come from the
# suffix sums of the paths of smallest members.
TRIE = r"""
WITH crcs AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) AS r(i)
), turns AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), counts AS (
    SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
), sized AS (
    SELECT conv_id, n, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
    FROM counts, crcs
), convs AS (
    SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM sized AS c LEFT JOIN sized AS b ON b.conv_id = c.base
), built AS (
    SELECT c.conv_id, t.p AS d, r, x FROM convs AS c JOIN turns AS t ON t.conv_id = c.base AND t.p <= c.h
    UNION ALL
    SELECT c.conv_id, c.k + t.p - c.h, r, x FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.p > c.h
), paths AS (
    SELECT conv_id, d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
        md5(string_agg(md5(len(r) || ':' || r || x), '/') OVER (PARTITION BY conv_id ORDER BY d)) AS path
    FROM built
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM convs
), linked AS (
    SELECT *, max(d) OVER (PARTITION BY conv_id) AS length, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS above FROM paths
), nodes AS (
    SELECT path, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(above) AS above, count(*) AS n_convs,
        (count(*) - 1) * any_value(words) AS saved, (max(length) = any_value(d))::BIGINT AS leaf,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = length), '')) AS ends_sha256
    FROM linked GROUP BY path
), suffixes AS (
    SELECT l.path, sum(coalesce(n.saved, 0)) OVER w AS saved, sum(coalesce(n.leaf, 0)) OVER w AS leaves
    FROM linked AS l LEFT JOIN nodes AS n ON n.path = l.path AND n.conv_id = l.conv_id
    WINDOW w AS (PARTITION BY l.conv_id ORDER BY l.d DESC)
), sums AS (
    SELECT path, sum(saved) AS saved, sum(leaves) AS leaves FROM suffixes GROUP BY path
), children AS (
    SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
    coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums AS s USING (path) LEFT JOIN children AS c ON c.above = n.path LEFT JOIN nodes AS p ON p.path = n.above
"""


def all_sql() -> dict[str, str]:
    return {
        "op3_chat_formats": CHATS,
        "op4_contamination": CONTAMINATION,
        "op5_warc_records": RECORDS,
        "op9_repeated_passages": PASSAGES,
        "op11_curriculum": CURRICULUM,
        "op13_prefix_trie": TRIE,
    }
