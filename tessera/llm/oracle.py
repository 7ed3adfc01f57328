"""DuckDB SQL that must return the same rows as the query of the same name."""

from __future__ import annotations

OP1 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

_AUTHORITY = r"split_part(split_part(split_part(split_part(substr(url, strpos(url, '://') + 3), '/', 1), '\', 1), '?', 1), '#', 1)"
_LAST = f"split_part({_AUTHORITY}, '@', -1)"
_HOST = (
    r"CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN nullif(rtrim(lower("
    rf"CASE WHEN starts_with({_LAST}, '[') THEN CASE WHEN contains({_LAST}, ']') THEN split_part({_LAST}, ']', 1) || ']' ELSE '' END ELSE split_part({_LAST}, ':', 1) END), '.'), '') END"
)
OP5 = (
    r"""
WITH h AS (SELECT DISTINCT {host} AS host FROM pages),
g AS (SELECT host, list_transform(range(6), lambda k: ('0x' || substr(md5(host), 2 * k::INT + 1, 2))::INT) AS d FROM h WHERE host IS NOT NULL),
n AS (SELECT host, d, 'list-' || (d[1] % 4)::VARCHAR AS list_name, CASE WHEN d[2] < 128 THEN 'block' ELSE 'allow' END AS action,
             CASE WHEN d[2] < 128 THEN 'allow' ELSE 'block' END AS other FROM g),
t AS (
  SELECT list_name, action, host AS pattern, 'add' AS change, d[3] AS n FROM n
  UNION SELECT list_name, action, host, 'remove', d[3] + d[4] % 90 FROM n WHERE d[4] < 128
  UNION SELECT list_name, action, host, 'add', d[3] + d[4] % 90 + 1 + d[5] % 60 FROM n WHERE d[4] < 64
  UNION SELECT list_name, action, host, 'remove', d[3] FROM n WHERE d[4] >= 250
  UNION SELECT 'paths', other, host || '/' || substr('defresen', 1 + 2 * (d[6] % 4), 2), 'add', d[6] FROM n WHERE d[5] < 128
  UNION SELECT 'domains', 'block', regexp_extract(host, '([^.]*\.)?[^.]*$'), 'add', 300 FROM n),
intervals AS (
  SELECT * FROM (
    SELECT list_name, action, pattern, change, (DATE '2024-01-01' + n)::DATE AS a,
           lead((DATE '2024-01-01' + n)::DATE) OVER (PARTITION BY list_name, action, pattern ORDER BY n, change) AS b
    FROM t)
  WHERE change = 'add' AND (b IS NULL OR b > a)),
p AS (
  SELECT page_id, url, (DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INT))::DATE AS fetched_at, {host} AS host,
         lower(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]*[/\\]([^?#]*)', 1), '\', '/')) AS path
  FROM pages),
hit AS (
  SELECT p.url, p.fetched_at, i.*,
         row_number() OVER (PARTITION BY p.url, p.fetched_at ORDER BY length(pattern) DESC, action, list_name, pattern) AS rank,
         count(*) OVER (PARTITION BY p.url, p.fetched_at) AS n
  FROM (SELECT DISTINCT url, fetched_at, host, path FROM p) p JOIN intervals i
    ON i.a <= p.fetched_at AND (i.b IS NULL OR p.fetched_at < i.b)
   AND (p.host = i.pattern OR ends_with(p.host, '.' || i.pattern)
        OR (contains(i.pattern, '/') AND starts_with(p.host || '/' || regexp_replace(p.path, '/+', '/', 'g') || '/', i.pattern || '/'))))
SELECT p.page_id, p.url, p.fetched_at, p.host,
       CASE WHEN p.host IS NULL THEN 'invalid' ELSE coalesce(h.action, 'none') END AS decision,
       h.list_name, h.pattern, coalesce(h.n, 0) AS n_active
FROM p LEFT JOIN hit h ON h.url = p.url AND h.fetched_at = p.fetched_at AND h.rank = 1
""".replace("{host}", _HOST)
)

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                               ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) r USING (doc_id)
"""


def _crc_step(bits: int) -> str:
    """One byte of CRC-32, bit by bit, over the running value c and the byte b."""
    step = "xor(c, b)"
    for _ in range(bits):
        step = f"xor(({step}) >> 1, 3988292384 * (({step}) & 1))"
    return step


OP7 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT::HUGEINT AS key FROM documents),
j AS (
  SELECT doc_id, shards, key AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM d, unnest([24, 25]) t(shards)
  UNION ALL
  SELECT doc_id, shards, next, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (((next >> 33) + 1)::DOUBLE)))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM j WHERE j < shards)),
s AS (SELECT doc_id, max(j) FILTER (shards = 24 AND j < 24) AS shard, max(j) FILTER (shards = 25 AND j < 25) AS grown FROM j GROUP BY doc_id),
c AS (
  SELECT doc_id, octet_length(bytes) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(bytes), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, b: {_crc_step(8)}), 4294967295) AS text_crc32
  FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown::INTEGER AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 16, 3))::INTEGER // 4, doc_id) - 1 AS slot
FROM c JOIN s USING (doc_id)
"""



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, byte by byte."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {_crc_step(8)}), 4294967295)"


_TURN_DIGEST = "sha256(strlen(role) || ':' || role || text)"
OP11 = f"""
WITH t AS (
  SELECT conv_id, {_TURN_DIGEST} AS digest, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN_DIGEST}) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {_crc32("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS donor FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(h, coalesce(n.n, 0)) AS taken FROM c LEFT JOIN n ON n.conv_id = c.donor),
r AS (
  SELECT k.conv_id, t.place AS depth, t.digest, t.bytes FROM k JOIN t ON t.conv_id = k.donor AND t.place <= k.taken
  UNION ALL SELECT k.conv_id, t.place - k.h + k.taken, t.digest, t.bytes FROM k JOIN t ON t.conv_id = k.conv_id AND t.place > k.h),
p AS (
  SELECT conv_id, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
m AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS is_last FROM p),
x AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_last), '')) AS ends_sha256
  FROM m GROUP BY depth, path),
ch AS (SELECT depth - 1 AS depth, left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM x WHERE depth > 0 GROUP BY ALL),
y AS (SELECT x.*, coalesce(ch.n, 0) AS n_children FROM x LEFT JOIN ch USING (depth, path)),
s AS (
  SELECT d AS depth, left(path, 64 * d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM y) GROUP BY ALL)
SELECT y.conv_id, y.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, y.n_convs, y.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, y.ends_sha256
FROM y JOIN s USING (depth, path) LEFT JOIN y u ON u.depth = y.depth - 1 AND u.path = left(y.path, 64 * (y.depth - 1))
"""

OP12 = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o WHERE kind <> 0),
p AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN_DIGEST}) AS place
  FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM p),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY place) AS i_before
  FROM r),
moves(s, edit, i, to_s, cost) AS (VALUES
  (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4),
  (0, 'R', '', 2, 3), (1, 'R', '', 2, 3), (2, 'R', '', 3, 3), (3, 'R', '', 2, 3),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)),
inserts(s, added, to_s) AS (VALUES
  (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 'I', 2), (1, 'I', 2), (2, 'I', 3), (3, 'I', 2), (0, 'II', 3), (1, 'II', 3), (2, 'II', 2), (3, 'II', 3)),
dp AS (
  SELECT c.conv_id, 0::BIGINT AS t, n.to_s AS s, 3 * len(n.added) AS cost, n.added AS audit
  FROM (SELECT DISTINCT conv_id FROM f) c, inserts n WHERE n.s = 0
  UNION ALL
  SELECT conv_id, t, s, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM (
    SELECT x.conv_id, x.t + 1 AS t, n.to_s AS s,
           min(lpad((x.cost + m.cost + 3 * len(n.added) + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 9, '0') || x.audit || m.edit || n.added) AS best
    FROM dp x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.place = x.t + 1
    JOIN moves m ON m.s = x.s AND (m.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.i = f.i)))
    JOIN inserts n ON n.s = m.to_s
    GROUP BY x.conv_id, x.t, n.to_s)),
g AS (
  SELECT conv_id, greatest(0, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i_before IS NOT NULL AND i_before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
best AS (
  SELECT g.conv_id, min(lpad(cost::VARCHAR, 9, '0') || audit) AS best FROM g JOIN dp ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.t = g.n AND dp.s IN (0, 3) GROUP BY g.conv_id),
a AS (SELECT conv_id, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM best),
l AS (
  SELECT conv_id, q, e, sum((e <> 'I')::INT) OVER w AS place, sum((e <> 'D')::INT) OVER w AS nth
  FROM (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS q, substr(audit, q::INT, 1) AS e FROM a) WINDOW w AS (PARTITION BY conv_id ORDER BY q)),
k AS (
  SELECT l.*, f.role, f.text, bool_or(e = 'K' AND f.i = 's') OVER (PARTITION BY l.conv_id) AS has_system
  FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.place = l.place WHERE e <> 'D'),
z AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN (nth - has_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                                    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY q)) AS repaired
  FROM k GROUP BY conv_id)
SELECT c.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated,
       coalesce(g.illegal, 0) AS illegal, coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, coalesce(z.repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1, "op4_ngram_jaccard": OP4, "op5_url_filters": OP5, "op7_sharding": OP7, "op11_conversation_trie": OP11, "op12_conversation_repair": OP12}
