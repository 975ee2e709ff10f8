"""DuckDB SQL for the queries of this subpackage that SQL can express.

They are brute force and meant for small tables.  The rest (trained networks,
byte-level tokenizers, alignments) is tested in tests/llm.
"""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT item, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS s FROM (SELECT item, w, unnest(range(0, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(0, greatest(0, len(w) - n + 1))) AS i FROM d, size)),
hit AS (SELECT doc_id, i, n, item FROM pos JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_SEAT = """
    {name}_q AS (SELECT *, {weight} / (2 * s + 1)::DOUBLE AS quotient FROM (SELECT *, unnest(range(0, greatest({seats}, 1))) AS s FROM {of}) WHERE {weight} > 0 AND {seats} > 0),
    {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY quotient DESC, {key} NULLS LAST, s) AS rank FROM {name}_q),
    {name} AS (SELECT o.*, coalesce(c.won, 0) AS quota FROM {of} o LEFT JOIN (SELECT {cols}, count(*) AS won FROM {name}_r WHERE rank <= {seats} GROUP BY ALL) c ON {match})
"""

MIXING = (
    """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
    tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight, sum(source_size) OVER ()::BIGINT AS all_size FROM tot),
    f AS (SELECT *, 3 * source_size / weight::DOUBLE AS ratio FROM w),
    g AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped, sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights FROM f),
    l AS (SELECT *, (all_size - capped) / weights::DOUBLE AS level FROM g),
    v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
    goal AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM v), 0) * weight) AS target, round(all_size / 64.0::DOUBLE)::BIGINT AS seats,
      greatest(1, ceil(sqrt(round(source_size / 64.0::DOUBLE)) / 4))::BIGINT AS shards FROM l),"""
    + _SEAT.format(name="src", of="goal", weight="target", seats="seats", group="1", key="source", cols="source", match="o.source IS NOT DISTINCT FROM c.source")
    + """, dealt AS (SELECT s.doc_id, s.size, s.h, g.*, ('0x' || s.h[1:8])::BIGINT % g.shards AS shard FROM sized s JOIN src g ON s.source IS NOT DISTINCT FROM g.source),
    sh AS (SELECT source, shard, quota AS source_quota, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL),"""
    + _SEAT.format(name="shq", of="sh", weight="shard_size", seats="source_quota", group="source", key="shard", cols="source, shard", match="o.source IS NOT DISTINCT FROM c.source AND o.shard = c.shard")
    + """, p AS (SELECT *, greatest(1, round(shard_size / 64.0::DOUBLE))::BIGINT AS n, md5('mix-1:' || coalesce(source, '') || ':' || shard) AS m FROM shq),
    par AS (SELECT source, shard, shard_size, n, least(quota, 3 * n) AS q, [1000003, 15485863, 32452843, 49979687, 67867967][(('0x' || m[1:8])::BIGINT % 5) + 1] AS stride, ('0x' || m[9:16])::BIGINT AS shift FROM p),
    placed AS (SELECT d.*, sum(size) OVER (PARTITION BY source, shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM dealt d),
    x AS (SELECT a.doc_id, a.size, a.source_size, a.target, a.upto, a.upto - a.size AS start, par.shard_size, par.n, par.q, par.stride, par.shift FROM placed a JOIN par ON a.source IS NOT DISTINCT FROM par.source AND a.shard = par.shard),
    e AS (SELECT *, unnest(range(((start + 1) * n - 1) // shard_size, (upto * n - 1) // shard_size + 1)) AS j FROM x WHERE size > 0),
    t AS (SELECT doc_id, start, upto, sum(CASE WHEN (j * stride + shift) % n < q % n THEN least((j + 1) * shard_size // n, upto) - greatest(j * shard_size // n, start) ELSE 0 END)::BIGINT AS extra FROM e GROUP BY doc_id, start, upto)
SELECT x.doc_id, x.size, x.source_size, x.target, CASE WHEN x.size > 0 THEN (q // n) * x.size + coalesce(t.extra, 0) ELSE 0 END::BIGINT AS taken FROM x LEFT JOIN t ON x.doc_id = t.doc_id AND x.start = t.start AND x.upto = t.upto
"""
)

_COMPONENTS = """
    both_ways AS (SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT x AS id, x AS seen FROM both_ways UNION SELECT r.id, w.y FROM reach r JOIN both_ways w ON w.x = r.seen),
    comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)
"""

MINHASH = (
    f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),"""
    + _COMPONENTS
    + """SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component, d.doc_id) AS component_id, coalesce(comp.component, d.doc_id) = d.doc_id AS kept
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id"""
)

SUFFIX = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    s AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(0, greatest(0, octet_length(b) - 399))) AS i FROM d)),
    again AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
    edge AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM again),
    grp AS (SELECT doc_id, i, sum(CASE WHEN step IS NULL OR step > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge),
    run AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS z FROM grp GROUP BY doc_id, k),
    gap AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, r.a AS z FROM run r WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(z), 1000000000000 FROM run GROUP BY doc_id),
    kept AS (SELECT g.doc_id, string_agg(hex(d.b[g.a + 1 : least(g.z, octet_length(d.b))]), '' ORDER BY g.a) AS x FROM gap g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id),
    total AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id),
    w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    p AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + 51], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 50))) AS i FROM w)),
    shares AS (SELECT DISTINCT doc_id FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1))
SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM shares) AS shares_passage, octet_length(b) AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN x IS NULL THEN b ELSE unhex(x) END) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN total ON total.doc_id = d.doc_id
"""

LATTICE = (
    """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),"""
    + _COMPONENTS
    + """, n AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(comp.component, e.vec_id) AS component_id, coalesce(comp.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN comp ON comp.id = e.vec_id"""
)

EXACT = f"""
WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

#: crc32 has no name in this SQL: bit by bit over the digits of an id, as a fold.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1), lambda i: ascii(substring(x, i, 1))::BIGINT)), lambda a, c:
      list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"""

TRIE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT c, c::VARCHAR AS x FROM t),
    h AS (SELECT c, c - c % 100 AS base, xor({_CRC}, 4294967295::BIGINT) % 6 AS h FROM ids),
    r AS (SELECT h.c, t.pos AS k, 0 AS part, role, text FROM h JOIN t ON t.c = h.base AND t.pos < h.h UNION ALL SELECT h.c, t.pos, 1, role, text FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
    s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, sha256(length(role) || ':' || role || text) AS x, length(text) AS chars FROM r),
    p AS (SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS key, chars FROM s UNION ALL SELECT c, 0, '', 0 FROM h),
    n AS (SELECT key, d, min(c) AS c, count(*) AS n, max(chars) AS chars FROM p GROUP BY key, d),
    e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(key, d) AS key FROM p GROUP BY c) GROUP BY key),
    k AS (SELECT substring(key, 1, 64 * (d - 1)::INT) AS key, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
    w AS (SELECT n.key, n.d, (n - 1) * chars AS saves, CASE WHEN kids IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN k ON k.key = n.key),
    a AS (SELECT substring(key, 1, (64 * u)::INT) AS key, sum(saves)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM w) GROUP BY ALL)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, CASE WHEN n.d > 0 THEN u.c END AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN a ON a.key = n.key LEFT JOIN k ON k.key = n.key LEFT JOIN e ON e.key = n.key LEFT JOIN n u ON u.key = substring(n.key, 1, (64 * (n.d - 1))::INT) AND u.d = n.d - 1
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    c AS (SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(u[1 : a], '') END AS p, CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1 : b], '') END AS m, CASE WHEN form <> 'plain' THEN array_to_string(u[b + 1 : n], '') END AS s FROM f)
SELECT doc_id, n, form, length(p)::BIGINT AS prefix_chars, length(m)::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op2_mixing": MIXING,
    "op4_minhash_near_dedup": MINHASH,
    "op6_suffix_dedup": SUFFIX,
    "op8_lattice_near_dedup": LATTICE,
    "op11_exact_dedup": EXACT,
    "op12_prefix_trie": TRIE,
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
