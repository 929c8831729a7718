"""DuckDB SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

from .sharding import feistel_sql, nested

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT rid, doc_id, pos, line, {_KEY} AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.rid, k.doc_id
"""

# The remainders of CRC-32's reflected polynomial for one nibble, built by its rule.
_T = ["0"] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ 0xEDB88320 if _c & 1 else _c >> 1
    _T[_i] = str(_c)
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], {nibbles}), lambda c, x: "
    f"xor(c >> 4, ([{', '.join(_T)}]::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295)"
)


def _op4(shards: int, seed: int) -> str:
    # Low nibble of each byte first.
    nibbles = "flatten(list_transform(range(1, octet_length(encode(t)) + 1), lambda i: [instr('0123456789ABCDEF', h[2 * i]) - 1, instr('0123456789ABCDEF', h[2 * i - 1]) - 1]))"
    base = f"""SELECT doc_id, octet_length(encode(t)) + 1 AS size, {_CRC.format(nibbles=nibbles)} AS text_crc32
      FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents)"""
    numbered = f"""SELECT *, row_number() OVER (ORDER BY doc_id, text_crc32) - 1 AS x, count(*) OVER () AS n FROM ({base})"""
    sized = f"""SELECT *, a, (n + a - 1) // a AS b FROM (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE floor(sqrt(n - 1))::BIGINT + 1 END AS a FROM ({numbered}))"""
    keep = ["doc_id", "size", "text_crc32", "n", "a", "b"]
    first = nested(keep, feistel_sql("x", "n", "a", "b", seed), f"({sized})")
    again = nested([*keep, "depth"], feistel_sql("y", "n", "a", "b", seed), "(SELECT * FROM w WHERE y >= n)")
    return f"""
WITH RECURSIVE start AS (SELECT {', '.join(keep)}, l * b + r AS y FROM ({first})),
w AS (SELECT {', '.join(keep)}, y, 0 AS depth FROM start
  UNION ALL SELECT {', '.join(keep)}, l * b + r AS y, depth + 1 AS depth FROM ({again}))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (y % {shards})::INTEGER AS shard, (y // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM w WHERE y < n
"""


OP7 = """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
"""

_NIBBLES = "flatten(list_transform(range(1, length(t) + 1), lambda i: [ascii(t[i]) & 15, ascii(t[i]) >> 4]))"
_SAID = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
OP12 = f"""
WITH o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), {_SAID}) AS pos, {_SAID} AS said,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, ({_CRC.format(nibbles=_NIBBLES)} % 4) AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS t FROM o)),
t AS (SELECT c.conv_id, 0 AS part, o.pos, o.said, o.words FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.said, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, list(said) OVER w AS path, words FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
p AS MATERIALIZED (SELECT conv_id, depth, sha256(array_to_string(path, ',')) AS node, words, max(depth) OVER (PARTITION BY conv_id) AS n_turns FROM r
  UNION ALL SELECT c.conv_id, 0, '', 0, coalesce(x.n, 0) FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM r GROUP BY 1) x USING (conv_id)),
n AS MATERIALIZED (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, max(n_turns) AS deepest,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
up AS MATERIALIZED (SELECT n.*, p.node AS above FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
sums AS (SELECT p.depth, p.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE n.deepest = n.depth) AS leaves FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1, 2)
SELECT up.conv_id::BIGINT AS conv_id, up.depth::BIGINT AS depth, par.conv_id::BIGINT AS parent_conv_id, up.n_convs::BIGINT AS n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children, sums.leaves::BIGINT AS n_leaves,
  sums.saved::BIGINT AS saved_tokens, up.ends_sha256 FROM up JOIN sums USING (depth, node) LEFT JOIN kids USING (depth, node) LEFT JOIN n par ON par.depth = up.depth - 1 AND par.node = up.above
"""


def _op13(clusters: int, rounds: int, dimensions: int, scale: int, seed: int) -> str:
    near = "SELECT vec_id, x, min_by(cl, (d, cl)) AS cl, min(d) AS d FROM (SELECT v.rid, v.vec_id, v.x, c.cl, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i])))::BIGINT AS d FROM v, {c} c) GROUP BY rid, vec_id, x"
    heads = [
        f"k AS (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"v AS MATERIALIZED (SELECT rid, vec_id, list_transform(e, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS x FROM k)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cl, x AS c FROM (SELECT x, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, x LIMIT {clusters}))",
    ]
    for i in range(rounds):
        heads.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        heads.append(f"s{i} AS (SELECT cl, pos, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT cl, unnest(x) AS y, unnest(range(len(x))) AS pos FROM a{i}) GROUP BY 1, 2)")
        heads.append(f"m{i} AS (SELECT cl, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{i} GROUP BY 1)")
        heads.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cl, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cl))")
    heads.append(f"z AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(heads)}
SELECT z.vec_id, z.cl::INTEGER AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.cl))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c ON c.cl = z.cl"""


def oracles() -> dict[str, str]:
    from .queries import SHARD_SEED, SHARDS

    return {"op3_line_dedup": OP3, "op4_sharding": _op4(SHARDS, SHARD_SEED), "op7_exact_dedup": OP7, "op12_prefix_trie": OP12, "op13_centroid_clustering": _op13(8, 10, 64, 1024, 3)}
