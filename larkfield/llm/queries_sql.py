"""SQL on DuckDB for those queries of this folder that SQL can state."""

from __future__ import annotations


#: crc32 of a whole number written as text, bit by bit; DuckDB has no such function.
_CRC32 = """xor(list_reduce(list_transform(string_split(({0})::varchar, ''), lambda s: ascii(s)::bigint),
  lambda c, b: list_reduce(range(8)::bigint[], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
  4294967295), 4294967295)"""

SQL: dict[str, str] = {
    "op11_turn_trie": f"""
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS points
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, {_CRC32.format("conv_id")} % 6 AS h FROM numbered GROUP BY 1),
plan AS (
  SELECT o.conv_id, o.base, o.h, least(o.h, coalesce(b.n, 0)) AS head FROM own o LEFT JOIN own b ON b.conv_id = o.base),
rebuilt AS (
  SELECT p.conv_id, head + place - h AS place, said, points FROM plan p JOIN numbered USING (conv_id) WHERE place > h
  UNION ALL
  SELECT p.conv_id, place, said, points FROM plan p JOIN numbered t ON t.conv_id = p.base WHERE place <= head),
paths AS (
  SELECT conv_id, place AS depth, points, count(*) OVER (PARTITION BY conv_id) AS ends_at,
         md5((list(md5(said)) OVER (PARTITION BY conv_id ORDER BY place))::varchar) AS node FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = plan.conv_id), 'root' FROM plan),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) * (count(*) - 1) AS own_saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE ends_at = depth), '')) AS ends_sha256
  FROM paths GROUP BY node),
links AS (  -- every node and what lies below it, itself included
  SELECT DISTINCT a.node AS upper, b.node AS lower, b.depth - a.depth AS apart FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
children AS (SELECT upper, count(*) AS n FROM links WHERE apart = 1 GROUP BY 1),
below AS (
  SELECT links.upper, sum(own_saved) AS saved_tokens, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves
  FROM links JOIN nodes ON nodes.node = lower LEFT JOIN children c ON c.upper = links.lower GROUP BY 1)
SELECT n.conv_id, n.depth::bigint AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::bigint AS n_children,
       b.n_leaves::bigint AS n_leaves, b.saved_tokens::bigint AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.upper = n.node LEFT JOIN children c ON c.upper = n.node
LEFT JOIN links l ON l.lower = n.node AND l.apart = 1 LEFT JOIN nodes p ON p.node = l.upper
""",
    "op8_embedding_dedup": """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (
  SELECT * FROM rows WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS x, b.r AS y FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS x, r AS y FROM rows UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
lowest AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN rows ON rows.r = y GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN lowest ON lowest.x = r LEFT JOIN counted ON counted.x = r
""",
}
SQL = {name: text.strip() for name, text in SQL.items()}
