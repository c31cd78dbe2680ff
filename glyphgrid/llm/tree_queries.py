"""Queries of the manifest, the language model and the conversation trie over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import table
from .conversation_trie import rebuilt_trie
from .katz import katz_scores
from .merkle import merkle_manifest, proof_digests


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against tampered ones: where 7 divides crc32(doc_id), n_chars is one more."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return proof_digests(merkle_manifest(table(spark, sf_dir, "documents"), altered={"n_chars": tampered}))


def op12_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts by a word-pair model of those whose crc32(doc_id) leaves another rest than 1 by 5. Scores are rounded to six
    decimals, as they are sums in any order."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    d = katz_scores(table(spark, sf_dir, "documents"), ~held_out)
    return d.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op11_merkle_manifest, op12_katz_scoring, op13_conversation_trie)}


def _crc32(x: str) -> str:
    """Unsigned crc32 of the decimal form of an integer: of each byte one xor and eight shifts (-1 stands for a shift)."""
    steps = f"flatten(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda b: [ascii(b), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = f"list_reduce(list_concat([4294967295::BIGINT], list_transform({steps}, lambda v: CAST(v AS BIGINT))), lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    return f"xor({fold}, 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_crc32("doc_id")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS other
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
), t AS (  -- level by level, the trees of the languages
  SELECT lang, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL
  SELECT lang, level + 1, i, n, h FROM (
    SELECT lang, max(level) AS level, i // 2 AS i, (max(n) + 1) // 2 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h
    FROM t WHERE n > 1 GROUP BY lang, i // 2
  )
), s AS (
  SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (  -- and the tree of the subroots
  SELECT 0 AS level, i, n, h FROM s
  UNION ALL
  SELECT level + 1, i, n, h FROM (
    SELECT max(level) AS level, i // 2 AS i, (max(n) + 1) // 2 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM u WHERE n > 1 GROUP BY i // 2
  )
), w AS (  -- the way of each leaf: its place and its sibling, if any
  SELECT l.lang, l.doc_id, l.i AS leaf_i, t.level, (l.i >> t.level) & 1 AS place, coalesce(o.h, '') AS sibling
  FROM l JOIN (SELECT DISTINCT lang, level FROM t WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = t.level AND o.i = xor(l.i >> t.level, 1)
  UNION ALL
  SELECT l.lang, l.doc_id, l.i, 100 + u.level, (s.i >> u.level) & 1, coalesce(o.h, '')
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT level FROM u WHERE n > 1) u ON true
  LEFT JOIN u o ON o.level = u.level AND o.i = xor(s.i >> u.level, 1)
), p AS (
  SELECT lang, leaf_i, list({{'place': place, 'sibling': sibling}} ORDER BY level) AS way, string_agg(sibling, '' ORDER BY level) AS siblings
  FROM w GROUP BY lang, leaf_i
), f AS (
  SELECT l.doc_id, l.lang, l.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(siblings, '') AS siblings, l.other,
         coalesce(way, []) AS way
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.leaf_i = l.i
), z AS (
  SELECT *, list_reduce(list_concat([{{'place': 0, 'sibling': other}}], way), lambda a, b: {{'place': 0, 'sibling':
    sha256(CASE WHEN b.place = 1 THEN b.sibling || a.sibling ELSE a.sibling || b.sibling END)}}).sibling AS folded_root
  FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
"""

_KATZ_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce({_crc32("doc_id")} % 5 = 1, false) AS held_out, row_number() OVER () AS d,
         list_concat(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: 'w' || x), ['end']) AS ws
  FROM documents
), t AS (
  SELECT d, held_out, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS h FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)
), u AS (
  SELECT w, CAST(count(*) AS DOUBLE) AS c FROM t WHERE NOT held_out GROUP BY w
), b AS (
  SELECT h, w, CAST(count(*) AS DOUBLE) AS c FROM t WHERE NOT held_out AND h IS NOT NULL GROUP BY h, w
), g AS (  -- counts of counts
  SELECT 1 AS k, c, CAST(count(*) AS DOUBLE) AS n FROM u WHERE c <= 6 GROUP BY c
  UNION ALL
  SELECT 2, c, CAST(count(*) AS DOUBLE) FROM b WHERE c <= 6 GROUP BY c
), r AS (
  SELECT a.k, a.c, a.n, (a.c + 1) * coalesce(x.n, 0) / (a.c * a.n) AS raw, 6 * coalesce(s.n, 0) / o.n AS rest
  FROM g a LEFT JOIN g x ON x.k = a.k AND x.c = a.c + 1 LEFT JOIN g s ON s.k = a.k AND s.c = 6 JOIN g o ON o.k = a.k AND o.c = 1
  WHERE a.c <= 5
), f AS (  -- the share of a count that is kept
  SELECT k, c, n, CASE WHEN rest < 1 AND (raw - rest) / (1 - rest) > 0 AND (raw - rest) / (1 - rest) < 1 THEN (raw - rest) / (1 - rest) ELSE 1 END AS kept FROM r
), n AS (
  SELECT coalesce((SELECT sum(c) FROM u), 0) AS tokens, (SELECT count(*) FROM u) AS types, coalesce((SELECT sum(c * n * (1 - kept)) FROM f WHERE k = 1), 0) AS lost
), m AS (
  SELECT tokens, types, tokens + CASE WHEN lost = 0 THEN 1 ELSE 0 END AS whole, CASE WHEN lost = 0 THEN 1 ELSE lost END / (tokens + CASE WHEN lost = 0 THEN 1 ELSE 0 END) AS unknown FROM n
), p AS (
  SELECT u.w, u.c, u.c * coalesce(f.kept, 1) / m.whole AS p FROM u CROSS JOIN m LEFT JOIN f ON f.k = 1 AND f.c = u.c
), q AS (
  SELECT b.h, b.w, b.c * coalesce(f.kept, 1) AS kept, b.c * (1 - coalesce(f.kept, 1)) AS lost, p.p
  FROM b LEFT JOIN f ON f.k = 2 AND f.c = b.c JOIN p ON p.w = b.w
), x AS (
  SELECT q.h, any_value(u.c) + CASE WHEN sum(lost) = 0 THEN 1 ELSE 0 END AS whole, CASE WHEN sum(lost) = 0 THEN 1 ELSE sum(lost) END AS lost, sum(q.p) AS low
  FROM q JOIN u ON u.w = q.h GROUP BY q.h
), s AS (
  SELECT t.d, p.c IS NOT NULL AS known, log10((coalesce(p.c, 0) + 0.5) / (m.tokens + 0.5 * (m.types + 1))) AS base,
         log10(CASE WHEN x.h IS NULL THEN coalesce(p.p, m.unknown) WHEN q.h IS NOT NULL THEN q.kept / x.whole
           ELSE x.lost / x.whole / greatest(1 - x.low, CAST(1e-12 AS DOUBLE)) * coalesce(p.p, m.unknown) END) AS score
  FROM t CROSS JOIN m LEFT JOIN p ON p.w = t.w LEFT JOIN x ON x.h = t.h LEFT JOIN q ON q.h = t.h AND q.w = t.w
), e AS (
  SELECT d, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, sum(base) AS base, sum(score) AS score FROM s GROUP BY d
)
SELECT w.doc_id, w.held_out, e.n_tokens, e.n_known, CAST(m.tokens AS BIGINT) AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score
FROM w JOIN e ON e.d = w.d CROSS JOIN m
"""

_TRIE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS r FROM c
), n AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM c)
), b AS (
  SELECT n.conv_id, 0 AS part, r, role, text FROM n JOIN o ON o.conv_id = n.base AND r <= h
  UNION ALL
  SELECT n.conv_id, 1, r, role, text FROM n JOIN o ON o.conv_id = n.conv_id AND r > h
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS depth FROM b
), p AS (  -- every prefix of every conversation
  SELECT conv_id, depth, length(text) AS len,
         sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix
  FROM t
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM n
), l AS (
  SELECT conv_id, max(depth) AS n_turns FROM p GROUP BY conv_id
), g AS (
  SELECT prefix, min(p.conv_id) AS conv_id, min(p.depth) AS depth, count(*) AS n_convs, max(len) AS len,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (p.depth = n_turns), '')) AS ends_sha256
  FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY prefix
), k AS (
  SELECT DISTINCT child.prefix, parent.prefix AS above FROM p child JOIN p parent ON parent.conv_id = child.conv_id AND parent.depth = child.depth - 1
), m AS (
  SELECT g.prefix, count(k.prefix) AS n_children FROM g LEFT JOIN k ON k.above = g.prefix GROUP BY g.prefix
), s AS (
  SELECT a.prefix, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((g.n_convs - 1) * g.len) AS saved_tokens
  FROM (SELECT DISTINCT x.prefix, y.prefix AS under FROM p x JOIN p y ON y.conv_id = x.conv_id AND y.depth >= x.depth) a
  JOIN g ON g.prefix = a.under JOIN m ON m.prefix = a.under GROUP BY a.prefix
)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, g.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN m ON m.prefix = g.prefix JOIN s ON s.prefix = g.prefix LEFT JOIN k ON k.prefix = g.prefix LEFT JOIN g up ON up.prefix = k.above
"""

ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": _MERKLE_SQL, "op12_katz_scoring": _KATZ_SQL, "op13_conversation_trie": _TRIE_SQL}
