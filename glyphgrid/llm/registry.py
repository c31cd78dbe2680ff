"""Queries of the training-data operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree_queries
from ._session import table, work_path, written
from .embedding_dedup import embedding_dedup
from .exact_topk import exact_topk
from .huffman_tokens import token_digests, tokenised
from .minhash_dedup import minhash_dedup
from .mixing import temperature_mix
from .packing import pack_tokens, places
from .rollups import GROUP, TokenRollup, delete_deltas, insert_deltas, revise_deltas, tokenizer_counts
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .window_dedup import window_dedup


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("span_starts", "span_ends")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token ids, each with its end id, packed; where each piece stands in its bin, read back from there."""
    import public_tokenizers

    tokens = tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return places(written(pack_tokens(tokens.where("token is null").select("doc_id", "n_tokens", "width", "ids")), "bins"))


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("toxic_starts").alias("n_spans"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizer versions; the word tokenizer's counts of documents of low quality are
    revised to include an end id; toxic documents are deleted with the counts that they have by then. Every batch is
    committed twice, and a snapshot is made between."""
    import public_tokenizers

    versions = {"word_bpe_49k": public_tokenizers.path("word_bpe_49k.json"), "byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    c = written(tokenizer_counts(table(spark, sf_dir, "documents"), versions, carry=("source", "lang")), "counts")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = c.join(labels, "doc_id")
    revised = (F.col("quality") == 0) & (F.col("tokenizer") == "word_bpe_49k")
    now = (F.col("n_tokens") + F.coalesce(revised, F.lit(False)).cast("long")).alias("n_tokens")
    rollup = TokenRollup(spark, work_path(spark, "rollup"))
    batches = {
        "1-load": insert_deltas(c),
        "2-revise": revise_deltas(known.where(revised).select(*GROUP, now, F.col("n_tokens").alias("old_tokens"))),
        "3-delete": delete_deltas(known.where("toxic = 1").select(*GROUP, now)),
    }
    for _ in range(2):
        for name, deltas in batches.items():
            rollup.commit(name, deltas)
        rollup.compact()
    return rollup.totals()


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix(table(spark, sf_dir, "documents"))


_ALL = (
    op1_embedding_near_dedup, op2_suffix_dedup, op3_substring_dedup, op4_minhash_near_dedup, op5_best_fit_packing,
    op6_toxicity_crf, op7_exact_topk, op8_huffman_tokens, op9_token_rollup, op10_temperature_mixing,
)
QUERIES = {f.__name__: f for f in _ALL} | tree_queries.QUERIES

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_WINDOW_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i AS start, list_slice(ws, i, i + 19) AS gram
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 18, 1))) AS i)
), f AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY gram ORDER BY doc_id, start) AS n FROM g
), c AS (
  SELECT DISTINCT doc_id, start + k AS pos FROM f, range(20) AS r(k) WHERE n > 1
), p AS (
  SELECT w.doc_id, i AS pos, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)
), k AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(p.word, ' ' ORDER BY p.pos) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.pos = p.pos
  WHERE c.pos IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

_MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         md5(CAST(doc_id AS VARCHAR) || ':1') AS key
  FROM documents
), k AS (
  SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % 4096 AS block FROM d
), t AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM k GROUP BY source HAVING sum(n_tokens) > 0
), o AS (
  SELECT list(CAST(tokens AS DOUBLE) / CAST(total AS DOUBLE) ORDER BY source) AS p, max(total) AS total
  FROM t, (SELECT CAST(sum(tokens) AS BIGINT) AS total FROM t)
), b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS lo2, CAST(1 AS DOUBLE) AS hi2, p FROM o
  UNION ALL
  SELECT i + 1, CASE WHEN e THEN mid ELSE lo END, CASE WHEN e THEN hi ELSE mid END,
         CASE WHEN r THEN mid2 ELSE lo2 END, CASE WHEN r THEN hi2 ELSE mid2 END, p
  FROM (
    SELECT *, ln(z) - list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) * mid / z
              >= CAST(0.95 AS DOUBLE) * ln(CAST(len(p) AS DOUBLE)) AS e,
           pow(list_min(p), mid2 - 1) / z2 > CAST(4 AS DOUBLE) AS r
    FROM (
      SELECT *, list_sum(list_transform(p, lambda x: pow(x, mid))) AS z, list_sum(list_transform(p, lambda x: pow(x, mid2))) AS z2
      FROM (SELECT *, (lo + hi) / 2 AS mid, (lo2 + hi2) / 2 AS mid2 FROM b WHERE i < 50)
    )
  )
), x AS (
  SELECT round(greatest((lo + hi) / 2, (lo2 + hi2) / 2), 9) AS e, p FROM b WHERE i = 50
), q AS (
  SELECT source, tokens,
         CAST(floor(round(pow(CAST(tokens AS DOUBLE) / CAST(o.total AS DOUBLE), e)
           / list_sum(list_transform(x.p, lambda y: pow(y, e))), 9) * o.total) AS BIGINT) AS quota
  FROM t, x, o
), bl AS (
  SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM k GROUP BY source, block
), ep AS (
  SELECT source, tokens, quota, unnest(range(0, (quota - 1) // tokens + 1)) AS epoch FROM q WHERE quota > 0
), ps AS (
  SELECT bl.source, bl.block, epoch, ep.tokens AS total, quota,
         coalesce(sum(bl.tokens) OVER (PARTITION BY bl.source, epoch ORDER BY md5(CAST(bl.block AS VARCHAR) || ':' || CAST(epoch AS VARCHAR) || ':1'), bl.block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM bl JOIN ep ON bl.source IS NOT DISTINCT FROM ep.source
), w AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY key, doc_id, n_tokens
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS within
  FROM k
)
SELECT w.doc_id, w.source, CAST(epoch AS INTEGER) AS epoch, CAST(first + within AS BIGINT) AS start, n_tokens
FROM w JOIN ps ON w.source IS NOT DISTINCT FROM ps.source AND w.block = ps.block
WHERE first + within < quota - epoch * total
"""

_VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= CAST(0.93 AS DOUBLE)
), r AS (
  SELECT DISTINCT a AS id, a AS root FROM p
  UNION
  SELECT p.b, r.root FROM r JOIN p ON p.a = r.id
), c AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_SUFFIX_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (  -- 256 bytes at a time and what their grams reach into
  SELECT doc_id, c, substr(x, 512 * c + 1, 612) AS x, least(256, length(x) // 2 - 256 * c) AS n
  FROM h, LATERAL (SELECT unnest(range(0, (length(x) + 511) // 512)) AS c)
), b AS (
  SELECT doc_id, 256 * c + i AS pos, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= length(x) THEN substr(x, 2 * i + 1, 100) END AS gram
  FROM c, LATERAL (SELECT unnest(range(0, n)) AS i)
), f AS (
  SELECT gram, min(doc_id) AS least FROM b WHERE gram IS NOT NULL GROUP BY gram HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT b.doc_id, pos, byte,
         pos - max(CASE WHEN f.least < b.doc_id THEN pos END) OVER (PARTITION BY b.doc_id ORDER BY pos) < 50 AS gone
  FROM b LEFT JOIN f ON f.gram = b.gram
), s AS (
  SELECT *, coalesce(gone, false) AS out, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM m
), g AS (
  SELECT doc_id, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT before) AS n_spans,
         string_agg(byte, '' ORDER BY pos) FILTER (NOT out) AS kept
  FROM s GROUP BY doc_id
)
SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN g ON g.doc_id = h.doc_id
"""

_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i)
  WHERE len(ws) > 0
), k AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), p AS (
  SELECT a, b FROM i JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)
), r AS (
  SELECT DISTINCT a AS id, a AS root FROM p
  UNION
  SELECT p.b, r.root FROM r JOIN p ON p.a = r.id
), c AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
)
SELECT w.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": _VECTOR_SQL, "op2_suffix_dedup": _SUFFIX_SQL, "op4_minhash_near_dedup": _NEAR_SQL, "op7_exact_topk": _TOPK_SQL, "op3_substring_dedup": _WINDOW_SQL, "op10_temperature_mixing": _MIX_SQL} | tree_queries.ORACLE_SQL
