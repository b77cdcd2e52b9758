"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, embdup, html_text, mixing, nearest, neardup, ngrams, quality, substring, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rank_path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    folder, manifest = token_files.write(_table(spark, sf_dir, "documents"), rank_path, public_tokenizers.PATTERN, separator=50256)
    counts = token_files.scan(spark, folder, separator=50256)
    return manifest.join(counts, ["file", "place"]).select("doc_id", "n_tokens")


def op3_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.backoff_scores(_table(spark, sf_dir, "documents"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(_table(spark, sf_dir, "documents"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_lm_backoff": op3_lm_backoff,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_html_main_text": op5_html_main_text,
    "op6_mix_sources": op6_mix_sources,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_level_bpe": op8_byte_level_bpe,
    "op9_embedding_neardup": op9_embedding_neardup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

ORACLE: dict[str, str] = {
    "op9_embedding_neardup": r"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
""",
    "op10_nearest_neighbours": r"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op4_minhash_neardup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, h FROM (
  SELECT r, md5_number(array_to_string(list_slice(w, p, p + 4), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
  UNION ALL SELECT r, md5_number(len(w) || ':' || array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d LEFT JOIN n USING (r) JOIN m USING (r)
""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
h AS (SELECT r, p, md5_number(array_to_string(list_slice(w, p, p + 34), ' ')) AS h FROM s),
t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
x AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM h SEMI JOIN t USING (h)),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN x USING (r, p) GROUP BY r),
g AS (SELECT r, count(*) AS n FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)
""",
    "op6_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
c AS (SELECT *, length(bin(size)) AS bits FROM d),
k AS (SELECT *, bits * 8 + CASE WHEN size > 0 THEN floor(size * 8 / pow(2.0, bits - 1))::BIGINT % 8 ELSE 0 END AS class FROM c),
p AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY source, class) / 2048.0)::BIGINT) AS parts FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, h % parts, size, h, doc_id) AS k FROM p),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s0)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
f AS (SELECT arg_min(level, ratio) AS level FROM s3 WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR cap <= w * f.level THEN cap ELSE w * f.level END AS target,
             (('0x' || substr(md5('11:offset:' || coalesce(source, '')), 1, 15))::BIGINT % 1024) / 1024.0::DOUBLE AS u FROM s3 LEFT JOIN f ON true),
q AS (SELECT t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT r.doc_id, r.size, q.source_size, q.target, ((floor(q.rate * r.k + q.u) - floor(q.rate * (r.k - 1) + q.u))::BIGINT * r.size)::BIGINT AS taken,
       (floor(q.rate * r.k + q.u) - floor(q.rate * (r.k - 1) + q.u))::INT AS copies, r.source
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source
""",
}
