"""The queries of this package by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, importance, langid, linechunks, lsh, multi_index, packing, pii, simhash, suffixes, whitening, windows


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linechunks.remove_repeats(docs).drop("text")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learned = langid.learn(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), learned).drop("text")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_importance_resampling, op2_line_chunks, op3_embedding_near_dedup, op4_suffix_array, op5_inverted_multi_index, op6_best_fit_packing, op7_byte_bpe, op8_simhash, op9_language_id, op10_pii, op11_fill_in_middle, op12_window_packing, op13_whitening)}


#: Vectors without a link stand for themselves; the closure over links gives the components.
VECTORS_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
v AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM p WHERE p.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""

#: Every 100-byte window of every text by its hex digits; a window seen earlier covers its bytes.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, CAST(2 * s + 1 AS BIGINT), 200)) AS g FROM (SELECT doc_id, x, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
c AS (SELECT doc_id, s, s + 100 AS e FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS i FROM w) WHERE i > 1),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m),
r AS (SELECT doc_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, island),
k AS (SELECT r.doc_id, r.s, r.e, substr(x, CAST(2 * coalesce(lag(r.e) OVER o, 0) + 1 AS BIGINT), CAST(2 * (r.s - coalesce(lag(r.e) OVER o, 0)) AS BIGINT)) AS part FROM r JOIN d USING (doc_id) WINDOW o AS (PARTITION BY r.doc_id ORDER BY r.s)),
t AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(part, '' ORDER BY s) AS kept, max(e) AS last FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_chunks": linechunks.SQL, "op3_embedding_near_dedup": VECTORS_SQL, "op4_suffix_array": REPEATS_SQL, "op11_fill_in_middle": fim.SQL}
