"""The queries opN_<name> over the driver's tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontaminate, divergence, jaccard_join, knn, langid, merkle, oracles, packing, secrets, substring_dedup, suffix_dedup, toxicity, urltree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.BpeTokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokenizer.digest(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(True))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 fit to use, 1 of low quality, 2 toxic."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, F.col("grade"), labels=gravest(table(spark, sf_dir, "labels"))))


def gravest(labels: DataFrame) -> DataFrame:
    """doc_id and grade; of several labels of a document the gravest counts."""
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.groupBy("doc_id").agg(F.max(grade).alias("grade"))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and grade of labelled documents."""
    return docs.select("doc_id", "text").join(gravest(labels), "doc_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), digest=True)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    text = F.when(F.coalesce(hit, F.lit(False)), F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, tampered={"text": text})
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_top_k": op3_top_k,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_best_fit_packing": op13_best_fit_packing,
}

#: The others need learned models, ranked merges, or positions of regular expressions; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_decontaminate": oracles.OP5,
    "op7_substring_dedup": oracles.OP7,
    "op9_jaccard_join": oracles.OP9,
    "op11_merkle_manifest": oracles.OP11,
    "op12_divergence_audit": oracles.OP12,
    "op3_top_k": """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""
}
