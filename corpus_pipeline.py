"""Training corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Stages but the last return the columns of documents; where a stage changes a text,
n_chars follows it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontaminate, jaccard_join, langid, secrets
from tidewatch.llm.common import stored

#: Texts whose likeliest language has less than this share of the probability are rejected.
MIN_LANGUAGE_SCORE = 0.5
#: Documents with more than this share of their words in benchmark items go as a whole; others lose those words.
MAX_BENCHMARK_SHARE = 0.5

#: Documents link from so many percent of common shingles of so many words.
SHINGLE_WORDS, MIN_JACCARD_PERCENT = 5, 80


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars as the text has now."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and texts of no clear language. Ties in score go to the first language by name; repeated rows fare alike. Where no document has a language, nothing is learned and all stay."""
    model = langid.fit(docs)
    if not model.languages:
        return docs
    lang, score = unused(docs, "found_lang"), unused(docs, "found_score")
    found = langid.identify(docs, model, keep=docs.columns, into=(lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones, the one of least id; texts without words are groups of their own."""
    return jaccard_join.keep_one(docs, words=SHINGLE_WORDS, percent=MIN_JACCARD_PERCENT).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark passages, and documents that are mostly such. Null and empty texts stay; without items nothing goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return measured(decontaminate.clean(docs, items, max_coverage=MAX_BENCHMARK_SHARE), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark. Null and empty texts stay as they are."""
    return measured(secrets.redact(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; null counts as empty."""
    return bpe.BpeTokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).digest(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: Language models, components and merges are not expressible in SQL. Tests hold the operators against brute force, run() so far only by counts and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
