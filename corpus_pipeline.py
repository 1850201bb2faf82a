"""A corpus pipeline in five stages: toxicity, exact copies, near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowaudit.llm import exact_dedup, ngram_join, packing, pii, toxicity
from rowaudit.llm.scratch import written

#: Documents that score this or more are rejected.
TOXIC_FROM = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on the labels and the documents given, and rejects documents that score ``TOXIC_FROM`` or more.

    Each row is judged by its text alone: null and empty texts have the score of a text without words, null and repeated
    ids are rows like others (labels of a null id are not used), extra columns pass, whatever their names."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return toxicity.score(docs, model, into=name).filter(F.col(name) < TOXIC_FROM).select(docs.columns)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal after lower-casing A-Z, the one of the smallest id stays; one without an id only where no
    copy has one. Null texts are copies of empty ones. Rows are told apart by texts, so a null or repeated id removes nothing."""
    return exact_dedup.drop_exact_copies(docs, keep="min")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles (Jaccard 0.8 or more) connect, the one of the smallest id stays; one without
    an id only where none of its group has one. Texts without words link with nothing and all stay, as do rows whose id
    repeats on another text."""
    return ngram_join.one_of_each_group(docs, words=5, num=8, den=10)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become placeholders; ``n_chars`` follows the new text. No row goes; null texts stay null."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its bin, its place there and the bin's length. Tokens are those of the vocabulary file
    and one end; a null or empty text is its end alone."""
    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_exact_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: The classifier, the components and the packing have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written before the next one reads it. An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
