"""Training-data pipeline over ``documents``: five stages, each written before the next reads it.

Every stage works on all documents that the one before kept. All but the last return the columns of
``documents``; the last returns token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm import bpe, decontaminate, language, shingle_join, surrogates
from larkfield.llm.common import table
from larkfield.llm.queries import SURROGATE_KEY, tokenizer
from larkfield.session import fresh_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language's centroids go."""
    return language.fit(docs, learn=F.lit(True)).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a shingle similarity of 0.8 the smallest id stays."""
    return shingle_join.keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; ``n_chars`` follows the new text."""
    return surrogates.replace_in_place(docs, SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Centroids, forests and keyed permutations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
