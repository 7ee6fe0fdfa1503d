"""Queries of this folder's operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm import (bpe, decontaminate, interpolation, language, sequence_packing, sharding, shingle_join, suffix_dedup, surrogates,
                           token_files, turn_trie, vectors, whitening)
from larkfield.llm.queries_sql import SQL as _SQL
from larkfield.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(_SQL)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; LARKFIELD_TOKENIZERS may name another folder."""
    folder = os.environ.get("LARKFIELD_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    shards = token_files.write_token_files(docs, tokenizer("byte_bpe_50k.json"), token_files.fresh_folder(docs))
    return token_files.read_token_digests(shards)


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_remainder(docs["doc_id"], 4) == 2
    found = language.fit(docs, learn=~held_out).predict(docs)
    return found.withColumn("held_out", id_remainder(found["doc_id"], 4) == 2)


#: Key of the surrogates in the registered queries; a real run brings a secret one.
SURROGATE_KEY = os.environ.get("LARKFIELD_SURROGATE_KEY", "registered-queries")


@query
def op9_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, folder, "documents"), SURROGATE_KEY)


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.balanced_shards(sharding.text_groups(table(spark, folder, "documents")), shards=8)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query
def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.similar_documents(table(spark, folder, "documents"))


@query
def op5_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = id_remainder(docs["doc_id"], 5)
    scored = interpolation.score_documents(docs, train=fold != 1, deleted=fold == 2)
    return scored.withColumn("held_out", id_remainder(scored["doc_id"], 5) == 1)


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"), length=400)
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may leave part of a character
    return found.withColumns({"n_kept": F.col("n_bytes") - F.col("n_removed"), "text": text}).drop("kept")


@query
def op11_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    numbered = turn_trie.numbered_turns(table(spark, folder, "conversations"))
    return turn_trie.prefix_trie(*turn_trie.with_shared_heads(numbered)).drop("digest_a", "digest_b")


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return sequence_packing.pack_documents(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
