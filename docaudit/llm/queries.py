"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.bpe import bpe_digest
from docaudit.llm.byte_bpe import byte_bpe_digest
from docaudit.llm.exact_dedup import exact_dedup
from docaudit.llm.hilbert import hilbert_shards
from docaudit.llm.langid import language_id
from docaudit.llm.mixing import mix_sources
from docaudit.llm.ngram_join import ngram_join
from docaudit.llm.packing import pack_tokens, packed_digest
from docaudit.llm.pq_dedup import pq_dedup
from docaudit.llm.quality import quality
from docaudit.llm.repair import conversation_repair
from docaudit.llm.secrets import scan_secrets, secret_digest
from docaudit.llm.sql import EXACT_DEDUP_SQL, NGRAM_JOIN_SQL, PQ_DEDUP_SQL
from docaudit.llm.whiten import whiten
from docaudit.session import read_table

#: Tokenizer file of the token queries; any byte-level BPE file with word ends will do.
TOKENIZER = "word_bpe_49k.json"


#: Rank file of the byte-level token query.
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path() -> str:
    return str(public_tokenizers.path(TOKENIZER))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(read_table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup(read_table(spark, sf_dir, "embeddings"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(read_table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digest(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_secret_scan": op2_secret_scan,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_bpe_codec": op4_bpe_codec,
        "op5_ngram_join": op5_ngram_join,
        "op6_pack_tokens": op6_pack_tokens,
        "op7_pq_dedup": op7_pq_dedup,
        "op8_hilbert_shards": op8_hilbert_shards,
        "op9_quality": op9_quality,
        "op10_language_id": op10_language_id,
        "op11_whitening": op11_whitening,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_byte_bpe": op13_byte_bpe,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": EXACT_DEDUP_SQL,
        "op5_ngram_join": NGRAM_JOIN_SQL,
        "op7_pq_dedup": PQ_DEDUP_SQL,
    }
