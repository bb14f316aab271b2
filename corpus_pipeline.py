"""Corpus pipeline over ``documents``: quality, exact dedup, near dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return rows of ``documents`` with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.bpe import bpe_digest
from docaudit.llm.exact_dedup import exact_dedup, keep_first_copies
from docaudit.llm.mixing import mix_sources, take_mix
from docaudit.llm.ngram_join import ngram_join
from docaudit.llm.quality import keep_good
from docaudit.llm.queries import tokenizer_path
from docaudit.session import cut_lineage, find_package, read_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    find_package(spark)
    return keep_good(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the document with the largest id stays."""
    return keep_first_copies(docs, exact_dedup(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document with the smallest id stays; rows without id come last.  Rows are told apart by number, so rows that share an id are judged each by its own text."""
    find_package(spark)
    rows = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    classes = ngram_join(rows, id_col="__row").select("__row", "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    first = classes.join(rows.select("__row", "doc_id"), "__row").groupBy("class_id").agg(F.min(order).alias("__first"))
    return rows.join(first.select(F.col("__first.__row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a document stands as often as the mix takes it.  A row is known by id and text, which exact dedup leaves unique."""
    find_package(spark)
    own = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.withColumn("__row", F.unhex(F.sha2(own, 256)))
    return take_mix(rows, mix_sources(rows, id_col="__row"), "__row").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: token counts and digests of every document of the mix."""
    find_package(spark)
    return bpe_digest(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", dedup_exact),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Trained scorers, MinHash classes and subset sums have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and reread, as a job for each stage would."""
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut_lineage(docs, f"pipeline-{n}")
    return docs
