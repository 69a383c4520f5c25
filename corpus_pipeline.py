"""From raw documents to tokens: language, copies, near copies, mix, encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, digest_index, language_id, ngram_join, source_mix
from gridloom.llm.common import documents, drop_stage, release_heap, small_batches, stage_table


def lean(stage):
    """A stage that starts with executors that have given back the last one's heap, and whose texts go to Python
    in small batches, also when the caller writes the result: the session keeps that setting."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go. The model learns from all labelled rows' folds 0 and 2."""
    model = language_id.fit(docs.where(~language_id.in_fold(F.col("doc_id"), 1)))
    return language_id.predict(docs, model).where(language_id.accepted()).select(*docs.columns)


@lean
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays."""
    return digest_index.keep_first_copies(docs).select(*docs.columns)


@lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    kept = ngram_join.join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").select(*docs.columns)


@lean
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number."""
    return source_mix.mixed_documents(docs).select(*docs.columns)


@lean
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", encode_texts),
]

#: Profiles, component search and BPE have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the tables between stages only the last one stays, as those rows are made from it."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            drop_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
