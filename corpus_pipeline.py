"""From raw documents to token ids: STAGES in order, each over all rows that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns the next docs. All but the last return the columns of documents, with the caller's values
also where an operator adds a column of that name; a document that the mix takes twice is two rows of its result. `run` writes each result as Parquet in the shared folder and reads it again, so a lost executor
costs one stage and no plan grows over several.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliocheck.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from foliocheck.llm.common import read, shared_dir
from foliocheck.llm.queries import VOCABULARY, toxicity_model


def _with_own_columns(docs: DataFrame, added: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`step` over docs, with the columns of docs that it would replace set aside and put back."""
    aside = {c: f"__llm_own_{c}" for c in docs.columns if c.lower() in added}
    return step(docs.withColumnsRenamed(aside)).select([F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5, by a model of the labelled rows of this input that are not held out."""
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return _with_own_columns(docs, ["score", "predicted"], lambda d: toxicity.score(d, model).filter("predicted = 0"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar shingle sets: the one with the smallest doc_id."""
    return ngram_join.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    def taken(d: DataFrame) -> DataFrame:
        return mixing.mix(d).filter("copies > 0").withColumn("__llm_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    return _with_own_columns(docs, ["size", "source_size", "target", "copies", "taken"], taken)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded bytes of every row."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing", mix_sources), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier and the tokenizer have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None
