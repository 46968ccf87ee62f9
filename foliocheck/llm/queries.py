"""The registered queries: each operator over its whole table, and the digest columns that a comparison needs."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliocheck.llm import bpe, collocations, exact_dedup, language_id, line_dedup, mixing, ngram_join, periodic, pii, quality_rules, secret_scan, sharding, toxicity
from foliocheck.llm.common import read, whole
from foliocheck.llm.oracles import ORACLES  # noqa: F401  registered beside the queries

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _sha(text: Column) -> Column:
    return F.sha2(whole(text), 256)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.written(F.col("secrets"), secret_scan.BASE), 256).alias("base_sha256"),
                        secret_scan.written(F.col("secrets")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, bpe.load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.members(docs, exact_dedup.build_index(docs)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_entities = sum((F.col(f"entities.{k}") for k in pii.KINDS), F.lit(0)).cast("long")
    return safe.select("doc_id", n_entities.alias("n_entities"), "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha(F.col("text")).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", F.coalesce(held_out_label("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def held_out_label(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """The toxicity model of a corpus: fitted on the labelled rows that are not held out."""
    return toxicity.fit(docs, labels.filter(~held_out_label("doc_id")).select("doc_id", F.col("toxic").alias("label")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return sharding.number(placed).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.collapse(docs).withColumn("best", periodic.strongest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(periodic.written(F.col("runs")), 256).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_ngram_join": op2_ngram_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}