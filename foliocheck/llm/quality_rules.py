"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger holds the measurements and one bit per failed rule. Policies are versioned masks over
those bits, so a policy can be changed, compared and ablated from the ledger alone, without reading a text again.

Defined cases: null text has no words and fails the base rule; a text without words fails; ties do not arise; repeated rows are judged one
by one; an empty table gives an empty ledger; other columns pass through, those named like a ledger column are replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliocheck.llm.common import BLANKS, let, whole, words

#: Rules in bit order: (name, failure as SQL over the measurements). The first two are the base rules.
RULES = [
    ("too_few_words", "n_words < 50"),
    ("repeats_itself", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 16 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_text_lines"),
]
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    """A document is kept if no bit of `mask` is set."""
    version: str
    mask: int


POLICIES = [Policy("v1", BASE_MASK), Policy("v2", 0b111), Policy("v3", 0b111111)]
CURRENT = POLICIES[-1]


def _covered(starts: Column) -> Column:
    """Words that windows of three starting at the sorted positions cover."""
    return let(starts, lambda p: F.when(F.size(p) == 0, 0).otherwise(3 + F.aggregate(
        F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3))),
        F.lit(0), lambda total, step: total + step)))


def repeat_words(tokens: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the same text.

    Windows are compared by a 64-bit hash. Only texts with an equal pair sort their windows with the positions, so the work stays n log n.
    """
    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(ordered, lambda s: F.sort_array(F.array_distinct(F.flatten(F.zip_with(
            F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_covered(starts))

    def windows(hashes: Column) -> Column:
        n = F.size(hashes) - 2
        return F.zip_with(F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b)),
                          F.slice(hashes, 3, n), lambda ab, c: F.xxhash64(ab, c))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < 4, 0).otherwise(let(hashed, lambda h: let(windows(h), covered)))


def ledger(docs: DataFrame) -> DataFrame:
    """`docs` with the measurements and `failed_bits`, one bit per rule of RULES."""
    text = whole("text")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words", "failed_bits"]
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    measured = docs.select(
        *[c for c in docs.columns if c not in measures],
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("__llm_w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("__llm_l"))
    measured = measured.select(
        *[c for c in measured.columns if not c.startswith("__llm_")],
        F.col("__llm_w.n").cast("long").alias("n_words"), F.col("__llm_w.r").cast("long").alias("n_repeat_words"),
        F.col("__llm_l.n").cast("long").alias("n_text_lines"), F.col("__llm_l.d").cast("long").alias("n_dup_lines"))
    bits = F.lit(0).cast("long")
    for bit, (_, failure) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failure), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with `policy`, `base_failed` and `kept`. The base rules hold under every policy."""
    failed = F.col("failed_bits")
    return (book.withColumn("policy", F.lit(policy.version))
            .withColumn("base_failed", failed.bitwiseAND(F.lit(BASE_MASK)) != 0)
            .withColumn("kept", failed.bitwiseAND(F.lit(policy.mask | BASE_MASK)) == 0))


def ablation(spark: SparkSession, book: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only this rule keeps out.

    The ledger is first counted per bit pattern (at most 2 ** rules rows), and only the patterns meet policies and rules.
    """
    patterns = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    versions = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask | BASE_MASK).cast("long").alias("mask"))
                         for p in policies or POLICIES])
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, (name, _) in enumerate(RULES)])
    each = patterns.select("failed_bits", "n", F.explode(versions).alias("p")).select("*", F.explode(rules).alias("r"))
    hit = F.col("failed_bits").bitwiseAND(F.col("p.mask"))
    return (each.filter(F.col("r.bit").bitwiseAND(F.col("p.mask")) != 0).groupBy("p.policy", "r.rule")
            .agg(F.sum(F.when(hit.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(hit == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only")))
