"""Lines that many documents share are kept in one of them only.

Lines are exploded under a normalised key, the key is hashed, distinct documents are counted per hash, and the lines over the threshold are
dropped from every document but the one with the largest id. Only hashes, ids and line numbers are shuffled for that; each text meets the
numbers of its dropped lines once and is put together again by position.

Defined cases: null text is one empty line; a null doc_id counts as one document and never keeps a line that a known one holds; rows that
repeat a doc_id are one document, each row being rewritten by itself; an empty table gives no rows; other columns pass through, those
named like an added column are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliocheck.llm.common import BLANKS, ascii_lower, let, whole

MIN_CHARS = 40
MIN_DOCS = 5


def _keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(every long line as doc_id, text_hash, pos, h1, h2; the keys found in `min_docs` documents or more with the document that keeps them)."""
    lines = (docs.select("doc_id", F.xxhash64(whole("text")).alias("text_hash"), F.posexplode(_keys(whole("text"))).alias("pos", "key"))
             .filter(F.char_length("key") >= min_chars)
             .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")))
    # One row per (key, document) first, so that a line found everywhere is summed by many tasks before its counts meet.
    frequent = (lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
                .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
                .filter(F.col("n_docs") >= min_docs))
    return lines, frequent


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with `text` rewritten, `n_lines` before dropping and `n_dropped`."""
    lines, frequent = shared_lines(docs, min_chars, min_docs)
    dropped = (lines.join(frequent, ["h1", "h2"])
               .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
               .groupBy(F.col("doc_id").alias("__llm_doc"), F.col("text_hash").alias("__llm_hash")).agg(F.collect_set("pos").alias("__llm_drop")))
    text = whole("text")
    n_lines = F.size(F.split(text, "\n"))
    kept = let(F.split(text, "\n"), lambda rows: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), F.col("__llm_drop")), lambda i: F.get(rows, i)), "\n"))
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__llm_doc")) & (F.xxhash64(text) == F.col("__llm_hash")), "left")
    return joined.select(*[c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
                         F.when(F.col("__llm_drop").isNull(), text).otherwise(kept).alias("text"),
                         n_lines.cast("long").alias("n_lines"),
                         F.coalesce(F.size("__llm_drop"), F.lit(0)).cast("long").alias("n_dropped"))
