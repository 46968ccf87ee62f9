"""Intake of uploaded files: manifest checks, part assembly, page expansion, key checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliocheck import constants as C
from foliocheck.functions import text as T


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of real files: only name, size and the first five bytes are kept."""
    return (spark.read.format("binaryFile").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"),
                    F.substring(F.col("content"), 1, 5).cast("string").alias("magic")))


def valid_key(col: Column) -> Column:
    return (F.length(col) <= 300) & col.rlike(C.P_UPLOAD_KEY) & ~col.contains("..")


def valid_parts(col: Column) -> Column:
    return col.between(1, C.MAX_PDF_PARTS)


def intake_manifest(files: DataFrame) -> DataFrame:
    """Adds `ok` and the first failing check of each file as `reason`."""
    reason = (F.when(~F.lower("file_name").endswith(".pdf"), "name")
              .when(F.col("size") <= 0, "empty").when(F.col("size") > C.MAX_PDF_BYTES, "too large")
              .when(~valid_key(F.col("object_key")), "key").when(~valid_parts(F.col("parts")), "parts")
              .when(F.col("magic") != "%PDF-", "magic"))
    return files.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def assemble_parts(parts: DataFrame) -> DataFrame:
    """Bodies in part order; a file with a missing part keeps its counts but no body.

    A file has at most 64 parts, so one file is a bounded group.
    """
    g = parts.groupBy("page_id").agg(
        F.max("declared").alias("declared"), F.count("*").alias("received"), F.max("idx").alias("last"),
        F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("p"))
    complete = (F.col("received") == F.col("declared")) & (F.col("last") + 1 == F.col("declared"))
    return g.select("page_id", "declared", "received", complete.alias("complete"),
                    F.when(complete, F.array_join(F.transform("p", lambda x: x["body"]), "")).alias("body"))


def expand_pages(books: DataFrame) -> DataFrame:
    """One pending page per page number."""
    return (books.filter("page_count >= 1")
            .select("book_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
            .withColumn("status", F.lit("pending")))


def check_keys(rows: DataFrame) -> DataFrame:
    """Validity of identifiers: 24 hex digits, page from 1, upload key, part count."""
    return rows.select(
        "page_id", F.col("hex_id").rlike(r"(?i)^[a-f0-9]{24}$").alias("id_ok"), (F.col("page") >= 1).alias("page_ok"),
        valid_key(F.col("object_key")).alias("key_ok"), valid_parts(F.col("parts")).alias("parts_ok"))


def book_defaults(rows: DataFrame) -> DataFrame:
    """Trimmed and bounded book fields; unknown languages and kinds become the default."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))
    name = text("original_name")
    title = T.strip(F.coalesce(F.when(text("title") != "", F.col("title")), F.regexp_replace(name, r"(?i)\.pdf$", "")))
    lang, kind = F.lower(text("language")), F.lower(text("book_type"))
    return rows.select(
        "page_id", F.substring(F.when(title == "", "Untitled proofread").otherwise(title), 1, 180).alias("title"),
        F.substring(name, 1, 220).alias("original_name"),
        F.substring(T.strip(text("class_level")), 1, 80).alias("class_level"),
        F.substring(T.strip(text("subject")), 1, 100).alias("subject"),
        F.when(lang.isin(C.LANGUAGES), lang).otherwise("auto").alias("language"),
        F.when(kind.isin(C.BOOK_TYPES), kind).otherwise("textbook").alias("book_type"))


def compile_instructions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Short, deduplicated instruction text of `raw`, with the number of parts left out.

    Works inside each row: the parts of one text never leave it.
    """
    clean = F.regexp_replace(F.coalesce("raw", F.lit("")), r"[\x00-\x1F]", " ")
    parts = F.filter(F.transform(F.split(clean, r"(?<=[.!?])\s+"), lambda p: T.strip(p)), lambda p: p != "")

    def key(p: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " "))

    def built_in(p: Column) -> Column:
        out = F.lit(False)
        for pattern in C.BUILT_IN_INSTRUCTIONS:
            out = out | p.rlike("(?i)" + pattern)
        return out
    # Position of the first part with the same key decides; built-in parts never count as first.
    keyed = F.transform("parts", lambda p: F.struct(p.alias("p"), F.when(~built_in(p), key(p)).otherwise("").alias("k")))
    rows = rows.select(*keys, parts.alias("parts")).select(*keys, "parts", keyed.alias("keyed"))
    rows = rows.select(*keys, "parts", "keyed", F.transform("keyed", lambda x: x["k"]).alias("ks"))
    first = F.filter(F.arrays_zip("keyed", F.sequence(F.lit(1), F.size("keyed")).alias("i")),
                     lambda z: (z["keyed"]["k"] != "") & (F.array_position(F.col("ks"), z["keyed"]["k"]) == z["i"]))
    kept = F.transform(first, lambda z: F.substring(z["keyed"]["p"], 1, 500))
    rows = rows.select(*keys, F.size("parts").alias("n"), F.when(F.size("keyed") > 0, kept)
                       .otherwise(F.array().cast("array<string>")).alias("kept"))
    return rows.select(*keys, F.substring(F.array_join("kept", "\n"), 1, 2000).alias("text"),
                       (F.col("n") - F.size("kept")).cast("bigint").alias("ignored"))
