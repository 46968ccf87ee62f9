"""Exports of findings as tables and files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck.functions import text as T

EXPORT_COLUMNS = ["Page", "Type", "Severity", "Found", "Suggestion", "Why", "Confidence", "Status"]
REVIEW_COLUMNS = ["ID", "Category", "Type", "Severity", "Original Text", "Suggested Text", "Explanation", "Page", "Status"]
EXPORT_STATUSES = ["all", "open", "accepted", "dismissed", "fixed"]


def export_findings(findings: DataFrame, status: str = "accepted") -> DataFrame:
    if status not in EXPORT_STATUSES:
        raise ValueError(f"Invalid export status: {status}")
    rows = findings if status == "all" else findings.filter(F.col("status") == status)
    return rows.select("book_id", "seq", F.col("page_number").alias("page"), "type", "severity", F.col("quote").alias("found"),
                       "suggestion", F.col("explanation").alias("why"), "confidence", "status")


def csv_line(*cols: Column) -> Column:
    """One CSV line, every value quoted, quotes doubled."""
    def field(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[field(c) for c in cols])


def write_export(findings: DataFrame, path: str, status: str = "accepted", fmt: str = "csv") -> None:
    """One folder of files per book, pages in order inside a book. CSV files carry a UTF-8 mark."""
    rows = export_findings(findings, status)
    if fmt == "json":
        rows.drop("seq").write.mode("overwrite").partitionBy("book_id").json(path)
        return
    out = rows.repartition("book_id").sortWithinPartitions("book_id", "page", "seq")
    named = out.select("book_id", *[F.col(c).alias(n) for c, n in zip(
        ["page", "type", "severity", "found", "suggestion", "why", "confidence", "status"], EXPORT_COLUMNS)])
    # The header's first name carries the byte order mark that spreadsheet programs look for.
    named = named.withColumnRenamed("Page", "﻿Page")
    (named.write.mode("overwrite").partitionBy("book_id")
     .option("header", True).option("quoteAll", True).option("escape", '"').csv(path))


def export_review_csv(view: DataFrame) -> DataFrame:
    """The reviewer's nine columns; `id` is the number shown beside the finding."""
    order = W.partitionBy("book_id").orderBy("page_number", "seq", "uid")
    state = F.when(F.col("resolved"), "Resolved").when(F.col("ignored"), "Ignored").otherwise("Pending")
    return view.select("book_id", F.row_number().over(order).alias("id"), "category", "type", "severity",
                       F.col("quote").alias("original_text"), F.col("suggestion").alias("suggested_text"), "explanation",
                       F.coalesce("page_number", F.lit(1)).alias("page"), state.alias("status"))


def annotation_sheet(view: DataFrame, marks: DataFrame) -> DataFrame:
    """Printed notes of each page from top to bottom: open and resolved findings plus manual marks."""
    ids = W.partitionBy("book_id").orderBy("page_number", "seq", "uid")
    mark_ids = W.partitionBy("book_id").orderBy("doc_id")

    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + " "), value))
    notes = (view.withColumn("id", F.row_number().over(ids)).filter("NOT ignored").select(
        "book_id", "page_number", F.lit("ai").alias("kind"), "id", F.col("y").alias("y"),
        F.concat(F.lit("[A"), F.col("id"), F.lit("] "), F.col("category")).alias("label"),
        T.ascii_fold(F.concat_ws(" | ", part("Found:", F.concat(F.lit('"'), F.col("quote"), F.lit('"'))),
                                 part("Fix:", F.col("suggestion")), part("Why:", F.col("explanation")))).alias("body")))
    title = F.when(F.col("mark_type") == "highlight", "Text Highlight").otherwise(F.concat("mark_type", F.lit(" Mark")))
    manual = marks.withColumn("id", F.row_number().over(mark_ids)).select(
        "book_id", F.col("page").alias("page_number"), F.col("mark_type").alias("kind"), "id", F.col("my").alias("y"),
        F.concat(F.lit("[M"), F.col("id"), F.lit("] "), title).alias("label"),
        T.ascii_fold(F.coalesce(part("Note:", F.col("comment")), F.lit(""))).alias("body"))
    rows = notes.unionByName(manual)
    first = F.when(F.col("kind") == "ai", 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("book_id", "page_number").orderBy(F.coalesce("y", F.lit(0.0)), first, "id"))
    return rows.select("book_id", "page_number", place.alias("place"), "label", "body")


def book_snapshot(books: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per book with its pages in order, each with its findings in order."""
    f = findings.groupBy("book_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(
        "seq", "uid", "type", "severity", "quote", "suggestion", "status"))).alias("findings"))
    p = pages.select("book_id", "page_number", "status", "tokens_used", "warning").join(f, ["book_id", "page_number"], "left")
    g = p.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(
        "page_number", "status", "tokens_used", "warning",
        F.coalesce("findings", F.array().cast("array<struct<seq:bigint,uid:string,type:string,severity:string,quote:string,suggestion:string,status:string>>")
                   ).alias("findings")))).alias("pages"))
    return books.select("book_id", "title", "status", "page_count", "language", "book_type").join(g, "book_id", "left")
