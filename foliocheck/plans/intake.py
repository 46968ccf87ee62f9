"""Queries of intake, exports and single-row checks."""
from pyspark.sql import functions as F

from foliocheck.functions import geometry as G, text as T
from foliocheck.operators import findings as O, marks as M
from foliocheck.sources import corpus, findings as FS, intake, seeds


def a1(spark, d):
    return intake.intake_manifest(corpus.uploads(spark, d)).select("page_id", "ok", "reason")


def a2(spark, d):
    a = intake.assemble_parts(corpus.upload_parts(spark, d))
    return a.select("page_id", "declared", "received", "complete", F.sha2("body", 256).alias("digest"),
                    F.length("body").alias("chars"))


def a3(spark, d):
    return intake.expand_pages(corpus.books(spark, d))


def a4(spark, d):
    return (corpus.books(spark, d).orderBy(F.col("created_s").desc(), "book_id").limit(100)
            .select("book_id", "title", "created_s"))


def b1(spark, d):
    n = O.normalize_findings(corpus.raw_issues(spark, d))
    return n.select("doc_id", "type", "severity", "quote", "suggestion", "explanation", "box_source", "source", "status",
                    "confidence")


def b2(spark, d):
    n = O.normalize_findings(corpus.raw_issues(spark, d)).select("doc_id", "box.*")
    flat = G.clamp(F.col("xmin") - 15, F.col("ymin"), F.col("xmax") + 15, F.col("ymin") + (F.col("doc_id") % 3) * 10)
    return n.select("*", flat.isNotNull().alias("has_area"), flat["xmin"].alias("cut_xmin"), flat["xmax"].alias("cut_xmax"))


def b3(spark, d):
    v = O.review_view(FS.findings(spark, d))
    return v.select("uid", "page_number", "severity", "category", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
                    F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), "resolved", "ignored")


def b5(spark, d):
    return O.classify_error(corpus.errors(spark, d)).select("event_id", "friendly", "fatal_auth", "retryable")


def b6(spark, d):
    return O.rule_tag(O.review_view(FS.findings(spark, d))).select("uid", "rule_tag")


def b7(spark, d):
    p = corpus.pages(spark, d).select("book_id", "page_number", T.location_tokens(F.col("text")).alias("t"))
    return p.select("book_id", "page_number", F.size("t").cast("bigint").alias("tokens"),
                    F.sha2(F.array_join("t", " "), 256).alias("digest"))


def b8(spark, d):
    p = corpus.pages(spark, d)
    return p.select("book_id", "page_number", T.clip(F.col("text"), 200).alias("clipped"), T.slug(F.col("text")).alias("slug"),
                    F.length(T.squash(F.col("text"))).cast("bigint").alias("chars"))


def b9(spark, d):
    f = FS.findings(spark, d)
    return f.select("uid", T.requires_literal_match(F.col("quote"), F.col("suggestion")).alias("literal"))


def b10(spark, d):
    f = FS.findings(spark, d).select("uid", T.clean_text(F.col("quote")).alias("q"), T.clean_text(F.col("suggestion")).alias("s"))
    f = f.select("uid", T.minimal_edit(F.col("q"), F.col("s")).alias("e"))
    return f.select("uid", F.col("e.before").alias("before"), F.col("e.after").alias("after"), F.col("e.start").alias("start"))


def b11(spark, d):
    return intake.compile_instructions(corpus.instructions(spark, d), ["conv_id", "turn"])


def b12(spark, d):
    return M.check_marks(corpus.marks(spark, d), corpus.books(spark, d))


def b13(spark, d):
    rows = corpus.uploads(spark, d).selectExpr(
        "page_id", "object_key", "parts", "page_id % 5 - 1 AS page",
        "CASE WHEN page_id % 8 = 7 THEN 'xyz' ELSE substring(md5(CAST(page_id AS STRING)), 1, 24) END AS hex_id")
    return intake.check_keys(rows)


def b14(spark, d):
    rows = corpus.table(spark, d, "pages").selectExpr(
        "page_id", "url AS original_name", "CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '   ' ELSE html END AS title",
        "concat('  ', substring(html, 1, 120)) AS class_level", "url AS subject",
        "CASE page_id % 4 WHEN 0 THEN 'ENGLISH' WHEN 1 THEN 'klingon' WHEN 2 THEN 'hindi' END AS language",
        "CASE page_id % 3 WHEN 0 THEN 'Story' WHEN 1 THEN 'poem' END AS book_type")
    return intake.book_defaults(rows)


def b15(spark, d):
    f = FS.findings(spark, d)
    return f.select("uid", G.location_phrase(O.is_measured(), *G.box_cols()).alias("location"))


QUERIES = {
    "a1_intake_manifest": a1, "a2_assemble_parts": a2, "a3_expand_pages": a3, "a4_recent_books": a4,
    "b1_normalize_findings": b1, "b2_clamp_box": b2, "b3_review_view": b3, "b5_classify_error": b5, "b6_rule_tag": b6,
    "b7_location_tokens": b7, "b8_clip_slug_squash": b8, "b9_requires_literal_match": b9, "b10_minimal_edit": b10,
    "b11_compile_instructions": b11, "b12_check_marks": b12, "b13_check_keys": b13, "b14_book_defaults": b14,
    "b15_location_phrase": b15,
}
