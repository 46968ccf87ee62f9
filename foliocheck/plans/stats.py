"""Queries of exports, predicates, totals and work state."""
from pyspark.sql import functions as F

from foliocheck.functions import geometry as G, text as T
from foliocheck.operators import findings as O, queue_state as Q, rules, stats as S
from foliocheck.sources import corpus, findings as FS, sinks


def view(spark, d):
    return O.review_view(FS.findings(spark, d))


def pages(spark, d):
    return corpus.pages(spark, d, text=False)


def a5(spark, d):
    snap = sinks.book_snapshot(corpus.books(spark, d), pages(spark, d), FS.findings(spark, d))
    line = F.transform("pages", lambda p: F.concat_ws(":", p["page_number"].cast("string"), p["status"], F.concat_ws(
        ",", F.transform(p["findings"], lambda f: f["type"]))))
    return snap.select("book_id", "title", F.size("pages").cast("bigint").alias("pages"), F.array_join(line, ";").alias("content"))


def a6(spark, d):
    e = sinks.export_findings(FS.findings(spark, d))
    cols = [F.col(c) for c in ("page", "type", "severity", "found", "suggestion", "why", "status")]
    return e.select("book_id", "seq", "page", "confidence", sinks.csv_line(*cols).alias("line"))


def a7(spark, d):
    return sinks.export_review_csv(view(spark, d))


def a8(spark, d):
    return sinks.annotation_sheet(view(spark, d), corpus.marks(spark, d))


def c1(spark, d):
    p = corpus.pages(spark, d).select("book_id", "page_number", T.letters(F.col("text")).cast("bigint").alias("letters"), F.size(
        F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("bigint").alias("words"))
    return p.withColumn("native", T.has_native_evidence(F.col("letters"), F.col("words")))


def c2(spark, d):
    return FS.findings(spark, d).select("uid", O.is_grounded().alias("verified"))


def c4(spark, d):
    return FS.findings(spark, d).filter(G.usable()).select("uid", "xmin", "ymin", "xmax", "ymax")


def c5(spark, d):
    return O.visible_overlays(view(spark, d)).select("uid", "page_number", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def c6(spark, d):
    return (pages(spark, d).filter("warning <> ''").filter(O.important_warning(F.col("warning")))
            .select("book_id", "page_number", "warning"))


def c7(spark, d):
    return FS.findings(spark, d).select("uid", O.is_textual().alias("textual"), O.can_repeat().alias("repeatable"))


def c8(spark, d):
    return FS.findings(spark, d).select("uid", O.pending_verification().alias("pending"))


def c10(spark, d):
    return corpus.pages(spark, d).select("book_id", "page_number", T.is_contents_page(F.col("text")).alias("heading"),
                                         T.is_contents_page(F.col("text"), "printed").alias("printed"))


def c11(spark, d):
    return corpus.pages(spark, d).select("book_id", "page_number", T.is_indexed(F.col("evidence_indexed"), F.col("text")).alias("indexed"))


def book_scorecard(spark, d):
    return S.scorecard(corpus.books(spark, d), pages(spark, d), FS.findings(spark, d))


def w5(spark, d):
    return Q.failure_streaks(corpus.attempts(spark, d)).select(
        "event_id", "book_id", "failed", F.col("streak").cast("bigint").alias("streak"), "pause")


def w6(spark, d):
    return Q.fair_batch(corpus.books(spark, d), pages(spark, d))


def w7(spark, d):
    r = Q.last_n(corpus.messages(spark, d))
    return r.select("conv_id", "turn", "role", "from_end", (F.col("from_end") <= 30).alias("shown"), (F.col("from_end") <= 16).alias("in_context"))


def j20(spark, d):
    return Q.runnable_books(corpus.books(spark, d), pages(spark, d)).select("book_id", "status")


def s8(spark, d):
    return Q.approval_gate(corpus.books(spark, d), pages(spark, d))


def s4(spark, d):
    a = corpus.attempts(spark, d)
    beats = a.groupBy("book_id", "page_number").agg(F.max(F.when(F.col("event_id") % 7 != 0, F.col("heartbeat_at"))).alias("heartbeat_at"),
                                                    F.min("heartbeat_at").alias("updated_at"))
    running = pages(spark, d).filter("doc_id % 3 <> 0").withColumn("status", F.lit("processing")).select("book_id", "page_number", "status")
    rows = running.join(beats, ["book_id", "page_number"])
    return Q.stale_attempts(rows, F.expr("timestamp '2024-01-15 00:00:00'")).select("book_id", "page_number", "new_status")


def s7(spark, d):
    r = corpus.table(spark, d, "events").selectExpr(
        "event_id AS request_id", "CASE event_type WHEN 'view' THEN 'reanalyze' WHEN 'click' THEN 'reanalyze' WHEN 'signup' THEN 'resume' "
        "WHEN 'purchase' THEN 'pause' END AS kind",
        "concat('book-', lpad(CAST(event_id div 500 AS STRING), 12, '0')) AS book_id",
        "CAST(CASE WHEN event_type IN ('view', 'click') THEN event_id % 55 + 1 END AS INT) AS page_number").filter("kind IS NOT NULL")
    return Q.apply_requests(pages(spark, d), r)


QUERIES = {
    "a5_book_snapshot": a5, "a6_export_findings": a6, "a7_export_review_csv": a7, "a8_annotation_sheet": a8,
    "c1_has_native_evidence": c1, "c2_partition_grounded": c2, "c4_usable_box": c4, "c5_visible_overlays": c5,
    "c6_important_warnings": c6, "c7_textual_repeatable": c7, "c8_pending_verification": c8, "c10_contents_page": c10,
    "c11_is_indexed": c11,
    "f1_book_status": lambda s, d: S.book_status(corpus.books(s, d), pages(s, d)),
    "f2_finding_stats": lambda s, d: S.finding_stats(FS.findings(s, d)),
    "f3_review_summary": lambda s, d: S.review_summary(corpus.books(s, d), pages(s, d), view(s, d)),
    "f4_category_scores": lambda s, d: S.category_scores(corpus.books(s, d), view(s, d)),
    "f5_progress": lambda s, d: S.progress(corpus.books(s, d), pages(s, d)),
    "f15_resolution_progress": lambda s, d: S.resolution_progress(view(s, d), corpus.marks(s, d)),
    "f17_open_findings_per_page": lambda s, d: S.open_findings_per_page(pages(s, d), view(s, d)),
    "w5_failure_streaks": w5, "w6_fair_batch": w6, "w7_last_n": w7, "j20_runnable_books": j20,
    "s4_stale_attempts": s4, "s7_apply_requests": s7, "s8_approval_gate": s8,
    "scorecard": book_scorecard,
}
