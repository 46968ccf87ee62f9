"""Book progress, scores and totals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck import constants as C
from foliocheck.operators import findings as O


def page_counts(pages: DataFrame) -> DataFrame:
    s = F.col("status")
    return pages.groupBy("book_id").agg(
        F.count("*").alias("pages"), F.count_if(s == "done").alias("done"), F.count_if(s == "error").alias("failed"),
        F.count_if(s == "pending").alias("pending"), F.count_if(s == "processing").alias("processing"),
        F.count_if(F.col("evidence_prepared")).alias("indexed"),
        F.min(F.when(s == "processing", F.col("page_number"))).alias("processing_page"))


def book_status(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Status and progress of a book from its pages; human holds and finished books stay as they are."""
    return status_of(books, page_counts(pages))


def status_of(books: DataFrame, counts: DataFrame) -> DataFrame:
    c = books.select("book_id", F.col("status").alias("old_status")).join(counts, "book_id", "left")
    c = c.fillna(0, ["pages", "done", "failed", "pending", "processing", "indexed"])
    derived = (F.when((F.col("pending") == 0) & (F.col("processing") == 0),
                      F.when((F.col("pages") > 0) & (F.col("failed") == F.col("pages")), "error").otherwise("done"))
               .when(F.col("processing") > 0, "processing").otherwise("queued"))
    keep = (F.col("old_status").isin("paused", "context_approval")
            | (F.col("old_status").isin("done", "error") & derived.isin("queued", "processing")))
    return c.select("book_id", "pages", "done", "failed", "pending", "processing", "indexed",
                    F.coalesce(F.col("processing_page").cast("bigint"), F.col("done")).alias("current"),
                    F.when(keep, F.col("old_status")).otherwise(derived).alias("status"))


def finding_stats(findings: DataFrame) -> DataFrame:
    return findings.groupBy("book_id").agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES],
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "dismissed")])


def review_summary(books: DataFrame, pages: DataFrame, view: DataFrame) -> DataFrame:
    """One row per book: severities after mapping, pages reviewed, whether it may go to print."""
    warned = F.col("warning") != ""
    p = pages.groupBy("book_id").agg(
        F.count_if(F.col("status") == "done").alias("pages_reviewed"), F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if((F.col("status") != "done") | warned).alias("visual_pending"),
        F.bool_and(~warned & F.col("coverage_complete")).alias("all_clean"))
    subjects = pages.filter("subject_key <> ''").groupBy("book_id", "subject_key").agg(F.min("page_number").alias("first"))
    f = view.groupBy("book_id").agg(F.count("*").alias("issue_count"), *[
        F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])
    return summary_of(books, p, subjects, f)


def summary_of(books: DataFrame, p: DataFrame, subjects: DataFrame, f: DataFrame) -> DataFrame:
    """The summary from counts of pages and findings per book and the first page of each subject."""
    subjects = (subjects.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("first", "subject_key"))).alias("s"))
                .select("book_id", F.array_join(F.transform("s", lambda x: x["subject_key"]), ", ").alias("subjects")))
    out = (books.select("book_id", "status", "page_count").join(p, "book_id", "left").join(f, "book_id", "left")
           .join(subjects, "book_id", "left")
           .fillna(0, ["pages_reviewed", "failed", "visual_pending", "issue_count", "critical", "high", "medium", "low"]))
    success = (F.col("status") == "done") & (F.col("failed") == 0)
    return out.select(
        "book_id", success.alias("success"), "pages_reviewed", F.col("page_count").alias("pages_expected"), "visual_pending",
        "issue_count", (success & (F.col("issue_count") == 0) & F.coalesce("all_clean", F.lit(True))).alias("print_ready"),
        "critical", "high", "medium", "low", F.coalesce("subjects", F.lit("GENERAL")).alias("subjects"))


def score_bucket(category: Column) -> Column:
    low, out = F.lower(F.coalesce(category, F.lit(""))), F.lit(C.SCORE_DEFAULT)
    for name, parts in reversed(C.SCORE_BUCKETS):
        out = F.when(O._contains_any(low, parts), name).otherwise(out)
    return out


def category_scores(books: DataFrame, view: DataFrame) -> DataFrame:
    """Four scores per book: 100 less 4 per open finding, never below 0."""
    n = (view.filter("NOT resolved AND NOT ignored").groupBy("book_id", score_bucket(F.col("category")).alias("bucket"))
         .agg(F.count("*").alias("n")))
    return scores_of(books, n)


def scores_of(books: DataFrame, n: DataFrame) -> DataFrame:
    """Scores from the open findings `n` of each book and bucket."""
    buckets = [b for b, _ in C.SCORE_BUCKETS] + [C.SCORE_DEFAULT]
    grid = books.select("book_id", F.explode(F.array(*[F.lit(b) for b in buckets])).alias("bucket"))
    n0 = F.coalesce("n", F.lit(0))
    return grid.join(n, ["book_id", "bucket"], "left").select(
        "book_id", "bucket", n0.alias("open_findings"), F.greatest(F.lit(0), 100 - n0 * 4).cast("bigint").alias("score"))


def progress(books: DataFrame, pages: DataFrame) -> DataFrame:
    return progress_of(books, page_counts(pages))


def progress_of(books: DataFrame, counts: DataFrame) -> DataFrame:
    c = books.select("book_id", F.col("page_count").alias("expected")).join(counts, "book_id", "left")
    done, failed = F.coalesce("done", F.lit(0)), F.coalesce("failed", F.lit(0))
    pct = F.when(F.col("expected") > 0, F.least(F.lit(100), F.floor((done + failed) / F.col("expected") * 100 + 0.5))).otherwise(0)
    out = c.select("book_id", "expected", done.alias("done"), pct.cast("bigint").alias("progress"))
    left = F.greatest(F.lit(0), F.col("expected") - F.col("done"))
    return out.withColumn("eta_seconds", F.when((F.col("progress") == 0) | (F.col("expected") == 0), 30)
                          .when(F.col("progress") < 100, F.greatest(F.lit(2), left * 3)).otherwise(0).cast("bigint"))


def resolution_progress(view: DataFrame, marks: DataFrame) -> DataFrame:
    m = marks.groupBy("book_id").agg(F.count("*").alias("marks"))
    f = view.groupBy("book_id").agg(F.count_if(F.col("resolved") | F.col("ignored")).alias("handled"), F.count("*").alias("findings"))
    out = f.join(m, "book_id", "full").fillna(0, ["handled", "findings", "marks"])
    return out.select("book_id", (F.col("handled") + F.col("marks")).alias("handled"),
                      (F.col("findings") + F.col("marks")).alias("total"))


def open_findings_per_page(pages: DataFrame, view: DataFrame) -> DataFrame:
    """Open findings of every page, pages without findings included, with the book total."""
    n = view.groupBy("book_id", "page_number").agg(F.count_if(~F.col("resolved") & ~F.col("ignored")).alias("open_findings"))
    out = pages.select("book_id", "page_number").join(n, ["book_id", "page_number"], "left").fillna(0, ["open_findings"])
    return out.withColumn("book_total", F.sum("open_findings").over(W.partitionBy("book_id")))


def scorecard(books: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per book with its four scores side by side."""
    wide = wide_scores(category_scores(books, O.review_view(findings)))
    return wide.join(finding_stats(findings), "book_id", "left").fillna(0, ["findings", *C.SEVERITIES, "accepted", "dismissed"])


def wide_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("book_id").agg(*[
        F.max(F.when(F.col("bucket") == b, F.col("score"))).alias(a) for b, a in
        (("Syntax Health", "syntax"), ("Curriculum Alignment", "curriculum"), ("Fact Accuracy", "facts"),
         ("Style & Consistency", "style"))])
