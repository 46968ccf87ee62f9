"""Rules over work state: batches, failures, stale claims, requests, approval."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliocheck import constants as C
from foliocheck.operators import findings as O


def failure_streaks(attempts: DataFrame, limit: int = C.FAILURES_BEFORE_PAUSE) -> DataFrame:
    """Consecutive failures of a book after each attempt and whether the book must pause.

    A book has one attempt series per page and run, so it is a bounded group.
    """
    limit = min(10, max(1, limit))
    order = W.partitionBy("book_id").orderBy("heartbeat_at", "event_id")
    a = attempts.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    a = a.withColumn("streak", F.when(F.col("failed"), F.sum(F.col("failed").cast("int")).over(
        W.partitionBy("book_id", "island").orderBy("heartbeat_at", "event_id")
        .rowsBetween(W.unboundedPreceding, W.currentRow))).otherwise(0))
    a = O.classify_error(a)
    return a.withColumn("pause", F.col("failed") & (F.coalesce("fatal_auth", F.lit(False)) | (F.col("streak") >= limit)))


def book_flags(books: DataFrame, pages: DataFrame) -> DataFrame:
    pending, running = F.col("p.status") == "pending", F.col("p.status") == "processing"
    unprepared = ~F.col("p.evidence_prepared")
    g = pages.alias("p").groupBy("book_id").agg(
        F.bool_or(pending).alias("has_pending"), F.bool_or(pending & unprepared).alias("needs_evidence"),
        F.bool_or(running & unprepared).alias("running_unprepared"),
        F.bool_and(F.col("p.evidence_prepared")).alias("all_prepared"))
    return (books.select("book_id", "status", "approved").join(g, "book_id")
            .withColumn("preparing", ~F.col("needs_evidence") & F.col("running_unprepared")))


def runnable_books(books: DataFrame, pages: DataFrame) -> DataFrame:
    return (books.filter(F.col("status").isin("queued", "processing"))
            .join(pages.filter("status = 'pending'").select("book_id"), "book_id", "left_semi"))


def fair_batch(books: DataFrame, pages: DataFrame, n: int = 8) -> DataFrame:
    """Up to `n` pages, one per book in turn, lowest page first.

    Books with unprepared pages give those first; a fully prepared book waits for running
    preparations and for its approval. Ties between books follow a hash of the book.
    """
    n = min(8, max(1, n))
    f = book_flags(books, pages).filter(F.col("status").isin("queued", "processing") & F.col("has_pending"))
    f = f.filter("needs_evidence OR (NOT preparing AND approved)").select("book_id", "needs_evidence")
    c = (pages.filter("status = 'pending'").select("book_id", "page_number", "evidence_prepared").join(f, "book_id")
         .filter("NOT needs_evidence OR NOT evidence_prepared"))
    turn = F.row_number().over(W.partitionBy("book_id").orderBy("page_number"))
    return (c.withColumn("turn", turn).filter(F.col("turn") <= n)
            .orderBy("turn", F.md5("book_id")).limit(n).select("book_id", "page_number", "turn"))


def approval_gate(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Status of each book after the approval rule: a prepared, unapproved book waits for a human."""
    f = book_flags(books, pages)
    active = F.col("status").isin("queued", "processing") & F.col("has_pending")
    waits = active & ~F.col("needs_evidence") & ~F.col("preparing") & ~F.col("approved")
    back = (F.col("status") == "context_approval") & F.col("approved")
    return f.select("book_id", F.col("status").alias("old_status"),
                    F.when(waits, "context_approval").when(back, "queued").otherwise(F.col("status")).alias("status"),
                    waits.alias("gated"))


def stale_attempts(heartbeats: DataFrame, now: Column, cutoff_minutes: int = 15) -> DataFrame:
    """Running pages without a recent heartbeat (or update, if none was ever sent) become pending."""
    cutoff = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(max(15, cutoff_minutes)), F.lit(0.0))
    seen = F.coalesce("heartbeat_at", "updated_at")
    return heartbeats.filter((F.col("status") == "processing") & (seen < cutoff)).withColumn("new_status", F.lit("pending"))


def apply_requests(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of reanalyse, resume and pause requests as one row per request and page.

    `requests`: request_id, kind, book_id, page_number (null for resume and pause).
    """
    p = pages.select("book_id", "page_number", F.col("status").alias("page_status"))
    again = requests.filter("kind = 'reanalyze'")
    # The first request of a page queues it; a later one then meets a queued page.
    first = again.groupBy("book_id", "page_number").agg(F.min("request_id").alias("first_id"))
    one = (again.join(first, ["book_id", "page_number"], "left").join(p, ["book_id", "page_number"], "left")
           .withColumn("outcome", F.when(F.col("page_status").isNull(), "missing")
                       .when(F.col("page_status").isin("done", "error") & (F.col("request_id") == F.col("first_id")), "pending")
                       .otherwise("conflict")))
    # Resuming twice finds no failed page the second time, so the first request of a book counts.
    resumed = (requests.filter("kind = 'resume'").groupBy("book_id", "kind").agg(F.min("request_id").alias("request_id"))
               .join(p.filter("page_status = 'error'"), "book_id").withColumn("outcome", F.lit("pending")))
    paused = (requests.filter("kind = 'pause'").withColumn("page_status", F.lit(None).cast("string"))
              .withColumn("outcome", F.lit("paused")))
    cols = ["request_id", "kind", "book_id", "page_number", "page_status", "outcome"]
    return one.select(cols).unionByName(resumed.select(cols)).unionByName(paused.select(cols))


def last_n(messages: DataFrame, n: int = 100) -> DataFrame:
    """The newest `n` messages of each conversation with their rank from the end.

    The rank filter is applied inside each input partition before rows are exchanged.
    """
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return messages.withColumn("from_end", rank).filter(F.col("from_end") <= n)
